"""The engine's statements, values in code."""

from __future__ import annotations

import pytest
from pyspark.sql import Row

from quern.engine import Engine, SqlError


@pytest.fixture
def db(spark):
    return Engine(spark)


def rows(db, sql, params=None):
    return [tuple(r) for r in db.query(sql, params).collect()]


def test_basic_table(db):
    db.execute_many("CREATE TABLE users(id INTEGER PRIMARY KEY, name TEXT NOT NULL, age INTEGER CHECK (age >= 0)); INSERT INTO users(name, age) VALUES ('a', 1), ('b', 2)")
    assert rows(db, "SELECT * FROM users ORDER BY id") == [(1, "a", 1), (2, "b", 2)]
    assert db.execute("UPDATE users SET age = age + 1 WHERE name = ?", ["b"]).rows_affected == 1
    assert rows(db, "SELECT changes(), last_insert_rowid(), total_changes()") == [(1, 2, 3)]
    assert db.query_one("SELECT age FROM users WHERE id = ?2", [9, 2]) == Row(age=3)
    assert rows(db, "SELECT rowid, oid FROM users WHERE id = 1") == [(1, 1)]


@pytest.mark.parametrize(
    ("sql", "message"),
    [
        ("INSERT INTO t(a) VALUES (NULL)", "NOT NULL constraint failed: t.a"),
        ("INSERT INTO t(a, u) VALUES ('x', 1)", "UNIQUE constraint failed: t.u"),
        ("INSERT INTO t(a, u) VALUES ('x', 7), ('y', 7)", "UNIQUE constraint failed: t.u"),
        ("INSERT INTO t(a, c) VALUES ('x', -1)", "CHECK constraint failed"),
        ("INSERT INTO t(id, a) VALUES (1, 'x')", "UNIQUE constraint failed: t.id"),
        ("UPDATE t SET u = 2", "UNIQUE constraint failed: t.u"),
        ("INSERT INTO t(g) VALUES (1)", "generated column"),
        ("UPDATE t SET g = 1", "generated column"),
        ("INSERT INTO t(zz) VALUES (1)", "no column named zz"),
        ("SELECT zz FROM t", "no such column: zz"),
        ("SELECT * FROM nope", "no such table: nope"),
        ("SELECT nope(1)", "no such function: NOPE"),
        ("SELECT length()", "wrong number of arguments"),
        ("SELECT FROM t", "syntax error"),
        ("DROP TABLE nope", "no such table: nope"),
        ("CREATE TABLE t(x)", "already exists"),
        ("COMMIT", "no transaction"),
        ("RELEASE nope", "no such savepoint"),
        ("ALTER TABLE t ADD COLUMN n TEXT NOT NULL", "NOT NULL"),
        ("CREATE VIRTUAL TABLE v USING nope", "no such module"),
    ],
)
def test_errors_leave_the_table(db, sql, message):
    db.execute_many("CREATE TABLE t(id INTEGER PRIMARY KEY, a TEXT NOT NULL, u INTEGER UNIQUE, c INTEGER CHECK (c > 0), g INTEGER AS (u * 2)); INSERT INTO t(a, u, c) VALUES ('p', 1, 1), ('q', 5, NULL)")
    with pytest.raises(SqlError, match=message):
        db.sql(sql)
    assert rows(db, "SELECT id, a, u, c, g FROM t ORDER BY id") == [(1, "p", 1, 1, 2), (2, "q", 5, None, 10)]


def test_upsert_repeats_a_key(db):
    db.execute_many("CREATE TABLE c(k TEXT PRIMARY KEY, n INTEGER); INSERT INTO c VALUES ('a', 1)")
    db.execute("INSERT INTO c VALUES ('a', 10), ('b', 5), ('a', 100), ('b', 50) ON CONFLICT(k) DO UPDATE SET n = n + excluded.n")
    assert rows(db, "SELECT k, n FROM c ORDER BY k") == [("a", 111), ("b", 55)]
    assert db.execute("INSERT INTO c VALUES ('a', 0), ('z', 1) ON CONFLICT DO NOTHING").rows_affected == 1


def test_update_from_inventory(db):
    db.execute_many("CREATE TABLE inventory(sku TEXT PRIMARY KEY, qty INTEGER); CREATE TABLE sold(sku TEXT, amount INTEGER); INSERT INTO inventory VALUES ('A', 100), ('B', 50), ('C', 10); INSERT INTO sold VALUES ('A', 30), ('B', 5)")
    db.execute("UPDATE inventory SET qty = qty - sold.amount FROM sold WHERE sold.sku = inventory.sku")
    assert rows(db, "SELECT * FROM inventory ORDER BY sku") == [("A", 70), ("B", 45), ("C", 10)]


def test_foreign_keys(db):
    db.execute_many("CREATE TABLE p(id INTEGER PRIMARY KEY); CREATE TABLE c(id INTEGER PRIMARY KEY, p INTEGER DEFAULT 1 REFERENCES p(id) ON DELETE SET DEFAULT); CREATE TABLE g(id INTEGER PRIMARY KEY, c INTEGER REFERENCES c(id) ON DELETE RESTRICT); INSERT INTO c VALUES (10, 99)")
    assert rows(db, "PRAGMA foreign_keys") == [(0,)]
    db.execute_many("DELETE FROM c; PRAGMA foreign_keys = ON; INSERT INTO p VALUES (1), (2); INSERT INTO c VALUES (10, 2); INSERT INTO g VALUES (5, 10)")
    with pytest.raises(SqlError, match="FOREIGN KEY"):
        db.execute("INSERT INTO c VALUES (11, 3)")
    with pytest.raises(SqlError, match="FOREIGN KEY"):
        db.execute("DELETE FROM c")
    db.execute("DELETE FROM p WHERE id = 2")
    assert rows(db, "SELECT * FROM c") == [(10, 1)]


def test_triggers_run_row_by_row_and_stop(db):
    db.execute_many("CREATE TABLE t(a INTEGER); CREATE TABLE log(s TEXT); CREATE TRIGGER g AFTER INSERT ON t WHEN new.a > 1 BEGIN INSERT INTO log VALUES ('a' || new.a); UPDATE t SET a = a * 10 WHERE a = new.a; END; INSERT INTO t VALUES (1), (2), (3)")
    assert rows(db, "SELECT a FROM t ORDER BY a") == [(1,), (20,), (30,)]
    assert rows(db, "SELECT s FROM log ORDER BY s") == [("a2",), ("a3",)]
    db.execute("DROP TRIGGER g")
    db.execute("CREATE TRIGGER loop AFTER INSERT ON log BEGIN INSERT INTO log VALUES (new.s); END")
    import quern.changes as changes

    saved, changes.TRIGGER_DEPTH = changes.TRIGGER_DEPTH, 3
    try:
        with pytest.raises(SqlError, match="too many levels"):
            db.execute("INSERT INTO log VALUES ('x')")
    finally:
        changes.TRIGGER_DEPTH = saved
    assert db.query("SELECT * FROM log").count() == 2


def test_transactions_hold_definitions_too(db):
    db.execute_many("CREATE TABLE a(x INTEGER); BEGIN; CREATE TABLE b(x INTEGER); INSERT INTO a VALUES (1); ROLLBACK")
    assert rows(db, "SELECT COUNT(*) FROM a") == [(0,)]
    with pytest.raises(SqlError, match="no such table"):
        db.query("SELECT * FROM b")
    db.execute("BEGIN")
    with pytest.raises(SqlError, match="within a transaction"):
        db.execute("BEGIN")
    with pytest.raises(SqlError, match="VACUUM"):
        db.execute("VACUUM")


def test_reopen(spark, tmp_path):
    path = f"file://{tmp_path}/db"
    first = Engine(spark, path)
    first.execute_many("CREATE TABLE t(id INTEGER PRIMARY KEY AUTOINCREMENT, a TEXT DEFAULT 'x'); INSERT INTO t DEFAULT VALUES; INSERT INTO t DEFAULT VALUES; DELETE FROM t WHERE id = 2; CREATE VIEW v AS SELECT a FROM t; CREATE VIRTUAL TABLE d USING fts5(body); INSERT INTO d VALUES ('quick fox'); PRAGMA user_version = 7")
    first.execute("ALTER TABLE t ADD COLUMN b INTEGER DEFAULT 4")
    again = Engine(spark, path)
    again.execute("INSERT INTO t(a) VALUES ('y')")
    assert rows(again, "SELECT id, a, b FROM t ORDER BY id") == [(1, "x", 4), (3, "y", 4)]
    assert rows(again, "SELECT body FROM d WHERE d MATCH 'fox'") == [("quick fox",)] and rows(again, "PRAGMA user_version") == [(7,)]
    main = Engine(spark)
    main.execute("ATTACH DATABASE ? AS other", [path])
    assert rows(main, "SELECT COUNT(*) FROM other.t") == [(2,)]
    assert [r[1] for r in rows(main, "PRAGMA database_list")] == ["main", "other"]
    main.execute("DETACH other")
    with pytest.raises(SqlError):
        main.query("SELECT * FROM other.t")


def test_export_and_import(spark, db, tmp_path):
    db.execute_many("CREATE TABLE t(id INTEGER PRIMARY KEY, a TEXT); INSERT INTO t(a) VALUES ('x'), ('y')")
    db.export(f"file://{tmp_path}")
    other = Engine(spark)
    other.import_tables(f"file://{tmp_path}", "t")
    other.execute("UPDATE t SET a = a || '!' WHERE id = 2")
    assert rows(other, "SELECT id, a FROM t ORDER BY id") == [(1, "x"), (2, "y!")]


def test_layers_are_compacted(db):
    db.execute("CREATE TABLE t(a INTEGER)")
    for k in range(10):
        db.execute(f"INSERT INTO t VALUES ({k})")
    db.execute("DELETE FROM t WHERE a % 2 = 0")
    assert len(db.table("t").layers) <= 9
    db.execute("VACUUM")
    assert len(db.table("t").layers) == 1 and rows(db, "SELECT SUM(a) FROM t") == [(25,)]


def test_small_layers_are_merged_and_large_ones_stay(db, monkeypatch):
    import quern.engine as engine

    monkeypatch.setattr(engine, "SMALL_LAYER", 1)
    db.execute_many("CREATE TABLE t(id INTEGER PRIMARY KEY, a INTEGER); INSERT INTO t SELECT value, value * 7919 % 100003 FROM generate_series(1, 200000)")
    large = db.table("t").layers[0]
    for k in range(12):
        db.execute(f"UPDATE t SET a = -{k} WHERE id = {k % 5 + 1}")
        db.execute(f"DELETE FROM t WHERE id = {k + 100}")
        db.execute(f"INSERT INTO t VALUES ({k + 100}, {k})")
    assert db.table("t").layers[0] is large and len(db.table("t").layers) <= 9
    assert rows(db, "SELECT COUNT(*), SUM(a < 0 OR id BETWEEN 100 AND 111 AND a = id - 100) FROM t") == [(200000, 17)]
    assert rows(db, "SELECT id, a FROM t WHERE id <= 5 ORDER BY id") == [(1, -10), (2, -11), (3, -7), (4, -8), (5, -9)]


def test_two_connections(spark, tmp_path):
    path = f"file://{tmp_path}/db"
    first = Engine(spark, path)
    first.execute("CREATE TABLE t(a INTEGER)")
    second = Engine(spark, path)
    first.execute("INSERT INTO t VALUES (1)")
    with pytest.raises(SqlError, match="locked"):
        second.execute("INSERT INTO t VALUES (2)")
    assert rows(second, "SELECT a FROM t") == [(1,)]
    second.execute("INSERT INTO t VALUES (2)")
    with pytest.raises(SqlError, match="locked"):
        first.execute("DELETE FROM t")
    assert rows(first, "SELECT a FROM t ORDER BY a") == [(1,), (2,)]


def test_a_manifest_that_was_not_finished_does_not_count(spark, tmp_path):
    path = f"file://{tmp_path}/db"
    Engine(spark, path).execute_many("CREATE TABLE t(a INTEGER); INSERT INTO t VALUES (1)")
    (tmp_path / "db" / "manifests" / "0123.tmp").write_text("{")
    assert rows(Engine(spark, path), "SELECT a FROM t") == [(1,)]


def test_vacuum_deletes_what_no_table_holds(spark, tmp_path, monkeypatch):
    import quern.definitions as definitions
    import quern.engine as engine

    db = Engine(spark, f"file://{tmp_path}/db")
    db.execute_many("CREATE TABLE t(a INTEGER); INSERT INTO t VALUES (1); INSERT INTO t VALUES (2); DELETE FROM t WHERE a = 1")
    before = len(list((tmp_path / "db" / "data").iterdir()))
    db.execute("VACUUM")
    assert len(list((tmp_path / "db" / "data").iterdir())) >= before
    monkeypatch.setattr(definitions, "SWEEP_AFTER", -60.0)
    monkeypatch.setattr(engine, "KEPT_MANIFESTS", 1)
    db.execute_many("INSERT INTO t VALUES (3); VACUUM; VACUUM; VACUUM")
    left = {f for x in db.table("t").layers for f in (x.added, x.removed) if f}
    assert len(left) == 1 and len(list((tmp_path / "db" / "data").iterdir())) < before
    assert rows(Engine(spark, f"file://{tmp_path}/db"), "SELECT a FROM t ORDER BY a") == [(2,), (3,)]


def test_unique_expressions_and_partial_indexes(db):
    db.execute_many("CREATE TABLE t(id INTEGER PRIMARY KEY, a TEXT, live INTEGER); INSERT INTO t(a, live) VALUES ('x', 1), ('X', 0), ('y', 1), (NULL, 1), (NULL, 1)")
    with pytest.raises(SqlError, match="UNIQUE constraint failed: index 'u'"):
        db.execute("CREATE UNIQUE INDEX u ON t(lower(a))")
    db.execute("CREATE UNIQUE INDEX u ON t(lower(a)) WHERE live = 1")
    with pytest.raises(SqlError, match="index 'u'"):
        db.execute("INSERT INTO t(a, live) VALUES ('Y', 1)")
    with pytest.raises(SqlError, match="index 'u'"):
        db.execute("UPDATE t SET live = 1")
    db.execute("INSERT INTO t(a, live) VALUES ('Y', 0)")
    db.execute("INSERT OR IGNORE INTO t(a, live) VALUES ('X', 1), ('z', 1), ('Z', 1), ('Z', 0)")
    assert rows(db, "SELECT a, live FROM t WHERE id > 5 ORDER BY id") == [("Y", 0), ("z", 1), ("Z", 0)]
    db.execute("INSERT OR REPLACE INTO t(a, live) VALUES ('Y', 1)")
    assert rows(db, "SELECT a FROM t WHERE live = 1 AND lower(a) = 'y'") == [("Y",)] and rows(db, "SELECT COUNT(*) FROM t") == [(8,)]
    db.execute_many("DROP INDEX u; INSERT INTO t(a, live) VALUES ('y', 1)")


def test_upsert_of_a_hot_key(db):
    db.execute_many("CREATE TABLE t(k INTEGER PRIMARY KEY, n INTEGER CHECK (n < 1000000000), last TEXT, kept TEXT); INSERT INTO t VALUES (0, 100, 'old', 'first')")
    sql = "INSERT INTO t SELECT value % 3 * (value % 2), value, 'v' || value, 'x' FROM generate_series(1, 20000) WHERE true ON CONFLICT(k) DO UPDATE SET n = n + excluded.n, last = excluded.last"
    expected = {0: [100, "old", "first"]}
    for v in range(1, 20001):
        k = v % 3 * (v % 2)
        if k in expected:
            expected[k][:2] = [expected[k][0] + v, f"v{v}"]
        else:
            expected[k] = [v, f"v{v}", "x"]
    assert db.execute(sql).rows_affected == 20000
    assert rows(db, "SELECT * FROM t ORDER BY k") == [(k, *v) for k, v in sorted(expected.items())]
    with pytest.raises(SqlError, match="CHECK"):
        db.execute("INSERT INTO t VALUES (5, 1, 'a', 'b'), (5, 2000000000, 'a', 'b'), (5, -2000000000, 'a', 'b') ON CONFLICT(k) DO UPDATE SET n = n + excluded.n")
    back = db.execute("INSERT INTO t VALUES (7, 1, 'a', 'b'), (7, NULL, 'c', 'd'), (7, 3, 'e', 'f') ON CONFLICT(k) DO UPDATE SET n = t.n + excluded.n, last = excluded.last RETURNING k, n, last").returning
    assert sorted(map(tuple, back.collect()), key=str) == [(7, 1, "a"), (7, None, "c"), (7, None, "e")]
    db.execute("INSERT INTO t VALUES (8, 2, 'a', 'b'), (8, 3, 'c', 'd'), (8, 4, 'e', 'f') ON CONFLICT(k) DO UPDATE SET n = t.n * excluded.n")
    assert rows(db, "SELECT n, last FROM t WHERE k IN (7, 8) ORDER BY k") == [(None, "e"), (24, "a")]


def test_trigger_of_many_rows(db):
    db.execute_many(
        "CREATE TABLE t(a INTEGER); CREATE TABLE x(s TEXT); CREATE TABLE y(n INTEGER); INSERT INTO t SELECT value FROM generate_series(1, 20000);"
        "CREATE TRIGGER g AFTER UPDATE ON t WHEN new.a % 2 = 0 BEGIN INSERT INTO x VALUES (old.a || '>' || new.a); INSERT INTO y VALUES (new.a - old.a); END; UPDATE t SET a = a * 3"
    )
    assert rows(db, "SELECT COUNT(*), MIN(s) FROM x") == [(10000, "10000>30000")] and rows(db, "SELECT SUM(n) FROM y") == [(2 * sum(range(2, 20001, 2)),)]


def test_trigger_that_sees_earlier_rows(db):
    db.execute_many("CREATE TABLE t(a INTEGER); CREATE TABLE x(n INTEGER); CREATE TRIGGER g AFTER INSERT ON t BEGIN INSERT INTO x VALUES ((SELECT COUNT(*) FROM x) * 10 + new.a); END; INSERT INTO t VALUES (1), (2), (3)")
    assert rows(db, "SELECT n FROM x ORDER BY n") == [(1,), (12,), (23,)]


def test_rows_with_and_without_ids(db):
    db.execute_many("CREATE TABLE t(id INTEGER PRIMARY KEY, a TEXT); INSERT INTO t VALUES (NULL, 'a'), (7, 'b'), (NULL, 'c'), (3, 'd'), (NULL, 'e')")
    assert rows(db, "SELECT a, id FROM t ORDER BY a") == [("a", 8), ("b", 7), ("c", 9), ("d", 3), ("e", 10)]


def test_full_text(db):
    db.execute_many("CREATE VIRTUAL TABLE docs USING fts5(title, body, weights=(2.0, 1.0)); INSERT INTO docs VALUES ('The quick brown fox', 'x'), ('Lazy dogs nap all day', 'quick nap'), ('Quick foxes jump high', 'Café')")
    find = lambda q: sorted(r[0] for r in rows(db, f"SELECT rowid FROM docs WHERE docs MATCH '{q}'"))
    assert find("fox") == [1] and find("quick") == [1, 2, 3] and find("fox*") == [1, 3] and find("\"quick brown\"") == [1]
    assert find("fox OR dogs") == [1, 2] and find("NEAR(quick fox, 2)") == [1] and find("NEAR(lazy day, 2)") == [] and find("CAFE") == [3]
    assert rows(db, "SELECT rowid FROM docs WHERE body MATCH 'quick'") == [(2,)]
    db.execute("DELETE FROM docs WHERE rowid = 1")
    assert find("fox") == []
    assert rows(db, "SELECT FTS5_RANK('apple banana', 'apple grape'), FTS5_MATCH('apple', 'apple pear'), FTS5_MATCH(NULL, 'x'), FTS5_MATCH('x', '')") == [(0.5, 0, 0, 1)]


def test_modules(spark, db):
    db.execute_many("CREATE VIRTUAL TABLE b USING rtree(2); INSERT INTO b VALUES (0, 2, 0, 2)")
    with pytest.raises(SqlError, match="CHECK"):
        db.execute("INSERT INTO b VALUES (3, 1, 0, 0)")
    with pytest.raises(SqlError, match="may not be modified"):
        db.execute("DELETE FROM b")
    db.execute("CREATE VIRTUAL TABLE v USING vec_index(dim=3, metric=euclidean)")
    with pytest.raises(SqlError, match="dimension"):
        db.execute("INSERT INTO v(vector) VALUES (vec_from_json('[1,2]'))")
    db.register_module("squares", lambda engine, args: spark.range(int(args[0])).selectExpr("id", "id * id AS square"))
    db.execute("CREATE VIRTUAL TABLE s USING squares(4)")
    assert rows(db, "SELECT square FROM s WHERE id = 3") == [(9,)]


def test_functions_of_the_user(db):
    db.create_function("twice", 1, lambda x: None if x is None else 2 * x, "bigint")
    assert rows(db, "SELECT TWICE(21), twice(NULL)") == [(42, None)]
    with pytest.raises(SqlError, match="wrong number"):
        db.query("SELECT twice(1, 2)")
    with pytest.raises(SqlError, match="built in"):
        db.create_function("upper", 1, str)
    assert db.delete_function("twice") and not db.delete_function("twice")
    with pytest.raises(SqlError, match="no such function"):
        db.query("SELECT twice(1)")


def test_pragmas(db):
    db.execute_many("CREATE TABLE t(id INTEGER PRIMARY KEY, a TEXT NOT NULL DEFAULT 'x', b INTEGER AS (id * 2)); CREATE INDEX i ON t(a); CREATE TABLE c(t INTEGER REFERENCES t(id) ON DELETE CASCADE)")
    assert rows(db, "PRAGMA table_info(t)") == [(0, "id", "INTEGER", 0, None, 1), (1, "a", "TEXT", 1, "'x'", 0)]
    assert [r[6] for r in rows(db, "PRAGMA table_xinfo(t)")] == [0, 0, 2]
    assert rows(db, "PRAGMA index_list(t)") == [(0, "i", 0, "c", 0)] and rows(db, "PRAGMA index_info(i)") == [(0, 1, "a")]
    assert rows(db, "PRAGMA foreign_key_list(c)") == [(0, 0, "t", "t", "id", "NO ACTION", "CASCADE", "NONE")]
    assert {r[1] for r in rows(db, "PRAGMA table_list")} == {"t", "c"}
    assert rows(db, "PRAGMA integrity_check") == [("ok",)] and rows(db, "PRAGMA journal_mode") == [("delete",)]
    assert rows(db, "SELECT name FROM sqlite_master WHERE type = 'index'") == [("i",)]
    assert "Scan" in " ".join(r[3] for r in rows(db, "EXPLAIN QUERY PLAN SELECT * FROM t"))


ORDERS = {"k": "k NULLS FIRST", "k DESC": "k DESC NULLS LAST", "k NULLS LAST": "k NULLS LAST", "k DESC NULLS FIRST": "k DESC NULLS FIRST"}  # ours, and as DuckDB says it


def plan(db, sql):
    return db.query(sql)._jdf.queryExecution().executedPlan().toString().lower()


def against_duckdb(db, spark, table, data, schema, columns):
    """Columns by their own SQL and by DuckDB's, over rows ``data``."""
    import duckdb

    db.register(table, spark.createDataFrame(data, schema))
    con = duckdb.connect()
    con.execute(f"CREATE TABLE {table}({schema})")
    con.executemany(f"INSERT INTO {table} VALUES ({', '.join('?' * len(data[0]))})", data)
    ours, theirs = (f"SELECT id, {', '.join(f'{c[at]} AS c{k}' for k, c in enumerate(columns))} FROM {table} ORDER BY id" for at in (0, 1))
    for got, want in zip(rows(db, ours), con.execute(theirs).fetchall(), strict=True):
        assert [*got] == [*want]
    return plan(db, ours)


def test_range_and_groups_frames_to_the_end_are_running_ones(db, spark):
    data = [(i, i % 3, None if i % 7 == 0 else i * i % 23) for i in range(120)]
    frames = ["RANGE BETWEEN CURRENT ROW", "RANGE BETWEEN 2 PRECEDING", "RANGE BETWEEN 3 FOLLOWING", "GROUPS BETWEEN CURRENT ROW", "GROUPS BETWEEN 1 PRECEDING", "GROUPS BETWEEN 2 FOLLOWING"]
    over = "CAST({}(id) OVER (PARTITION BY p ORDER BY {} {} AND UNBOUNDED FOLLOWING) AS BIGINT)"
    columns = [tuple(over.format(f, o, frame) for o in order) for f, order in zip(("SUM", "COUNT", "MIN", "MAX"), ORDERS.items()) for frame in frames]
    assert "unboundedfollowing" not in against_duckdb(db, spark, "t", data, "id BIGINT, p BIGINT, k BIGINT", columns)


def test_rows_frames_to_the_end_are_running_ones(db, spark):
    data = [(i * 37 % 121, i % 3, None if i % 7 == 0 else i * i % 23) for i in range(120)]
    frames = ["ROWS BETWEEN CURRENT ROW", "ROWS BETWEEN 2 PRECEDING", "ROWS BETWEEN 3 FOLLOWING"]
    over = "CAST({}(id) OVER (PARTITION BY p ORDER BY {}, id {} AND UNBOUNDED FOLLOWING) AS BIGINT)"
    columns = [tuple(over.format(f, o, frame) for o in order) for f, order in zip(("SUM", "COUNT", "MIN", "MAX"), ORDERS.items()) for frame in frames]
    assert "unboundedfollowing" not in against_duckdb(db, spark, "t", data, "id BIGINT, p BIGINT, k BIGINT", columns)


@pytest.mark.parametrize(
    "source",
    ["SELECT {} FROM t", "SELECT {} FROM t WHERE id >= 0", "SELECT {} FROM (SELECT a.id, a.k FROM t a JOIN u b ON a.id = b.id)", "SELECT {} FROM (SELECT id AS i, k AS j FROM t) GROUP BY i, j", "SELECT id % 1000 AS g, {} FROM t GROUP BY g", "SELECT id % 1000, {} FROM t GROUP BY 1"],
)
def test_frames_before_and_behind_a_row_share_no_peer(db, spark, source):
    db.register("t", spark.createDataFrame([(i, i % 4) for i in range(400)], "id BIGINT, k BIGINT").repartition(7))
    db.register("u", spark.range(400).repartition(5))
    v, k = ("i", "j") if "GROUP BY i" in source else ("SUM(id)", "COUNT(*)") if "GROUP" in source else ("id", "k")
    for order in (f"ORDER BY {k}", f"ORDER BY {k} DESC", ""):
        part = f"SUM({v}) OVER ({order} ROWS BETWEEN "
        parts = f"{v} AS v, {part}UNBOUNDED PRECEDING AND 1 PRECEDING) AS a, {part}1 FOLLOWING AND UNBOUNDED FOLLOWING) AS b, ROW_NUMBER() OVER ({order}) AS n, COUNT(*) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS m, LEAD({v}) OVER ({order}) AS next, {part}1 FOLLOWING AND 1 FOLLOWING) AS later"
        got = db.query(source.format(parts)).collect()
        assert len(got) == 400
        assert all((r.a or 0) + r.v + (r.b or 0) == sum(range(400)) and r.n + r.m == 401 and r.next == r.later for r in got)


def test_frames_to_the_end_with_having_and_without_tables(db):
    db.execute_many("CREATE TABLE t(id INTEGER PRIMARY KEY, k INTEGER); INSERT INTO t(k) VALUES (1), (1), (2)")
    end = "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"
    assert rows(db, f"SELECT SUM(1) OVER ({end}) FROM t HAVING COUNT(*) > 1") == [(1,)]
    assert rows(db, f"SELECT COUNT(*) OVER ({end})") == [(1,)]
    assert rows(db, f"SELECT id, (SELECT count(*) FROM t b WHERE b.k = t.k), SUM(id) OVER (ORDER BY k {end}) FROM t ORDER BY id") == [(1, 2, 6), (2, 2, 5), (3, 1, 3)]


VALUES = [
    ("5 / 2", 2), ("-5 / 2", -2), ("5 / 0", 0), ("5 % 0", 0), ("5.0 / 0", float("inf")), ("'a' + 1", 1), ("1 < 'a'", 1), ("NULL + 1", None), ("1 = 1.0", 1), ("'a' = 'A'", 0),
    ("'a' = 'A' COLLATE NOCASE", 1), ("'ABC' LIKE 'a%'", 1), ("'É' LIKE 'é'", 0), ("'a%b' LIKE 'a\\%b'", 0), ("3 NOT IN (1, NULL)", 1), ("NULL IN (1)", None), ("1 IN ()", 0), ("1 IS NOT 2", 1),
    ("NULL IS NULL", 1), ("CASE NULL WHEN NULL THEN 1 ELSE 2 END", 2), ("1 || 2", "12"), ("1.0 || ''", "1"), ("0.1 || ''", "0.1"), ("CAST('12abc' AS INTEGER)", 0), ("CAST(3.9 AS INT)", 3),
    ("CAST(' 7 ' AS INTEGER)", 7), ("CAST(1 AS TEXT)", "1"), ("TYPEOF(1.0)", "real"), ("TYPEOF(x'00')", "blob"), ("-8 >> 1", 9223372036854775804), ("~0", -1), ("1 << 62", 4611686018427387904),
    ("0x10", 16), ("NOT 'text'", 0), ("substr('hello', 0, 3)", "he"), ("substr('hello', -10, 2)", "he"), ("substr('hello', 2, -1)", "ello"), ("replace('ab', '', '-')", "-a-b-"), ("round(-2.5)", -3.0),
    ("unicode('')", None), ("hex(17)", "3137"), ("quote(NULL)", "NULL"), ("quote(x'0aff')", "X'0AFF'"), ("trim(char(9, 32) || 'a ')", "a"), ("min(1, NULL)", None), ("max(NULL, 2)", 2),
    ("sign('-3')", -1), ("sign('x')", None), ("date('2024-01-31', '+1 month')", "2024-02-29"), ("time('23:59:59', '+1 second')", "00:00:00"), ("datetime(86400)", "1970-01-02 00:00:00"),
    ("date(2460384.5)", "1970-01-29"), ("date('nonsense!!')", None), ("strftime('%W', '2024-01-07')", "01"), ("julianday('1970-01-01')", 2440587.5), ("unixepoch('1970-01-01 00:01:00')", 60),
    ("json_extract('{\"a\":[1,{\"b\":2.0}]}', '$.a[1].b')", "2"), ("json_extract('{\"a\":true}', '$.a')", "1"), ("json_extract('bad', '$')", None), ("json_type('[1,null]', '$[1]')", "null"),
    ("json_array('[1]', 'x')", "[[1],\"x\"]"), ("json_set('[1]', '$[5]', 2)", "[1,2]"), ("json_set('{}', '$.a.b', 1)", "{}"), ("json_remove('{\"a\":1,\"b\":2}', '$.a')", "{\"b\":2}"),
    ("'{\"b\":1,\"a\":2}' -> 'a'", "2"), ("'[1,2,3]' ->> -1", "3"), ("printf('%d %s %%', 3.9, 'x')", "3 x %"), ("glob('a[^b-d]*', 'aex')", 1), ("'abc' GLOB '?b'", 0), ("iif(0, 1, 2)", 2),
    ("vec_distance_l2(vec_from_json('[0,0]'), vec_from_json('[3,4]'))", 5.0), ("vec_distance_cosine(x'0000803f', x'00000040')", 0.0), ("vec_length(x'0000803f00000000')", 2), ("2.5 IS TRUE", 1), ("NULL IS NOT FALSE", 1),
]


def test_values(db):
    got = db.query("SELECT " + ", ".join(f"{sql} AS c{k}" for k, (sql, _) in enumerate(VALUES))).first()
    assert {sql: v for (sql, _), v in zip(VALUES, got)} == dict(VALUES)
