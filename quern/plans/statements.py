"""Queries that change copies of tables first: (statements, the query, SQL for DuckDB). Each runs in a database of its own."""

from __future__ import annotations

COPY = "CREATE TABLE n(k INTEGER PRIMARY KEY, name TEXT NOT NULL, r INTEGER); INSERT INTO n SELECT n_nationkey, n_name, n_regionkey FROM nation;"
NATION = "SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS name, CAST(n_regionkey AS BIGINT) AS r FROM nation"

QUERIES: dict[str, tuple[str, str, str]] = {
    "q_insert_select": (COPY, "SELECT k, name, r, rowid AS id FROM n", f"SELECT k, name, r, k AS id FROM ({NATION})"),
    "q_insert_defaults": ("CREATE TABLE t(id INTEGER PRIMARY KEY, a TEXT DEFAULT 'x', b REAL DEFAULT 1.5, c INTEGER); INSERT INTO t(c) VALUES (1), (2); INSERT INTO t DEFAULT VALUES; INSERT INTO t(a, c) VALUES (NULL, 4)", "SELECT id, a, b, c FROM t", "SELECT CAST(id AS BIGINT) AS id, a, CAST(1.5 AS DOUBLE) AS b, CAST(c AS BIGINT) AS c FROM (VALUES (1, 'x', 1), (2, 'x', 2), (3, 'x', NULL), (4, NULL, 4)) AS t(id, a, c)"),
    "q_insert_or_replace": (COPY + "INSERT OR REPLACE INTO n SELECT n_nationkey, 'new ' || n_name, 9 FROM nation WHERE n_nationkey % 3 = 0; REPLACE INTO n VALUES (100, 'extra', 1)", "SELECT k, name, r FROM n", f"SELECT k, CASE WHEN k % 3 = 0 THEN 'new ' || name ELSE name END AS name, CASE WHEN k % 3 = 0 THEN 9 ELSE r END AS r FROM ({NATION}) UNION ALL SELECT 100, 'extra', 1"),
    "q_insert_or_ignore": (COPY + "INSERT OR IGNORE INTO n SELECT n_nationkey + 20, 'more ' || n_name, 0 FROM nation", "SELECT k, name, r FROM n", f"SELECT k, name, r FROM ({NATION}) UNION ALL SELECT k + 20, 'more ' || name, 0 FROM ({NATION}) WHERE k + 20 > 24"),
    "q_upsert": (COPY + "INSERT INTO n SELECT n_nationkey * 2, n_name, 50 FROM nation WHERE true ON CONFLICT(k) DO UPDATE SET name = excluded.name || '/' || n.name, r = n.r + excluded.r WHERE n.r <> 2", "SELECT k, name, r FROM n", f"WITH n AS ({NATION}), m AS (SELECT k * 2 AS k, name FROM n) SELECT n.k, CASE WHEN m.k IS NULL OR n.r = 2 THEN n.name ELSE m.name || '/' || n.name END AS name, CASE WHEN m.k IS NULL OR n.r = 2 THEN n.r ELSE n.r + 50 END AS r FROM n LEFT JOIN m ON n.k = m.k UNION ALL SELECT k, name, 50 FROM m WHERE k > 24"),
    "q_update": (COPY + "UPDATE n SET name = lower(name), r = r * 10 + k WHERE r IN (1, 3)", "SELECT k, name, r FROM n", f"SELECT k, CASE WHEN r IN (1, 3) THEN lower(name) ELSE name END AS name, CASE WHEN r IN (1, 3) THEN r * 10 + k ELSE r END AS r FROM ({NATION})"),
    "q_update_from": (COPY + "UPDATE n SET name = n.name || '@' || region.r_name FROM region WHERE region.r_regionkey = n.r AND n.k > 9", "SELECT k, name, r FROM n", f"SELECT k, CASE WHEN k > 9 THEN name || '@' || r_name ELSE name END AS name, r FROM ({NATION}) JOIN region ON r = r_regionkey"),
    "q_update_limit": (COPY + "UPDATE n SET r = 77 WHERE r < 3 ORDER BY name DESC LIMIT 4", "SELECT k, name, r FROM n", f"WITH n AS ({NATION}) SELECT k, name, CASE WHEN k IN (SELECT k FROM n WHERE r < 3 ORDER BY name DESC LIMIT 4) THEN 77 ELSE r END AS r FROM n"),
    "q_delete": (COPY + "DELETE FROM n WHERE name LIKE '%a' OR r = 4", "SELECT k, name FROM n", f"SELECT k, name FROM ({NATION}) WHERE NOT (name ILIKE '%a' OR r = 4)"),
    "q_delete_limit": (COPY + "DELETE FROM n WHERE r > 0 ORDER BY name LIMIT 5 OFFSET 1", "SELECT k FROM n", f"WITH n AS ({NATION}) SELECT k FROM n WHERE k NOT IN (SELECT k FROM n WHERE r > 0 ORDER BY name LIMIT 5 OFFSET 1)"),
    "q_returning": (COPY, "UPDATE n SET r = r + 100 WHERE k < 5 RETURNING k, r, upper(name) AS up", f"SELECT k, r + 100 AS r, upper(name) AS up FROM ({NATION}) WHERE k < 5"),
    "q_delete_returning": (COPY, "DELETE FROM n WHERE k % 5 = 0 RETURNING *", f"SELECT k, name, r FROM ({NATION}) WHERE k % 5 = 0"),
    "q_without_rowid": ("CREATE TABLE w(a TEXT, b INTEGER, v REAL, PRIMARY KEY (a, b)) WITHOUT ROWID; INSERT INTO w SELECT n_name, n_regionkey, n_nationkey FROM nation; INSERT OR REPLACE INTO w SELECT n_name, n_regionkey, -1 FROM nation WHERE n_nationkey < 3", "SELECT a, b, v FROM w ORDER BY a, b", "SELECT n_name AS a, CAST(n_regionkey AS BIGINT) AS b, CAST(CASE WHEN n_nationkey < 3 THEN -1 ELSE n_nationkey END AS DOUBLE) AS v FROM nation"),
    "q_generated": ("CREATE TABLE g(a INTEGER, b INTEGER, c INTEGER GENERATED ALWAYS AS (a * b) STORED, d TEXT GENERATED ALWAYS AS (a || '+' || b) VIRTUAL); INSERT INTO g(a, b) SELECT n_nationkey, n_regionkey FROM nation; UPDATE g SET b = b + 1 WHERE a > 10", "SELECT a, b, c, d FROM g", "SELECT a, b, a * b AS c, a || '+' || b AS d FROM (SELECT CAST(n_nationkey AS BIGINT) AS a, CAST(n_regionkey + CASE WHEN n_nationkey > 10 THEN 1 ELSE 0 END AS BIGINT) AS b FROM nation)"),
    "q_autoincrement": ("CREATE TABLE a(id INTEGER PRIMARY KEY AUTOINCREMENT, v TEXT); INSERT INTO a(v) VALUES ('x'), ('y'), ('z'); DELETE FROM a WHERE id >= 2; INSERT INTO a(v) VALUES ('w')", "SELECT id, v FROM a", "SELECT CAST(id AS BIGINT) AS id, v FROM (VALUES (1, 'x'), (4, 'w')) AS t(id, v)"),
    "q_fk_cascade": ("PRAGMA foreign_keys = ON; CREATE TABLE p(id INTEGER PRIMARY KEY); CREATE TABLE c(id INTEGER PRIMARY KEY, p INTEGER REFERENCES p(id) ON DELETE CASCADE ON UPDATE CASCADE); CREATE TABLE s(id INTEGER PRIMARY KEY, p INTEGER REFERENCES p(id) ON DELETE SET NULL); INSERT INTO p SELECT r_regionkey FROM region; INSERT INTO c SELECT n_nationkey, n_regionkey FROM nation; INSERT INTO s SELECT n_nationkey, n_regionkey FROM nation; DELETE FROM p WHERE id = 2; UPDATE p SET id = 30 WHERE id = 3 AND NOT EXISTS (SELECT 1 FROM s WHERE p = 3 AND id < 0) AND id < 0", "SELECT 'c' AS t, id, p FROM c UNION ALL SELECT 's', id, p FROM s", "SELECT 'c' AS t, CAST(n_nationkey AS BIGINT) AS id, CAST(n_regionkey AS BIGINT) AS p FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT 's', n_nationkey, nullif(n_regionkey, 2) FROM nation"),
    "q_trigger_log": (COPY + "CREATE TABLE log(what TEXT, old_name TEXT, new_name TEXT); CREATE TRIGGER tu AFTER UPDATE ON n WHEN old.name <> new.name BEGIN INSERT INTO log VALUES ('u' || new.k, old.name, new.name); END; CREATE TRIGGER td BEFORE DELETE ON n BEGIN INSERT INTO log VALUES ('d', old.name, NULL); END; UPDATE n SET name = lower(name) WHERE k < 8; UPDATE n SET name = name WHERE k = 20; DELETE FROM n WHERE k >= 22", "SELECT what, old_name, new_name FROM log", f"SELECT 'u' || k AS what, name AS old_name, lower(name) AS new_name FROM ({NATION}) WHERE k < 8 AND name <> lower(name) UNION ALL SELECT 'd', name, NULL FROM ({NATION}) WHERE k >= 22"),
    "q_savepoint": (COPY + "BEGIN; DELETE FROM n WHERE k < 5; SAVEPOINT a; DELETE FROM n WHERE k < 10; ROLLBACK TO a; DELETE FROM n WHERE k = 20; COMMIT; BEGIN; DELETE FROM n; ROLLBACK", "SELECT k FROM n", f"SELECT k FROM ({NATION}) WHERE k >= 5 AND k <> 20"),
    "q_create_table_as": ("CREATE TABLE t AS SELECT n_regionkey AS r, COUNT(*) AS n FROM nation GROUP BY n_regionkey", "SELECT r, n FROM t", "SELECT n_regionkey AS r, count(*) AS n FROM nation GROUP BY n_regionkey"),
    "q_view": ("CREATE VIEW v(k, label) AS SELECT n_nationkey, n_name || ':' || n_regionkey FROM nation WHERE n_regionkey > 1", "SELECT k, label FROM v WHERE k > 5", "SELECT n_nationkey AS k, n_name || ':' || n_regionkey AS label FROM nation WHERE n_regionkey > 1 AND n_nationkey > 5"),
    "q_instead_of_trigger": (COPY + "CREATE VIEW v AS SELECT k, name FROM n; CREATE TRIGGER tv INSTEAD OF INSERT ON v BEGIN INSERT INTO n VALUES (new.k, new.name, -1); END; INSERT INTO v VALUES (90, 'ninety'), (91, 'ninety-one')", "SELECT k, name, r FROM n WHERE k > 20", f"SELECT k, name, r FROM ({NATION}) WHERE k > 20 UNION ALL SELECT * FROM (VALUES (90, 'ninety', -1), (91, 'ninety-one', -1))"),
    "q_alter_add_rename": (COPY + "ALTER TABLE n ADD COLUMN tag TEXT DEFAULT 'none'; ALTER TABLE n ADD COLUMN num INTEGER; ALTER TABLE n RENAME TO m; UPDATE m SET tag = 'low' WHERE k < 4", "SELECT k, tag, num FROM m", f"SELECT k, CASE WHEN k < 4 THEN 'low' ELSE 'none' END AS tag, CAST(NULL AS BIGINT) AS num FROM ({NATION})"),
    "q_table_info": (COPY, "PRAGMA table_info(n)", "SELECT CAST(cid AS BIGINT) AS cid, name, type, CAST(nn AS BIGINT) AS \"notnull\", CAST(NULL AS VARCHAR) AS dflt_value, CAST(pk AS BIGINT) AS pk FROM (VALUES (0, 'k', 'INTEGER', 0, 1), (1, 'name', 'TEXT', 1, 0), (2, 'r', 'INTEGER', 0, 0)) AS t(cid, name, type, nn, pk)"),
    "q_foreign_key_check": ("CREATE TABLE p(id INTEGER PRIMARY KEY); CREATE TABLE c(id INTEGER PRIMARY KEY, p INTEGER REFERENCES p(id)); INSERT INTO p SELECT r_regionkey FROM region WHERE r_regionkey < 3; INSERT INTO c SELECT n_nationkey, n_regionkey FROM nation", "PRAGMA foreign_key_check", "SELECT 'c' AS \"table\", CAST(n_nationkey AS BIGINT) AS rowid, 'p' AS parent, CAST(0 AS BIGINT) AS fkid FROM nation WHERE n_regionkey >= 3"),
    "q_analyze_stats": (COPY + "CREATE INDEX i ON n(r, name); ANALYZE", "SELECT tbl, idx, stat FROM sqlite_stat1", f"SELECT 'n' AS tbl, 'i' AS idx, count(*) || ' ' || CAST(ceil(count(*) / count(DISTINCT r)) AS BIGINT) || ' 1' AS stat FROM ({NATION})"),
    "q_unique_index": (COPY + "CREATE UNIQUE INDEX u ON n(name); INSERT OR IGNORE INTO n VALUES (200, 'FRANCE', 1), (201, 'ATLANTIS', 1)", "SELECT k, name FROM n WHERE k > 20", f"SELECT k, name FROM ({NATION}) WHERE k > 20 UNION ALL SELECT k, name FROM (VALUES (200, 'FRANCE'), (201, 'ATLANTIS')) AS t(k, name) WHERE name NOT IN (SELECT n_name FROM nation)"),
    "q_kvstore": ("CREATE VIRTUAL TABLE kv USING kvstore; INSERT INTO kv VALUES ('a', '1'), ('b', '2'); UPDATE kv SET value = '3' WHERE key = 'a'; DELETE FROM kv WHERE key = 'b'; INSERT INTO kv SELECT n_name, 'n' FROM nation WHERE n_nationkey < 2", "SELECT key, value FROM kv", "SELECT 'a' AS key, '3' AS value UNION ALL SELECT n_name, 'n' FROM nation WHERE n_nationkey < 2"),
    "q_series_table": ("CREATE VIRTUAL TABLE s USING series(0, 50, 5)", "SELECT value FROM s WHERE value > 10", "SELECT generate_series AS value FROM generate_series(0, 50, 5) WHERE generate_series > 10"),
    "q_fts_table": ("CREATE VIRTUAL TABLE d USING fts5(lang, body); INSERT INTO d(lang, body) SELECT lang, text FROM documents", "SELECT COUNT(*) AS n FROM d WHERE d MATCH 'the' AND lang = 'en'", r"SELECT count(*) AS n FROM documents WHERE lang = 'en' AND list_contains(list_transform(regexp_extract_all(lower(strip_accents(text)), $$(?:\p{L}(?:[:.'’·]\p{L})*|\p{N}(?:[,;.'’]\p{N})*|_)+$$), lambda x: regexp_replace(x, '[^\p{L}\p{N}]', '', 'g')), 'the')"),
    "q_rtree_table": ("CREATE VIRTUAL TABLE b USING rtree(2); INSERT INTO b SELECT n_nationkey, n_nationkey + 2, n_regionkey, n_regionkey + 1 FROM nation", "SELECT min_0, max_0 FROM b WHERE max_0 >= 5 AND min_0 <= 9 AND max_1 >= 2 AND min_1 <= 3", "SELECT CAST(n_nationkey AS DOUBLE) AS min_0, CAST(n_nationkey + 2 AS DOUBLE) AS max_0 FROM nation WHERE n_nationkey + 2 >= 5 AND n_nationkey <= 9 AND n_regionkey + 1 >= 2 AND n_regionkey <= 3"),
    "q_vec_index_table": ("CREATE VIRTUAL TABLE v USING vec_index(dim=64, metric=l2); INSERT INTO v(rowid, vector) SELECT vec_id + 1, embedding FROM embeddings", "SELECT rowid AS id, round(VEC_DISTANCE_L2(vector, (SELECT embedding FROM embeddings WHERE vec_id = 5)), 5) AS d FROM v ORDER BY d, id LIMIT 5", "SELECT vec_id + 1 AS id, round(list_distance(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 5)), 5) AS d FROM embeddings ORDER BY d, id LIMIT 5"),
    "q_constraints_hold": (COPY + "CREATE TABLE c(k INTEGER PRIMARY KEY, a INTEGER CHECK (a >= -1), b TEXT UNIQUE); INSERT OR IGNORE INTO c SELECT k, r - 1, name FROM n; INSERT OR IGNORE INTO c SELECT k + 100, r, name FROM n; DROP TABLE IF EXISTS none", "SELECT k, a, b FROM c", f"SELECT k, r - 1 AS a, name AS b FROM ({NATION})"),
    "q_change_counts": (COPY + "UPDATE n SET r = 9 WHERE k < 7", "SELECT CHANGES() AS c, TOTAL_CHANGES() AS t FROM n", f"SELECT CAST(7 AS BIGINT) AS c, CAST(32 AS BIGINT) AS t FROM ({NATION})"),
    "q_drop_trigger": (COPY + "CREATE TABLE log(m TEXT); CREATE TRIGGER g AFTER DELETE ON n BEGIN INSERT INTO log VALUES (OLD.name); END; DELETE FROM n WHERE k = 1; DROP TRIGGER g; DELETE FROM n WHERE k = 2", "SELECT m FROM log", f"SELECT name AS m FROM ({NATION}) WHERE k = 1"),
}
