"""INSERT, UPDATE and DELETE as sets of added and removed rows.

A statement's rows are staged once as Parquet; conflicts, constraints, foreign keys and
triggers are joins and aggregates over them. Whatever fails leaves the catalog as it was.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.catalog import ForeignKey, Index, Table, Trigger, replace
from quern.dialect.emit import ROWID, Emitter, Relation, Scope, quote, spark_type
from quern.dialect.parser import Node, SqlError
from quern.engine import TRIGGER_DEPTH, Engine, ExecResult

POS, OLD = "__pos__", "__old_rowid__"


def stage(eng: Engine, df: DataFrame) -> DataFrame:
    return eng.spark.read.schema(df.schema).parquet(eng.write(df))


def numbered(eng: Engine, df: DataFrame) -> DataFrame:
    """``df`` staged, with its rows' places 0, 1, 2, ... in the order it came in, without a single task for all."""
    staged = stage(eng, df.withColumn(POS, F.monotonically_increasing_id()))
    part, inside = F.shiftright(POS, 33), F.col(POS).bitwiseAND((1 << 33) - 1)
    sizes = dict(staged.groupBy(part.alias("p")).count().collect())  # a row for each partition
    starts, at = [], 0
    for p in sorted(sizes):
        starts.append((p, at))
        at += sizes[p]
    begins = F.broadcast(eng.frame(starts, "__part long, __start long"))  # two numbers for each partition
    return staged.join(begins, part == F.col("__part")).withColumn(POS, inside + F.col("__start")).select(*staged.columns)


def on(left: DataFrame, right: DataFrame, a: list[str] | tuple[str, ...], b: list[str] | tuple[str, ...]) -> SparkColumn:
    return reduce(lambda x, y: x & y, [left[quote(x)] == right[quote(y)] for x, y in zip(a, b)])


def semi(left: DataFrame, right: DataFrame, a: Any, b: Any = None, how: str = "left_semi") -> DataFrame:
    left, right = left.alias("__a"), right.select(*[F.col(quote(c)).alias(f"__k{i}") for i, c in enumerate(b or a)]).alias("__b")
    return left.join(right, reduce(lambda x, y: x & y, [F.col(f"__a.{quote(c)}") == F.col(f"__b.__k{i}") for i, c in enumerate(a)]), how)


def any_null(key: tuple[str, ...]) -> SparkColumn:
    return reduce(lambda x, y: x | y, [F.col(quote(c)).isNull() for c in key])


def first_of(df: DataFrame, key: tuple[str, ...], last: bool = False) -> DataFrame:
    """One row for each key, the first by place or the last; rows with a null in the key all stay."""
    order = F.col(POS).desc() if last else F.col(POS)
    apart = F.when(any_null(key), F.col(POS))  # rows with a null are a group each, not one large group
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*[quote(c) for c in key], apart).orderBy(order))).filter("__n = 1").drop("__n")


def returning(eng: Engine, t: Table, items: list[Node] | None, df: DataFrame, params: Any, count: int) -> ExecResult:
    if items is None:
        return ExecResult(count)
    eng.sources["__returned"] = (eng.temporary(df.drop(POS, OLD)), [(c.name, spark_type(c.type)) for c in t.columns])
    e = Emitter(eng, params)
    view = eng.sources.pop("__returned")[0]
    e.scope = Scope([])
    host_relation = Relation(t.name, [(c.name, spark_type(c.type)) for c in t.columns], ROWID)
    e.scope.relations.append(host_relation)
    out = []
    for item in items:
        if item.arg.kind == "star":
            out += [f"{quote(t.name)}.{quote(c.name)}" for c in t.columns]
        else:
            out.append(f"{e.value(e.expr(item.arg))[0]} AS {quote(item.alias or (item.arg.name if item.arg.kind == 'column' else item.text))}")
    return ExecResult(count, eng.spark.sql(f"SELECT {', '.join(out)} FROM {view} AS {quote(t.name)} ORDER BY {quote(t.name)}.{ROWID}"))


def fail(kind: str, t: Table, columns: Any) -> None:
    names = ", ".join(f"{t.name}.{c}" for c in columns) if not isinstance(columns, str) else columns
    raise SqlError(f"{kind} constraint failed: {names}")


def validate(eng: Engine, t: Table, rows: DataFrame, params: Any = None) -> tuple[int, int | None]:
    """NOT NULL and CHECK of new rows, in one aggregate with their number and their largest row id."""
    e = eng.emitter_on("__row", [(c.name, spark_type(c.type)) for c in t.columns], params)
    tests: list[tuple[str, Any, str]] = [("NOT NULL", (c.name,), f"{quote(c.name)} IS NULL") for c in t.columns if (c.notnull or c.pk) and c.name != t.id_column]
    tests += [("CHECK", text, f"NOT coalesce({e.cond(check)}, true)") for check, text in t.checks]
    if t.module == "rtree":
        pairs = [c.name for c in t.columns]
        tests += [("CHECK", f"{low} <= {high}", f"{quote(low)} IS NULL OR {quote(high)} IS NULL OR {quote(low)} > {quote(high)}") for low, high in zip(pairs[::2], pairs[1::2])]
    if t.module == "vec_index":
        tests.append(("CHECK", f"dimension is {dict(t.options)['dim']}", f"vector IS NULL OR size(vector) <> {dict(t.options)['dim']}"))
    n, top, *found = rows.alias("__row").agg(F.count("*").alias("n"), F.max(ROWID).alias("top"), *[F.coalesce(F.sum(F.expr(f"CAST({sql} AS INT)")), F.lit(0)).alias(f"t{k}") for k, (_, _, sql) in enumerate(tests)]).first()
    for (kind, what, _), bad in zip(tests, found):
        if bad:
            fail(kind, t, what)
    return n, top


def check_unique(eng: Engine, t: Table, new: DataFrame, others: DataFrame, sets: set[str] | None = None) -> None:
    """No key twice among the new rows, nor among them and the others. Keys outside ``sets`` did not change."""
    for key in t.keys:
        if sets is not None and not sets & set(key):
            continue
        own, names = new.filter(~any_null(key)), [quote(c) for c in key]
        twice = own.groupBy(*names).count().filter("count > 1").select(*names)
        if not twice.unionAll(semi(own, others, key).select(*names)).isEmpty():
            fail("UNIQUE", t, key)
    for index in computed_indexes(eng, t):
        if sets is None or sets & read_by(t, index):
            check_computed(eng, t, index, new, others)


def computed_indexes(eng: Engine, t: Table) -> list[Index]:
    return [x for _, x in sorted(eng.catalog.indexes.items()) if x.computed and x.table.lower() == t.name.lower()]


def read_by(t: Table, index: Index) -> set[str]:
    """The columns that an index reads; those of generated columns count, too."""
    low = {n.name.lower() for n in nodes([*index.columns, index.where]) if n.kind == "column"}
    low |= {n.name.lower() for c in t.columns if c.generated is not None and c.name.lower() in low for n in nodes(c.generated) if n.kind == "column"}
    return {c.name for c in t.columns if c.name.lower() in low}


def with_key(eng: Engine, t: Table, index: Index, df: DataFrame) -> tuple[DataFrame, tuple[str, ...]]:
    """``df`` with an index's expressions as columns, null in rows that are not in it."""
    e = eng.emitter_on("__row", [(c.name, spark_type(c.type)) for c in t.columns])
    key = tuple(f"__u{k}" for k in range(len(index.columns)))
    values = [e.value(e.expr(x))[0] for x in index.columns]
    inside = e.cond(index.where) if index.where is not None else "true"
    return df.alias("__row").select("*", *[F.expr(f"CASE WHEN {inside} THEN {x} END").alias(k) for k, x in zip(key, values)]), key


def check_computed(eng: Engine, t: Table, index: Index, new: DataFrame, others: DataFrame) -> None:
    own, key = with_key(eng, t, index, new)
    own = own.filter(~any_null(key))
    twice = own.groupBy(*key).count().filter("count > 1").select(*key)
    if not twice.unionAll(semi(own, with_key(eng, t, index, others)[0], key).select(*key)).isEmpty():
        fail("UNIQUE", t, f"index '{index.name}'")


def check_parents(eng: Engine, t: Table, new: DataFrame) -> None:
    if not eng.foreign_keys:
        return
    for fk in t.foreign:
        parent = eng.table(fk.table)
        own = new.filter(~any_null(fk.columns))
        if not semi(own, eng.rows(parent), fk.columns, fk.parent or parent.primary, "left_anti").isEmpty():
            raise SqlError("FOREIGN KEY constraint failed")


def children_of(eng: Engine, t: Table) -> list[tuple[Table, ForeignKey]]:
    return [(c, fk) for c in eng.catalog.tables.values() for fk in c.foreign if fk.table.lower() == t.name.lower()]


def put(eng: Engine, t: Table, added: DataFrame | None, removed: DataFrame | None) -> None:
    eng.catalog = eng.catalog.put("tables", t.name, eng.layered(eng.table(t.name), added, removed))


# insert


def insert(eng: Engine, node: Node, params: Any) -> ExecResult:
    if view_trigger(eng, node.table, "INSERT"):
        return instead(eng, node, params)
    t = eng.table(node.table)
    names = node.columns or [c.name for c in t.columns if c.generated is None]
    for n in names:
        c = t.column(n)
        if c is None and n.lower() not in ("rowid", "_rowid_", "oid"):
            raise SqlError(f"table {t.name} has no column named {n}")
        if c is not None and c.generated is not None:
            raise SqlError(f"cannot INSERT into generated column {c.name!r}")
    rows = incoming(eng, t, node, names, params)
    new = with_ids(eng, t, rows)
    removed = None
    conflict = node.conflict
    if conflict == "IGNORE" or node.upserts and node.upserts[0].sets is None:
        target = tuple(node.upserts[0].target) if node.upserts and node.upserts[0].target else None
        for key in [target] if target else t.keys:
            new = first_of(semi(new, eng.rows(t), key, how="left_anti"), key)
        for index in computed_indexes(eng, t) if target is None else ():
            keyed, key = with_key(eng, t, index, new)
            new = first_of(semi(keyed, with_key(eng, t, index, eng.rows(t))[0], key, how="left_anti"), key).drop(*key)
        new = stage(eng, new)
    elif conflict == "REPLACE":
        for key in t.keys:
            new = first_of(new, key, last=True)
        for index in computed_indexes(eng, t):
            keyed, key = with_key(eng, t, index, new)
            new = first_of(keyed, key, last=True).drop(*key)
        hits = [semi(eng.rows(t), new.filter(~any_null(key)), key) for key in t.keys]
        for index in computed_indexes(eng, t):
            keyed, key = with_key(eng, t, index, new)
            hits.append(semi(with_key(eng, t, index, eng.rows(t))[0], keyed.filter(~any_null(key)), key).drop(*key))
        removed = stage(eng, reduce(DataFrame.unionByName, hits).dropDuplicates([ROWID])) if hits else None
        new = stage(eng, new)
    elif node.upserts:
        return upsert(eng, t, node, new, params)
    added = add_rows(eng, t, new, removed, params)
    return returning(eng, t, node.returning, new, params, added)


def add_rows(eng: Engine, t: Table, new: DataFrame, removed: DataFrame | None = None, params: Any = None) -> int:
    """Checks new rows, fires triggers and adds them; rows of ``removed`` make room first."""
    n, top = validate(eng, t, new, params)
    if not n:
        return 0
    rest = eng.rows(t) if removed is None else semi(eng.rows(t), removed, (ROWID,), how="left_anti")
    check_unique(eng, t, new, rest)
    check_parents(eng, t, new) if not any(fk.table.lower() == t.name.lower() for fk in t.foreign) else None
    fire(eng, t, "BEFORE", "INSERT", new, None)
    put(eng, t, new, removed)
    if any(fk.table.lower() == t.name.lower() for fk in t.foreign):
        check_parents(eng, t, new)
    if t.auto:
        eng.catalog = eng.catalog.put("tables", t.name, replace(eng.table(t.name), sequence=max(eng.table(t.name).sequence, top)))
    eng.state["last_insert_rowid"] = top
    fire(eng, t, "AFTER", "INSERT", new, None)
    return n


def incoming(eng: Engine, t: Table, node: Node, names: list[str], params: Any) -> DataFrame:
    """The statement's rows with all stored columns, the given row ids (or null) and their places."""
    e = Emitter(eng, params)
    if node.query is None:
        df, given = eng.spark.sql(f"SELECT 0L AS {POS}"), {}
    else:
        q, values = node.query, node.query.body.kind == "values" and not node.query.ctes
        width = len(q.body.rows[0]) if values else None
        if values:
            if any(len(r) != len(names) for r in q.body.rows):
                raise SqlError(f"{width} values for {len(names)} columns")
            cells = [e.common([e.expr(r[k]) for r in q.body.rows]) for k in range(width)]
            lines = [f"{i}L, {', '.join(c[0][i] for c in cells)}" for i in range(len(q.body.rows))]
            if any(n.kind in ("query", "select") for n in nodes(q.body.rows)):  # VALUES takes no subqueries
                table = f"({' UNION ALL '.join(f'SELECT {x}' for x in lines)})"
            else:
                table = f"VALUES {', '.join(f'({x})' for x in lines)}"
            sql = f"SELECT * FROM {table} AS __v({POS}, {', '.join(f'__c{k}' for k in range(width))})"
            df, kinds = eng.spark.sql(sql), [c[1] for c in cells]
        else:
            sql, out = e.query(q)
            if len(out) != len(names):
                raise SqlError(f"{len(out)} values for {len(names)} columns")
            df, kinds = numbered(eng, eng.spark.sql(sql).toDF(*[f"__c{k}" for k in range(len(out))])), [k for _, k in out]
        given = {n.lower(): (f"__c{k}", kinds[k]) for k, n in enumerate(names)}
    columns = [F.col(POS)]
    own = next((given[r] for r in ("rowid", "_rowid_", "oid") if r in given and not t.column(r)), None)
    columns.append((F.col(own[0]) if own else F.lit(None)).cast("long").alias(ROWID))
    for c in t.columns:
        if c.generated is not None:
            continue
        if c.name.lower() in given:
            sql, kind = given[c.name.lower()]
            text = e.text((sql, kind)) if c.kind == "text" and kind not in ("text", "json", "null") else sql
            columns.append(F.expr(f"CAST({text} AS {c.type.simpleString()})").alias(c.name))
        else:
            columns.append(F.expr(f"CAST({e.value(e.expr(c.default))[0] if c.default else 'NULL'} AS {c.type.simpleString()})").alias(c.name))
    df = df.select(*columns)
    return stage(eng, df.select(POS, ROWID, *[quote(c.name) for c in t.columns if c.generated is None]))


def with_ids(eng: Engine, t: Table, rows: DataFrame) -> DataFrame:
    """Row ids for rows without one: behind the largest of the table, of the statement and of an AUTOINCREMENT sequence."""
    own = t.id_column
    if own:
        rows = rows.withColumn(ROWID, F.coalesce(F.col(quote(own)), F.col(ROWID)))
    n, given, top = rows.agg(F.count("*"), F.count(ROWID), F.max(ROWID)).first()
    if given < n:
        base = max(x or 0 for x in (top, eng.rows(t).agg(F.max(ROWID)).first()[0], t.sequence))
        if given:
            without = numbered(eng, rows.filter(F.col(ROWID).isNull()).withColumnRenamed(POS, "__was").orderBy("__was"))
            behind = without.withColumn(ROWID, F.lit(base).cast("long") + F.col(POS) + 1).withColumn(POS, F.col("__was"))
            rows = rows.filter(F.col(ROWID).isNotNull()).unionByName(behind.select(*rows.columns))
        else:
            rows = rows.withColumn(ROWID, F.lit(base).cast("long") + F.col(POS) + 1)
    if own:
        rows = rows.withColumn(own, F.col(ROWID))
    rows = eng.computed(t, with_missing(t, rows), [c for c in t.columns if c.generated is not None])
    return stage(eng, rows.select(POS, ROWID, *[quote(c.name) for c in t.columns]))


def with_missing(t: Table, rows: DataFrame) -> DataFrame:
    have = {c.lower() for c in rows.columns}
    return rows.withColumns({c.name: F.lit(None).cast(c.type) for c in t.columns if c.name.lower() not in have})


def upsert(eng: Engine, t: Table, node: Node, new: DataFrame, params: Any) -> ExecResult:
    """ON CONFLICT DO UPDATE. Of rows that repeat a key within the statement the first inserts, each later one updates
    what is there then. Where every SET is a ``fold``, all of them are taken at once; else in as many rounds as a key
    has rows."""
    u = node.upserts[0]
    key = tuple(t.column(c).name for c in u.target) if u.target else t.keys[0]
    turn = F.row_number().over(Window.partitionBy(*[quote(c) for c in key], F.when(any_null(key), F.col(POS))).orderBy(POS))
    new = stage(eng, new.withColumn("__turn", turn))
    rounds, total, back = new.agg(F.max("__turn")).first()[0] or 0, 0, []
    kinds = [(c.name, spark_type(c.type)) for c in t.columns]
    if rounds > 1 and (folds := folds_of(eng, t, node, key, params)) is not None:
        return upsert_at_once(eng, t, node, new, key, folds, params)
    for k in range(1, rounds + 1):
        t = eng.table(t.name)
        own = new.filter(F.col("__turn") == k).drop("__turn")
        fresh = stage(eng, semi(own, eng.rows(t), key, how="left_anti"))
        total += add_rows(eng, t, fresh, params=params)
        t = eng.table(t.name)
        back.append(fresh.drop(POS))
        held = semi(own, fresh, (POS,), how="left_anti")
        e = Emitter(eng, params)
        e.scope = Scope([Relation(node.alias or t.name, kinds, ROWID), Relation("excluded", kinds)])
        sets = {n.lower(): e.value(e.expr(x))[0] for n, x in u.sets}
        a, b = eng.rows(t).alias(node.alias or t.name), held.alias("excluded")
        joined = a.join(b, reduce(lambda x, y: x & y, [F.col(f"{quote(node.alias or t.name)}.{quote(c)}") == F.col(f"excluded.{quote(c)}") for c in key]))
        if u.where is not None:
            joined = joined.filter(F.expr(e.cond(u.where)))
        changed = joined.select(F.col(f"{quote(node.alias or t.name)}.{ROWID}").alias(OLD), *[F.expr(f"CAST({sets[c.name.lower()]} AS {c.type.simpleString()})").alias(c.name) if c.name.lower() in sets else F.col(f"{quote(node.alias or t.name)}.{quote(c.name)}").alias(c.name) for c in t.columns])
        n, df = change_rows(eng, t, changed, params)
        total += n
        back.append(df)
    names = [ROWID, *[quote(c.name) for c in t.columns]]
    merged = reduce(DataFrame.unionByName, [df.select(*names) for df in back]) if back else eng.rows(t).limit(0)
    return returning(eng, t, node.returning, merged, params, total)


def nodes(x: Any) -> list[Node]:
    """All nodes below ``x``, itself included."""
    if isinstance(x, Node):
        return [x, *[n for k, v in x.__dict__.items() if k != "kind" for n in nodes(v)]]
    return [n for y in x for n in nodes(y)] if isinstance(x, (list, tuple)) else []


def of_excluded(x: Node) -> bool:
    """Whether an expression depends on the statement's own row alone."""
    return all(n.kind not in ("query", "select") and (n.kind != "column" or (n.table or "").lower() == "excluded") for n in nodes(x))


def folds_of(eng: Engine, t: Table, node: Node, key: tuple[str, ...], params: Any) -> dict[str, tuple[str, str]] | None:
    """(how, SQL of the part that depends on the own row) of each SET: "last" for an expression of ``excluded`` alone, "sum"
    for a whole-number column plus one. None if some SET is neither, or if versions between would be seen: by WHERE, by
    triggers, by unique keys and by foreign keys."""
    u, names = node.upserts[0], {(node.alias or t.name).lower(), ""}
    sets = {t.column(n).name for n, _ in u.sets if t.column(n)}
    watched = {c for k in (*t.keys, key, *[fk.columns for fk in t.foreign]) for c in k} | {t.id_column}
    watched |= {c for index in computed_indexes(eng, t) for c in read_by(t, index)}
    generated = {c.name for c in t.columns if c.generated is not None}
    if u.where is not None or (sets | generated) & watched or len(sets) < len(u.sets) or any(matching(eng, t.name, when, "UPDATE", sets) for when in ("BEFORE", "AFTER")):
        return None
    kinds = [(c.name, spark_type(c.type)) for c in t.columns]
    e = Emitter(eng, params)
    e.scope = Scope([Relation(node.alias or t.name, kinds, ROWID), Relation("excluded", kinds)])
    found = {}
    for n, x in u.sets:
        c = t.column(n)
        if of_excluded(x):
            found[c.name] = "last", e.value(e.expr(x))[0]
            continue
        if x.kind != "binary" or x.op != "+" or spark_type(c.type) != "int":
            return None
        own = [y for y in (x.left, x.right) if y.kind == "column" and (y.table or "").lower() in names and y.name.lower() == c.name.lower()]
        other = x.right if own and own[0] is x.left else x.left
        if len(own) != 1 or not of_excluded(other):
            return None
        sql, kind = e.value(e.expr(other))
        if kind != "int":
            return None
        found[c.name] = "sum", sql
    return found


def upsert_at_once(eng: Engine, t: Table, node: Node, new: DataFrame, key: tuple[str, ...], folds: dict[str, tuple[str, str]], params: Any) -> ExecResult:
    """Every row's version of its key's row by windows in the order of the rows; the last version of each key is written,
    all of them are validated, counted and returned."""
    alias = node.alias or t.name
    fresh = stage(eng, semi(new.filter("__turn = 1").drop("__turn"), eng.rows(t), key, how="left_anti"))
    total = add_rows(eng, t, fresh, params=params)
    t = eng.table(t.name)
    held = semi(new.drop("__turn"), fresh, (POS,), how="left_anti").alias("excluded")
    joined = eng.rows(t).alias(alias).join(held, reduce(lambda x, y: x & y, [F.col(f"{quote(alias)}.{quote(c)}") == F.col(f"excluded.{quote(c)}") for c in key]))
    window = f"PARTITION BY {', '.join(f'excluded.{quote(c)}' for c in key)} ORDER BY excluded.{POS}"
    so_far = f"OVER ({window} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"

    def version(c: Any) -> SparkColumn:
        old = f"{quote(alias)}.{quote(c.name)}"
        if c.name not in folds:
            return F.expr(old).alias(c.name)
        how, sql = folds[c.name]
        value = sql if how == "last" else f"CASE WHEN count_if(({sql}) IS NULL) {so_far} = 0 THEN {old} + SUM({sql}) {so_far} END"
        return F.expr(f"CAST({value} AS {c.type.simpleString()})").alias(c.name)

    versions = joined.select(F.col(f"{quote(alias)}.{ROWID}").alias(OLD), F.col(f"{quote(alias)}.{ROWID}").alias(ROWID), F.expr(f"LEAD(excluded.{POS}) OVER ({window}) IS NULL").alias("__last"), *[version(c) for c in t.columns])
    versions = stage(eng, eng.computed(t, versions, [c for c in t.columns if c.generated is not None]))
    n, _ = validate(eng, t, versions, params)
    names = [ROWID, *[quote(c.name) for c in t.columns]]
    if n:
        change_rows(eng, t, versions.filter("__last").select(OLD, *names[1:]), params, set(folds))
    return returning(eng, t, node.returning, fresh.select(*names).unionByName(versions.select(*names)), params, total + n)


# update and delete


def chosen(eng: Engine, t: Table, node: Node, params: Any) -> str:
    """For ORDER BY and LIMIT: a condition on the row ids."""
    if node.limit is None and not node.order:
        return ""
    e = Emitter(eng, params)
    view, columns, _, fts = eng.relation(t.name)
    alias = node.alias or t.name
    e.scope = Scope([Relation(alias, columns, ROWID, fts)])
    where = f" WHERE {e.cond(node.where)}" if node.where is not None else ""
    q = Node("query", limit=node.limit, offset=node.offset)
    keys = ", ".join(filter(None, [e.order(node.order), f"{quote(alias)}.{ROWID}"]))
    picked = eng.spark.sql(f"SELECT {quote(alias)}.{ROWID} AS id FROM {view} AS {quote(alias)}{where} ORDER BY {keys}{e.limits(q)}")
    return f"{quote(alias)}.{ROWID} IN (SELECT id FROM {eng.temporary(picked)})"


def update(eng: Engine, node: Node, params: Any) -> ExecResult:
    if view_trigger(eng, node.table, "UPDATE"):
        return instead(eng, node, params)
    t = eng.table(node.table)
    if t.module in ("rtree", "vec_index"):
        raise SqlError(f"table {t.name} may not be modified")
    alias = node.alias or t.name
    e = Emitter(eng, params)
    e.scope = Scope([])
    own = Node("table", name=node.table, alias=alias)
    source = e.source(Node("join", how="CROSS", left=own, right=node.source, on=None, using=None, natural=False) if node.source is not None else own)
    e.scope.relations[0].rowid = ROWID
    sets = {}
    for name, x in node.sets:
        c = t.column(name)
        if c is None:
            raise SqlError(f"no such column: {name}")
        if c.generated is not None:
            raise SqlError(f"cannot UPDATE generated column {c.name!r}")
        sql, kind = e.value(e.expr(x))
        sets[c.name] = e.text((sql, kind)) if c.kind == "text" and kind not in ("text", "json", "null") else sql
    conditions = [x for x in (e.cond(node.where) if node.where is not None else "", chosen(eng, t, node, params)) if x]
    columns = ", ".join(f"CAST({sets[c.name]} AS {c.type.simpleString()}) AS {quote(c.name)}" if c.name in sets else f"{quote(alias)}.{quote(c.name)}" for c in t.columns)
    changed = eng.spark.sql(f"SELECT {quote(alias)}.{ROWID} AS {OLD}, {columns} FROM {source}{' WHERE ' + ' AND '.join(conditions) if conditions else ''}")
    if node.source is not None:  # several matches: the one with the largest new values
        order = [F.col(quote(c)).desc() for c in sets]
        changed = changed.withColumn("__n", F.row_number().over(Window.partitionBy(OLD).orderBy(*order))).filter("__n = 1").drop("__n")
    n, df = change_rows(eng, t, changed, params, set(sets))
    return returning(eng, t, node.returning, df, params, n)


def change_rows(eng: Engine, t: Table, changed: DataFrame, params: Any = None, sets: set[str] | None = None) -> tuple[int, DataFrame]:
    """Puts new versions (with their old row ids in ``OLD``) in the place of rows."""
    id_now = F.col(quote(t.id_column)) if t.id_column else F.col(OLD)
    changed = changed.withColumn(ROWID, id_now)
    changed = stage(eng, eng.computed(t, changed, [c for c in t.columns if c.generated is not None]).select(OLD, ROWID, *[quote(c.name) for c in t.columns]))
    n, _ = validate(eng, t, changed, params)
    if not n:
        return 0, changed
    before = stage(eng, semi(eng.rows(t), changed, (ROWID,), (OLD,)))
    check_unique(eng, t, changed, semi(eng.rows(t), changed, (ROWID,), (OLD,), "left_anti"), sets)
    fire(eng, t, "BEFORE", "UPDATE", changed, before, sets)
    put(eng, t, changed, before)
    check_parents(eng, t, changed)
    follow_parents(eng, t, before, changed)
    fire(eng, t, "AFTER", "UPDATE", changed, before, sets)
    return n, changed


def delete(eng: Engine, node: Node, params: Any) -> ExecResult:
    if view_trigger(eng, node.table, "DELETE"):
        return instead(eng, node, params)
    t = eng.table(node.table)
    if t.module in ("rtree", "vec_index"):
        raise SqlError(f"table {t.name} may not be modified")
    alias = node.alias or t.name
    e = Emitter(eng, params)
    e.scope = Scope([])
    source = e.source(Node("table", name=node.table, alias=alias))
    e.scope.relations[0].rowid = ROWID
    conditions = [x for x in (e.cond(node.where) if node.where is not None else "", chosen(eng, t, node, params)) if x]
    doomed = stage(eng, eng.spark.sql(f"SELECT {quote(alias)}.{ROWID}, {', '.join(f'{quote(alias)}.{quote(c.name)}' for c in t.columns)} FROM {source}{' WHERE ' + ' AND '.join(conditions) if conditions else ''}"))
    return returning(eng, t, node.returning, doomed, params, remove_rows(eng, t, doomed))


def remove_rows(eng: Engine, t: Table, doomed: DataFrame) -> int:
    n = doomed.count()
    if n:
        fire(eng, t, "BEFORE", "DELETE", None, doomed)
        put(eng, t, None, doomed)
        follow_parents(eng, t, doomed, None)
        fire(eng, t, "AFTER", "DELETE", None, doomed)
    return n


def follow_parents(eng: Engine, t: Table, before: DataFrame, after: DataFrame | None) -> None:
    """What foreign keys ask for when parents' keys are gone or changed; child tables follow set by set."""
    if not eng.foreign_keys:
        return
    for child, fk in children_of(eng, t):
        parent = tuple(t.column(c).name for c in (fk.parent or t.primary))
        gone = semi(before, eng.rows(eng.table(t.name)), parent, how="left_anti").filter(~any_null(parent))
        child = eng.table(child.name)
        hit = stage(eng, semi(eng.rows(child), gone, fk.columns, parent))
        if hit.isEmpty():
            continue
        action = fk.delete if after is None else fk.update
        if action in ("NO ACTION", "RESTRICT"):
            raise SqlError("FOREIGN KEY constraint failed")
        if action == "CASCADE" and after is None:
            remove_rows(eng, child, hit)
            continue
        if action == "CASCADE":
            moved = gone.select(F.col(ROWID).alias("__was"), *[F.col(quote(c)).alias(f"__o{i}") for i, c in enumerate(parent)])
            moved = moved.join(after.select(F.col(OLD).alias("__was"), *[F.col(quote(c)).alias(f"__n{i}") for i, c in enumerate(parent)]), "__was")
            joined = hit.join(moved, reduce(lambda x, y: x & y, [hit[quote(c)] == F.col(f"__o{i}") for i, c in enumerate(fk.columns)]))
            value = {c.lower(): F.col(f"__n{i}") for i, c in enumerate(fk.columns)}
        else:
            joined = hit
            e = Emitter(eng)
            value = {c.lower(): F.lit(None) if action == "SET NULL" or child.column(c).default is None else F.expr(e.value(e.expr(child.column(c).default))[0]) for c in fk.columns}
        changed = joined.select(F.col(ROWID).alias(OLD), *[(value[c.name.lower()].cast(c.type) if c.name.lower() in value else hit[quote(c.name)]).alias(c.name) for c in child.columns])
        change_rows(eng, child, changed)


# triggers


def substitute(node: Any, rows: dict[str, dict[str, Any]]) -> Any:
    """``node`` with NEW.x and OLD.x replaced by literals."""
    if isinstance(node, Node):
        if node.kind == "column" and node.table and node.table.lower() in rows:
            return Node("literal", value=rows[node.table.lower()].get(node.name.lower()))
        return Node(node.kind, **{k: substitute(v, rows) for k, v in node.__dict__.items() if k != "kind"})
    if isinstance(node, list):
        return [substitute(x, rows) for x in node]
    return tuple(substitute(x, rows) for x in node) if isinstance(node, tuple) else node


def matching(eng: Engine, name: str, timing: str, event: str, sets: set[str] | None = None) -> list[Trigger]:
    low = {s.lower() for s in sets or ()}
    return [g for _, g in sorted(eng.catalog.triggers.items()) if g.table.lower() == name.lower() and g.timing == timing and g.event == event and (not g.columns or sets is None or low & {c.lower() for c in g.columns})]


def fire(eng: Engine, t: Table, timing: str, event: str, new: DataFrame | None, old: DataFrame | None, sets: set[str] | None = None) -> None:
    """Triggers of the rows. A body of INSERTs of values becomes one INSERT ... SELECT over all rows for each of them; other
    bodies run row by row, as a statement may see what the rows before it have changed."""
    for g in matching(eng, t.name, timing, event, sets):
        if eng.depth >= TRIGGER_DEPTH:
            raise SqlError("too many levels of trigger recursion")
        eng.depth += 1
        try:
            if runs_as_set(eng, g):
                for statement in g.body:
                    fire_set(eng, t, g, statement, new, old)
            else:
                fire_rows(eng, t, g, new, old)
        finally:
            eng.depth -= 1


def runs_as_set(eng: Engine, g: Trigger) -> bool:
    """Whether a body is INSERTs of one line of values that read no table, into tables that differ and have no triggers (or
    one INSERT, into any table): then their order among the rows cannot be seen."""
    for s in g.body:
        if s.kind != "insert" or s.upserts or s.query is None or s.query.body.kind != "values" or len(s.query.body.rows) != 1:
            return False
        if any(n.kind in ("query", "select") for n in nodes([s.query.body.rows[0], g.when])):
            return False
    targets = [s.table.lower() for s in g.body]
    alone = len(set(targets)) == len(targets) and not any(h.table.lower() in targets for h in eng.catalog.triggers.values())
    return len(g.body) == 1 or alone


def fire_set(eng: Engine, t: Table, g: Trigger, body: Node, new: DataFrame | None, old: DataFrame | None) -> None:
    kinds = [(c.name, spark_type(c.type)) for c in t.columns]
    source, on_ = None, None
    for name, df in (("new", new), ("old", old)):
        if df is None:
            continue
        key = OLD if name == "new" and old is not None else ROWID
        view = f"__{name}_{id(df)}"
        eng.sources[view] = (eng.temporary(df.withColumn("__row", F.col(key))), [*kinds, ("__row", "int")])
        own = Node("table", name=view, alias=name)
        on_ = Node("binary", op="=", left=Node("column", table="new", name="__row"), right=Node("column", table="old", name="__row"))
        source = own if source is None else Node("join", how="INNER", left=source, right=own, on=on_, using=None, natural=False)
    items = [Node("item", arg=x, alias=None, text="x") for x in body.query.body.rows[0]]
    select = Node("select", distinct=False, items=items, source=source, where=g.when, group=[], having=None, windows=[])
    order = [Node("order", arg=Node("column", table="new" if new is not None else "old", name="__row"), down=False, nulls=None)]
    query = Node("query", ctes=[], recursive=False, body=select, order=order, limit=None, offset=None)
    run_body(eng, Node("insert", **{**{k: v for k, v in body.__dict__.items() if k != "kind"}, "query": query}))


def run_body(eng: Engine, statement: Node) -> None:
    state = dict(eng.state)
    eng.run(statement)
    eng.state.update({k: state[k] for k in ("changes", "last_insert_rowid")})


def fire_rows(eng: Engine, t: Table, g: Trigger, new: DataFrame | None, old: DataFrame | None) -> None:
    sides = []
    for name, df in (("new", new), ("old", old)):
        if df is not None:
            key = OLD if name == "new" and old is not None else ROWID
            sides.append(df.select(F.col(key).alias("__key"), F.struct(F.col(ROWID).alias("__id"), *[F.col(quote(c.name)) for c in t.columns]).alias(name)))
    for r in reduce(lambda a, b: a.join(b, "__key"), sides).orderBy("__key").toLocalIterator():  # a partition at a time
        rows = {name: {c.name.lower(): r[name][c.name] for c in t.columns} | {"rowid": r[name]["__id"]} for name in r.asDict() if name != "__key"}
        if g.when is not None:
            e = Emitter(eng)
            if not eng.spark.sql(f"SELECT coalesce({e.cond(substitute(g.when, rows))}, false)").first()[0]:
                continue
        for statement in g.body:
            bound = substitute(statement, rows)
            eng.run(bound).collect() if bound.kind == "query" else run_body(eng, bound)


def view_trigger(eng: Engine, name: str, event: str) -> bool:
    return name.lower() in eng.catalog.views and bool(matching(eng, name, "INSTEAD OF", event))


def instead(eng: Engine, node: Node, params: Any) -> ExecResult:
    """INSTEAD OF triggers of a view, row by row."""
    view = eng.catalog.views[node.table.lower()]
    _, columns, _, _ = eng.relation(view.name)
    t = Table(view.name, tuple(column_of(n, k) for n, k in columns))
    if node.kind == "insert":
        new, old = incoming(eng, t, node, node.columns or [c for c, _ in columns], params).withColumn(ROWID, F.col(POS)), None
    else:
        e = Emitter(eng, params)
        e.scope = Scope([])
        alias = node.alias or view.name
        source = e.source(Node("table", name=node.table, alias=alias))
        where = f" WHERE {e.cond(node.where)}" if node.where is not None else ""
        old = numbered(eng, eng.spark.sql(f"SELECT * FROM {source}{where}")).withColumn(ROWID, F.col(POS))
        new = None
        if node.kind == "update":
            sets = {n.lower(): e.value(e.expr(x))[0] for n, x in node.sets}
            new = old.alias(alias).select(F.col(ROWID).alias(OLD), F.col(ROWID), *[F.expr(sets[c.lower()]).alias(c) if c.lower() in sets else F.col(quote(c)) for c, _ in columns])
    n = (new if new is not None else old).count()
    for g in matching(eng, view.name, "INSTEAD OF", node.kind.upper()):
        eng.depth += 1
        try:
            fire_rows(eng, t, g, new, old)
        finally:
            eng.depth -= 1
    return ExecResult(n)


def column_of(name: str, kind: str) -> Any:
    from quern.catalog import SPARK, Column

    return Column(name, kind, kind, spark=SPARK.get(kind))
