"""The engine: one connection to a database of tables, in SQL.

``query`` gives a DataFrame, ``execute`` changes tables and gives the number of changed rows
and what RETURNING names. Queries are translated and planned by Catalyst, without running.
Changes are sets of removed and added rows, written as a layer on the table (see ``catalog``).
"""

from __future__ import annotations

import itertools
import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.catalog import Catalog, Column, Layer, Table, replace
from quern.dialect.emit import ROWID, Emitter, Relation, Scope, quote, spark_type
from quern.dialect.parser import Node, SqlError, parse, split_statements
from quern.functions import scalar
from quern.functions.worker import located
from quern.sources import TABLES, read_table

__all__ = ["Engine", "ExecResult", "SqlError"]

COMPACT_AT = 8  #: layers of a table from which small ones are merged
SMALL_LAYER = 1 << 20  #: bytes that every layer counts for at least, when layers are merged
KEPT_MANIFESTS = 16  #: manifests before the last that stay, so that a late writer meets them
TRIGGER_DEPTH, RECURSIONS = 32, 1000


@dataclass
class ExecResult:
    rows_affected: int
    returning: DataFrame | None = None


class Engine:
    """``path``: a folder that holds the database; without one it lives as long as the session, in the shared folder."""

    numbers = itertools.count()

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark, self.path = spark, path
        self.tag = f"quern_{next(Engine.numbers)}"
        self.catalog = Catalog()
        self.sources: dict[str, tuple[str, list[tuple[str, str]]]] = {}
        self.attached: dict[str, Engine] = {}
        self.functions: dict[str, tuple[int, str]] = {}
        self.modules: dict[str, Callable[[Engine, list[str]], DataFrame]] = {}
        self.state = {"last_insert_rowid": 0, "changes": 0, "total_changes": 0}
        self.foreign_keys = False
        self.settings: dict[str, Any] = {"user_version": 0, "application_id": 0}
        self.saved: list[tuple[str | None, Catalog]] = []  # BEGIN, then savepoints
        self.registered: dict[str, Table] = {}
        self.needed: set[str] = set()  # Python functions that are registered
        self.depth = 0
        self.version = 0  # of the manifest that was read or written last
        self.stats: list[tuple[str, str | None, str]] = []
        if path:
            self.open()

    # public interface
    def load(self, sf_dir: str, *names: str) -> Engine:
        """Make the Parquet tables of a folder queryable."""
        for name in names or TABLES:
            self.register(name, read_table(self.spark, sf_dir, name))
        return self

    def register(self, name: str, df: DataFrame) -> Engine:
        """Make a DataFrame queryable as a table that is not changed."""
        view = f"{self.tag}_src_{name}"
        df.createOrReplaceTempView(view)
        self.sources[name.lower()] = (view, [(f.name, spark_type(f.dataType)) for f in df.schema.fields])
        return self

    def query(self, sql: str, params: list[Any] | None = None) -> DataFrame:
        """A query's rows; also those of PRAGMA, EXPLAIN QUERY PLAN and of RETURNING."""
        found = self.run(parse(sql), params, sql)
        if isinstance(found, ExecResult):
            return found.returning if found.returning is not None else self.frame([], "changes long")
        return found

    def execute(self, sql: str, params: list[Any] | None = None) -> ExecResult:
        found = self.run(parse(sql), params, sql)
        return found if isinstance(found, ExecResult) else ExecResult(0, found)

    def sql(self, sql: str, params: list[Any] | None = None) -> DataFrame | ExecResult:
        return self.run(parse(sql), params, sql)

    def query_one(self, sql: str, params: list[Any] | None = None) -> Any:
        return self.query(sql, params).first()

    def execute_many(self, sql: str) -> list[ExecResult]:
        """Statements between semicolons, in order."""
        return [self.execute(s) for s in split_statements(sql)]

    def create_function(self, name: str, n_args: int, fn: Callable[..., Any], returns: str = "string") -> None:
        """A scalar Python function; ``n_args`` -1 for any number. Built-in names cannot be replaced."""
        if name.upper() in scalar.CALLS:
            raise SqlError(f"{name} is built in")
        own = f"{self.tag}_fn_{name.lower()}"
        self.spark.udf.register(own, fn, returns)
        self.functions[name.upper()] = (n_args, spark_type(T._parse_datatype_string(returns)))

    def delete_function(self, name: str) -> bool:
        if self.functions.pop(name.upper(), None) is None:
            return False
        self.spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {self.tag}_fn_{name.lower()}")
        return True

    def register_module(self, name: str, build: Callable[[Engine, list[str]], DataFrame]) -> None:
        """A module for CREATE VIRTUAL TABLE: ``build`` gets the engine and the arguments and returns the rows."""
        self.modules[name.lower()] = build

    def export(self, folder: str) -> None:
        """Every table's rows as Parquet under ``folder``."""
        for t in self.catalog.tables.values():
            self.rows(t).drop(ROWID).write.mode("overwrite").parquet(f"{folder}/{t.name}.parquet")

    def import_tables(self, folder: str, *names: str) -> None:
        """The tables of an export as tables that can be changed."""
        for name in names:
            self.register(f"__import_{name}", self.spark.read.parquet(f"{folder}/{name}.parquet"))
            self.execute(f"CREATE TABLE {quote(name)} AS SELECT * FROM __import_{name}")

    # what the emitter asks
    def relation(self, name: str) -> tuple[str, list[tuple[str, str]], str | None, Table | None] | None:
        schema, _, last = name.rpartition(".")
        if schema and schema.lower() in self.attached:
            return self.attached[schema.lower()].relation(last)
        low = last.lower()
        if low in self.catalog.tables:
            t = self.catalog.tables[low]
            view = f"{self.tag}_tab_{low}"
            if self.registered.get(low) is not t:
                self.rows(t).createOrReplaceTempView(quote(view))
                self.registered[low] = t
            columns = [(c.name, spark_type(c.type)) for c in t.columns]
            return quote(view), columns, None if t.without_rowid else ROWID, t if t.module == "fts5" else None
        if low in self.catalog.views:
            v = self.catalog.views[low]
            inner = Emitter(self)
            sql, out = inner.inner(v.query)
            names = [(c, k) for c, (_, k) in zip(v.columns, out)] if v.columns else out
            return f"(SELECT * FROM ({sql}) AS __view({', '.join(quote(c) for c, _ in names)}))", names, None, None
        if low in self.sources:
            view, columns = self.sources[low]
            return quote(view), columns, None, None
        if low == "sqlite_stat1":
            return self.temporary(self.frame(self.stats, "tbl string, idx string, stat string")), [("tbl", "text"), ("idx", "text"), ("stat", "text")], None, None
        if low in ("sqlite_master", "sqlite_schema"):
            rows = [(k, v.name, getattr(v, "table", v.name), v.sql) for k, d in (("table", self.catalog.tables), ("index", self.catalog.indexes), ("view", self.catalog.views), ("trigger", self.catalog.triggers)) for v in d.values()]
            return self.temporary(self.frame(rows, "type string, name string, tbl_name string, sql string")), [(c, "text") for c in ("type", "name", "tbl_name", "sql")], None, None
        return None

    def call(self, e: Emitter, node: Node) -> tuple[str, str]:
        found = scalar.call(e, node)
        if found:
            return found
        if node.name not in self.functions:
            raise SqlError(f"no such function: {node.name}")
        n, kind = self.functions[node.name]
        if n >= 0 and n != len(node.args):
            raise SqlError(f"wrong number of arguments to function {node.name}()")
        return f"{self.tag}_fn_{node.name.lower()}({', '.join(e.value(e.expr(a))[0] for a in node.args)})", kind

    def need(self, name: str) -> None:
        if name not in self.needed and name in (made := scalar.vector_functions()):
            self.spark.sql(made[name])
            self.needed.add(name)
        if name not in self.needed:
            module, fn, returns, fixed = scalar.PYTHON[name]
            made = F.udf(located(module, fn), returns, useArrow=True)
            self.spark.udf.register(name, made if fixed else made.asNondeterministic())
            self.needed.add(name)

    def glob(self, value: str, constant: Any, pattern: str) -> str:
        return scalar.glob_sql(self, value, constant, pattern)

    def unpack(self, variant: str) -> str:
        return scalar.unpacked(variant)

    def to_json_value(self, e: Emitter, x: tuple[str, str]) -> str:
        return scalar.to_json_value(e, x)

    def table_function(self, e: Emitter, node: Node) -> tuple[str, list[tuple[str, str]]]:
        alias = quote(node.alias or node.name)
        if node.name in ("json_each", "json_tree"):
            name = f"quern_{node.name}"
            if name not in self.needed:
                deep, tree = node.name == "json_tree", located("quern.functions.json_values", "tree")

                class Rows:
                    def eval(self, text: str, path: str):  # noqa: ANN202
                        yield from tree(text, path or "$", deep)

                self.spark.udtf.register(name, F.udtf(Rows, returnType="key string, value string, type string, atom string, id long, parent long, fullkey string, path string"))
                self.needed.add(name)
            args = [e.text(e.expr(a)) for a in node.args] + ["'$'"] * (len(node.args) < 2)
            lateral = any(a.kind != "literal" and a.kind != "param" for a in node.args)
            kinds = ["json", "json", "text", "json", "int", "int", "text", "text"]
            return f"{'LATERAL ' * lateral}{name}({', '.join(args)}) AS {alias}", list(zip("key value type atom id parent fullkey path".split(), kinds))
        if node.name in ("series", "generate_series"):
            args = [e.whole(e.expr(a)) for a in node.args] + ["1L"] * (len(node.args) < 3)
            return f"(SELECT CAST(id AS BIGINT) AS value FROM range({args[0]}, {args[1]} + sign({args[2]}), {args[2]})) AS {alias}", [("value", "int")]
        raise SqlError(f"no such table function: {node.name}")

    def recursive_union(self, e: Emitter, name: str, out: list[tuple[str, str]], first: str, step: Node) -> None:
        """WITH RECURSIVE whose parts a UNION joins: rows that were found before do not go on."""
        from quern.operators.recursive import recursive_union

        e.ctes.pop(name.lower(), None)
        columns = [(c, "int" if k == "bool" else k) for c, k in out]

        def advance(delta: DataFrame) -> DataFrame:
            inner = Engine(self.spark)
            inner.__dict__.update({k: v for k, v in self.__dict__.items() if k != "sources"})
            inner.sources = {**self.sources}
            view = f"{self.tag}_delta"
            delta.createOrReplaceTempView(view)
            inner.sources[name.lower()] = (view, columns)
            sql, _ = Emitter(inner, e.params).inner(Node("query", ctes=[], recursive=False, body=step, order=[], limit=None, offset=None))
            return self.spark.sql(sql)

        found = recursive_union(self.spark.sql(first), advance, RECURSIONS)
        view = f"{self.tag}_rec_{name.lower()}"
        found.createOrReplaceTempView(view)
        self.sources[name.lower()] = (view, columns)

    def fts_match(self, t: Table, column: str | None, query: str) -> str:
        from quern.operators import fts

        return self.temporary(fts.match(self.fts_index(t), query, column).select("rowid"))

    def fts_scores(self, t: Table, query: str) -> str:
        from quern.operators import fts

        weights = dict(t.options).get("weights") or [1.0] * len(t.columns)
        return self.temporary(fts.bm25(self.fts_index(t), query, dict(zip((c.name for c in t.columns), weights))))

    def fts_index(self, t: Table) -> Any:
        from quern.operators import fts

        return fts.build(self.rows(t), ROWID, [c.name for c in t.columns])

    # rows
    def frame(self, rows: list[tuple], schema: str | T.StructType) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    def temporary(self, df: DataFrame) -> str:
        view = f"{self.tag}_tmp_{uuid.uuid4().hex}"
        df.createOrReplaceTempView(view)
        return view

    def rows(self, t: Table) -> DataFrame:
        """A table's live rows, with row ids and with virtual generated columns."""
        if t.module and t.module in self.modules:
            return self.modules[t.module](self, list(dict(t.options)["args"])).withColumn(ROWID, F.lit(None).cast("long"))
        if t.module in ("series", "generate_series"):
            a = [int(x) for x in dict(t.options)["args"]]
            step = a[2] if len(a) > 2 else 1
            return self.spark.range(a[0], a[1] + (1 if step > 0 else -1), step).select(F.monotonically_increasing_id().alias(ROWID), F.col("id").alias("value"))
        return self.computed(t, self.laid(t, t.layers), [c for c in t.columns if c.generated is not None and not c.stored]).select(ROWID, *[quote(c.name) for c in t.columns])

    def laid(self, t: Table, layers: tuple[Layer, ...]) -> DataFrame:
        """Layers laid over each other: row ids and stored columns."""
        df = None
        for layer in layers:
            if layer.removed and df is not None:
                df = df.join(self.spark.read.schema(f"`{ROWID}` bigint").parquet(layer.removed), ROWID, "left_anti")
            if layer.added:
                own = self.spark.read.schema(t.schema).parquet(layer.added)
                df = own if df is None else df.unionByName(own)
        return self.frame([], t.schema) if df is None else df

    def computed(self, t: Table, df: DataFrame, columns: list[Column]) -> DataFrame:
        for c in columns:
            e = self.emitter_on("__row", [(x.name, spark_type(x.type)) for x in t.columns])
            sql, _ = e.value(e.expr(c.generated))
            df = df.alias("__row").withColumn(c.name, F.expr(f"CAST({sql} AS {c.type.simpleString()})"))
        return df

    def emitter_on(self, alias: str, columns: list[tuple[str, str]], params: list[Any] | None = None) -> Emitter:
        e = Emitter(self, params)
        e.scope = Scope([Relation(alias, columns, ROWID)])
        return e

    def table(self, name: str) -> Table:
        schema, _, last = name.rpartition(".")
        found = self.catalog.tables.get(last.lower())
        if not found:
            raise SqlError(f"no such table: {name}")
        return found

    def folder(self) -> str:
        if self.path:
            return self.path
        conf = self.spark.conf.get("spark.checkpoint.dir", None) or self.spark.conf.get("spark.sql.warehouse.dir")
        return f"{conf.rstrip('/')}/{self.tag}-{self.spark.sparkContext.applicationId}"

    def write(self, df: DataFrame) -> str:
        where = f"{self.folder()}/data/{uuid.uuid4().hex}"
        df.write.parquet(where)
        return where

    def layer(self, added: DataFrame | None, removed: DataFrame | None) -> Layer:
        """A layer of frames that must not read what is not written yet."""
        folders = [self.write(df) if df is not None else None for df in (added, removed)]
        return Layer(*folders, sum(self.size(f) for f in folders if f))

    def size(self, folder: str) -> int:
        fs, p = self.hadoop(folder)
        return fs.getContentSummary(p).getLength()

    def layered(self, t: Table, added: DataFrame | None, removed: DataFrame | None) -> Table:
        """The table with a layer more."""
        names = [quote(ROWID), *[quote(c.name) for c in t.stored]]
        own = self.layer(added.select(*names) if added is not None else None, removed.select(ROWID) if removed is not None else None)
        t = replace(t, layers=(*t.layers, own))
        return self.compacted(t, small=True) if len(t.layers) > COMPACT_AT else t

    def compacted(self, t: Table, small: bool = False) -> Table:
        """The table with all layers merged into one; ``small``: only its last ones, back to a layer that is more than twice
        as large as those behind it together. So a row is written again about as often as the table's size doubles, and the
        number of layers grows with the logarithm of that size."""
        start = 0
        if small:
            start, behind = len(t.layers) - 1, max(t.layers[-1].size, SMALL_LAYER)
            while start and t.layers[start - 1].size <= 2 * behind:
                start -= 1
                behind += max(t.layers[start].size, SMALL_LAYER)
        if len(t.layers) - start < 2:
            return t
        tail = t.layers[start:]
        added = self.laid(t, tail).select(quote(ROWID), *[quote(c.name) for c in t.stored])
        gone = [self.spark.read.schema(f"`{ROWID}` bigint").parquet(x.removed) for x in tail if x.removed] if start else []
        return replace(t, layers=(*t.layers[:start], self.layer(added, reduce(DataFrame.unionAll, gone).distinct() if gone else None)))

    # statements
    def run(self, node: Node, params: list[Any] | None = None, sql: str = "") -> DataFrame | ExecResult:
        from quern import changes, definitions

        if node.kind == "query":
            return self.select(node, params)
        if node.kind in ("insert", "update", "delete"):
            before = self.catalog
            try:
                result = getattr(changes, node.kind)(self, node, params)
            except Exception:
                self.catalog = before
                if node.kind == "insert" and node.conflict == "ROLLBACK" and self.saved:
                    self.catalog, self.saved = self.saved[0][1], []
                raise
            self.state["changes"] = result.rows_affected
            self.state["total_changes"] += result.rows_affected
        else:
            result = definitions.run(self, node, params, sql)
        if not self.saved and self.depth == 0:
            self.publish()
        return result

    def select(self, node: Node, params: list[Any] | None = None) -> DataFrame:
        saved = dict(self.sources)
        try:
            sql, out = Emitter(self, params).query(node)
            return self.spark.sql(sql)
        finally:
            self.sources = saved

    def explain(self, sql: str) -> str:
        """The Spark SQL of a query."""
        return Emitter(self).query(parse(sql))[0]

    # persistence: numbered manifests beside the layers; the highest number is the database
    def hadoop(self, path: str) -> tuple[Any, Any]:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def manifests(self) -> list[int]:
        """The numbers of the manifests, in order. A manifest has its name only once it is whole."""
        fs, p = self.hadoop(f"{self.path}/manifests")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n[:-5]) for n in names if n[:-5].isdigit() and n.endswith(".json"))

    def manifest(self, number: int) -> str:
        return f"{self.path}/manifests/{number:012d}.json"

    def publish(self) -> None:
        """Writes the next manifest under another name and renames it, which fails if the number is taken: of two writers
        that began with the same manifest one gets an error."""
        if not self.path:
            return
        body = {
            "settings": self.settings,
            "definitions": [x.sql for d in (self.catalog.tables, self.catalog.indexes, self.catalog.views, self.catalog.triggers) for x in d.values()],
            "tables": {k: {"layers": [[x.added, x.removed, x.size] for x in t.layers], "sequence": t.sequence} for k, t in self.catalog.tables.items()},
        }
        there = self.manifests()
        if (there[-1] if there else 0) != self.version:
            self.overtaken()
        fs, new = self.hadoop(f"{self.path}/manifests/{uuid.uuid4().hex}.tmp")
        out = fs.create(new)
        out.write(bytearray(json.dumps(body).encode()))
        out.close()
        sc = self.spark.sparkContext
        hadoop = sc._jvm.org.apache.hadoop.fs
        no_overwrite = sc._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
        try:
            hadoop.FileContext.getFileContext(new.toUri(), sc._jsc.hadoopConfiguration()).rename(new, self.hadoop(self.manifest(self.version + 1))[1], no_overwrite)
        except Exception:
            fs.delete(new, False)
            if not fs.exists(self.hadoop(self.manifest(self.version + 1))[1]):
                raise
            self.overtaken()
        self.version += 1
        for n in there[:-KEPT_MANIFESTS]:
            fs.delete(self.hadoop(self.manifest(n))[1], False)

    def overtaken(self) -> None:
        """Another connection has published first: its tables are read, and the statement is undone."""
        self.open()
        raise SqlError("database is locked: another connection changed it; its state was read again")

    def read_manifest(self, number: int) -> dict[str, Any]:
        return json.loads(self.spark.read.text(self.manifest(number), wholetext=True).first()[0])

    def sweep(self, seconds: float) -> None:
        """Deletes folders of rows that this connection's tables and the kept manifests do not name, if they are older than
        ``seconds``: other connections may be writing younger ones."""
        fs, data = self.hadoop(f"{self.folder()}/data")
        if not fs.exists(data):
            return
        used = {f for t in self.catalog.tables.values() for x in t.layers for f in (x.added, x.removed)}
        for n in self.manifests() if self.path else ():
            used |= {f for t in self.read_manifest(n)["tables"].values() for x in t["layers"] for f in x[:2]}
        names, until = {f.rsplit("/", 1)[1] for f in used if f}, (time.time() - seconds) * 1000
        for status in fs.listStatus(data):
            if status.getPath().getName() not in names and status.getModificationTime() <= until:
                fs.delete(status.getPath(), True)

    def open(self) -> None:
        there = self.manifests()
        if not there:
            return
        body = self.read_manifest(there[-1])
        path, self.path, self.catalog = self.path, None, Catalog()
        for sql in body["definitions"]:
            self.execute(sql)
        self.path, self.settings, self.version = path, body["settings"], there[-1]
        for name, own in body["tables"].items():
            t = replace(self.catalog.tables[name], layers=tuple(Layer(*x) for x in own["layers"]), sequence=own["sequence"])
            self.catalog = self.catalog.put("tables", name, t)
