"""Tables, views, indexes and triggers as values that never change.

A catalog is replaced, not edited, so a transaction or savepoint is a reference to an older
one. A table's rows are layers: each statement adds one, the rows it adds and the ids of those
it removes, as Parquet; a table is its layers laid over each other, and small layers are
merged when there are many. Layers are never rewritten in place, so readers keep what they began with.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import types as T

from quern.dialect.emit import ROWID
from quern.dialect.parser import Node

__all__ = ["Catalog", "Column", "ForeignKey", "Index", "Layer", "Table", "Trigger", "View", "affinity", "replace"]


def affinity(declared: str) -> str:
    """int, text, blob, real or numeric, by the parts of a declared type's name."""
    up = declared.upper()
    if "INT" in up:
        return "int"
    if any(x in up for x in ("CHAR", "CLOB", "TEXT", "STRING")):
        return "text"
    if "BLOB" in up:
        return "blob"
    return "real" if any(x in up for x in ("REAL", "FLOA", "DOUB")) else "numeric"


def column_type(declared: str) -> str:
    """A column's one static type. Dates and times are texts, Booleans whole numbers, other numerics doubles."""
    kind, up = affinity(declared), declared.upper()
    if kind == "numeric":
        return "text" if not up or any(x in up for x in ("DATE", "TIME", "JSON")) else "int" if "BOOL" in up else "real"
    return "vector" if up.startswith("VECTOR") else kind


SPARK = {"int": T.LongType(), "real": T.DoubleType(), "text": T.StringType(), "blob": T.BinaryType(), "vector": T.ArrayType(T.FloatType()), "null": T.StringType(), "json": T.StringType(), "bool": T.LongType()}


@dataclass(frozen=True)
class Column:
    name: str
    declared: str
    kind: str
    notnull: bool = False
    pk: int = 0
    unique: bool = False
    default: Node | None = None
    generated: Node | None = None
    stored: bool = True
    spark: Any = None  # a Spark type without a counterpart among the dialect's

    @property
    def type(self) -> T.DataType:
        return self.spark or SPARK[self.kind]


@dataclass(frozen=True)
class ForeignKey:
    columns: tuple[str, ...]
    table: str
    parent: tuple[str, ...] | None
    delete: str = "NO ACTION"
    update: str = "NO ACTION"


@dataclass(frozen=True)
class Layer:
    added: str | None  #: folder of Parquet files
    removed: str | None  #: folder of row ids that no longer count in the layers below
    size: int = 0  #: bytes of both


@dataclass(frozen=True)
class Table:
    name: str
    columns: tuple[Column, ...]
    checks: tuple[tuple[Node, str], ...] = ()
    uniques: tuple[tuple[str, ...], ...] = ()
    foreign: tuple[ForeignKey, ...] = ()
    without_rowid: bool = False
    auto: bool = False
    sequence: int = 0
    layers: tuple[Layer, ...] = ()
    sql: str = ""
    module: str = ""
    options: tuple[tuple[str, Any], ...] = ()

    def column(self, name: str) -> Column | None:
        return next((c for c in self.columns if c.name.lower() == name.lower()), None)

    @property
    def primary(self) -> tuple[str, ...]:
        return tuple(c.name for c in sorted((c for c in self.columns if c.pk), key=lambda c: c.pk))

    @property
    def id_column(self) -> str | None:
        """The INTEGER PRIMARY KEY column, which is the row id."""
        own = [c for c in self.columns if c.pk]
        return own[0].name if len(own) == 1 and own[0].declared.upper() == "INTEGER" and not self.without_rowid else None

    @property
    def keys(self) -> list[tuple[str, ...]]:
        """Sets of columns whose values are unique together; the primary key first."""
        found = [self.primary] if self.primary else []
        return found + [k for k in [*((c.name,) for c in self.columns if c.unique), *self.uniques] if k not in found]

    @property
    def stored(self) -> list[Column]:
        return [c for c in self.columns if c.generated is None or c.stored]

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(ROWID, T.LongType()), *[T.StructField(c.name, c.type) for c in self.stored]])


@dataclass(frozen=True)
class View:
    name: str
    columns: tuple[str, ...] | None
    query: Node
    sql: str


@dataclass(frozen=True)
class Index:
    name: str
    table: str
    columns: tuple[Node, ...]
    unique: bool
    where: Node | None
    sql: str

    @property
    def computed(self) -> bool:
        """Whether it is unique over expressions or over some rows, so that it is no key of columns."""
        return self.unique and (self.where is not None or any(c.kind != "column" for c in self.columns))


@dataclass(frozen=True)
class Trigger:
    name: str
    table: str
    timing: str
    event: str
    columns: tuple[str, ...] | None
    when: Node | None
    body: tuple[Node, ...]
    sql: str


@dataclass(frozen=True)
class Catalog:
    tables: dict[str, Table] = field(default_factory=dict)
    views: dict[str, View] = field(default_factory=dict)
    indexes: dict[str, Index] = field(default_factory=dict)
    triggers: dict[str, Trigger] = field(default_factory=dict)

    def put(self, kind: str, name: str, value: Any) -> Catalog:
        return replace(self, **{kind: {**getattr(self, kind), name.lower(): value}})

    def drop(self, kind: str, name: str) -> Catalog:
        return replace(self, **{kind: {k: v for k, v in getattr(self, kind).items() if k != name.lower()}})
