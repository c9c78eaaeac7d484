"""A Spark query's rows against those of SQL in DuckDB."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "float": "FLOAT"}


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    return str([plain(x) for x in v]) if isinstance(v, list) else str(v)


def mismatch(spark, sf, query, sql) -> str:
    """Empty if rows, column names and types agree."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = query(spark, sf)
    columns, kinds = sorted(df.columns), dict(df.dtypes)
    got = con.execute(sql)
    names, types = [d[0] for d in got.description], {d[0]: str(d[1]) for d in got.description}
    if sorted(names) != columns:
        return f"columns {columns} and {sorted(names)}"
    if odd := {c: (kinds[c], types[c]) for c in columns if KINDS.get(kinds[c], kinds[c]) != types[c]}:
        return f"types {odd}"
    a = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    b = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in got.fetchall())
    return "" if a == b else f"{len(a)} and {len(b)} rows; {[x for x in zip(a, b) if x[0] != x[1]][:2]}"
