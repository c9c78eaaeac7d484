"""All queries of the engine by name, with their SQL for a second engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.engine import Engine
from quern.plans import relational, scalars, search, statements

Query = Callable[[SparkSession, str], DataFrame]

FLAGSHIP = """
SELECT n_name, round(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue,
       RANK() OVER (ORDER BY round(SUM(l_extendedprice * (1 - l_discount)), 2) DESC) AS revenue_rank
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE l_shipdate >= '1997-01-01'
GROUP BY n_name ORDER BY revenue DESC, n_name LIMIT 10
"""
PLAIN = {"q_flagship_revenue_by_nation": ("lineitem orders customer nation", FLAGSHIP, None), **relational.QUERIES, **scalars.QUERIES}


def plain(tables: str, sql: str) -> Query:
    return lambda spark, sf_dir: Engine(spark).load(sf_dir, *tables.split()).query(sql)


def after(setup: str, sql: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine(spark).load(sf_dir, "nation", "region", "documents", "embeddings")
        engine.execute_many(setup)
        return engine.query(sql)

    return run


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {name: plain(tables, sql) for name, (tables, sql, _) in PLAIN.items()}
    found |= {name: query for name, (query, _) in search.QUERIES.items()}
    return found | {name: after(setup, sql) for name, (setup, sql, _) in statements.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: other or sql for name, (_, sql, other) in PLAIN.items()}
    found |= {name: sql for name, (_, sql) in search.QUERIES.items() if sql}
    return found | {name: sql for name, (_, _, sql) in statements.QUERIES.items()}
