"""Window forms that Spark's own do not have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def groups_frame(df: DataFrame, aggregate: Column, name: str, partition: list[str], order: str, before: int | None, after: int | None) -> DataFrame:
    """``df`` with ``name``: ``aggregate`` over GROUPS BETWEEN ``before`` PRECEDING AND ``after`` FOLLOWING (None: unbounded).

    Peers share a dense rank, so the frame is a range of ranks. A frame to the end is a running one in the order from the
    end, since Spark adds up frames to the end anew for each row.
    """
    parts = [F.col(p) for p in partition]
    ranked = df.withColumn("__group", F.dense_rank().over(Window.partitionBy(*parts).orderBy(order)))
    ranks = F.col("__group")
    if after is None and before is not None:
        ranks, before, after = ranks.desc(), None, before
    low = Window.unboundedPreceding if before is None else -before
    high = Window.unboundedFollowing if after is None else after
    return ranked.withColumn(name, aggregate.over(Window.partitionBy(*parts).orderBy(ranks).rangeBetween(low, high))).drop("__group")


def ntile(n: int, partition: list[str], *order: Column | str) -> Column:
    """Buckets of i * n / rows + 1, which spread the larger buckets evenly."""
    w = Window.partitionBy(*partition)
    return F.floor((F.row_number().over(w.orderBy(*order)) - 1).cast("long") * n / F.count("*").over(w)).cast("long") + 1
