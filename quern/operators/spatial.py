"""Boxes: overlap with given bounds, and overlap joins by a grid."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overlaps(low: list[str], high: list[str], bounds: list[tuple[float, float] | None]) -> Column:
    """Whether a box touches the bounds in every bounded dimension; a plain filter that reaches the scan."""
    tests = [(F.col(h) >= b[0]) & (F.col(l) <= b[1]) for l, h, b in zip(low, high, bounds) if b is not None]
    return reduce(lambda x, y: x & y, tests) if tests else F.lit(True)


def cell_sizes(boxes: list[tuple[DataFrame, list[str], list[str]]]) -> list[float]:
    """Twice the mean extent of all boxes in each dimension."""
    sizes = []
    for d in range(len(boxes[0][1])):
        means = [df.agg(F.avg(F.col(high[d]) - F.col(low[d]))).first()[0] or 0.0 for df, low, high in boxes]
        sizes.append(max(1e-9, 2 * max(means)) if max(means) > 0 else 1.0)
    return sizes


#: What a cell must hold of a side's dealt boxes to be split (a ``HOT``-th, so fewer than ``HOT`` cells a side can), and into how many.
HOT, SALTS = 1000, 16


def split_hot(left: DataFrame, right: DataFrame, cell: list[str], hot_rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with salts ``__a`` and ``__b`` beside the cell. In a cell that is hot on the left, each left box takes
    one of ``SALTS`` values of ``__a`` and each right box all of them; on the right likewise with ``__b``. Elsewhere both
    salts are 0. So two boxes of a cell meet once, and no task holds a whole hot cell."""

    def hot_cells(df: DataFrame, tag: str) -> DataFrame | None:
        counts = df.groupBy(*cell).count()
        total, most = counts.agg(F.sum("count"), F.max("count")).first()
        least = max(hot_rows, (total or 0) / HOT)
        return counts.filter(F.col("count") > least).select(*cell, F.lit(tag).alias("__side")) if (most or 0) > least else None

    found = [x for x in (hot_cells(left, "l"), hot_cells(right, "r")) if x is not None]
    if not found:
        return tuple(df.withColumns({"__a": F.lit(0), "__b": F.lit(0)}) for df in (left, right))
    sides = reduce(DataFrame.unionAll, found).groupBy(*cell)
    hot = F.broadcast(sides.agg(F.max(F.col("__side") == "l").alias("__hot_l"), F.max(F.col("__side") == "r").alias("__hot_r")))  # fewer than 2 * HOT rows

    def salted(df: DataFrame, own: str, one: str, other: str, is_hot: str, other_hot: str) -> DataFrame:
        drawn = F.pmod(F.xxhash64(own), F.lit(SALTS)).cast("int")
        spread = F.when(F.col(other_hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        df = df.join(hot, cell, "left").withColumn(one, F.when(F.col(is_hot), drawn).otherwise(0)).withColumn(other, F.explode(spread))
        return df.drop("__hot_l", "__hot_r")

    return salted(left, left.columns[0], "__a", "__b", "__hot_l", "__hot_r"), salted(right, right.columns[0], "__b", "__a", "__hot_r", "__hot_l")


def overlap_join(left: DataFrame, right: DataFrame, left_id: str, right_id: str, low: list[str], high: list[str], sizes: list[float] | None = None, most_cells: int = 64, hot_rows: int = 1024) -> DataFrame:
    """(left_id, right_id) of all pairs of boxes that touch; ``left_id`` and ``right_id`` differ in name, the bounds do not.

    Both sides are dealt to the cells of a grid that they touch, cells are joined by equality,
    and a pair counts only in the first cell that both touch, so no pair repeats and nothing is
    deduplicated. A box that would touch more than ``most_cells`` cells lives in a coarser grid:
    its level is the number of times that cells had to double. Boxes of two levels meet in the
    coarser one, for which the finer side is dealt to each coarser level in use. Cells of more than
    ``hot_rows`` boxes that hold a ``HOT``-th of a side are split.
    """
    sizes = sizes or cell_sizes([(left, low, high), (right, low, high)])
    bound = float(most_cells) ** (1.0 / len(low))

    def leveled(df: DataFrame) -> DataFrame:
        spans = [(F.col(h) - F.col(l)) / s for l, h, s in zip(low, high, sizes)]
        widest = F.greatest(*spans) if len(spans) > 1 else spans[0]
        return df.withColumn("__level", F.when(widest > bound, F.ceil(F.log2(widest / bound))).otherwise(0).cast("int"))

    left, right = leveled(left), leveled(right)
    levels = sorted({r[0] for df in (left, right) for r in df.select("__level").distinct().collect()})  # a few numbers

    def first_cell(c: str, s: float) -> Column:
        return F.floor(F.col(c) / (F.lit(s) * F.pow(F.lit(2.0), F.col("__at")))).cast("long")

    def dealt(df: DataFrame, tag: str, own: str) -> DataFrame:
        at = F.array(*[F.lit(k) for k in levels])
        df = df.withColumn("__at", F.explode(F.filter(at, lambda k: k >= F.col("__level"))))
        for d, (l, h, s) in enumerate(zip(low, high, sizes)):
            df = df.withColumn(f"__from{d}", first_cell(l, s)).withColumn(f"__c{d}", F.explode(F.sequence(first_cell(l, s), first_cell(h, s))))
        keep = [F.col(own), F.col("__level").alias(f"__level_{tag}"), "__at", *[f"__c{d}" for d in range(len(low))]]
        keep += [F.col(x).alias(f"{x}_{tag}") for x in [*low, *high]] + [F.col(f"__from{d}").alias(f"__from{d}_{tag}") for d in range(len(low))]
        return df.select(*keep)

    cell = ["__at", *[f"__c{d}" for d in range(len(low))]]
    left, right = split_hot(dealt(left, "l", left_id), dealt(right, "r", right_id), cell, hot_rows)
    joined = left.join(right, [*cell, "__a", "__b"])
    tests = [F.col("__at") == F.greatest("__level_l", "__level_r")]
    for d, (l, h) in enumerate(zip(low, high)):
        tests += [F.col(f"{h}_l") >= F.col(f"{l}_r"), F.col(f"{l}_l") <= F.col(f"{h}_r"), F.col(f"__c{d}") == F.greatest(f"__from{d}_l", f"__from{d}_r")]
    return joined.filter(reduce(lambda x, y: x & y, tests)).select(left_id, right_id)
