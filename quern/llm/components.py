"""Connected components of a graph whose edges are a DataFrame.

Large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce and
Beyond") turn the edges into stars around each component's smallest node, in a number of
rounds that grows with the logarithm of the component's size. Edges stay distributed; each
round is cut off by a checkpoint in the shared folder, and only their count and whether any is
left to turn reach the driver. Up to ``FEW`` edges, each task gets all minima; beyond, a node's edges are dealt to up to ``SALTS`` tasks by their other ends, each
with a partial minimum, so the hub of a star with most of the edges is no single task's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import checkpoint


SALTS, FEW = 256, 250_000


def with_least(edges: DataFrame, own: bool, few: bool) -> DataFrame:
    """``edges`` (u, v) with ``m``, the smallest v of u's edges, or of these and u itself (``own``)."""
    if few:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        return edges.join(F.broadcast(least.select("u", F.least("u", "m").alias("m")) if own else least), "u")
    dealt = edges.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    partial = dealt.groupBy("u", "s").agg(F.min("v").alias("p"))
    least = partial.groupBy("u").agg(F.min("p").alias("m"), F.collect_list("s").alias("s"))  # at most SALTS in a list
    least = least.select("u", F.explode("s").alias("s"), (F.least("u", "m") if own else F.col("m")).alias("m"))
    return dealt.join(least.hint("merge"), ["u", "s"]).drop("s")


def large_star(edges: DataFrame, few: bool) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of the node and its neighbours."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return with_least(both, True, few).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame, few: bool) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    linked = with_least(edges, False, few)
    pairs = F.when(F.col("v") == F.col("m"), F.array(F.struct("u", F.col("m").alias("v")))).otherwise(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
    return linked.select(F.explode(pairs).alias("p")).select("p.u", "p.v").distinct()


def are_stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour and no larger one, or only larger ones."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up")))).alias("e"))
    turns = ends.groupBy("e.x").agg(F.sum("e.up").alias("up"), F.min("e.up").alias("least"))
    return turns.filter("up > 1 OR up = 1 AND least = 0").isEmpty()


def components(pairs: DataFrame, rounds: int = 64, most: int = FEW) -> DataFrame:
    """(node, root) for each node of ``pairs`` (columns u, v of one orderable type) but the roots, the smallest of each
    component. Pairs of equal or null nodes are ignored, repeated pairs count once; no pairs give no rows."""
    edges = checkpoint(pairs.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(rounds):
        if are_stars(edges):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        few = edges.count() <= most
        edges = checkpoint(small_star(checkpoint(large_star(edges, few)), few))
    raise RuntimeError(f"no end after {rounds} rounds")
