"""Recursion over DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def recursive_union(first: DataFrame, step: Callable[[DataFrame], DataFrame], rounds: int = 1000) -> DataFrame:
    """All distinct rows of ``first`` and of ``step`` applied to each round's new rows, until none are new.

    Each round's rows are cut off from their history by a checkpoint in the shared folder. An
    error, not a silent stop, if ``rounds`` do not suffice.
    """
    context = first.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(first.sparkSession.conf.get("spark.checkpoint.dir", None) or "file:///tmp/checkpoints")
    delta = first.distinct().checkpoint()
    found = delta
    for _ in range(rounds):
        new = step(delta).toDF(*first.columns).distinct().exceptAll(found).checkpoint()
        if new.isEmpty():
            return found
        found, delta = found.unionAll(new), new
    raise RuntimeError(f"the recursion goes on after {rounds} rounds")
