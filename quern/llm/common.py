"""What several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else. Pure ASCII takes the fast built-in."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def hash_pair(*cols: Column) -> Column:
    """128 bits as two XXH64 with different seeds, so that equal hashes mean equal values at any corpus size."""
    return F.struct(F.xxhash64(*cols).alias("a"), F.xxhash64(F.lit(1), *cols).alias("b"))


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.

    A folder of our own is set only where the session names none, as in tests.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or "file:///tmp/checkpoints")
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a copy in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: What a key must hold of all counted rows to be dealt to several tasks (a ``HOT``-th, so fewer than ``HOT`` keys can), and to how many.
HOT, SALTS = 1000, 64


def small(rows: DataFrame, most: int) -> bool:
    """Whether ``rows`` are at most ``most``, so that they may be sent to every task. They are counted for that."""
    return rows.count() <= most


def join_counted(rows: DataFrame, counted: DataFrame, keys: list[str], n: str, by: Column, how: str = "inner", most: int = 0) -> DataFrame:
    """``rows`` joined with ``counted``, which has one row per key and in ``n`` how many of ``rows`` have it; ``counted`` is
    read several times, so it should be written already. It is sent to every task if it has at most ``most`` rows; if not,
    hot keys are dealt to ``SALTS`` tasks each, by ``by``."""
    if most and small(counted, most):
        return rows.join(F.broadcast(counted), keys, how)
    total = counted.agg(F.sum(n)).first()[0] or 0
    is_hot = F.col(n) * HOT > total
    hot = F.broadcast(counted.filter(is_hot).select(*keys, F.lit(True).alias("__hot")))  # fewer than HOT rows
    salt = F.when(F.col("__hot").isNull(), F.lit(0)).otherwise(F.pmod(by, F.lit(SALTS)).cast("int"))
    salts = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    dealt = rows.join(hot, keys, "left").withColumn("__salt", salt).drop("__hot")
    return dealt.join(counted.withColumn("__salt", F.explode(salts)).hint("merge"), [*keys, "__salt"], how).drop("__salt")


def release() -> None:
    """Give the memory that a worker has freed back to the machine, as workers idle while the JVM's stages run."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def remote(module: str, name: str, *args: object) -> Callable[[Iterator], Iterator]:
    """A function for mapInArrow that finds ``module`` on the worker, also where only the driver has it on its path."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

    def run(batches: Iterator) -> Iterator:
        import importlib
        import sys

        if root not in sys.path:
            sys.path.append(root)
        try:
            yield from getattr(importlib.import_module(module), name)(batches, *args)
        finally:
            importlib.import_module("quern.llm.common").release()

    return run
