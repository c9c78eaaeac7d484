"""Document fingerprints by winnowing.

A text's tokens are its words, lower-cased; an unbroken run of over 24 characters (Chinese,
base64) gives its characters instead, so that an insertion shifts nothing. Tokens are hashed
once each; a run of k tokens has the cyclic polynomial of its tokens' hashes, rolled up by
doubling: a run of a + b tokens is the run of a, rotated by b, xor the run of b behind it. Of
every window of w runs the smallest is chosen by the upper half of its hash, the rightmost of
equals, and kept with its position; window minima are doubled up as well, so neither k nor w
multiplies the work. Texts that share w + k - 1 tokens in a row always share a chosen hash,
and positions tell where. Texts of fewer tokens than that keep every token's hash besides.

Everything is an expression over one row's arrays: no Python, no shuffle, memory and time in
proportion to the text.

The query also needs each document's successor by id. Ids are cut into ranges of about
``ROWS`` rows: 64 quantiles of the ids, each cut evenly. A range's first row goes to the
range before it as well, so one shuffle by range brings each row its successor; only texts
move, and are fingerprinted behind the shuffle. What is broadcast is one pair of numbers per
range; from ``RANGES`` of them on (a thousand million rows), ranges grow in rows instead.

Defined cases: null and empty texts have no chosen hash, and two such fingerprints are alike
(1.0); a text of fewer than k tokens has one run; null ids come first in the order of ids, and
rows of equal ids are ordered by their text's hash; an empty table gives an empty one; only
the named columns are read, so that others may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import read

K, W = 5, 8
PIECES, ROWS, RANGES = 64, 1000, 1 << 20
SOLID = r"[^\x20\x09-\x0D]"
TOKEN = f"(?<!{SOLID}){SOLID}{{1,24}}+(?!{SOLID})|{SOLID}"
LAST = (1 << 31) - 1  #: no array is longer


def rotated(x: Column, by: int) -> Column:
    return F.shiftleft(x, by % 64).bitwiseOR(F.shiftrightunsigned(x, 64 - by % 64)) if by % 64 else x


def joined(front: str, back: str, offset: int, how: Callable[[Column, Column], Column]) -> Column:
    """Entry i: ``how`` of front[i] and back[i + offset], as far as there is a back[i + offset]."""
    n = F.greatest(F.size(back) - offset, F.lit(0))
    return F.zip_with(F.slice(front, F.lit(1), n), F.slice(back, F.lit(offset + 1), n), how)


def doubled(rows: DataFrame, of: str, n: int, how: Callable[[int], Callable[[Column, Column], Column]]) -> tuple[DataFrame, str]:
    """``rows`` with a column of ``how`` over every ``n`` entries in a row of ``of``; ``how(b)`` joins a front with a back of b."""
    name, length = of, 1
    for bit in bin(n)[3:]:
        rows, name, length = rows.withColumn(f"{of}_{2 * length}", joined(name, name, length, how(length))), f"{of}_{2 * length}", 2 * length
        if bit == "1":
            rows, name, length = rows.withColumn(f"{of}_{length + 1}", joined(name, of, length, how(1))), f"{of}_{length + 1}", length + 1
    return rows, name


def with_fingerprint(rows: DataFrame, text_col: str, prefix: str, k: int = K, w: int = W) -> DataFrame:
    """``rows`` with ``{prefix}positions`` and ``{prefix}hashes``: the chosen runs' first tokens, counted from 0, and their
    hashes; in short texts the tokens themselves follow."""
    columns = rows.columns
    tokens, runs, ranks, positions, hashes = (f"{prefix}{x}" for x in ("tokens", "runs", "ranks", "positions", "hashes"))
    n, none = F.size(tokens), F.array().cast("array<bigint>")
    found = F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(TOKEN), F.lit(0))
    rows = rows.withColumn(tokens, F.transform(found, lambda x: F.xxhash64(x)))
    rows, full = doubled(rows, tokens, k, lambda back: lambda x, y: rotated(x, back).bitwiseXOR(y))
    rows = rows.withColumn(runs, F.when(n >= k, F.col(full)).when(n > 0, F.array(F.xxhash64(tokens))).otherwise(none))
    rank = lambda x, i: F.shiftleft(F.shiftrightunsigned(x, 32), 31).bitwiseOR(F.lit(LAST) - i)
    rows = rows.withColumn(ranks, F.transform(runs, rank))
    rows, least = doubled(rows, ranks, w, lambda back: lambda x, y: F.least(x, y))
    chosen = F.when(F.size(runs) >= w, F.array_distinct(least)).when(n > 0, F.array(F.array_min(ranks))).otherwise(none)
    rows = rows.withColumn(positions, F.transform(chosen, lambda m: (F.lit(LAST) - m.bitwiseAND(F.lit(LAST))).cast("int")))
    short = (n > 0) & (n < k + w - 1)
    at = F.when(short, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn(hashes, F.concat(F.transform(positions, lambda p: F.get(runs, p)), F.when(short, F.col(tokens)).otherwise(none)))
    return rows.select(*columns, F.concat(positions, at).alias(positions), hashes)


def digest(prefix: str) -> Column:
    """32 hex digits for the chosen positions and hashes."""
    parts = [F.col(f"{prefix}positions"), F.col(f"{prefix}hashes")]
    halves = [F.lpad(F.lower(F.hex(h)), 16, "0") for h in (F.xxhash64(*parts), F.xxhash64(F.lit(1), *parts))]
    return F.concat(*halves)


def likeness(a: Column, b: Column) -> Column:
    """Shared among all distinct chosen hashes of two fingerprints, 0 to 1."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, w: int = W) -> DataFrame:
    """doc_id, positions, hashes of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text"))
    return with_fingerprint(rows, "__text", "", k, w).drop("__text")


def id_range(ids: DataFrame, rows_each: int, ranges: int) -> Column | None:
    """The number of an id's range, ascending with ids. None for an empty table."""
    cuts = [i / PIECES for i in range(1, PIECES)]
    n, low, high, inner = ids.agg(F.count("*"), F.min("id"), F.max("id"), F.percentile_approx("id", cuts, 10_000)).first()
    if not n:
        return None
    if low is None:
        return F.lit(0)
    bounds = sorted({low, high + 1, *inner})
    each = max(1, min(math.ceil(n / rows_each / (len(bounds) - 1)), ranges // PIECES))

    def search(a: int, b: int) -> Column:
        if b - a > 1:
            middle = (a + b) // 2
            return F.when(F.col("id") < bounds[middle], search(a, middle)).otherwise(search(middle, b))
        share = (F.col("id") - bounds[a]).cast("double") / float(bounds[b] - bounds[a])
        return F.lit(a * each) + F.least(F.floor(share * each), F.lit(each - 1)).cast("int")

    return F.when(F.col("id").isNull(), F.lit(0)).otherwise(search(0, len(bounds) - 1)).cast("int")


def with_successor(rows: DataFrame, carried: list[str], prepare: Callable[[DataFrame], DataFrame] = lambda rows: rows, rows_each: int = ROWS, ranges: int = RANGES) -> DataFrame:
    """``rows`` (long ``id``, ``text_hash``), with what ``prepare`` adds to them behind the shuffle, and ``next``: the struct
    of ``carried`` of the next row by id, of the last row the first's."""
    number = id_range(rows.select("id"), rows_each, ranges)
    if number is None:
        return prepare(rows).withColumn("next", F.struct(*carried))
    firsts = rows.select(number.alias("range"), "id").groupBy("range").agg(F.min(F.struct(F.col("id").isNotNull(), F.col("id"))).alias("first"))
    order = Window.orderBy("range")
    before = F.coalesce(F.lag("range").over(order), F.max("range").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    also = firsts.select(F.col("first.id").alias("first_id"), before.alias("also"))
    dealt = rows.withColumn("range", number).join(F.broadcast(also), F.col("id").eqNullSafe(F.col("first_id")), "left")
    to = F.array(F.struct(F.col("range").alias("range"), F.lit(0).alias("guest")), F.struct(F.col("also").alias("range"), F.lit(1).alias("guest")))
    dealt = dealt.withColumn("to", F.explode(F.filter(to, lambda x: x["range"].isNotNull()))).select(*rows.columns, "to.range", "to.guest")
    window = Window.partitionBy("range").orderBy("guest", F.col("id").asc_nulls_first(), "text_hash")
    return prepare(dealt.repartition("range")).withColumn("next", F.lead(F.struct(*carried)).over(window)).filter("guest = 0").drop("range", "guest")


def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    own = lambda rows: with_fingerprint(rows, "text", "own_").withColumn("fingerprint", digest("own_")).drop("own_positions")
    rows = with_successor(rows, ["text", "own_hashes"], own)
    n = F.char_length("text")
    part = F.floor(n / 4).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - part), F.substring(F.col("next.text"), F.lit(1), part)))
    rows = with_fingerprint(rows, "edited", "edited_")
    return rows.select(
        F.col("id").alias("doc_id"),
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        digest("edited_").alias("edited_fingerprint"),
        likeness(F.col("own_hashes"), F.col("edited_hashes")).alias("near_edited"),
        likeness(F.col("own_hashes"), F.col("next.own_hashes")).alias("near_next"),
    )
