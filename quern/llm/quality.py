"""Quality classifier by importance resampling (Xie et al., "Data Selection for Language Models via Importance Resampling").

Target texts (labelled good) and raw texts (all documents) each get a generative model of
hashed n-grams. A document's log importance is the sum of its n-grams' log ratios of the two
models; the k documents with the largest log importance plus Gumbel noise are sampled, which
is sampling without replacement in proportion to the importance.

N-grams are of four kinds, each with its own ``BUCKETS`` counts: a word (lower-cased), a
word's shape (runs of lower case, upper case, digits and each other sign; and whether it
repeats the word before), two shapes in a row, and two words in a row. A count model is
KINDS * BUCKETS numbers.

The raw model counts every document. The target model counts the labelled good documents, at
most ``SAMPLE`` of them, those with the smallest hashes of their ids. k is given, or else the
number of documents with a log importance over ``-MARGIN``: those that the target model
explains as well as the raw one.

Defined cases: null, empty and blank texts have no n-gram and log importance 0; with no label
or an empty table nothing is rejected; documents whose scores tie with the k-th (to six
decimals) are all kept, so repeated rows stay together; long texts take memory in proportion;
null labels do not count; other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import checkpoint, read, remote

BUCKETS, SAMPLE, MARGIN, BINS, PRIOR, KINDS = 1 << 11, 20_000, 8.0, 1024, 3.0, 4
PART = 1 << 17
BASE, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each byte: whether it is blank, its lower case, its class."""
    codes = np.arange(256, dtype=np.uint8)
    blank = np.isin(codes, [9, 10, 11, 12, 13, 32])
    upper, digit = (codes >= 65) & (codes <= 90), (codes >= 48) & (codes <= 57)
    letter = (codes >= 97) & (codes <= 122) | (codes >= 128)
    kind = np.where(letter, 97, np.where(upper, 65, np.where(digit, 48, codes)))
    return blank, np.where(upper, codes + 32, codes).astype(np.uint64), kind.astype(np.uint64)


def powers(n: int) -> np.ndarray:
    out = np.full(n, BASE | np.uint64(1))
    out[0] = 1
    return np.multiply.accumulate(out)


def bucket(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(31)) * MIX
    return ((h ^ h >> np.uint64(29)) % np.uint64(BUCKETS)).astype(np.int64)


def ngrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(which text, feature) of every n-gram; features are below KINDS * BUCKETS."""
    blank_of, lower_of, kind_of = tables()
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    solid = ~blank_of[data]
    before = np.concatenate(([False], solid[:-1]))
    starts = np.flatnonzero(solid & ~before)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc = np.searchsorted(np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1), starts, "right")
    at = np.flatnonzero(solid)
    word = np.cumsum((solid & ~before)[at]) - 1
    local = at - starts[word]
    power = powers(int(local.max()) + 1)
    first = np.flatnonzero(local == 0)
    lexical = np.add.reduceat(lower_of[data[at]] * power[local], first)
    kind = kind_of[data[at]]
    turn = np.ones(len(at), bool)
    turn[1:] = (kind[1:] != kind[:-1]) | (local[1:] == 0)
    kept = np.flatnonzero(turn)
    begins = np.flatnonzero(local[kept] == 0)
    step = np.arange(len(kept)) - begins[word[kept]]
    shape = np.add.reduceat(kind[kept] * power[step], begins)
    inside = np.zeros(len(starts), bool)
    inside[1:] = doc[1:] == doc[:-1]
    same = inside.copy()
    same[1:] &= lexical[1:] == lexical[:-1]
    shape = shape * np.uint64(2) + same
    pairs = np.flatnonzero(inside)
    two = shape[pairs - 1] * BASE + shape[pairs]
    words = lexical[pairs - 1] * BASE + lexical[pairs]
    feature = (bucket(lexical), bucket(shape) + BUCKETS, bucket(two) + 2 * BUCKETS, bucket(words) + 3 * BUCKETS)
    return np.concatenate((doc, doc, doc[pairs], doc[pairs])), np.concatenate(feature)


def parts(batch: pa.RecordBatch, column: int = 0) -> Iterator[list[bytes]]:
    """A column's texts, some at a time: up to the text with which they reach ``PART`` bytes, as n-grams take many times that."""
    for start in range(0, batch.num_rows, 256):
        texts = [t or b"" for t in batch.column(column).slice(start, 256).cast(pa.binary()).to_pylist()]
        first = held = 0
        for k, text in enumerate(texts):
            held += len(text)
            if held >= PART:
                yield texts[first : k + 1]
                first, held = k + 1, 0
        if first < len(texts):
            yield texts[first:]


def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(KINDS * BUCKETS, np.int64), np.zeros(KINDS * BUCKETS, np.int64)
    for batch in batches:
        good = np.array(batch.column(1).to_pylist(), bool)
        at = 0
        for texts in parts(batch):
            doc, feature = ngrams(texts)
            raw += np.bincount(feature, minlength=KINDS * BUCKETS)
            target += np.bincount(feature[good[at + doc]], minlength=KINDS * BUCKETS)
            at += len(texts)
    seen = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(raw[seen]), pa.array(target[seen])], ["feature", "raw", "target"])


def log_ratios(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, sample: int) -> np.ndarray:
    """Each feature's log ratio of the target's count and the count that the raw model expects among as many, both with
    ``PRIOR`` more, so that rare features say little; zeros without any target text."""
    good = labels.filter("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("__good")).distinct()
    good = good.orderBy(F.xxhash64("__good"), "__good").limit(sample)
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("text"))
    rows = rows.join(F.broadcast(good), F.col("__id") == F.col("__good"), "left").select("text", F.col("__good").isNotNull().alias("good"))  # at most ``sample`` ids
    counts = rows.mapInArrow(remote(__name__, "count_batches"), "feature int, raw long, target long").groupBy("feature").agg(F.sum("raw"), F.sum("target"))
    raw, target = np.zeros(KINDS * BUCKETS), np.zeros(KINDS * BUCKETS)
    for feature, r, t in counts.collect():  # at most KINDS * BUCKETS rows
        raw[feature], target[feature] = r, t
    if not target.any():
        return np.zeros(KINDS * BUCKETS)
    ratios = []
    for t, r in zip(np.split(target, KINDS), np.split(raw, KINDS)):
        expected = r * (t.sum() / max(r.sum(), 1))
        ratios.append(np.log((t + PRIOR) / (expected + PRIOR)))
    return np.concatenate(ratios)


def log_importance(text: Column, weights: np.ndarray) -> Column:
    """A column with each text's log importance."""
    run = remote(__name__, "importance_of", weights.astype(np.float64).tobytes())

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        return next(run([column]))

    return score(text)


def importance_of(columns: list[pa.Array], weights: bytes) -> Iterator[pa.Array]:
    of = np.frombuffer(weights, np.float64)
    for column in columns:
        scores = []
        for texts in parts(pa.RecordBatch.from_arrays([column], ["text"])):
            doc, feature = ngrams(texts)
            scores.append(np.bincount(doc, of[feature], len(texts)))
        yield pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())


def gumbel(key: Column) -> Column:
    """Standard Gumbel noise, the same for the same key."""
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit("gumbel"), key), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(uniform))


def kth_largest(keys: DataFrame, k: int) -> int | None:
    """The exact k-th largest of the long column ``key``, by repeated histograms of ``BINS`` bins. None without that many."""
    low, high, n = keys.agg(F.min("key"), F.max("key"), F.count("key")).first()
    if k < 1 or n < k:
        return None
    while low < high:
        width = (high - low) // BINS + 1
        inside = keys.filter(F.col("key").between(low, high))
        counts = dict(inside.groupBy(F.floor((F.col("key") - low) / width).cast("int").alias("bin")).count().collect())
        for b in sorted(counts, reverse=True):
            if counts[b] >= k:
                low, high = low + b * width, min(high, low + (b + 1) * width - 1)
                break
            k -= counts[b]
    return low


class Resampler:
    """The fitted models, and the score from which documents are kept."""

    def __init__(self, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int | None = None, sample: int = SAMPLE, margin: float = MARGIN) -> None:
        self.id_col, self.text_col = id_col, text_col
        self.weights = log_ratios(docs, labels, id_col, text_col, sample)
        self.scored = checkpoint(self.with_scores(docs.select(id_col, text_col)).select(F.col("row")[id_col].alias("doc_id"), "importance", "key"))
        self.k = self.scored.filter(F.col("importance") > -margin).count() if k is None else k
        self.least = kth_largest(self.scored.select("key"), self.k)

    def with_scores(self, docs: DataFrame) -> DataFrame:
        """(row, importance, key): a struct of each row, its log importance, and its score in millionths."""
        rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), log_importance(docs[self.text_col], self.weights).alias("importance"))
        return rows.withColumn("key", F.round((F.col("importance") + gumbel(F.col("row")[self.id_col])) * 1e6).cast("long"))

    def keeps(self) -> Column:
        return F.lit(True) if self.least is None else F.col("key") >= self.least


def op2_quality_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = Resampler(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return fitted.scored.select("doc_id", F.col("importance").alias("log_importance"), (F.col("key") / 1e6).alias("score"), fitted.keeps().alias("kept"))


def keep_sampled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are sampled."""
    fitted = Resampler(docs, labels, id_col, text_col)
    return fitted.with_scores(docs).filter(fitted.keeps()).select("row.*")
