"""Language ID by nearest centroids.

A text's vector has the TF-IDF weights of its hashed byte bigrams and trigrams (letters only,
A-Z lower-cased, everything else a space), normalised to length 1. Each language has several
centroids, found by spherical k-means; a text takes the language of the centroid with the
largest cosine. It is rejected where its distance from that centroid (1 - cosine) exceeds the
centroid's radius, which lets through ``REACH`` times the ``QUANTILE`` quantile of the cosines of
the centroid's own texts, so that neither an outlier nor a larger sample widens it. Texts whose
cosine with their language's mean is under ``OUTLIER`` times the median take no part in the fit.

Document frequencies count all labelled training texts. Centroids are fitted on at most
``SAMPLE`` different training texts a language, those with the smallest hashes of id and text;
a histogram of the hashes tells which of them can be among these, so that no task ranks a whole
language. Each language's sample is clustered in a task of its own. What is sent to the
workers is the frequencies and ``CENTROIDS`` vectors a language.

Defined cases: null texts and texts without a letter are ``und`` with score 0, as is every
text if there is no labelled training text; languages with few texts get as many centroids as
texts; equal cosines go to the first language by name; long texts take memory in proportion;
a null id is held out if the empty text's crc32 says so (it does not) and trains like any
other; rows that repeat id and text count once in the sample, equal ids with different texts
once each; repeated rows give repeated rows; an empty table gives an empty one; other columns
stay.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import checkpoint, read, remote

FEATURES, SAMPLE, CENTROIDS, ROUNDS, PART, REACH, QUANTILE, OUTLIER = 4096, 1500, 4, 10, 128, 0.5, 0.05, 0.25
BITS = 12  #: of a hash that make its bin in the histogram
UNKNOWN = "und"


def letters() -> np.ndarray:
    codes = np.arange(256, dtype=np.uint8)
    lower = np.where((codes >= 65) & (codes <= 90), codes + 32, codes)
    return np.where((lower >= 97) & (lower <= 122) | (codes >= 128), lower, 32).astype(np.uint32)


def counts_of(texts: list[bytes]) -> np.ndarray:
    """A row of n-gram counts for each text."""
    data = letters()[np.frombuffer(b" " + b"  ".join(texts) + b" ", np.uint8)]
    doc = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)) + 2)
    two = data[:-1] << 8 | data[1:]
    three = (two[:-1] << 8 | data[2:]) + np.uint32(1 << 24)
    rows = []
    for code, n, blank in ((two, 2, 0x2020), (three, 3, 0x1202020)):
        ok = (doc[n - 1 :] == doc[: len(code)]) & (code != blank)
        rows.append(doc[: len(code)][ok] * FEATURES + (code[ok] * np.uint32(2654435761) >> np.uint32(20)))
    return np.bincount(np.concatenate(rows), minlength=len(texts) * FEATURES).reshape(len(texts), FEATURES)


def vectors_of(texts: list[bytes], idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts_of(texts)).astype(np.float32) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def parts(column: pa.Array) -> Iterator[list[bytes]]:
    for start in range(0, len(column), PART):
        yield [t or b"" for t in column.slice(start, PART).cast(pa.binary()).to_pylist()]


def frequency_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, n = np.zeros(FEATURES + 1, np.int64), 0
    for batch in batches:
        for texts in parts(batch.column(0)):
            seen[:-1] += np.count_nonzero(counts_of(texts), axis=0)
            n += len(texts)
    seen[-1] = n
    yield pa.RecordBatch.from_arrays([pa.array(range(FEATURES + 1), pa.int32()), pa.array(seen)], ["feature", "n"])


def typical_of(x: np.ndarray, rounds: int = 3) -> np.ndarray:
    """The rows of ``x`` without those far from their mean, which is taken again without them."""
    kept = x
    for _ in range(rounds):
        mean = kept.sum(0)
        cosines = x @ (mean / max(np.linalg.norm(mean), 1e-12))
        kept = x[cosines >= OUTLIER * np.median(cosines)]
    return kept


def cluster(frame: pd.DataFrame, idf: bytes) -> pd.DataFrame:
    """One language's centroids and a low quantile of the cosines of each one's own texts."""
    frame = frame.sort_values(["place", "text"])
    texts, weights = [t.encode() for t in frame["text"]], np.frombuffer(idf, np.float32)
    x = np.concatenate([vectors_of(texts[i : i + PART], weights) for i in range(0, len(texts), PART)])
    x = typical_of(x)
    # from texts at even steps of typicality, so that no centroid begins, and stays, at an outlier
    k = min(CENTROIDS, len(x))
    typical = np.argsort(x @ x.mean(0), kind="stable")
    centers = x[typical[((np.arange(k) + 0.5) * len(x) / k).astype(int)]]
    for _ in range(ROUNDS):
        own = (x @ centers.T).argmax(1)
        sums = np.stack([x[own == c].sum(0) if (own == c).any() else centers[c] for c in range(len(centers))])
        centers = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    cosines = x @ centers.T
    own = cosines.argmax(1)
    least = [float(np.quantile(cosines[own == c, c] if (own == c).any() else cosines.max(1), QUANTILE)) for c in range(len(centers))]
    return pd.DataFrame({"lang": frame["lang"].iloc[0], "center": [c.astype(np.float32).tobytes() for c in centers], "least": least})


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


class LanguageModel:
    """Fitted on ``docs`` with a text and a language."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> None:
        train = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
        counted = train.select("text").mapInArrow(remote(__name__, "frequency_batches"), "feature int, n long").groupBy("feature").agg(F.sum("n")).collect()
        seen = np.zeros(FEATURES + 1)
        for feature, n in counted:  # FEATURES + 1 rows
            seen[feature] = n
        self.idf = (np.log((1 + seen[-1]) / (1 + seen[:-1])) + 1).astype(np.float32)
        keys = train.select("lang", F.xxhash64("id", "text").alias("place"), F.xxhash64(F.lit(1), "id", "text").alias("tie"))
        keys = checkpoint(keys.distinct())
        place_bin = F.shiftright("place", 64 - BITS)
        counted = keys.groupBy("lang", place_bin.alias("bin")).agg(F.count("*").alias("n"))
        before = F.sum("n").over(Window.partitionBy("lang").orderBy("bin")) - F.col("n")  # at most 2**BITS rows a language
        cuts = counted.withColumn("before", before).filter(F.col("before") < sample).groupBy("lang").agg(F.max("bin").alias("cut"))
        least = keys.join(F.broadcast(cuts), "lang").filter(place_bin <= F.col("cut")).select("lang", "place", "tie")
        ranked = least.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("place", "tie")))
        chosen = F.broadcast(ranked.filter(F.col("rank") <= sample).drop("rank"))  # at most ``sample`` a language
        idf, run = self.idf.tobytes(), remote(__name__, "cluster_run")

        def fit(frame: pd.DataFrame) -> pd.DataFrame:
            return next(run([(frame, idf)]))

        keyed = train.withColumns({"place": F.xxhash64("id", "text"), "tie": F.xxhash64(F.lit(1), "id", "text")})
        picked = keyed.join(chosen, ["lang", "place", "tie"], "left_semi").dropDuplicates(["lang", "place", "tie"])
        fitted = sorted(picked.groupBy("lang").applyInPandas(fit, "lang string, center binary, least double").collect(), key=lambda r: (r["lang"], bytes(r["center"])))
        self.langs = [r["lang"] for r in fitted]
        self.centers = np.stack([np.frombuffer(r["center"], np.float32) for r in fitted]) if fitted else np.zeros((0, FEATURES), np.float32)
        self.least = np.array([r["least"] for r in fitted])

    def predict(self, text: Column) -> Column:
        """struct<lang, score, rejected> of each text."""
        unknown = F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
        if not self.langs:
            return unknown
        run = remote(__name__, "predict_columns", self.idf.tobytes(), self.centers.tobytes(), json.dumps(self.langs), self.least.tobytes())

        @F.arrow_udf("struct<lang: string, score: double, rejected: boolean>")
        def nearest(column: pa.Array) -> pa.Array:
            return next(run([column]))

        return F.when(F.coalesce(text.rlike(r"\p{L}"), F.lit(False)), nearest(text)).otherwise(unknown)


def cluster_run(frames: list[tuple[pd.DataFrame, bytes]]) -> Iterator[pd.DataFrame]:
    for frame, idf in frames:
        yield cluster(frame, idf)


def predict_columns(columns: list[pa.Array], idf: bytes, centers: bytes, langs: str, least: bytes) -> Iterator[pa.Array]:
    weights, names, smallest = np.frombuffer(idf, np.float32), np.array(json.loads(langs), object), np.frombuffer(least)
    all_centers = np.frombuffer(centers, np.float32).reshape(-1, FEATURES)
    for column in columns:
        found, scores, rejected = [], [], []
        for texts in parts(column):
            cosines = vectors_of(texts, weights) @ all_centers.T
            best = cosines.argmax(1)
            top = cosines[np.arange(len(best)), best]
            found += names[best].tolist()
            scores += np.clip(top, 0, 1).astype(float).tolist()
            rejected += (top < smallest[best] * REACH).tolist()
        yield pa.StructArray.from_arrays([pa.array(found, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], ["lang", "score", "rejected"])


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = LanguageModel(docs.filter(~held_out("doc_id")))
    rows = docs.select("doc_id", held_out("doc_id").alias("held_out"), model.predict(F.col("text")).alias("p"))
    return rows.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"), F.col("p.rejected").alias("rejected"))


def keep_known(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that a model of its own labelled texts does not reject."""
    model = LanguageModel(docs, id_col, text_col, lang_col)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), model.predict(docs[text_col]).alias("p"))
    return rows.filter(~F.col("p.rejected")).select("row.*")
