"""SimHash near-dedup with covering locality-sensitive hashing.

A text's fingerprint has a bit set where over half of its word shingles' XXH64 have it set.
Fingerprints that differ in at most two bits are linked. Candidates come from covering
tables (Pagh, "Locality-sensitive Hashing without False Negatives"): bit i carries a nonzero
vector m(i) of three bits, and table v, one of the seven nonzero vectors, keeps the bits with
an odd product m(i)*v. Two differing bits span at most two of three dimensions, so some v is
orthogonal to both: in that table the pair collides, always.

Only distinct fingerprints enter, so copies cost nothing. A table's group of two is compared
directly. In a larger group nobody is compared with everybody: each member names itself and
the fingerprints one bit away (among the bits that the table leaves out), and members that
name the same one are at most two bits apart. Such a meeting has at most 65 members, and any
linked pair of the group meets, so no link is lost and no group is quadratic.

Defined cases: texts without words (null, empty, blank) have fingerprint zero; texts of fewer
words than a shingle hash as a whole; long texts are hashed in blocks; rows that repeat are
one fingerprint; a null id is never a component's id unless all ids there are null; an empty
table gives an empty one; only the named columns are read, so that others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import checkpoint, read, remote
from quern.llm.components import components

RADIUS, SEED, BLOCK = 2, 42, 1 << 16


def shingle_hashes(text: bytes | None, words: int) -> np.ndarray:
    """The XXH64 of every shingle, repeats included; of all words if they are fewer; none without a word."""
    own = (text or b"").lower().split()  # bytes: A-Z and ASCII white space only
    if not own:
        return np.zeros(0, np.uint64)
    joined = memoryview(b" ".join(own))
    ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    stops = ends[min(words, len(own)) - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), stops.tolist())), np.uint64, len(stops))


def simhash_of(hashes: np.ndarray) -> int:
    """As a signed 64-bit integer; zero without a shingle."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        bits = np.unpackbits(hashes[at : at + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: bytes | None, words: int) -> int:
    return simhash_of(shingle_hashes(text, words))


def fingerprint_batches(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = [fingerprint(text, words) for text in batch.column(1).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64()), batch.column(2)], ["id", "fp", "text_hash"])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, text_hash) of every row, written to the shared folder, as several passes follow."""
    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    return checkpoint(picked.mapInArrow(remote(__name__, "fingerprint_batches", words), "id long, fp long, text_hash long"))


def covering_masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """Masks such that any ``radius`` bits are all left out by one of them; each keeps over half of the bits."""
    top = 1 << radius + 1
    carried = [1 + i % (top - 1) for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (carried[i] & v).bit_count() & 1) for v in range(1, top)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(nodes: DataFrame) -> DataFrame:
    """(u, v): enough pairs of linked fingerprints in ``nodes.fp`` (distinct) to connect all that are linked."""
    masks = covering_masks()
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for t, m in enumerate(masks)])
    entries = nodes.select("fp", F.explode(tables).alias("e")).select("fp", "e.t", "e.key")
    groups = entries.groupBy("t", "key").agg(F.count("*").alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v"))
    twos = groups.filter("n = 2").filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= RADIUS).select("u", "v")
    left_out = [F.array(F.lit(0), *[F.lit(signed(1 << i)) for i in range(64) if not m >> i & 1]) for m in masks]
    flips = F.element_at(F.array(*left_out), F.col("t") + 1)
    met = (
        entries.join(groups.filter("n > 2").select("t", "key"), ["t", "key"])
        .select("fp", F.explode(flips).alias("flip"))
        .select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("name"))
        .groupBy("name")
        .agg(F.collect_set("fp").alias("all"))  # at most 65: the name and what is one bit away
        .filter(F.size("all") > 1)
        .select(F.array_min("all").alias("u"), F.explode("all").alias("v"))
        .filter("u <> v")
    )
    return twos.unionAll(met)


def classes(prints: DataFrame) -> DataFrame:
    """(fp, component_id) for each distinct fingerprint of (id, fp): the smallest id that its links reach."""
    nodes = checkpoint(prints.groupBy("fp").agg(F.min("id").alias("first")))
    roots = components(links(nodes))
    joined = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    rooted = joined.select("fp", "first", F.coalesce("root", "fp").alias("root"))
    first = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.join(first, "root").select("fp", "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def near_duplicates(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint and component_id of every row."""
    prints = fingerprints(docs, words, id_col, text_col)
    return prints.join(classes(prints), "fp").select(F.col("id").alias("doc_id"), hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
