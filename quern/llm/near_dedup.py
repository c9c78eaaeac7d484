"""Near-duplicate removal at a Jaccard similarity of 0.8 of five-word shingles: one document of each group stays.

Equal texts are one node before anything else; their copies are no part of the graph.

A first pass links most nodes at little cost. Two ways name its candidate pairs: the covering
SimHash tables of ``simhash`` (two bits), and MinHash bands, as pairs of similarity 0.8 mostly
differ in 5 to 15 of 64 SimHash bits. Each member of a band's bucket is compared with one of
them only, the one that meets most others in all its buckets (in a family, the least changed),
so candidates grow with the documents, however many share a bucket.

A second pass is about buckets that the first left in several components: every similar pair of
their members is found by prefix filtering (Xiao et al., "Efficient Similarity Joins for Near
Duplicate Detection"). Shingles that no two components share come first in the order of all
shingles, then the others by how many members have them. Sets of similarity t share a shingle
among the first n - ceil(2t/(1+t) n) + 1 of the smaller and the first n - ceil(tn) + 1 of the
larger, and its place bounds the sizes of the sets that may meet there. Both are part of what
is joined on: shingle and bucket of sizes. So the members of a family that share its boilerplate
and are not similar do not meet, and only texts of different components do.

Every candidate pair of either pass is verified by exact set similarity, then linked texts are
grouped. A pair is compared if it shares a band's bucket, or its SimHashes are near: two texts of
similarity s share a bucket with a probability of 1 - (1 - s^5)^20 (0.9996 at 0.8, 0.99999 at 0.85).

Tables are broadcast only up to ``MOST`` rows, counted first; beyond that the same joins shuffle.

Defined cases: null texts are empty; texts without a word are copies of each other; texts of
fewer words than a shingle have one; the smallest id of a group stays, an id before none, of
equal ids that of the smaller text hash; rows that repeat id and text are one document, rows
of one id and different texts are different documents; long texts are hashed in blocks; an
empty table gives an empty one; other columns stay as they are, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import checkpoint, hash_pair, join_counted, remote, small
from quern.llm.components import components
from quern.llm.simhash import SEED, links, shingle_hashes, simhash_of

WORDS, SIMILARITY, BANDS, ROWS, MOST, BLOCK = 5, 0.8, 20, 5, 1_000_000, 4096
STEP, EPSILON = 1.05, 1e-6  #: sizes of one bucket differ by this factor at most; slack of float bounds


@cache
def permutations() -> tuple[np.ndarray, np.ndarray]:
    made = np.array([xxhash.xxh64_intdigest(f"{k}".encode(), SEED) for k in range(2 * BANDS * ROWS)], np.uint64)
    return made[::2] | np.uint64(1), made[1::2]


def band_keys(hashes: np.ndarray) -> list[int]:
    """A key for each band of the MinHash signature of distinct shingle hashes."""
    a, b = permutations()
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), BLOCK):
        least = np.minimum(least, (hashes[at : at + BLOCK, None] * a + b).min(0))
    return [xxhash.xxh64_intdigest(least[k : k + ROWS].tobytes(), k) - (1 << 63) for k in range(0, len(a), ROWS)]


def sketch_batches(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            prints, bands = [], []
            for text in part.column(0).cast(pa.binary()).to_pylist():
                hashes = shingle_hashes(text, words)
                prints.append(simhash_of(hashes))
                bands.append(band_keys(np.unique(hashes)))
            yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(prints, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], ["id", "a", "b", "fp", "bands"])


def set_batches(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            sets = [np.unique(shingle_hashes(t, words)).view(np.int64) for t in part.column(0).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(1), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])


def sent(rows: DataFrame) -> DataFrame:
    """``rows``, sent to every task if they are few enough."""
    return F.broadcast(rows) if small(rows, MOST) else rows


def texts_of(sketches: DataFrame) -> DataFrame:
    """A node for each distinct text, with its smallest id and how many rows have it."""
    found = sketches.groupBy("a", "b").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.min(F.struct("fp", "bands")).alias("s"))
    return checkpoint(found.select(F.monotonically_increasing_id().alias("node"), "a", "b", "id", "n", "s.fp", "s.bands"))


def bucket_members(texts: DataFrame) -> DataFrame:
    """(key, u, v): the members of buckets of several, each with the bucket's member that meets most others."""
    entries = texts.select("node", F.explode("bands").alias("key"))
    several = checkpoint(entries.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
    members = checkpoint(join_counted(entries, several, ["key"], "n", F.xxhash64("node"), most=MOST).select("key", "n", "node"))
    meets = members.groupBy("node").agg(F.sum("n").alias("meets"))
    ranked = members.join(meets.hint("merge"), "node")  # a node has at most BANDS members
    central = checkpoint(ranked.groupBy("key").agg(F.count("*").alias("n"), F.max(F.struct("meets", F.negative("node").alias("r"), "node"))["node"].alias("v")))
    return checkpoint(join_counted(members.select("key", "node"), central, ["key"], "n", F.xxhash64("node"), most=MOST).select("key", F.col("node").alias("u"), "v"))


def candidates(texts: DataFrame, members: DataFrame) -> DataFrame:
    """(u, v), v < u: pairs of nodes to be compared."""
    prints = checkpoint(texts.groupBy("fp").agg(F.min("node").alias("first"), F.count("*").alias("n")))
    several = checkpoint(prints.filter("n > 1"))
    same = join_counted(texts.select("node", "fp"), several, ["fp"], "n", F.xxhash64("node"), most=MOST).select(F.col("node").alias("u"), F.col("first").alias("v"))
    one, two = (prints.select(F.col("fp").alias(k), F.col("first").alias(f"{k}_first")) for k in "uv")
    near = links(prints.select("fp")).join(one, "u").join(two, "v").select(F.greatest("u_first", "v_first").alias("u"), F.least("u_first", "v_first").alias("v"))
    pairs = members.select("u", "v").unionAll(same).unionAll(near).filter("u <> v")
    return pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def shingle_sets(nodes: DataFrame, texts: DataFrame, picked: DataFrame, words: int) -> DataFrame:
    """(node, shingles) of some nodes, each from one row that has its text."""
    wanted = checkpoint(texts.join(sent(nodes), "node", "left_semi").select("node", F.col("a").alias("wa"), F.col("b").alias("wb"), F.col("id").alias("wid")))
    chosen = picked.join(sent(wanted), (F.col("a") == F.col("wa")) & (F.col("b") == F.col("wb")) & F.col("id").eqNullSafe(F.col("wid"))).select("text", "node")
    return checkpoint(chosen.mapInArrow(remote(__name__, "set_batches", words), "node long, shingles array<long>").dropDuplicates(["node"]))


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The (u, v) of ``pairs`` whose shingle sets are similar."""
    one, two = (sets.select(F.col("node").alias(k), F.col("shingles").alias(f"{k}_set")) for k in "uv")
    both = pairs.join(one.hint("merge"), "u").join(two.hint("merge"), "v")
    union = F.size(F.array_union("u_set", "v_set"))
    return both.filter((union == 0) | (F.size(F.array_intersect("u_set", "v_set")) >= similarity * union)).select("u", "v")


def open_nodes(members: DataFrame, linked: DataFrame) -> DataFrame:
    """(node, root) of all members of buckets that are not of one component."""
    roots = linked.select(F.col("node").alias("u"), "root")
    rooted = checkpoint(members.join(sent(roots), "u", "left").select("key", F.col("u").alias("node"), F.coalesce("root", "u").alias("root")))
    ends = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"))
    split = checkpoint(ends.filter("low < high").select("key", "n"))
    return checkpoint(join_counted(rooted, split, ["key"], "n", F.xxhash64("node"), most=MOST).select("node", "root").distinct())


def unlinked(sets: DataFrame, similarity: float) -> DataFrame:
    """(u, v): pairs of nodes of different roots in (node, root, shingles) that the prefix filter cannot rule out."""
    share = similarity / (1 + similarity)  # of both sizes, the least overlap of a similar pair
    entries = sets.select("node", "root", F.explode("shingles").alias("token"))
    ends = entries.groupBy("token").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"))
    shared = checkpoint(ends.filter("low < high").select("token", "n"))
    met = join_counted(entries.select("node", "token"), shared, ["token"], "n", F.xxhash64("node"), most=MOST)
    common = met.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("common"))  # a text's own shingles
    size, first = F.col("size"), F.col("size") - F.size("common")
    ranked = sets.select("node", "root", F.size("shingles").alias("size")).join(common, "node")
    looked = F.greatest(size - F.ceil(similarity * size - EPSILON) + 1 - first, F.lit(0)).cast("int")
    placed = ranked.select("node", "root", "size", first.alias("first"), F.posexplode(F.slice("common", F.lit(1), looked)).alias("at", "t"))
    placed = checkpoint(placed.select("node", "root", "size", (F.col("first") + F.col("at")).alias("at"), "t.token"))
    bucket = lambda x: F.floor(F.log(x) / math.log(STEP)).cast("int")
    least, most = similarity * size - EPSILON, F.least(size, (size - F.col("at")) / share - size) + EPSILON
    larger = placed.filter(most >= least).withColumn("sizes", F.explode(F.sequence(bucket(least), bucket(most))))
    smaller = placed.filter(F.col("at") < size - F.ceil(2 * share * size - EPSILON) + 1).withColumn("sizes", bucket(size))
    names = ("node", "root", "size", "at")
    larger, smaller = (x.select("token", "sizes", *[F.col(c).alias(f"{c}_{k}") for c in names]) for k, x in (("u", larger), ("v", smaller)))
    # components meet, then their texts: those of one component are not paired at all
    roots = larger.select("token", "sizes", "root_u").distinct().join(smaller.select("token", "sizes", "root_v").distinct().hint("merge"), ["token", "sizes"]).filter("root_u <> root_v")
    pairs = roots.join(larger.hint("merge"), ["token", "sizes", "root_u"]).join(smaller.hint("merge"), ["token", "sizes", "root_v"])
    both = F.col("size_u") + F.col("size_v")
    left = F.least(F.col("size_u") - F.col("at_u"), F.col("size_v") - F.col("at_v"))
    pairs = pairs.filter("size_v < size_u OR size_v = size_u AND node_v < node_u").filter(F.col("size_v") >= similarity * F.col("size_u") - EPSILON).filter(left >= share * both - EPSILON)
    return checkpoint(pairs.select(F.col("node_u").alias("u"), F.col("node_v").alias("v")).distinct())


def linked_texts(texts: DataFrame, picked: DataFrame, words: int, similarity: float) -> DataFrame:
    """(node, root) of the nodes that are similar to others, but the roots."""
    ends = lambda pairs: pairs.select(F.col("u").alias("node")).unionAll(pairs.select(F.col("v").alias("node"))).distinct()
    members = bucket_members(texts)
    pairs = checkpoint(candidates(texts, members))
    linked = components(similar(pairs, shingle_sets(checkpoint(ends(pairs)), texts, picked, words), similarity))
    left = open_nodes(members, linked)
    if left.isEmpty():
        return linked
    sets = shingle_sets(left.select("node"), texts, picked, words)
    more = checkpoint(similar(unlinked(sets.join(sent(left), "node"), similarity), sets, similarity))
    return linked if more.isEmpty() else components(more.unionAll(linked.select(F.col("node").alias("u"), F.col("root").alias("v"))))


def fates(texts: DataFrame, linked: DataFrame) -> DataFrame:
    """(a, b, n, first, goes) of the texts that have copies or are similar to others: how many rows have the text, the
    smallest id of these, and whether the text gives way to another one."""
    members = checkpoint(linked.unionAll(linked.select(F.col("root").alias("node"), "root").distinct()))
    own = texts.select("node", "id", "a", "b").join(sent(members), "node")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "a", "b", "node")
    best = checkpoint(own.groupBy("root").agg(F.min(order)["node"].alias("best"), F.count("*").alias("n")))
    goes = join_counted(own.select("node", "root"), best, ["root"], "n", F.xxhash64("node"), most=MOST).filter("node <> best").select("node", F.lit(True).alias("goes"))
    judged = texts.join(sent(checkpoint(goes)), "node", "left").filter("n > 1 OR goes")
    return checkpoint(judged.select("a", "b", "n", F.col("id").alias("first"), F.coalesce("goes", F.lit(False)).alias("goes")))


def keep_one(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without those of each group but the one of the smallest id."""
    text = F.coalesce(docs[text_col], F.lit(""))
    keys = [docs[id_col].cast("long").alias("id"), hash_pair(text).alias("h")]
    picked = docs.select(text.alias("text"), *keys).select("text", "id", "h.a", "h.b")
    sketches = checkpoint(picked.mapInArrow(remote(__name__, "sketch_batches", words), "id long, a long, b long, fp long, bands array<long>"))
    texts = texts_of(sketches)
    fate = fates(texts, linked_texts(texts, picked, words, similarity))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *keys).select("row", "id", "h.a", "h.b")
    judge = lambda rows: join_counted(rows, fate, ["a", "b"], "n", F.xxhash64("id"), "left", MOST)
    stays = ~F.col("goes") & F.col("id").eqNullSafe(F.col("first"))
    judged = judge(rows)
    if judge(sketches.select("id", "a", "b")).filter(stays).groupBy("a", "b").count().filter("count > 1").isEmpty():
        return judged.filter(F.col("n").isNull() | stays).select("row.*")
    return judged.filter("n IS NULL").unionAll(judged.filter(stays).dropDuplicates(["a", "b"])).select("row.*")
