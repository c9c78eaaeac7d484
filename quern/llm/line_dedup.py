"""Line dedup: lines that many documents hold stay in one of them only.

Normalised lines are exploded and hashed (128 bits), distinct documents are counted per hash,
and lines of hashes over the threshold are dropped by position from all but the largest
document id. Only hashes, ids and positions are shuffled for the count; each text moves
once, to meet the positions that it loses. Counting is partial before every shuffle, and
where lines meet their counts, the lines of a hot hash are dealt to several tasks, so a line
that a third of all documents hold stays spread.

Defined cases: null and empty texts are one empty line; a null id counts as one document,
smaller than all others; rows that repeat an id count as one document and each keeps its own
lines; equal positions cannot tie; an empty table gives an empty one; other columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import BLANKS, ascii_lower, checkpoint, hash_pair, join_counted, read

MIN_CHARS, MIN_DOCS = 20, 3
NO_ID = -(2**63)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def dropped_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int) -> DataFrame:
    """(__id, __text_hash, __dropped): sorted positions of the lines that a row loses; rows that lose none are absent."""
    keyed = (
        docs.select(
            F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("__id"),
            F.xxhash64(text_col).alias("__text_hash"),
            F.posexplode(lines_of(F.col(text_col))).alias("__pos", "__line"),
        )
        .withColumn("__key", line_key(F.col("__line")))
        .filter(F.char_length("__key") >= min_chars)
        .select("__id", "__text_hash", "__pos", hash_pair(F.col("__key")).alias("__h"))
        .select("__id", "__text_hash", "__pos", "__h.a", "__h.b")
    )
    counted = keyed.groupBy("a", "b", "__id").agg(F.count("*").alias("__rows")).groupBy("a", "b")
    counted = counted.agg(F.count("*").alias("__n"), F.sum("__rows").alias("__rows"), F.max("__id").alias("__last"))
    frequent = checkpoint(counted.filter(F.col("__n") >= min_docs).drop("__n"))
    return (
        join_counted(keyed, frequent, ["a", "b"], "__rows", F.xxhash64("__id", "__pos"))
        .filter(F.col("__id") != F.col("__last"))
        .groupBy("__id", "__text_hash")
        .agg(F.sort_array(F.collect_set("__pos")).alias("__dropped"))
    )


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, counts: tuple[str, str] | None = ("n_lines", "n_dropped")) -> DataFrame:
    """``docs`` with the kept lines in ``text_col``, and how many lines there were and are dropped in the columns
    ``counts``, which replace columns of the same names."""
    lost = dropped_lines(docs, id_col, text_col, min_chars, min_docs)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID)).alias("__id"), F.xxhash64(docs[text_col]).alias("__text_hash"))
    text = F.col("row")[text_col]
    parts = rows.join(lost, ["__id", "__text_hash"], "left").select("row", "__dropped", lines_of(text).alias("lines"))
    n = F.size("lines")
    stays = F.array_except(F.sequence(F.lit(0), n - 1), F.col("__dropped"))
    kept = F.array_join(F.transform(stays, lambda p: F.get("lines", p)), "\n")
    made = {text_col: F.when(F.col("__dropped").isNull(), text).otherwise(kept)}
    if counts:
        made |= {counts[0]: n.cast("long"), counts[1]: F.coalesce(F.size("__dropped"), F.lit(0)).cast("long")}
    return parts.select(*[made.get(c, F.col("row")[c]).alias(c) for c in docs.columns], *[x.alias(c) for c, x in made.items() if c not in docs.columns])


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs).select(
        "doc_id",
        "n_lines",
        "n_dropped",
        F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("kept_sha256"),
    )


OP1_SQL = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), frequent AS (
  SELECT key, max(doc_id) AS last_id FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), judged AS (
  SELECT k.doc_id, k.pos, k.line, f.key IS NOT NULL AND k.doc_id <> f.last_id AS dropped
  FROM keyed k LEFT JOIN frequent f ON k.key = f.key
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (dropped) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
