"""Full-text search: an inverted index as DataFrames, its query language, and BM25.

Words are those of Unicode's text segmentation: letters, digits and underscores, with signs
such as ' and . between letters and , and . between digits; an ideograph is a word of its own.
A token is a word's letters and digits, in lower case, without combining marks after
compatibility decomposition. ASCII texts stay with built-in functions. The index is (col, term,
rowid, positions) and (col, rowid, dl). A query becomes filters and joins on the index; the
words of a phrase are picked in one scan.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.dialect.parser import SqlError
from quern.functions.worker import located

K1, B, NEAR = 1.2, 0.75, 10
#: Between letters, between digits: what does not end a word. The same in each dialect of patterns.
JOINS = "(?:{letter}(?:[:.'\u2019\u00b7]{letter})*|{digit}(?:[,;.'\u2019]{digit})*|_)+"
ASCII_WORD = JOINS.format(letter="[a-z]", digit="[0-9]")
IDEOGRAPH = r"[\p{Han}\p{Hiragana}]"
ANY_WORD = regex.compile(rf"{IDEOGRAPH}\p{{M}}*|" + JOINS.format(letter=rf"(?:(?!{IDEOGRAPH})\p{{L}}\p{{M}}*)", digit=r"(?:\p{N}\p{M}*)"))


def fold(word: str) -> str:
    kept = (c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))
    return "".join(c for c in "".join(kept).lower() if c.isalnum())


def words(text: str | None) -> list[str] | None:
    return None if text is None else [t for t in map(fold, ANY_WORD.findall(text)) if t]


def matched(text: str, query: str) -> int:
    """How many of a query's tokens a text has."""
    own = set(words(text))
    return sum(w in own for w in words(query))


def query_tokens(text: str) -> list[str]:
    return words(text) or []


def plain_tokens(text: str) -> str:
    """Spark SQL for the tokens of an ASCII text."""
    pattern = ASCII_WORD.replace("'", "\\'")
    return f"filter(transform(regexp_extract_all(lower({text}), '{pattern}', 0), w -> regexp_replace(w, '[^a-z0-9]', '')), w -> w != '')"


def tokens(text: Column) -> Column:
    """A text's tokens in order."""
    one = located(__name__, "words")

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    plain = F.octet_length(text) == F.char_length(text)
    found = F.regexp_extract_all(F.lower(text), F.lit(ASCII_WORD), F.lit(0))
    ascii_tokens = F.filter(F.transform(found, lambda w: F.regexp_replace(w, "[^a-z0-9]", "")), lambda w: w != "")
    return F.when(plain, ascii_tokens).otherwise(run(F.when(~plain, text)))


@dataclass
class Index:
    postings: DataFrame  #: col, term, rowid, positions
    lengths: DataFrame  #: col, rowid, dl
    columns: list[str]


def build(rows: DataFrame, id_col: str, columns: list[str]) -> Index:
    """The index of text columns. A posting's group is one term of one row, so a common term is no large group; a filter
    on terms is pushed below the grouping, so a query groups only the postings of its own words."""
    each = [rows.select(F.col(id_col).alias("rowid"), F.lit(c).alias("col"), tokens(F.coalesce(F.col(c), F.lit(""))).alias("tokens")) for c in columns]
    split = reduce(DataFrame.unionAll, each)
    # outer: else Spark would tokenise a second time to drop empty texts before
    terms = split.select("col", "rowid", F.posexplode_outer("tokens").alias("pos", "term")).filter("term IS NOT NULL")
    postings = terms.groupBy("col", "term", "rowid").agg(F.sort_array(F.collect_list("pos")).alias("positions"))
    return Index(postings, split.select("col", "rowid", F.size("tokens").cast("long").alias("dl")), columns)


# query language: juxtaposition is AND, OR, "phrase", prefix*, NEAR(a b, n)


def parse(query: str) -> tuple:
    """('or', parts), ('and', parts), ('phrase', words), ('prefix', word) or ('near', words, n)."""
    pieces = re.findall(r'"[^"]*"|NEAR\s*\([^)]*\)|[^\s"()]+', query)
    groups: list[list[tuple]] = [[]]
    for p in pieces:
        if p == "OR":
            groups.append([])
        elif p == "AND":
            continue
        elif p.startswith('"'):
            words = query_tokens(p)
            groups[-1].append(("phrase", words))
        elif p.startswith("NEAR") and "(" in p:
            inside, _, n = p[p.index("(") + 1 : -1].partition(",")
            groups[-1].append(("near", query_tokens(inside), int(n) if n.strip() else NEAR))
        elif p.endswith("*") and query_tokens(p):
            groups[-1].append(("prefix", query_tokens(p)[-1]))
        else:
            groups[-1] += [("phrase", [w]) for w in query_tokens(p)]
    parts = [("and", [x for x in g if x[0] == "prefix" or x[1]]) for g in groups]
    parts = [g for g in parts if g[1]]
    if not parts:
        raise SqlError("empty full-text query")
    return ("or", parts)


def words_joined(index: DataFrame, words: list[str]) -> DataFrame:
    """(col, rowid, p0, p1, ...) of the rows with all words; a row for each column of a row."""
    found = index.filter(F.col("term").isin(sorted(set(words))))
    picked = found.groupBy("col", "rowid").agg(*[F.max(F.when(F.col("term") == w, F.col("positions"))).alias(f"p{k}") for k, w in enumerate(words)])
    return picked.dropna()


def near(words: int, n: int) -> Column:
    """Whether some position of the first word has all others within ``n``, the nearest ones spanning ``n`` at most."""

    def nearest(k: int, p: Column) -> Column:
        best = F.array_min(F.transform(f"p{k}", lambda q: F.struct(F.abs(q - p).alias("d"), q.alias("q"))))
        return best["q"]

    def holds(p: Column) -> Column:
        at = [nearest(k, p) for k in range(1, words)]
        close = reduce(lambda a, b: a & b, [F.abs(q - p) <= n for q in at])
        return close & (F.greatest(p, *at) - F.least(p, *at) <= n)

    return F.exists("p0", holds) if words > 1 else F.lit(True)


def minus(k: int) -> Callable[[Column], Column]:
    return lambda p: p - k


def rows_of(index: DataFrame, part: tuple) -> DataFrame:
    """The distinct row ids that a part of a query matches, in any column."""
    kind = part[0]
    if kind == "or":
        return reduce(DataFrame.unionAll, [rows_of(index, p) for p in part[1]]).distinct()
    if kind == "and":
        return reduce(lambda a, b: a.join(b, "rowid"), [rows_of(index, p) for p in part[1]])
    if kind == "prefix":
        return index.filter(F.col("term").startswith(part[1])).select("rowid").distinct()
    joined = words_joined(index, part[1])
    if kind == "near":
        return joined.filter(near(len(part[1]), part[2])).select("rowid").distinct()
    shifted = [F.transform(f"p{k}", minus(k)) for k in range(len(part[1]))]
    return joined.filter(F.size(reduce(F.array_intersect, shifted)) > 0).select("rowid").distinct()


def match(index: Index, query: str, column: str | None = None) -> DataFrame:
    """(rowid) of the rows that a query matches, in ``column`` or in any."""
    postings = index.postings.filter(F.col("col") == column) if column else index.postings
    return rows_of(postings, parse(query))


def terms_of(part: tuple) -> list[str]:
    if part[0] in ("or", "and"):
        return [t for p in part[1] for t in terms_of(p)]
    return [] if part[0] == "prefix" else list(part[1])


def bm25(index: Index, query: str, weights: dict[str, float] | None = None) -> DataFrame:
    """(rowid, score): BM25 of the query's words, summed over columns with their weights. Prefixes do not score.

    Per-column totals and document frequencies are a few rows; the postings meet lengths by row id.
    """
    weights = weights or {}
    words = sorted(set(terms_of(parse(query))))
    totals = index.lengths.groupBy("col").agg(F.count("*").alias("n"), F.greatest(F.avg("dl"), F.lit(1.0)).alias("avgdl"))
    found = index.postings.filter(F.col("term").isin(words)).select("col", "term", "rowid", F.size("positions").alias("tf"))
    df = found.groupBy("col", "term").agg(F.count("*").alias("df")).join(totals, "col")
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    stats = df.select("col", "term", idf.alias("idf"), "avgdl")
    weight = F.coalesce(*[F.when(F.col("col") == c, F.lit(float(w))) for c, w in weights.items()], F.lit(1.0))
    scored = found.join(F.broadcast(stats), ["col", "term"]).join(index.lengths, ["col", "rowid"])  # a row for each word and column
    part = F.col("idf") * (F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return scored.groupBy("rowid").agg(F.sum(weight * part).alias("score"))
