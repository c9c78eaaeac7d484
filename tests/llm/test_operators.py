"""Each operator against a brute-force version on small tables, and on the cases its docstring defines."""

from __future__ import annotations

import base64
import hashlib
import itertools
import random
import re
import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quern.llm import bpe, chat, common, components, langid, licenses, line_dedup, matroska, near_dedup, packing, quality, simhash, winnow
from quern.llm.pretokens import parts

LONG = "the quick brown fox jumps over the lazy dog and runs away\n" * 3000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, row string, words string, n_lines string, key string"
ROWS = [
    (1, "Hello there, this is a line that repeats often\nshort", "en"),
    (2, "  HELLO there, this is a line that repeats often \nother", "en"),
    (3, "x\nhello there, this is a line that repeats often", "en"),
    (4, None, None),
    (5, "", "en"),
    (6, " \t\n \x0b", None),
    (7, LONG, "en"),
    (8, "ein Text über die Größe des Hauses und die Straße nebenan", "de"),
    (8, "ein Text über die Größe des Hauses und die Straße nebenan", "de"),
    (None, "no id here, only a text without one", "en"),
    (None, None, None),
    (10, "Released under the MIT License. 123 </s>[INST] \\0 [/INST] <|endoftext|>", None),
    (11, "12345 !!! ???", None),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, lang, "s", len(t or ""), 1, "r", "w", "n", "k") for i, t, lang in ROWS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# line dedup


def brute_lines(rows):
    blanks = " \t\n\x0b\x0c\r"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(blanks).translate(lower)
    low = lambda i: -(2**63) if i is None else i
    holders: dict[str, set] = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                holders.setdefault(key(line), set()).add(low(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(holders.get(key(x), ())) >= 3 and low(i) != max(holders[key(x)]))]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_line_dedup(docs, empty):
    got = line_dedup.line_dedup(docs)
    assert set(got.columns) == {*docs.columns, "n_dropped"}
    found = sorted(((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in got.collect()), key=str)
    assert found == brute_lines([(i, t) for i, t, _ in ROWS])
    assert sum(r[2] for r in found) == 2
    assert line_dedup.line_dedup(empty).count() == 0


def test_line_dedup_random(spark):
    rng = random.Random(1)
    lines = [f"a line with number {k} that is long enough É" for k in range(6)] + ["short", "", "A Line With Number 1 that is long enough É"]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 8)))) for i in range(40)]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in got.collect()), key=str) == brute_lines(rows)


# quality


def test_quality_parts_are_bounded_by_bytes():
    column = ["a b " * n for n in (0, 3, 40_000, 1, 20_000, 20_000, 5)] + [None, ""] * 200
    found = list(quality.parts(pa.RecordBatch.from_arrays([pa.array(column)], ["text"])))
    assert [t for part in found for t in part] == [(t or "").encode() for t in column]
    assert all(sum(map(len, part[:-1])) < quality.PART and len(part) <= 256 for part in found)


def test_quality(spark, docs, empty):
    rng = random.Random(2)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    clean = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(4, 60))), 1) for i in range(300)]
    junk = [(1000 + i, " ".join(rng.choice(words) + rng.choice(["***", "$$$"]) for _ in range(rng.randint(10, 60))), 0) for i in range(40)]
    df = spark.createDataFrame(clean + junk, "doc_id long, text string, good int")
    labels = df.filter("doc_id % 2 = 0").select("doc_id", F.col("good").alias("quality"), F.lit(0).alias("toxic"))
    kept = {r.doc_id for r in quality.keep_sampled(df, labels).collect()}
    assert kept >= {i for i, _, _ in clean} and not kept & {i for i, _, _ in junk}
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.keep_sampled(docs, none).count() == docs.count() and quality.keep_sampled(docs, none).columns == docs.columns
    assert quality.keep_sampled(empty, labels).count() == 0


def slow_ngrams(text):
    """The hashed n-grams of one text, word by word."""
    mask, base = 2**64 - 1, int(quality.BASE)

    def poly(codes, start):
        return sum(c * pow(base | 1, k, 1 << 64) for k, c in enumerate(codes, start)) & mask

    def bucket(h):
        h = ((h ^ h >> 31) * int(quality.MIX)) & mask
        return (h ^ h >> 29) % quality.BUCKETS

    kind = lambda c: 97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c
    found, last, last_shape = [], None, None
    for word in re.split(rb"[\x09-\x0d\x20]+", text):
        if word:
            own = poly(word.lower(), 0)
            shape = (poly([k for k, _ in itertools.groupby(map(kind, word))], 0) * 2 + (own == last)) & mask
            found += [bucket(own), bucket(shape) + quality.BUCKETS]
            if last is not None:
                found.append(bucket((last_shape * base + shape) & mask) + 2 * quality.BUCKETS)
                found.append(bucket((last * base + own) & mask) + 3 * quality.BUCKETS)
            last, last_shape = own, shape
    return found


def test_resampling_is_brute_force(spark):
    """Log importances and the Gumbel top-k by plain Python, with ties at the k-th score, repeated rows and null texts."""
    rng = random.Random(21)
    words = "Alpha beta beta Gamma 12 delta!! epsilon Zeta99".split()
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))) for i in range(120)] + [(200, None), (201, ""), (202, " \n")]
    rows += [rows[5]] * 3 + [(None, "no id")] * 2
    labels = {i: rng.randint(0, 1) for i in range(0, 120, 2)}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, q, 0) for i, q in labels.items()] + [(None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    raw, target = np.zeros(4 * quality.BUCKETS), np.zeros(4 * quality.BUCKETS)
    for i, t in rows:
        for f in slow_ngrams((t or "").encode()):
            raw[f] += 1
            target[f] += labels.get(i) == 1
    weights = []
    for t, r in zip(np.split(target, 4), np.split(raw, 4)):
        weights.append(np.log((t + quality.PRIOR) / (r * t.sum() / r.sum() + quality.PRIOR)))
    weights = np.concatenate(weights)
    noise = {r.doc_id: r.g for r in df.select("doc_id", quality.gumbel(F.col("doc_id")).alias("g")).collect()}
    want = [(i, sum(weights[f] for f in slow_ngrams((t or "").encode()))) for i, t in rows]
    scores = sorted((round((x + noise[i]) * 1e6) for i, x in want), reverse=True)
    for k in (1, 40, len(rows)):
        fitted = quality.Resampler(df, marks, k=k)
        got = fitted.scored.withColumn("kept", fitted.keeps()).collect()
        order = lambda pairs: sorted(pairs, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        for (i, x), (j, y) in zip(order((r.doc_id, r.importance) for r in got), order(want)):
            assert i == j and x == pytest.approx(y, abs=1e-6)
        assert all(r.kept == (r.key >= fitted.least) for r in got) and abs(fitted.least - scores[k - 1]) <= 1
        assert len({r.kept for r in got if r.doc_id == 5}) == 1 and sum(r.kept for r in got) >= k


def test_ngrams_do_not_depend_on_the_batch():
    texts = [(t or "").encode() for _, t, _ in ROWS]
    one = [sorted(quality.ngrams([t])[1].tolist()) for t in texts]
    doc, feature = quality.ngrams(texts)
    assert [sorted(feature[doc == k].tolist()) for k in range(len(texts))] == one
    assert len(one[0]) == 4 * len(texts[0].split()) - 2 and one[3] == one[4] == one[5] == []


def test_kth_largest(spark):
    rng = random.Random(3)
    values = [rng.randint(-(10**12), 10**12) for _ in range(500)] + [7] * 20
    df = spark.createDataFrame([(v,) for v in values], "key long")
    for k in (1, 17, 260, 520):
        assert quality.kth_largest(df, k) == sorted(values, reverse=True)[k - 1]
    assert quality.kth_largest(df, 521) is None


# language


def test_language_id(spark, docs, empty):
    rng = random.Random(4)
    pools = {"en": "the and of with that from this have not".split(), "de": "der die und nicht über schön größe ein".split()}
    rows = [(k, " ".join(rng.choice(pools[lang]) for _ in range(rng.randint(3, 40))), lang) for k in range(400) for lang in pools]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.LanguageModel(df.filter(~langid.held_out("doc_id")))
    assert len(model.langs) == 8
    test = df.filter(langid.held_out("doc_id")).select("lang", model.predict(F.col("text")).alias("p")).collect()
    assert all(r.p.lang == r.lang and 0 <= r.p.score <= 1 for r in test) and test
    by_text = {r.text: r.p for r in docs.select("text", model.predict(F.col("text")).alias("p")).collect()}
    assert by_text[None].lang == by_text[""].lang == by_text["12345 !!! ???"].lang == "und" and by_text[None].score == 0
    assert langid.keep_known(docs).columns == docs.columns
    assert langid.LanguageModel(empty).langs == [] and langid.keep_known(empty).count() == 0
    assert model.predict(F.lit("x")) is not None


FOREIGN = [
    "kaikki ihmiset syntyvat vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu jarki ja omatunto",
    "все люди рождаются свободными и равными в своем достоинстве и правах они наделены разумом и совестью",
    "人人生而自由在尊严和权利上一律平等他们赋有理性和良心并应以兄弟关系的精神相对待",
    "minden emberi leny szabadon szuletik es egyenlo meltosaga es joga van az emberek esszel es lelkiismerettel birvan",
    "alle mensen worden vrij en gelijk in waardigheid en rechten geboren zij zijn begiftigd met verstand en geweten",
    random.Random(1).randbytes(300).hex(),
    base64.b64encode(random.Random(2).randbytes(300)).decode(),
    "zzzz qqqq " * 30,
]


def test_foreign_and_garbage_texts_are_rejected_labelled_or_not(spark):
    own = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    planted = [(10**9 + 100 * k + j, t, lang) for k, t in enumerate(FOREIGN) for j, lang in enumerate(("en", "de", "fr", "es", None))]
    kept = {r.doc_id for r in langid.keep_known(own.unionAll(spark.createDataFrame(planted, "doc_id long, text string, lang string"))).select("doc_id").collect()}
    assert [(t[:9], lang) for i, t, lang in planted if i in kept] == []
    clean = {r.doc_id for r in own.filter(r"text RLIKE '\\p{L}'").select("doc_id").collect()}
    assert len(clean - kept) <= len(clean) // 200


def test_language_model_is_brute_force(spark):
    """Sample, frequencies and predictions by plain Python; equal ids with different texts and rows without an id take part."""
    rng = random.Random(20)
    pools = {"en": "the and of with that from this have not".split(), "de": "der die und nicht über schön größe ein".split()}
    rows = [(k % 90 if k % 7 else None, " ".join(rng.choice(pools[lang]) for _ in range(rng.randint(3, 20))), lang) for k in range(150) for lang in pools]
    rows += rows[:20] + [(500, None, "en"), (501, "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.LanguageModel(df, sample=40)
    train = [(i, t, lang) for i, t, lang in rows if t is not None and lang is not None]
    counts = [langid.counts_of([t.encode()])[0] for _, t, _ in train]
    seen = sum((c > 0).astype(int) for c in counts)
    idf = np.log((1 + len(train)) / (1 + seen)) + 1
    assert np.allclose(model.idf, idf, rtol=1e-5)
    hashed = {(r.doc_id, r.text, r.lang): (r.place, r.tie) for r in df.filter("text IS NOT NULL").select("*", F.xxhash64(F.col("doc_id").cast("string"), "text").alias("place"), F.xxhash64(F.lit(1), F.col("doc_id").cast("string"), "text").alias("tie")).collect()}
    for lang in pools:
        sample = sorted({(hashed[r], r) for r in train if r[2] == lang}, key=lambda x: x[0])[:40]
        x = [np.log1p(langid.counts_of([r[1].encode()])[0]) * idf for _, r in sample]
        x = np.array([v / np.linalg.norm(v) for v in x], np.float32)
        frame = pd.DataFrame({"lang": lang, "place": [h[0] for h, _ in sample], "text": [r[1] for _, r in sample]})
        want = langid.cluster(frame, model.idf.tobytes())
        own = [k for k, name in enumerate(model.langs) if name == lang]
        assert sorted(np.frombuffer(c, np.float32).round(4).tolist() for c in want["center"]) == sorted(model.centers[k].round(4).tolist() for k in own)
        assert np.allclose(np.linalg.norm(x, axis=1), 1)
    for r in df.filter("text IS NOT NULL").select("text", model.predict(F.col("text")).alias("p")).collect():
        v = np.log1p(langid.counts_of([r.text.encode()])[0]) * idf
        cosines = model.centers @ (v / np.linalg.norm(v))
        best = int(np.argmax(cosines))
        assert r.p.score == pytest.approx(cosines[best], abs=1e-4) and cosines[model.langs.index(r.p.lang)] <= cosines[best] + 1e-4
        assert abs(cosines[best] - model.least[best] * langid.REACH) < 1e-4 or r.p.rejected == (cosines[best] < model.least[best] * langid.REACH)


def test_held_out_is_crc32(docs):
    got = {(r.doc_id, r.h) for r in docs.filter("doc_id IS NOT NULL").select("doc_id", langid.held_out("doc_id").alias("h")).collect()}
    assert got == {(i, zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in ROWS if i is not None}


# media


def test_matroska_round_trip(docs, empty):
    got = matroska.store_texts(docs).collect()
    assert len(got) == len(ROWS)
    for r in got:
        text = next((t or "") for i, t, _ in ROWS if i == r.doc_id and len((t or "").encode()) == r.n_bytes).encode()
        padded = text + bytes(-len(text) % 64 or (0 if text else 64))
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert r.media_sha256 == hashlib.sha256(r.media).hexdigest() and matroska.payload(bytes(r.media), matroska.parse(bytes(r.media))) == padded
    assert matroska.store_texts(empty).count() == 0
    table = matroska.packet_table(matroska.store_texts(docs))
    assert table.filter("error IS NOT NULL").count() == 0 and table.agg(F.sum("size")).first()[0] == sum(r.payload_bytes for r in got)


def test_matroska_parser_lacings_and_errors(spark):
    frames = [b"a" * 300, b"b" * 5, b"c" * 700, b"d"]
    for kind in (matroska.XIPH_LACING, matroska.EBML_LACING):
        cluster = matroska.element(matroska.CLUSTER, matroska.number(matroska.CLUSTER_TIME, 7) + matroska.block(1, -3, frames, kind))
        data = matroska.element(matroska.EBML, b"") + matroska.element(matroska.SEGMENT, cluster)
        packets = matroska.parse(data).packets
        assert [data[at : at + n] for _, _, at, n, _, _ in packets] == frames and packets[0][1] == 4_000_000 and packets[0][5] == kind
    group = matroska.element(matroska.BLOCK_GROUP, matroska.element(matroska.BLOCK, b"\x81\x00\x01\x00xyz") + matroska.number(matroska.REFERENCE_BLOCK, 1))
    body = matroska.number(matroska.CLUSTER_TIME, 0) + group
    unknown = matroska.CLUSTER.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + body
    data = matroska.element(matroska.EBML, b"") + matroska.SEGMENT.to_bytes(4, "big") + b"\xff" + unknown + unknown
    media = matroska.parse(data)
    assert len(media.clusters) == 2 and [(p[3], p[4]) for p in media.packets] == [(3, False)] * 2
    for broken in (b"", b"RIFF", data[:20], matroska.write(b"\0" * 64)[:-5]):
        with pytest.raises(ValueError):
            matroska.parse(broken)
    df = spark.createDataFrame([(1, None), (2, bytearray(b"no media"))], "doc_id long, media binary")
    assert [(r.media_id, r.error is not None) for r in matroska.packet_table(df).collect()] == [(2, True)]
    big = matroska.write(bytes(300_032))
    found = matroska.parse(big)
    assert [c[2] + 4 < s[1] for c, s in zip(found.cues, found.clusters)] and len(found.cues) == len(found.clusters) == 3


# tokenizers

SIGNS = ["a", "the", "ing", " ", "  ", "\n", "\t", "\r", "\x0b", "\x1c", "\x85", " ", "é", "ß", "1", "²", "Ⅷ", "'s", "'", "!", "***", "中", "😀", "́", "<|endoftext|>", "-"]


def texts_of(n):
    rng = random.Random(5)
    return ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 25))) for _ in range(n)]


@pytest.fixture(scope="module")
def encoder():
    return bpe.TextEncoder(str(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)


def test_parts_join_to_the_text():
    for t in texts_of(2000):
        assert "".join(parts(t)) == t


def test_bpe_is_tiktoken(encoder):
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.encoder.ranks, special_tokens={})
    for t in [*texts_of(1500), *(t or "" for _, t, _ in ROWS[:6]), "x" * 400, " " * 300]:
        ids = encoder.ids(t)
        assert [int(x) for x in ids.split()] == plain.encode_ordinary(t) and encoder.decode(ids) == t.encode()


def test_bpe_appends_and_edits_are_exact(encoder):
    own, rng = encoder.encoder, random.Random(6)
    make = lambda n: bytes(rng.choice(b"abcthe ing") for _ in range(n))
    for _ in range(60):
        piece, new = make(rng.randint(1, 300)), make(rng.randint(0, 6))
        a = rng.randint(0, len(piece))
        b = rng.randint(a, min(len(piece), a + 6))
        last = own.extend(piece, [])
        assert own.extend(piece + new, list(last)) == own.extend(piece + new, [])
        changed, table = own.edit(piece, last, a, b, new)
        assert changed == piece[:a] + new + piece[b:] and table == own.extend(changed, [])
        assert own.backtrack(last) == own.merge(piece)[-1]


def test_merge_trees_judge_neighbours_as_merging_does(encoder):
    own, rng = encoder.encoder, random.Random(16)
    ranks = {bytes([b]): b for b in range(256)}
    for _ in range(400):  # a small vocabulary of few letters, whose tokens overlap in every way, grown as training does
        a, b = (rng.choice(list(ranks)[97:100] + list(ranks)[256:]) for _ in "ab")
        if len(a + b) < 9 and bpe.PrefixEncoder(ranks).merge(a + b)[-1] == [ranks[a], ranks[b]]:
            ranks[a + b] = len(ranks)
    small = bpe.PrefixEncoder(ranks, pairs=50)
    for encode, tokens in ((own, list(own.tokens)), (small, [97, 98, 99, *range(256, len(ranks))])):
        for _ in range(4000):
            a, b = rng.choice(tokens), rng.choice(tokens)
            fine = encode.halves(a) is not None and encode.halves(b) is not None
            assert not fine or encode.may_follow(a, b) == (encode.merge(encode.tokens[a] + encode.tokens[b])[-1] == [a, b])
    for _ in range(300):
        piece = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 40)))
        assert small.backtrack(small.extend(piece, [])) == small.merge(piece)[-1]


def test_bpe_texts_are_edited_near_the_change(encoder):
    rng = random.Random(17)
    for t in texts_of(400):
        a = rng.randint(0, len(t))
        b = rng.randint(a, len(t))
        for start, end, new in ((a, b, rng.choice(texts_of(20))), (len(t), len(t), rng.choice(SIGNS))):
            changed, ids = encoder.replace(t, encoder.ids(t), start, end, new)
            assert changed == t[:start] + new + t[end:] and ids == encoder.ids(changed)


def test_bpe_frames(docs, empty):
    path = str(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoded = bpe.encode_texts(docs, path, public_tokenizers.PATTERN)
    back = bpe.decode_ids(encoded, path)
    assert sorted(bytes(r.bytes).decode() for r in back.collect()) == sorted(t or "" for _, t, _ in ROWS)
    assert bpe.encode_texts(empty, path, public_tokenizers.PATTERN).count() == 0


def test_packing_ids_are_those_of_tokenizers():
    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    own, plain = packing.Ids(path), Tokenizer.from_file(path)
    for t in [*texts_of(1500), LONG[:5000], "a <|endoftext|> b", "<|endoftext|><|endoftext|>  x", "<|endoftext|", " <|endoftext|>"]:
        assert np.frombuffer(own.of(t), "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids


def check_packing(rows, lengths):
    docs, sequences = {}, {}
    for r in rows:
        docs.setdefault(r[0], []).append((r[1], r[2], r[4]))
        sequences.setdefault(r[5], []).append((r[6], r[2], r[7]))
    for pieces in sequences.values():
        at = 0
        for offset, length, _ in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= 1024 and not at & (at - 1)  # a power of two: no padding
    for doc, n in lengths.items():
        at = 0
        for start, length, total in sorted(docs[doc]):
            assert start == at and total == n
            at += length
        assert at == n


def test_packer():
    rng = random.Random(7)
    packer, lengths = packing.Packer(0, waiting=20), {}
    for k in range(300):
        lengths[k] = rng.choice([1, 5, 63, 64, 65, 1000, 1023, 1024, 1025, 2048, rng.randint(1, 4000)])
        packer.add(k, np.arange(lengths[k], dtype="<u4").tobytes())
    packer.finish()
    check_packing(packer.rows, lengths)
    for doc, start, length, crc, *_ in packer.rows:
        assert crc == zlib.crc32(np.arange(start, start + length, dtype="<u4").tobytes())
    groups = {}
    for r in packer.rows:
        groups[(r[7], r[8])] = groups.get((r[7], r[8]), 0) + r[2]
    assert all(v <= packing.GROUP_TOKENS for v in groups.values())


def test_packing_frames(docs, empty):
    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack(docs, path).collect()
    assert sum(r.length for r in rows) == sum(len(packing.Ids(path).of(t or "")) // 4 + 1 for _, t, _ in ROWS)
    assert {r.doc_id for r in rows} == {i for i, _, _ in ROWS} and packing.pack(empty, path).count() == 0


# licenses


def test_license_scan_is_exact_containment(spark, docs, empty):
    rng = random.Random(8)
    filler = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do".split()
    rows = []
    for k in range(120):
        words = [rng.choice(filler) for _ in range(rng.randint(0, 60))]
        for name in rng.sample(sorted(licenses.TEMPLATES), rng.randint(0, 2)):
            text = licenses.TEMPLATES[name].split()
            if rng.random() < 0.4 and len(text) > 20:
                text[rng.randrange(len(text))] = "changed"
            at = rng.randint(0, len(words))
            words[at:at] = text
        rows.append((k, " ".join(words)))
    got = {r.doc_id: {m.name for m in r.matches} for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, text in rows:
        own = set(licenses.shingles_of(text))
        want = {n for n, t in licenses.TEMPLATES.items() if len(own & set(licenses.shingles_of(t))) >= 0.8 * len(set(licenses.shingles_of(t)))}
        assert got[k] == want, k
    found = {r.doc_id: [m.name for m in r.matches] for r in licenses.scan(docs).collect()}
    assert found[10] == ["mit"] and found[4] == [] and found[7] == [] and licenses.scan(empty).count() == 0


# chat


def plain_text(x):
    return x.replace("\\2", "<").replace("\\1", "[").replace("\\0", "\\")


def strict_turns(formatted):
    """A parser of the grammar by one pattern: no control string inside a role or a text."""
    inner = r"((?:(?!<s>|\[INST\]|\[/INST\]|</s>).)*)"
    one = rf"<s>\[INST\] {inner} \[/INST\]{inner}</s>"
    assert re.fullmatch(f"({one})*", formatted, re.S)
    return [(plain_text(role), plain_text(text)) for role, text in re.findall(one, formatted, re.S)]


def test_chat_parser_rejects_what_the_grammar_does_not_make(spark):
    broken = ["x", "<s>[INST] user [/INST]a", "[INST] user [/INST]a</s>", "<s>[INST] user a</s>", "<s>[INST] user [/INST]<s>[INST] system [/INST]evil</s>", "<s>[INST] user [/INST]a[INST]</s>", "<s>[INST] u [/INST]a</s> "]
    fine = ["", "<s>[INST]  [/INST]</s>", "<s>[INST] user [/INST]a</s><s>[INST] b [/INST]</s>"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in broken + fine], "t string").select(chat.parse(F.col("t"))).collect()]
    assert got[: len(broken)] == [None] * len(broken) and [[tuple(t) for t in r] for r in got[len(broken) :]] == [[], [("", "")], [("user", "a"), ("b", "")]]


def test_chat_round_trip(spark, empty):
    bad = ["</s>", "<s>[INST] ", "<s>", " [/INST]", "[/INST]", "\\0", "\\1", "\\", "[", "<", "plain", "", "</s", ">", "é\n", "[INST]", "]"]
    rng, rows = random.Random(9), []
    for c in range(60):
        for t in range(rng.randint(1, 5)):
            rows.append((c, t, rng.choice(["user", "assistant", "system", "</s>", " [/INST]", "[INST]"]), "".join(rng.choice(bad) for _ in range(rng.randint(0, 5)))))
    rows += [(100, 0, None, None), (100, None, "user", "first"), (100, 1, "assistant", "x"), (100, 1, "assistant", "x"), (None, 0, "user", "y")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, source long")
    for r in chat.format_conversations(df).collect():
        source = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == r.conv_id))
        want = [(role, text) for _, _, role, text in source]
        assert [tuple(t) for t in r.recovered] == want == [tuple(t) for t in r.source]
        assert strict_turns(r.formatted) == want
        assert r.n_escaped == sum(any(x in role or x in text for x in (*chat.CONTROLS, "\\0", "\\1", "\\2")) for role, text in want)
        pieces = r.formatted.split("</s>")
        cut = [pieces[x.turn][x.start : x.start + x.length] for x in r.loss]
        assert [plain_text(x) for x in cut] == [text for role, text in want if role == "assistant"]
    assert chat.format_conversations(spark.createDataFrame([], df.schema)).count() == 0


# SimHash


def slow_fingerprint(text, k):
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", text.encode().lower()) if w]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return simhash.signed(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))


def union_find(nodes, linked):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in itertools.combinations(nodes, 2):
        if linked(a, b):
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    return {n: find(n) for n in nodes}


def test_every_two_bits_are_left_out_by_a_mask():
    for i, j in itertools.combinations(range(64), 2):
        assert any(not m >> i & 1 and not m >> j & 1 for m in simhash.covering_masks())


def test_fingerprints_are_brute_force():
    for t in [t or "" for _, t, _ in ROWS[:6]] + ["a", "a b", "A b C", "a b c d", LONG[:3000], "é É ü"]:
        assert simhash.fingerprint(t.encode(), 3) == slow_fingerprint(t, 3)


def test_links_are_brute_force(spark):
    rng, points = random.Random(10), set()
    for _ in range(4):
        cluster = [rng.getrandbits(64)]
        for _ in range(70):
            x = rng.choice(cluster)
            for b in rng.sample(range(64), rng.choice([1, 1, 2, 2, 3])):
                x ^= 1 << b
            cluster.append(x)
        points |= set(cluster)
    fp = {k: simhash.signed(x) for k, x in enumerate(sorted(points))}
    df = spark.createDataFrame(list(fp.items()), "id long, fp long")
    got = {r.id: r.component_id for r in df.join(simhash.classes(df), "fp").collect()}
    assert got == union_find(list(fp), lambda a, b: ((fp[a] ^ fp[b]) & (2**64 - 1)).bit_count() <= 2)


def test_near_duplicates(docs, empty):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    zero = [r for r in got if r.fingerprint == "0" * 16]
    assert {r.doc_id for r in zero} >= {4, 5, 6, None} and {r.component_id for r in zero} == {4}
    assert simhash.near_duplicates(empty).count() == 0


def similar(a, b, k=5):
    x, y = (set(simhash.shingle_hashes(t.encode(), k).tolist()) for t in (a, b))
    return not x | y or len(x & y) >= 0.8 * len(x | y)


def test_keep_one_is_brute_force(spark):
    rng, texts = random.Random(13), []
    for _ in range(25):
        base = [rng.choice("abcdefghij") + str(rng.randint(0, 200)) for _ in range(rng.choice([3, 30, 120, 400]))]
        for _ in range(rng.randint(1, 8)):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                own[rng.randrange(len(own))] = "changed" + str(rng.randint(0, 9))
            texts.append(" ".join(own))
    texts += ["", "  ", "one", "One"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = sorted(r.doc_id for r in near_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted(set(union_find([i for i, _ in rows], lambda a, b: similar(texts[a], texts[b])).values()))


def test_keep_one_finds_pairs_within_a_family(spark):
    # 400 texts that are about 0.76 alike, planted in pairs that are about 0.84 alike
    rng = random.Random(5)
    base, texts = [f"b{i}" for i in range(360)], []
    for k in range(200):
        pair = base + [f"p{k}_{i}" for i in range(20)]
        texts += [" ".join(pair + [f"o{k}_{side}_{i}" for i in range(32)]) for side in (0, 1)]
    rng.shuffle(texts)
    sets = [set(simhash.shingle_hashes(t.encode(), 5).tolist()) for t in texts]
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    rows = list(enumerate(texts))
    want = sorted(set(union_find(list(range(len(texts))), alike).values()))
    assert len(want) == 200
    got = sorted(r.doc_id for r in near_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == want


def test_keep_one_finds_pairs_within_a_large_family(spark):
    # 4,000 texts that are about 0.69 alike; 400 of them have a partner at 0.8 to 0.9, all in the same buckets
    rng = random.Random(15)
    base, texts = [f"b{i}" for i in range(360)], []
    for k in range(4000):
        own = base + [f"o{k}_{i}" for i in range(76)]
        texts.append(" ".join(own))
        if k < 400:
            other = list(own)
            other[-(8 + k % 40) :] = [f"x{k}_{i}" for i in range(8 + k % 40)]
            texts.append(" ".join(other))
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = [(i, texts[k]) for i, k in enumerate(order)]
    place = {k: i for i, k in enumerate(order)}
    gone = {max(place[2 * k], place[2 * k + 1]) for k in range(400) if similar(texts[2 * k], texts[2 * k + 1])}
    assert len(gone) > 300 and not similar(texts[800], texts[801])
    got = {r.doc_id for r in near_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(place.values()) - got == gone


def test_rows_of_one_id_and_other_texts_stay(spark):
    rows = [(1, "a b c"), (1, "d e f"), (1, "d e f"), (2, "a b c"), (None, "g h"), (None, "g h"), (None, "i j"), (3, "i j")]
    got = near_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, "a b c"), (1, "d e f"), (None, "g h"), (3, "i j")], key=str)


def test_counted_joins_deal_hot_keys(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 2000, 0).otherwise(F.col("id")).alias("k"), "id")
    counted = common.checkpoint(rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("first")).filter("k < 2500"))
    want = list(map(tuple, rows.join(counted, "k", "left").select("id", "n", "first").collect()))
    for most in (0, 10**6):
        got = common.join_counted(rows, counted, ["k"], "n", F.xxhash64("id"), "left", most).select("id", "n", "first").collect()
        assert sorted(map(tuple, got), key=lambda r: r[0]) == sorted(want, key=lambda r: r[0])


def test_keep_one_of_odd_rows(docs, empty):
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    # 4, 5, 6 and the empty row without an id have no word; the rows of id 8 are one document
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 2, 3, 4, 7, 8, None, 10, 11], key=str)
    assert near_dedup.keep_one(empty).count() == 0


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(100)] + [(200, 201), (7, 7)], "u long, v long")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert got == {**{k: 0 for k in range(1, 101)}, 201: 200}
    assert {r.node: r.root for r in components.components(edges, most=0).collect()} == got
    assert components.components(edges.limit(0)).count() == 0


# winnowing


def chain(items, seed=42):
    for x in items:
        seed = xxhash.xxh64_intdigest(x, seed)
    return simhash.signed(seed)


def slow_winnow(text, k=winnow.K, w=winnow.W):
    """By the definition: each run's hash from its k tokens, each window's minimum from its w runs."""
    tokens = []
    for run in re.findall(r"[^\x20\x09-\x0D]+", text.lower()):
        tokens += [run] if len(run) <= 24 else list(run)
    tokens = [chain([x.encode()]) for x in tokens]
    turn = lambda x, by: (x << by | (x & 2**64 - 1) >> 64 - by) & 2**64 - 1 if by else x & 2**64 - 1
    runs = []
    for i in range(len(tokens) - k + 1):
        h = 0
        for j, x in enumerate(tokens[i : i + k]):
            h ^= turn(x & 2**64 - 1, k - 1 - j)
        runs.append(simhash.signed(h))
    if 0 < len(tokens) < k:
        runs = [chain(struct.pack("<q", x) for x in tokens)]
    rank = [(x & 2**64 - 1) >> 32 for x in runs]
    at = []
    for i in range(max(1, len(runs) - w + 1)):
        own = rank[i : i + w]
        if own:
            p = i + max(j for j, x in enumerate(own) if x == min(own))
            at += [p] if not at or at[-1] != p else []
    alone = list(range(len(tokens))) if len(tokens) < k + w - 1 else []
    return at + alone, [runs[p] for p in at] + [tokens[p] for p in alone]


def test_winnowing_is_brute_force(spark, docs, empty):
    rng = random.Random(11)
    rows = [(i, " ".join(rng.choice(["a", "b", "c", "d", "é\n", "中文" * 14]) for _ in range(rng.randint(0, 60)))) for i in range(60)]
    for df, texts in ((spark.createDataFrame(rows, "doc_id long, text string"), rows), (docs.filter("doc_id < 7"), [(i, t) for i, t, _ in ROWS if i and i < 7])):
        want = {i: slow_winnow(t or "") for i, t in texts}
        for r in winnow.fingerprints(df).collect():
            assert (list(r.positions), list(r.hashes)) == want[r.doc_id]
    assert winnow.fingerprints(empty).count() == 0


def test_winnowing_of_other_lengths_is_brute_force(spark):
    rng = random.Random(18)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 40)))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for k, w in ((1, 1), (2, 3), (3, 5), (7, 6), (4, 13)):
        for r in winnow.fingerprints(df, k=k, w=w).collect():
            assert (list(r.positions), list(r.hashes)) == slow_winnow(rows[r.doc_id][1], k, w)


def test_an_insertion_into_an_unbroken_run_leaves_its_other_hashes():
    rng = random.Random(19)
    text = "".join(chr(0x4E00 + rng.randrange(2000)) for _ in range(300))
    a, b = (set(slow_winnow(t)[1]) for t in (text, text[:20] + "x" + text[20:]))
    assert len(a & b) >= 0.9 * len(a)


def test_shared_runs_share_a_hash():
    rng = random.Random(12)
    for _ in range(200):
        shared = [rng.choice("abcdefgh") + str(rng.randint(0, 99)) for _ in range(winnow.W + winnow.K - 1)]
        a, b = ([rng.choice("xyz") + str(rng.randint(0, 99)) for _ in range(rng.randint(0, 20))] for _ in range(2))
        assert set(slow_winnow(" ".join(a + shared))[1]) & set(slow_winnow(" ".join(shared + b))[1])


def test_successors(spark):
    rows = [(i * i % 977, f"text {i}") for i in range(300)] + [(None, "null a"), (None, "null b"), (5, "dup"), (5, "dup")]
    df = spark.createDataFrame(rows, "id long, text string").withColumn("text_hash", F.xxhash64("text"))
    got = sorted(winnow.with_successor(df, ["id", "text"], rows_each=10).collect(), key=lambda r: (r.id is not None, r.id or 0, r.text_hash))
    assert len(got) == len(rows) and all((a.next.id, a.next.text) == (b.id, b.text) for a, b in zip(got, got[1:] + got[:1]))
    one = winnow.with_successor(df.limit(1), ["id"]).first()
    assert one.next.id == one.id and winnow.with_successor(df.limit(0), ["id"]).count() == 0
