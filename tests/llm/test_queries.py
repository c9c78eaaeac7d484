"""The registered queries on the smallest tables: against SQL where there is some, against brute force where not."""

from __future__ import annotations

import hashlib
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

import corpus_pipeline
from quern.llm import bpe, registry
from tests.compare import TABLES, mismatch
from tests.llm.test_operators import check_packing, slow_fingerprint, slow_winnow, union_find

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, name):
    assert mismatch(spark, SF, registry.queries()[name], registry.oracle_sql()[name]) == ""


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.connect().execute(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall())


def rows(spark, name):
    return registry.queries()[name](spark, SF).collect()


def test_quality_labels(spark):
    labels = dict(duckdb.connect().execute(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'").fetchall())
    kept = {r.doc_id: r.kept for r in rows(spark, "op2_quality_resample")}
    good = [kept[i] for i, q in labels.items() if q == 1]
    bad = [kept[i] for i, q in labels.items() if q == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_language_held_out(spark):
    langs = dict(duckdb.connect().execute(f"SELECT doc_id, lang FROM '{SF}/documents.parquet'").fetchall())
    got = [r for r in rows(spark, "op3_language_id") if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in got) >= 0.97 * len(got)


def test_media_digests(spark, texts):
    for r in rows(spark, "op4_matroska"):
        data = texts[r.doc_id].encode()
        padded = data + bytes(-len(data) % 64)
        assert (r.n_bytes, r.payload_sha256) == (len(data), hashlib.sha256(padded).hexdigest())


def test_bpe_is_tiktoken(spark, texts):
    ranks = bpe.read_ranks(str(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = rows(spark, "op5_byte_bpe")
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        ids = plain.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_packing_places_every_id_of_tokenizers_once(spark, texts):
    plain = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    ids = {i: [*plain.encode(t, add_special_tokens=False).ids, 0] for i, t in texts.items()}
    got = rows(spark, "op7_packing")
    check_packing([tuple(r) for r in got], {i: len(x) for i, x in ids.items()})
    for r in got:
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())


def test_simhash_components(spark, texts):
    fp = {i: slow_fingerprint(t, 3) for i, t in texts.items()}
    got = rows(spark, "op9_simhash")
    assert {r.doc_id: r.component_id for r in got} == union_find(sorted(fp), lambda a, b: ((fp[a] ^ fp[b]) & (2**64 - 1)).bit_count() <= 2)
    assert all(int(r.fingerprint, 16) == fp[r.doc_id] & (2**64 - 1) for r in got)


def test_winnowing_edits(spark, texts):
    ids = sorted(texts)
    got = {r.doc_id: r for r in rows(spark, "op10_winnowing")}
    assert len({r.fingerprint for i, r in got.items()}) == len({tuple(map(tuple, slow_winnow(t))) for t in texts.values()})
    like = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 1.0
    for i, j in zip(ids, ids[1:] + ids[:1]):
        n = len(texts[i]) // 4
        edited = texts[i][: len(texts[i]) - n] + texts[j][:n]
        own, new, other = (slow_winnow(t)[1] for t in (texts[i], edited, texts[j]))
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i].near_edited == pytest.approx(like(own, new)) and got[i].near_next == pytest.approx(like(own, other))


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept, SF).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == columns
        kept = out
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    after = spark.read.parquet(f"{tmp_path}/0")
    assert after.join(labels, "doc_id").filter("quality = 0").count() <= 0.1 * labels.filter("quality = 0").count()
    check_packing([tuple(r) for r in kept.collect()], {r.doc_id: r.doc_tokens for r in kept.collect()})
    assert corpus_pipeline.run(spark, SF).count() == kept.count()
    assert set(TABLES) >= {"documents", "labels"}


def test_pipeline_of_nothing(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
