"""Hierarchical multi-length packing of documents into sequences of at most 1024 tokens.

A document's ids end with id 0. Whole windows of the longest tier are cut off as they are;
the rest is routed to the smallest tier (64 to 1024 tokens) that holds it. A tier's sequence
begins with its longest waiting rest; its gap is filled with the longest waiting rests that
fit, and at last with the first part of one that does not, so that it is exactly full. The
other part waits for its own tier. At the end of a partition the last tokens go to sequences
whose lengths are powers of two. No sequence needs padding.

Equal amounts of tokens of one tier make a step group (``group_tokens``), so that the steps
of a training run cost the same; only a partition's last group of a tier may be smaller.

Each task packs its own rows: no shuffle, and at most ``waiting`` rests are held at a time.

Defined cases: null and empty texts are their id 0 alone; a null id is kept as null; repeated
rows are packed once each; ties go to the rest that came first; an empty table gives an empty
one; only the named columns are read, so that others may have any name.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import read, remote
from quern.llm.pretokens import PartCache, parts

TIERS = (64, 128, 256, 512, 1024)
WAITING, GROUP_TOKENS, END = 2048, 16_384, 0
COLUMNS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


# Fixed value: the pattern that byte-level tokenizer files with ``use_regex`` imply.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def read_vocabulary(path: str) -> dict[bytes, int]:
    """A byte-level tokenizer file's tokens as bytes. Its signs stand for bytes: printable Latin-1 ones for themselves,
    those from 256 on for the other bytes in order. Added tokens are left out."""
    document = json.loads(Path(path).read_bytes())
    special = read_added(path)
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    byte_of = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}
    return {bytes(byte_of[c] for c in token): i for token, i in document["model"]["vocab"].items() if token not in special}


def read_added(path: str) -> dict[str, int]:
    """The tokens that are found in a text before its words are, special ones included, as the library does it by default."""
    added = json.loads(Path(path).read_bytes()).get("added_tokens", [])
    if any(t.get(flag) for t in added for flag in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("added tokens that take in their surroundings are not supported")
    return {t["content"]: t["id"] for t in added}


class Ids:
    """The ids of a byte-level BPE tokenizer's JSON file as little-endian 32-bit bytes.

    A text is cut at added tokens, then where the tokenizer's own pattern always cuts, and each new part is encoded
    once, by the file's vocabulary in tiktoken's merging loop, which gives the ids of the tokenizers library in a
    quarter of its time.
    """

    def __init__(self, path: str) -> None:
        self.encode = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=read_vocabulary(path), special_tokens={}).encode_ordinary
        self.parts = PartCache(self.make, 400_000)
        self.added = {token: array("I", [i]).tobytes() for token, i in read_added(path).items()}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.cut = re.compile(f"({'|'.join(map(re.escape, longest_first))})" if self.added else r"(?!)")

    def make(self, part: str) -> bytes:
        return array("I", self.encode(part)).tobytes()

    def of(self, text: str) -> bytes:
        """Between two matches of ``cut`` lies text of its own."""
        spans = self.cut.split(text)
        return b"".join(self.added[span] if k % 2 else b"".join(map(self.parts.__getitem__, parts(span))) for k, span in enumerate(spans) if span)


@cache
def ids_of(path: str) -> Ids:
    """One for each worker process and vocabulary."""
    return Ids(path)


class Packer:
    """Packs a stream of documents; ``rows`` gathers the pieces that are placed."""

    def __init__(self, base: int, tiers: tuple[int, ...] = TIERS, waiting: int = WAITING, group_tokens: int = GROUP_TOKENS) -> None:
        self.base, self.tiers, self.most, self.group_tokens = base, sorted(tiers), waiting, group_tokens
        self.rows: list[tuple] = []
        self.rests: list[tuple[int, int]] = []  # (length, -order), ascending: of equal lengths the first comes last
        self.held: dict[int, tuple] = {}
        self.order = self.sequences = 0
        self.in_tier: dict[int, int] = {}

    def add(self, doc: int | None, ids: bytes) -> None:
        """``ids``: little-endian 32-bit, with the end id."""
        total, top = len(ids) // 4, self.tiers[-1]
        for start in range(0, total - total % top, top):
            self.place([(doc, start, ids[4 * start : 4 * (start + top)], total)], top)
        if total % top:
            start = total - total % top
            self.wait((doc, start, ids[4 * start :], total))
        while len(self.rests) > self.most:
            self.fill()

    def wait(self, rest: tuple) -> None:
        insort(self.rests, (len(rest[2]) // 4, -self.order))
        self.held[-self.order] = rest
        self.order += 1

    def take(self, at: int) -> tuple:
        return self.held.pop(self.rests.pop(at)[1])

    def fill(self) -> None:
        """One full sequence that begins with the longest rest, or what is left at the end."""
        first = self.take(-1)
        size = len(first[2]) // 4
        tier = self.tiers[bisect_left(self.tiers, size)]
        pieces, gap = [first], tier - size
        while gap and self.rests:
            at = bisect_right(self.rests, (gap, 1)) - 1
            if at >= 0:
                pieces.append(self.take(at))
                gap -= len(pieces[-1][2]) // 4
            else:  # the shortest is too long: cut it
                doc, start, ids, total = self.take(0)
                pieces.append((doc, start, ids[: 4 * gap], total))
                self.wait((doc, start + gap, ids[4 * gap :], total))
                gap = 0
        if gap:
            self.split(pieces, tier - gap)
        else:
            self.place(pieces, tier)

    def split(self, pieces: list[tuple], length: int) -> None:
        """Sequences whose lengths are the powers of two in ``length``."""
        stream = list(pieces)
        while length:
            size = 1 << length.bit_length() - 1
            own, gap = [], size
            while gap:
                doc, start, ids, total = stream.pop(0)
                n = min(gap, len(ids) // 4)
                own.append((doc, start, ids[: 4 * n], total))
                if n < len(ids) // 4:
                    stream.insert(0, (doc, start + n, ids[4 * n :], total))
                gap -= n
            self.place(own, size)
            length -= size

    def place(self, pieces: list[tuple], tier: int) -> None:
        k = self.in_tier.get(tier, 0)
        self.in_tier[tier] = k + 1
        group = self.base + (tier.bit_length() << 34) + k // max(1, self.group_tokens // tier)
        sequence, offset = self.base + self.sequences, 0
        self.sequences += 1
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, sequence, offset, tier, group))
            offset += len(ids) // 4

    def finish(self) -> None:
        while self.rests:
            self.fill()


def pack_batches(batches: Iterator[pa.RecordBatch], path: str, tiers: tuple[int, ...], waiting: int, group_tokens: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    own = ids_of(path)
    packer = Packer(TaskContext.get().partitionId() << 40, tiers, waiting, group_tokens)
    kinds = [pa.int32() if c.endswith(" int") else pa.int64() for c in COLUMNS.split(", ")]
    names = [c.split()[0] for c in COLUMNS.split(", ")]

    def flush() -> pa.RecordBatch:
        rows, packer.rows = packer.rows, []
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    end = np.uint32(END).tobytes()
    for whole in batches:
        for start in range(0, whole.num_rows, 1024):
            batch = whole.slice(start, 1024)
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                packer.add(doc, own.of(text or "") + end)
            if packer.rows:
                yield flush()
    packer.finish()
    if packer.rows:
        yield flush()


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tiers: tuple[int, ...] = TIERS, waiting: int = WAITING, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """One row per piece of a document in a sequence; see ``COLUMNS``. ``path``: the tokenizer's JSON file on each worker."""
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(remote(__name__, "pack_batches", path, tuple(tiers), waiting, group_tokens), COLUMNS)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as files

    return pack(read(spark, sf_dir, "documents"), str(files.path("byte_bpe_50k.json")))
