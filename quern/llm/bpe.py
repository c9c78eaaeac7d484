"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For each prefix of a piece's bytes the encoding's last token is unique: it is the one token
that ends the prefix and may follow the last token of what stands before it. An Aho-Corasick
automaton names the tokens that end at each byte. Two tokens may follow each other if no merge
across their border comes before the merges that made them; their merge trees (which two tokens
each was made of) tell that by a walk down the border, without merging anything. The table of
last tokens is all the state there is, which makes appends exact and lets an edit reuse every
entry before it and, once enough entries agree again, every entry behind it.

Defined cases: null and empty texts have no tokens; texts of any length take memory in
proportion to their own size; repeated rows give repeated rows; an empty table gives an
empty one; only the named columns are read, so that others may have any name.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import accumulate
from pathlib import Path

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import read, remote
from quern.llm.pretokens import CUTS, PartCache, parts


def read_ranks(path: str) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, Path(path).read_bytes().splitlines())}


class PrefixEncoder:
    """Encodes one piece at a time; ``pairs`` bounds the remembered verdicts on neighbours."""

    def __init__(self, ranks: dict[bytes, int], pairs: int = 500_000) -> None:
        self.ranks, self.pairs = ranks, pairs
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.sizes = [len(self.tokens.get(rank, b"")) for rank in range(max(self.tokens, default=-1) + 1)]
        self.longest = max(self.sizes, default=0)
        self.follows: dict[int, bool] = {}
        self.trees: dict[int, tuple[int, int] | None] = {}  # these two have at most an entry or two per token
        self.spines: dict[int, list[tuple[bytes, float]]] = {}
        self.ending = ahocorasick.Automaton(ahocorasick.STORE_INTS)  # token bytes as Latin-1 -> rank
        for token, rank in ranks.items():
            self.ending.add_word(token.decode("latin-1"), rank)
        self.ending.make_automaton()

    def merge(self, piece: bytes) -> list[list[int]]:
        """Plain merging by rank, leftmost first: the definition. The parts after each merge, the last being the encoding."""
        cuts, states = [piece[i : i + 1] for i in range(len(piece))], []
        while True:
            states.append([self.ranks[c] for c in cuts])
            found = min(((self.ranks[a + b], i) for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if a + b in self.ranks), default=None)
            if found is None:
                return states
            at = found[1]
            cuts[at : at + 2] = [cuts[at] + cuts[at + 1]]

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens that make ``token``; (-1, -1) for a single byte, None where its own bytes do not merge to it.
        Bytes may have any ranks."""
        if token not in self.trees:
            states = self.merge(self.tokens[token])
            self.trees[token] = None if states[-1] != [token] else tuple(states[-2]) if len(states) > 1 else (-1, -1)
            if any(h > token and self.sizes[h] > 1 for h in self.trees[token] or ()):
                raise ValueError("ranks must ascend from a token's halves to the token, as training gives them")
        return self.trees[token]

    def spine(self, token: int, side: int) -> list[tuple[bytes, float]]:
        """The nodes on one side of a token's merge tree, from the byte up, each with the rank of the merge that ends it."""
        if (known := self.spines.get(token << 1 | side)) is None:
            known, node, ends = [], token, float("inf")
            while node >= 0:
                known.append((self.tokens[node], ends))
                ends, node = node, self.halves(node)[side]
            known.reverse()
            self.spines[token << 1 | side] = known
        return known

    def may_follow(self, before: int, token: int) -> bool:
        """``before`` -1: whether ``token`` may begin a piece, that is, whether its bytes merge to itself.

        The two nodes at the border change as ranks ascend; at each moment their own merge across it must not come
        before the next merge on either side. Of equal ranks the left one comes first."""
        if self.halves(token) is None:
            return False
        if before < 0:
            return True
        left, right, i, j = self.spine(before, 1), self.spine(token, 0), 0, 0
        while True:
            (a, a_ends), (b, b_ends) = left[i], right[j]
            across = self.ranks.get(a + b)
            if across is not None and across < a_ends and across <= b_ends:
                return False
            if a_ends <= b_ends:
                i += 1
            else:
                j += 1
            if i == len(left) or j == len(right):
                return True

    def judge(self, before: int, token: int) -> bool:
        """``may_follow``, remembered."""
        if len(self.follows) >= self.pairs:
            self.follows.clear()
        known = self.follows[before << 32 | token] = self.may_follow(before, token)
        return known

    def extend(self, piece: bytes, last: list[int], upto: int | None = None) -> list[int]:
        """``last`` continued to one entry per prefix of ``piece`` (up to ``upto`` bytes): an exact append."""
        known, judge, sizes = self.follows.get, self.judge, self.sizes
        have, stop = len(last), len(piece) if upto is None else upto
        if have >= stop:
            return last
        for end, token in self.ending.iter(piece.decode("latin-1"), max(0, have + 1 - self.longest), stop):
            if end < have:
                continue
            start = end + 1 - sizes[token]
            before = last[start - 1] if start else -1
            ok = known(before << 32 | token)
            if ok is None:
                ok = judge(before, token)
            if ok:
                last.append(token)
                have += 1
        if have != stop:
            raise ValueError(f"no token ends at byte {have + 1}")
        return last

    def edit(self, piece: bytes, last: list[int], start: int, end: int, new: bytes) -> tuple[bytes, list[int]]:
        """``piece`` with the bytes from ``start`` to ``end`` replaced, and its table. Entries before the edit stay; behind
        it, once as many entries in a row agree as a token is long, the old ones hold."""
        changed = piece[:start] + new + piece[end:]
        table, shift, at, same = last[:start], len(new) - (end - start), start, 0
        while at < len(changed):
            self.extend(changed, table, min(len(changed), max(at, start + len(new)) + self.longest))
            for at in range(at + 1, len(table) + 1):
                if at > start + len(new):
                    same = same + 1 if table[at - 1] == last[at - shift - 1] else 0
                    if same >= self.longest:
                        return changed, table[:at] + last[at - shift :]
        return changed, table

    def backtrack(self, last: list[int]) -> list[int]:
        ids, at = [], len(last)
        while at:
            ids.append(last[at - 1])
            at -= self.sizes[last[at - 1]]
        return ids[::-1]

    def encode(self, piece: bytes) -> list[int]:
        """A piece that is itself a token is that token, as in the tiktoken library."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        return self.backtrack(self.extend(piece, []))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(self.tokens[i] for i in ids)


class TextEncoder:
    """Whole texts: the pattern's matches, each encoded by itself."""

    def __init__(self, path: str, pattern: str) -> None:
        self.encoder = PrefixEncoder(read_ranks(path))
        self.pattern = regex.compile(pattern)
        self.pieces = PartCache(lambda piece: " ".join(map(str, self.encoder.encode(piece.encode()))), 400_000)
        self.parts = PartCache(lambda part: " ".join(map(self.pieces.__getitem__, self.pattern.findall(part))))
        self.bytes_of = {str(i): token for i, token in self.encoder.tokens.items()}

    def ids(self, text: str) -> str:
        """Decimal ids joined by one space."""
        return " ".join(map(self.parts.__getitem__, parts(text))) if text else ""

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.split(" "))) if ids else b""

    def replace(self, text: str, ids: str, start: int, end: int, new: str) -> tuple[str, str]:
        """``text`` with the characters from ``start`` to ``end`` replaced, and its ids; ``ids`` are those of ``text``.
        Only what lies between the nearest cuts around the edit is encoded again; an append is an edit at the end."""
        cuts = [m.start() for m in CUTS.finditer(text)]
        first = max((c for c in cuts if c + 2 <= start), default=0)
        behind = min((c for c in cuts if c >= max(end, 1)), default=len(text))
        old = ids.split()
        ends = list(accumulate((len(self.bytes_of[i]) for i in old), initial=0))
        a, b = (ends.index(len(text[:c].encode())) for c in (first, behind))
        middle = self.ids(text[first:start] + new + text[end:behind])
        return text[:start] + new + text[end:], " ".join([*old[:a], *middle.split(), *old[b:]])


@cache
def text_encoder(path: str, pattern: str) -> TextEncoder:
    """One for each worker process and vocabulary."""
    return TextEncoder(path, pattern)


def encode_batches(batches: Iterator[pa.RecordBatch], path: str, pattern: str, with_ids: bool) -> Iterator[pa.RecordBatch]:
    own = text_encoder(path, pattern)
    for whole in batches:
        for start in range(0, whole.num_rows, 512):
            batch = whole.slice(start, 512)
            counts, digests, decoded, lists = [], [], [], []
            for text in batch.column(1).to_pylist():
                ids = own.ids(text or "")
                counts.append(ids.count(" ") + 1 if ids else 0)
                digests.append(hashlib.sha256(ids.encode()).hexdigest())
                decoded.append(hashlib.sha256(own.decode(ids)).hexdigest())
                if with_ids:
                    lists.append(list(map(int, ids.split())))
            arrays = [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
            if with_ids:
                arrays.append(pa.array(lists, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(arrays)])


def encode_texts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, with ``with_ids``, ids. One pass without a shuffle; the
    vocabulary file is read on each worker by its path."""
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return picked.mapInArrow(remote(__name__, "encode_batches", path, pattern, with_ids), schema)


def decode_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    tokens = {rank: token for token, rank in read_ranks(path).items()}
    for batch in batches:
        whole = [None if ids is None else b"".join(map(tokens.__getitem__, ids)) for ids in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(whole, pa.binary())], ["doc_id", "bytes"])


def decode_ids(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the bytes of its ids; null ids give null."""
    picked = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return picked.mapInArrow(remote(__name__, "decode_batches", path), "doc_id long, bytes binary")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as files

    return encode_texts(read(spark, sf_dir, "documents"), str(files.path("byte_bpe_50k.tiktoken")), files.PATTERN, with_ids=False)
