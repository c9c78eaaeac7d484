"""Media columns: Matroska files in a binary column, written and parsed without a media library.

A file is a tree of EBML elements: an id and a size, both variable-length integers, then a
payload. ``parse`` walks that tree and returns a packet table: one row per frame with its
track, time, byte range, key flag and lacing, besides the tracks, clusters and cues.

Defined cases: a null or empty text is the payload of 64 zero bytes; a null media value has
no packets and no error; bytes that are no Matroska file give one packet row that carries
only ``error``. Repeated rows give repeated rows, an empty table an empty one, and only the
named columns are read, so that others may have any name.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import remote

# Fixed values of the Matroska specification (RFC 9559) and of EBML (RFC 8794).
EBML, DOC_TYPE, SEGMENT, INFO, TIMESTAMP_SCALE, DURATION = 0x1A45DFA3, 0x4282, 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489
MUXING_APP, WRITING_APP, TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID = 0x4D80, 0x5741, 0x1654AE6B, 0xAE, 0xD7, 0x73C5
TRACK_TYPE, FLAG_LACING, CODEC_ID, AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0x83, 0x9C, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
DEFAULT_DURATION, CLUSTER, CLUSTER_TIME, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x23E383, 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
REFERENCE_BLOCK, CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK = 0xFB, 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7
CUE_CLUSTER_POSITION, CUE_RELATIVE_POSITION = 0xF1, 0xF0
NO_LACING, XIPH_LACING, FIXED_LACING, EBML_LACING = 0, 1, 2, 3

RATE = 8000  #: samples a second of the files that are written
FRAME = 512  #: samples in a frame: 64 ms
LACED = 8  #: frames in a block at most
BLOCKS = 32  #: blocks in a cluster at most, so that a block's 16-bit time fits
ALIGN = 64


def vint(value: int, width: int = 0) -> bytes:
    """An EBML size: as short as can be, or of ``width`` bytes."""
    n = width or next(n for n in range(1, 9) if value < (1 << 7 * n) - 1)
    return (value | 1 << 7 * n).to_bytes(n, "big")


def element(key: int, payload: bytes) -> bytes:
    return key.to_bytes((key.bit_length() + 7) // 8, "big") + vint(len(payload)) + payload


def number(key: int, value: int) -> bytes:
    return element(key, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], kind: int) -> bytes:
    """The frames of one block behind the header of their lacing."""
    if kind == NO_LACING:
        return frames[0]
    head = bytes([len(frames) - 1])
    if kind == XIPH_LACING:
        head += b"".join(b"\xff" * (len(f) // 255) + bytes([len(f) % 255]) for f in frames[:-1])
    elif kind == EBML_LACING:
        head += vint(len(frames[0]))
        for before, f in zip(frames, frames[1:-1]):
            step = len(f) - len(before)
            n = next(n for n in range(1, 9) if abs(step) < (1 << 7 * n - 1) - 1)
            head += vint(step + (1 << 7 * n - 1) - 1, n)
    return head + b"".join(frames)


def block(track: int, time: int, frames: list[bytes], kind: int | None = None) -> bytes:
    if kind is None:
        kind = NO_LACING if len(frames) == 1 else FIXED_LACING if len(set(map(len, frames))) == 1 else EBML_LACING
    return element(SIMPLE_BLOCK, vint(track) + struct.pack(">hB", time, 0x80 | kind << 1) + lace(frames, kind))


def write(samples: bytes) -> bytes:
    """A Matroska file whose only track holds ``samples`` as 8-bit PCM; the same bytes for the same samples."""
    tick = FRAME * 1000 // RATE
    info = element(INFO, number(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(samples) * 1000 / RATE)) + element(MUXING_APP, b"quern") + element(WRITING_APP, b"quern"))
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)) + number(CHANNELS, 1) + number(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + number(FLAG_LACING, 1) + number(DEFAULT_DURATION, tick * 1_000_000) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio))
    parts, at, cues = [info, tracks], len(info) + len(tracks), []
    span = FRAME * LACED * BLOCKS
    for start in range(0, len(samples), span):
        inside = samples[start : start + span]
        time = start // FRAME * tick
        stamp = number(CLUSTER_TIME, time)
        body = [stamp]
        for k in range(0, len(inside), FRAME * LACED):
            body.append(block(1, k // FRAME * tick, [inside[i : i + FRAME] for i in range(k, min(k + FRAME * LACED, len(inside)), FRAME)]))
        cues.append(element(CUE_POINT, number(CUE_TIME, time) + element(CUE_TRACK_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER_POSITION, at) + number(CUE_RELATIVE_POSITION, len(stamp)))))
        parts.append(element(CLUSTER, b"".join(body)))
        at += len(parts[-1])
    parts.append(element(CUES, b"".join(cues)))
    return element(EBML, element(DOC_TYPE, b"matroska")) + element(SEGMENT, b"".join(parts))


@dataclass
class Media:
    """What ``parse`` finds. Times are nanoseconds; ``packets`` are (track, time, offset, size, key, lacing)."""

    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[tuple[int, int, int, int, bool, int]] = field(default_factory=list)
    clusters: list[tuple[int, int]] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    duration: int = 0


def read_vint(data: bytes, at: int, keep_mark: bool = False) -> tuple[int, int, bool]:
    """The value, the position behind it, and whether it stands for an unknown size."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no variable-length integer at byte {at}")
    n = 9 - data[at].bit_length()
    if at + n > len(data):
        raise ValueError(f"cut off in the integer at byte {at}")
    raw = int.from_bytes(data[at : at + n], "big")
    value = raw & (1 << 7 * n) - 1
    return (raw if keep_mark else value), at + n, value == (1 << 7 * n) - 1


#: Elements that end a cluster of unknown size.
TOP = {CLUSTER, CUES, INFO, TRACKS}


def children(data: bytes, at: int, end: int, stop: frozenset | set = frozenset()) -> Iterator[tuple[int, int, int]]:
    """(id, start, end) of the payloads between ``at`` and ``end``."""
    while at < end:
        key, body, _ = read_vint(data, at, True)
        if key in stop:
            return
        size, body, unknown = read_vint(data, body)
        if unknown:
            if key not in (SEGMENT, CLUSTER):
                raise ValueError(f"element {key:X} of unknown size")
            last = end
            if key == CLUSTER:  # up to the next element of its parent
                last = body
                for _, _, last in children(data, body, end, TOP):
                    pass
            yield key, body, last
            at = last
            continue
        if body + size > end:
            raise ValueError(f"element {key:X} at byte {at} ends behind its parent")
        yield key, body, body + size
        at = body + size


def unsigned(data: bytes, start: int, end: int) -> int:
    return int.from_bytes(data[start:end], "big")


def real(data: bytes, start: int, end: int) -> float:
    return 0.0 if start == end else struct.unpack(">f" if end - start == 4 else ">d", data[start:end])[0]


def sizes(data: bytes, at: int, end: int, kind: int) -> tuple[int, list[int]]:
    """Where the first frame of a block starts, and the frames' sizes."""
    if kind == NO_LACING:
        return at, [end - at]
    n, at = data[at] + 1, at + 1
    if kind == FIXED_LACING:
        if (end - at) % n:
            raise ValueError("frames of fixed lacing that differ in size")
        return at, [(end - at) // n] * n
    found: list[int] = []
    for k in range(n - 1):
        if kind == XIPH_LACING:
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            size, at = size + data[at], at + 1
        else:
            value, behind, _ = read_vint(data, at)
            size = value if not k else found[-1] + value - ((1 << 7 * (behind - at) - 1) - 1)
            at = behind
        found.append(size)
    found.append(end - at - sum(found))
    if min(found) < 0:
        raise ValueError("laced frames that are larger than their block")
    return at, found


def parse(data: bytes) -> Media:
    """The packet table of a Matroska file; ValueError for anything else."""
    media, scale = Media(), 1_000_000
    try:
        top = list(children(data, 0, len(data)))
        if not top or top[0][0] != EBML:
            raise ValueError("no EBML header")
        for _, base, segment_end in (x for x in top if x[0] == SEGMENT):
            for key, start, end in children(data, base, segment_end):
                if key == INFO:
                    info = {k: (a, b) for k, a, b in children(data, start, end)}
                    scale = unsigned(data, *info[TIMESTAMP_SCALE]) if TIMESTAMP_SCALE in info else scale
                    media.duration = round(real(data, *info[DURATION]) * scale) if DURATION in info else 0
                elif key == TRACKS:
                    for _, a, b in children(data, start, end):
                        entry = {k: (c, d) for k, c, d in children(data, a, b)}
                        sound = {k: (c, d) for k, c, d in children(data, *entry[AUDIO])} if AUDIO in entry else {}
                        media.tracks[unsigned(data, *entry[TRACK_NUMBER])] = {
                            "codec": data[slice(*entry[CODEC_ID])].decode() if CODEC_ID in entry else "",
                            "rate": real(data, *sound[SAMPLING_FREQUENCY]) if SAMPLING_FREQUENCY in sound else 0.0,
                            "bits": unsigned(data, *sound[BIT_DEPTH]) if BIT_DEPTH in sound else 0,
                            "frame_ns": unsigned(data, *entry[DEFAULT_DURATION]) if DEFAULT_DURATION in entry else 0,
                        }
                elif key == CLUSTER:
                    read_cluster(data, start, end, scale, media)
                elif key == CUES:
                    for _, a, b in children(data, start, end):
                        point = {k: (c, d) for k, c, d in children(data, a, b)}
                        place = {k: unsigned(data, c, d) for k, c, d in children(data, *point[CUE_TRACK_POSITIONS])}
                        media.cues.append((unsigned(data, *point[CUE_TIME]) * scale, place[CUE_TRACK], base + place[CUE_CLUSTER_POSITION]))
    except (IndexError, KeyError, struct.error) as e:
        raise ValueError(f"a broken file: {e!r}") from e
    return media


def read_cluster(data: bytes, start: int, end: int, scale: int, media: Media) -> None:
    time = 0
    for key, a, b in children(data, start, end):
        if key == CLUSTER_TIME:
            time = unsigned(data, a, b)
            media.clusters.append((time * scale, start))
        elif key == SIMPLE_BLOCK:
            read_block(data, a, b, time, scale, bool(data[a + 3] & 0x80) if data[a] & 0x80 else None, media)
        elif key == BLOCK_GROUP:
            inner = {k: (c, d) for k, c, d in children(data, a, b)}
            read_block(data, *inner[BLOCK], time, scale, REFERENCE_BLOCK not in inner, media)


def read_block(data: bytes, a: int, b: int, time: int, scale: int, key: bool | None, media: Media) -> None:
    track, at, _ = read_vint(data, a)
    shift, flags = struct.unpack(">hB", data[at : at + 3])
    key = bool(flags & 0x80) if key is None else key
    kind = flags >> 1 & 3
    at, found = sizes(data, at + 3, b, kind)
    stamp, frame_ns = (time + shift) * scale, media.tracks.get(track, {}).get("frame_ns", 0)
    for k, size in enumerate(found):
        media.packets.append((track, stamp + k * frame_ns, at, size, key, kind))
        at += size


def payload(data: bytes, media: Media, track: int = 1) -> bytes:
    """A track's bytes, by the byte ranges of its packets."""
    return b"".join(data[at : at + size] for t, _, at, size, _, _ in media.packets if t == track)


def describe(samples: bytes, media: Media) -> str:
    """Features of the stored sound: sizes of the tables, then level, loudness and zero crossings of the samples."""
    x = np.frombuffer(samples, np.uint8)
    counts = np.bincount(x, minlength=256)
    values = np.arange(256)
    mean = float(counts @ values) / len(x)
    power = float(counts @ (values - 128) ** 2) / len(x)
    share = counts[counts > 0] / len(x)
    crossings = int(np.count_nonzero(np.diff((x >= 128).view(np.int8))))
    return f"packets={len(media.packets)};clusters={len(media.clusters)};cues={len(media.cues)};ms={media.duration // 1_000_000};mean={mean:.4f};rms={power**0.5:.4f};crossings={crossings};bits={float(-(share * np.log2(share)).sum()) + 0.0:.4f}"


COLUMNS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store_batches(batches: Iterator[pa.RecordBatch], with_media: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 256):  # a small part of a batch at a time is held as files
            part = batch.slice(start, 256)
            rows = []
            for key, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist()):
                text = text or b""
                data = write(text + bytes(-len(text) % ALIGN or (0 if text else ALIGN)))
                media = parse(data)
                back = payload(data, media)
                rows.append((key, len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-ALIGN:]), len(data), hashlib.sha256(data).hexdigest(), describe(back, media), *([data] if with_media else [])))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            names = [*(c.split()[0] for c in COLUMNS.split(", ")), "media"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names[: len(rows[0])])


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_media: bool = True) -> DataFrame:
    """Each text's UTF-8 bytes as the sound track of a Matroska file, read back, with digests and features.

    One pass without a shuffle; memory is bounded by the longest text and its file.
    """
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(remote(__name__, "store_batches", with_media), COLUMNS + (", media binary" if with_media else ""))


PACKETS = "media_id long, track long, packet long, time_ns long, offset long, size long, key boolean, lacing string, error string"


def packet_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("media_id", pa.int64()), ("track", pa.int64()), ("packet", pa.int64()), ("time_ns", pa.int64()), ("offset", pa.int64()), ("size", pa.int64()), ("key", pa.bool_()), ("lacing", pa.string()), ("error", pa.string())])
    lacings = ("none", "xiph", "fixed", "ebml")
    for batch in batches:
        for key, data in zip(batch.column(0), batch.column(1)):
            if not data.is_valid:
                continue
            try:
                rows = [(key.as_py(), t, k, time, at, size, flag, lacings[kind], None) for k, (t, time, at, size, flag, kind) in enumerate(parse(data.as_py()).packets)]
            except ValueError as e:
                rows = [(key.as_py(), *[None] * 7, str(e))]
            for start in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[start : start + 10_000]), schema)], schema=schema)


def packet_table(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per packet of each Matroska file in ``media_col``."""
    picked = media.select(F.col(id_col).cast("long").alias("media_id"), F.col(media_col).alias("media"))
    return picked.mapInArrow(remote(__name__, "packet_batches"), PACKETS)
