"""Matroska media columns: a muxer for fixed-size sample frames and a demuxer into packet tables.

The demuxer parses variable-length EBML elements (known and unknown sizes), walks Segment,
Tracks, Clusters and Cues, and splits blocks by their lacing (none, Xiph, fixed, EBML) into
packets with track, timestamp in nanoseconds, key flag and byte range.

``store`` keeps any bytes losslessly as one track of 8-bit mono PCM at 8,000 Hz: the bytes are
padded with 255 to a positive multiple of 576, each packet is 576 samples (72 ms), blocks lace
up to eight packets, clusters hold up to 64, and each cluster has a cue. Null is stored as
empty bytes, that is one packet of padding.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

FRAME, RATE, PER_BLOCK, PER_CLUSTER = 576, 8000, 8, 64
FRAME_MS = FRAME * 1000 // RATE

# Element ids of the Matroska specification.
EBML, SEGMENT, INFO, TRACKS, TRACK, AUDIO = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0xE1
CLUSTER, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, TIMESTAMP = 0x1F43B675, 0xA3, 0xA0, 0xA1, 0xE7
CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
SCALE, DURATION, MUXER, WRITER = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
NUMBER, UID, TYPE, LACING, CODEC, SAMPLE_RATE, CHANNELS, BIT_DEPTH, DEFAULT_DURATION = 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0xB5, 0x9F, 0x6264, 0x23E383
DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x4282, 0x4287, 0x4285
TOP_LEVEL = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367}

PACKET_SCHEMA = "track long, timestamp_ns long, key boolean, offset long, size long, cluster long"


class Packet(NamedTuple):
    track: int
    timestamp_ns: int
    key: bool
    offset: int
    size: int
    cluster: int


def number(x: int) -> bytes:
    return x.to_bytes(max(1, (x.bit_length() + 7) // 8), "big")


def vint(x: int, width: int = 0) -> bytes:
    """A size as a variable-length integer, in the least number of bytes."""
    n = max(1, width)
    while x >= (1 << 7 * n) - 1:
        n += 1
    return (x | 1 << 7 * n).to_bytes(n, "big")


def element(key: int, body: bytes) -> bytes:
    return number(key) + vint(len(body)) + body


def signed_vint(x: int) -> bytes:
    """A size difference of EBML lacing: a variable-length integer less half its range."""
    n = 1
    while not -(1 << 7 * n - 1) < x < (1 << 7 * n - 1):
        n += 1
    return (x + (1 << 7 * n - 1) - 1 | 1 << 7 * n).to_bytes(n, "big")


def block(track: int, at: int, frames: list[bytes], lacing: int, key: bool = True) -> bytes:
    """A SimpleBlock body. lacing: 0 none, 1 Xiph, 2 fixed, 3 EBML."""
    head = vint(track) + at.to_bytes(2, "big", signed=True) + bytes([128 * key | lacing << 1])
    if lacing:
        head += bytes([len(frames) - 1])
        sizes = [len(f) for f in frames]
        if lacing == 1:
            head += b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
        elif lacing == 3 and len(sizes) > 1:
            head += vint(sizes[0]) + b"".join(signed_vint(b - a) for a, b in zip(sizes, sizes[1:-1], strict=False))
    return head + b"".join(frames)


def padded(payload: bytes) -> bytes:
    return payload + b"\xff" * (-len(payload) % FRAME or (0 if payload else FRAME))


def store(payload: bytes) -> bytes:
    """A Matroska file with the padded payload as 8-bit samples."""
    data = padded(payload)
    frames = [data[i : i + FRAME] for i in range(0, len(data), FRAME)]
    head = element(EBML, element(DOC_TYPE, b"matroska") + element(DOC_VERSION, number(4)) + element(DOC_READ_VERSION, number(2)))
    info = element(INFO, element(SCALE, number(1_000_000)) + element(DURATION, np.float64(len(frames) * FRAME_MS).astype(">f8").tobytes()) + element(MUXER, b"framelode") + element(WRITER, b"framelode"))
    audio = element(AUDIO, element(SAMPLE_RATE, np.float64(RATE).astype(">f8").tobytes()) + element(CHANNELS, number(1)) + element(BIT_DEPTH, number(8)))
    tracks = element(TRACKS, element(TRACK, element(NUMBER, number(1)) + element(UID, number(1)) + element(TYPE, number(2)) + element(LACING, number(1)) + element(CODEC, b"A_PCM/INT/LIT") + element(DEFAULT_DURATION, number(FRAME_MS * 1_000_000)) + audio))
    parts, at, cues = [info, tracks], len(info) + len(tracks), []
    for c in range(0, len(frames), PER_CLUSTER):
        body = [element(TIMESTAMP, number(c * FRAME_MS))]
        for b in range(c, min(c + PER_CLUSTER, len(frames)), PER_BLOCK):
            laced = frames[b : min(b + PER_BLOCK, c + PER_CLUSTER)]
            body.append(element(SIMPLE_BLOCK, block(1, (b - c) * FRAME_MS, laced, (1 + b // PER_BLOCK % 3) if len(laced) > 1 else 0)))
        part = element(CLUSTER, b"".join(body))
        cues.append(element(CUE_POINT, element(CUE_TIME, number(c * FRAME_MS)) + element(CUE_POSITIONS, element(CUE_TRACK, number(1)) + element(CUE_CLUSTER, number(at)))))
        parts.append(part)
        at += len(part)
    return head + element(SEGMENT, b"".join([*parts, element(CUES, b"".join(cues))]))


def read_vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int, int, bool]:
    """Value, next offset, and whether all value bits are set (an unknown size)."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no variable-length integer at byte {at}")
    n = 9 - data[at].bit_length()
    if at + n > len(data):
        raise ValueError(f"cut off at byte {at}")
    raw = int.from_bytes(data[at : at + n], "big")
    value = raw & (1 << 7 * n) - 1
    return (raw if keep_marker else value), at + n, value == (1 << 7 * n) - 1


def elements(data: bytes, at: int, end: int, top: bool = False) -> Iterator[tuple[int, int, int, int]]:
    """``(id, offset, body start, body end)`` of the elements in a range.

    A Segment or Cluster of unknown size reaches to the next top-level element, else the end."""
    while at < end:
        key, p, _ = read_vint(data, at, True)
        size, p, unknown = read_vint(data, p)
        stop = p + size
        if unknown:
            stop = end
            if key == CLUSTER:
                q = p
                while q < end:
                    child, r, _ = read_vint(data, q, True)
                    if child in TOP_LEVEL:
                        stop = q
                        break
                    inner, r, _ = read_vint(data, r)
                    q = r + inner
        if stop > end:
            raise ValueError(f"element {key:x} at byte {at} passes the end of its parent")
        yield key, at, p, stop
        at = stop


def unsigned(data: bytes, s: int, e: int) -> int:
    return int.from_bytes(data[s:e], "big")


def unlaced(data: bytes, at: int, end: int) -> tuple[int, int, int, list[tuple[int, int]]]:
    """Track, relative timestamp, flags and the byte ranges of a block's frames."""
    track, at, _ = read_vint(data, at)
    when, flags = int.from_bytes(data[at : at + 2], "big", signed=True), data[at + 2]
    at += 3
    lacing = flags >> 1 & 3
    if not lacing:
        return track, when, flags, [(at, end - at)]
    n = data[at] + 1
    at += 1
    sizes: list[int] = []
    if lacing == 1:
        for _ in range(n - 1):
            s = 0
            while data[at] == 255:
                s, at = s + 255, at + 1
            sizes.append(s + data[at])
            at += 1
    elif lacing == 3:
        for k in range(n - 1):
            p = at
            x, at, _ = read_vint(data, at)
            sizes.append(sizes[-1] + x - ((1 << 7 * (at - p) - 1) - 1) if k else x)
    else:
        if (end - at) % n:
            raise ValueError(f"fixed lacing of {n} frames in {end - at} bytes")
        sizes = [(end - at) // n] * (n - 1)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("laced frames pass the end of their block")
    ranges = []
    for s in sizes:
        ranges.append((at, s))
        at += s
    return track, when, flags, ranges


def demux(data: bytes) -> tuple[list[Packet], list[tuple[int, int]]]:
    """Packets in stored order and cues ``(time in ns, cluster offset)``. Raises ValueError on damage."""
    packets: list[Packet] = []
    cues: list[tuple[int, int]] = []
    clusters: set[int] = set()
    for key, _, s, e in elements(data, 0, len(data)):
        if key != SEGMENT:
            continue
        scale, durations = 1_000_000, {}
        for k, at, p, q in elements(data, s, e):
            if k == INFO:
                scale = next((unsigned(data, x, y) for i, _, x, y in elements(data, p, q) if i == SCALE), scale)
            elif k == TRACKS:
                for i, _, x, y in elements(data, p, q):
                    if i == TRACK:
                        f = {j: unsigned(data, u, v) for j, _, u, v in elements(data, x, y) if j in (NUMBER, DEFAULT_DURATION)}
                        durations[f.get(NUMBER, 0)] = f.get(DEFAULT_DURATION, 0)
            elif k == CLUSTER:
                clusters.add(at - s)
                base = 0
                for i, _, x, y in elements(data, p, q):
                    if i == TIMESTAMP:
                        base = unsigned(data, x, y)
                        continue
                    bodies = [(x, y, None)] if i == SIMPLE_BLOCK else []
                    if i == BLOCK_GROUP:
                        inner = list(elements(data, x, y))
                        bodies = [(u, v, all(j != 0xFB for j, *_ in inner)) for j, _, u, v in inner if j == BLOCK]
                    for u, v, key_frame in bodies:
                        track, when, flags, ranges = unlaced(data, u, v)
                        for n, (offset, size) in enumerate(ranges):
                            ns = (base + when) * scale + n * durations.get(track, 0)
                            packets.append(Packet(track, ns, flags >= 128 if key_frame is None else key_frame, offset, size, at - s))
            elif k == CUES:
                for i, _, x, y in elements(data, p, q):
                    if i == CUE_POINT:
                        time = cluster = 0
                        for j, _, u, v in elements(data, x, y):
                            if j == CUE_TIME:
                                time = unsigned(data, u, v)
                            elif j == CUE_POSITIONS:
                                cluster = next((unsigned(data, a, b) for m, _, a, b in elements(data, u, v) if m == CUE_CLUSTER), 0)
                        cues.append((time * scale, cluster))
    if any(c not in clusters for _, c in cues):
        raise ValueError("a cue points at no cluster")
    return packets, cues


def feature(samples: bytes, packets: list[Packet], cues: list[tuple[int, int]]) -> str:
    """``p`` packets, ``c`` cues, ``d`` the last packet's time in ms, then mean, variance and energy steps of the samples."""
    x = np.frombuffer(samples, np.uint8)
    n, total, squares = len(x), int(x.sum(dtype=np.int64)), int(np.square(x, dtype=np.int64).sum())
    steps = int(np.abs(np.diff(x.astype(np.int16))).sum(dtype=np.int64))
    return f"p={len(packets)};c={len(cues)};d={packets[-1].timestamp_ns // 1_000_000};mean={total / n:.6f};var={squares / n - (total / n) ** 2:.6f};step={steps / n:.6f}"


def store_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, media binary`` with each text's UTF-8 bytes as a Matroska file (null: empty)."""
    narrow = df.select(df[id_col], df[text_col])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 512):
                part = b.slice(s, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([store((t or "").encode()) for t in part.column(1).to_pylist()], pa.binary())], [id_col, "media"])

    return narrow.mapInArrow(scan, f"`{id_col}` {narrow.schema[0].dataType.simpleString()}, media binary")


def packet_table(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """``id_col`` and one row for each packet: track, timestamp_ns, key, offset, size, cluster. A null file has none, and a
    damaged one raises, as its bytes can't be told apart from others: filter such files first."""
    narrow = df.select(df[id_col], df[media_col])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64())
        for b in batches:
            for s in range(0, b.num_rows, 512):
                part = b.slice(s, 512)
                tables = [demux(m)[0] if m is not None else [] for m in part.column(1).to_pylist()]
                rows = np.repeat(np.arange(part.num_rows), [len(t) for t in tables])
                flat = [list(c) for c in zip(*(p for t in tables for p in t), strict=True)] or [[]] * 6
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, t) for c, t in zip(flat, types, strict=True))], [id_col, *Packet._fields])

    return narrow.mapInArrow(scan, f"`{id_col}` {narrow.schema[0].dataType.simpleString()}, {PACKET_SCHEMA}")


def digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each text, read the samples back through the demuxer, and describe what was read.

    ``id_col, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature``.
    One narrow pass; a task holds one text's file at a time. Equal texts give equal values. Null texts are empty ones; ids
    may be null or repeated, a row each; an empty table gives an empty table; other columns are not read, and an id column
    named like a result stands beside it.
    """
    narrow = df.select(df[id_col], df[text_col])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            for text in b.column(1).to_pylist():
                raw = (text or "").encode()
                media = store(raw)
                packets, cues = demux(media)
                back = b"".join(media[p.offset : p.offset + p.size] for p in packets)
                row = (len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(back, packets, cues))
                for c, v in zip(out, row, strict=True):
                    c.append(v)
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, t) for c, t in zip(out, types, strict=True))],
                [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    return narrow.mapInArrow(scan, f"`{id_col}` {narrow.schema[0].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
