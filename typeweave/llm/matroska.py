"""Matroska in a binary column: packet tables out of EBML, and a writer for 8-bit PCM.

The parser walks variable-length elements (known and unknown sizes), clusters,
simple blocks and block groups, undoes all four kinds of lacing, and gives each
packet's track, timestamp and byte range in the file, so that payloads can be
read by range.
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

# Element ids of the format.
EBML, DOC_TYPE = 0x1A45DFA3, 0x4282
SEGMENT, INFO, TIMESTAMP_SCALE, MUXER, WRITER = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83
CODEC_ID, DEFAULT_DURATION, AUDIO, RATE, CHANNELS, BIT_DEPTH = 0x86, 0x23E383, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, CLUSTER_TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE, BLOCK_DURATION = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB, 0x9B
CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER, CUE_RELATIVE = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1, 0xF0
TOP_LEVEL = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367}
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3
LACING_NAMES = ["none", "xiph", "fixed", "ebml"]

#: Samples of a frame (a multiple of 64), frames of a block, blocks of a cluster, samples a second.
FRAME, LACED, BLOCKS, SAMPLE_RATE = 4096, 8, 7, 8000


class Damaged(ValueError):
    """The bytes break off or break the format."""


def read_id(data: bytes, at: int) -> tuple[int, int]:
    """An element id, marker bits included, and where it ends."""
    if at >= len(data) or data[at] < 0x10:
        raise Damaged(f"no element id at {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise Damaged(f"an element id breaks off at {at}")
    return int.from_bytes(data[at : at + width], "big"), at + width


def read_size(data: bytes, at: int) -> tuple[int | None, int]:
    """A variable-length integer without its marker, and where it ends; None if all its bits are 1 (unknown)."""
    if at >= len(data) or data[at] == 0:
        raise Damaged(f"no size at {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise Damaged(f"a size breaks off at {at}")
    value = int.from_bytes(data[at : at + width], "big") & ((1 << (7 * width)) - 1)
    return (None if value == (1 << (7 * width)) - 1 else value), at + width


def elements(data: bytes, at: int, end: int, *, until: frozenset[int] = frozenset()) -> Iterator[tuple[int, int, int]]:
    """(id, body, end) of the elements from at to end; stops before an id of `until`. Unknown sizes reach to the end."""
    while at < end:
        ident, body = read_id(data, at)
        if ident in until:
            return
        size, body = read_size(data, body)
        stop = end if size is None else body + size
        if stop > end:
            raise Damaged(f"element {ident:x} at {at} ends beyond its parent")
        yield ident, body, stop
        at = stop


def _uint(data: bytes, body: int, end: int) -> int:
    return int.from_bytes(data[body:end], "big")


@dataclass
class Packet:
    cluster: int
    track: int
    timestamp_ns: int
    keyframe: bool
    lacing: str
    frame: int
    offset: int
    length: int


@dataclass
class Media:
    """What a file holds; error tells where it stopped being readable, None if it didn't."""

    scale: int = 1_000_000
    tracks: dict[int, dict[str, object]] = field(default_factory=dict)
    packets: list[Packet] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    clusters: int = 0
    segment: int = 0
    error: str | None = None


def laced(data: bytes, body: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """(offset, length) of the frames of a block whose frame data begin at body."""
    if lacing == NO_LACING:
        return [(body, end - body)]
    if body >= end:
        raise Damaged(f"lacing breaks off at {body}")
    number, at = data[body] + 1, body + 1
    if lacing == FIXED:
        size, odd = divmod(end - at, number)
        if odd:
            raise Damaged(f"fixed lacing at {body} leaves a remainder")
        return [(at + i * size, size) for i in range(number)]
    sizes: list[int] = []
    if lacing == XIPH:
        for _ in range(number - 1):
            size = 0
            while True:
                if at >= end:
                    raise Damaged(f"lacing breaks off at {at}")
                size, at, more = size + data[at], at + 1, data[at] == 255
                if not more:
                    break
            sizes.append(size)
    elif number > 1:
        first, at = read_size(data, at)
        sizes.append(first or 0)
        for _ in range(number - 2):
            start = at
            step, at = read_size(data, at)
            width = at - start
            value = (1 << (7 * width)) - 1 if step is None else step
            sizes.append(sizes[-1] + value - ((1 << (7 * width - 1)) - 1))
    last = end - at - sum(sizes)
    if last < 0 or any(s < 0 for s in sizes):
        raise Damaged(f"lacing at {body} asks for more than the block has")
    out = []
    for size in [*sizes, last]:
        out.append((at, size))
        at += size
    return out


def _block(media: Media, data: bytes, body: int, end: int, base: int, keyframe: bool | None) -> None:
    track, at = read_size(data, body)
    if at + 3 > end:
        raise Damaged(f"a block breaks off at {body}")
    relative, flags = struct.unpack(">hB", data[at : at + 3])
    lacing = flags >> 1 & 3
    step = int(media.tracks.get(track or 0, {}).get("default_duration", 0) or 0)
    start = (base + relative) * media.scale
    if abs(start) + 256 * step >= 1 << 62 or (track or 0) >= 1 << 62:
        raise Damaged(f"a block at {body} has a time or track beyond 64 bits")
    key = bool(flags & 0x80) if keyframe is None else keyframe
    for i, (offset, length) in enumerate(laced(data, at + 3, end, lacing)):
        media.packets.append(Packet(media.clusters - 1, track or 0, start + i * step, key, LACING_NAMES[lacing], i, offset, length))


def _cluster(media: Media, data: bytes, body: int, end: int, known: bool) -> int:
    """Parses a cluster; returns where it ends, which for unknown sizes is at the next element of its level."""
    media.clusters += 1
    base, at = 0, body
    for ident, inner, stop in elements(data, body, end, until=frozenset() if known else frozenset(TOP_LEVEL | {SEGMENT, EBML})):
        at = stop
        if ident == CLUSTER_TIMESTAMP:
            base = _uint(data, inner, stop)
        elif ident == SIMPLE_BLOCK:
            _block(media, data, inner, stop, base, None)
        elif ident == BLOCK_GROUP:
            parts = list(elements(data, inner, stop))
            key = all(i != REFERENCE for i, _, _ in parts)
            for i, b, e in parts:
                if i == BLOCK:
                    _block(media, data, b, e, base, key)
    return end if known else at


def _track(data: bytes, body: int, end: int) -> tuple[int, dict[str, object]]:
    number, found = 0, {"type": 0, "codec": "", "default_duration": 0, "rate": None, "channels": None, "bit_depth": None}
    names = {TRACK_TYPE: "type", DEFAULT_DURATION: "default_duration", CHANNELS: "channels", BIT_DEPTH: "bit_depth"}
    parts = list(elements(data, body, end))
    for ident, b, e in list(parts):
        if ident == AUDIO:
            parts += list(elements(data, b, e))
    for ident, b, e in parts:
        if ident == TRACK_NUMBER:
            number = _uint(data, b, e)
        elif ident in names:
            found[names[ident]] = _uint(data, b, e)
        elif ident == CODEC_ID:
            found["codec"] = data[b:e].rstrip(b"\0").decode("ascii", "replace")
        elif ident == RATE and e - b in (4, 8):
            found["rate"] = struct.unpack(">f" if e - b == 4 else ">d", data[b:e])[0]
    return number, found


def _cue(media: Media, data: bytes, body: int, end: int) -> None:
    time = 0
    for ident, b, e in elements(data, body, end):
        if ident == CUE_TIME:
            time = _uint(data, b, e)
        elif ident == CUE_POSITIONS:
            at = {i: _uint(data, x, y) for i, x, y in elements(data, b, e)}
            cue = (time, at.get(CUE_TRACK, 0), media.segment + at.get(CUE_CLUSTER, 0))
            if max(cue) >= 1 << 62:
                raise Damaged(f"a cue at {body} has a value beyond 64 bits")
            media.cues.append(cue)


def parse(data: bytes | None) -> Media:
    """The contents of a file; of a damaged one, all that comes before the damage."""
    media = Media()
    data = data or b""
    try:
        ident, body = read_id(data, 0)
        size, body = read_size(data, body)
        if ident != EBML or size is None:
            raise Damaged("no EBML header")
        at = body + size
        while at < len(data):
            ident, body = read_id(data, at)
            size, body = read_size(data, body)
            end = len(data) if size is None else min(len(data), body + size)
            if ident == SEGMENT:
                _segment(media, data, body, end)
            if size is not None and body + size > len(data):
                raise Damaged(f"element {ident:x} at {at} ends beyond the file")
            at = end
    except Damaged as e:
        media.error = str(e)
    return media


def _segment(media: Media, data: bytes, body: int, end: int) -> None:
    media.segment, at = body, body
    while at < end:
        ident, inner = read_id(data, at)
        size, inner = read_size(data, inner)
        stop = end if size is None else inner + size
        if stop > end:
            raise Damaged(f"element {ident:x} at {at} ends beyond its parent")
        if ident == INFO:
            for i, b, e in elements(data, inner, stop):
                if i == TIMESTAMP_SCALE:
                    media.scale = _uint(data, b, e)
        elif ident == TRACKS:
            for i, b, e in elements(data, inner, stop):
                if i == TRACK_ENTRY:
                    number, found = _track(data, b, e)
                    media.tracks[number] = found
        elif ident == CLUSTER:
            stop = _cluster(media, data, inner, stop, size is not None)
        elif ident == CUES:
            for i, b, e in elements(data, inner, stop):
                if i == CUE_POINT:
                    _cue(media, data, b, e)
        at = stop


def _size(n: int) -> bytes:
    width = 1
    while n >= (1 << (7 * width)) - 1:
        width += 1
    return (n | 1 << (7 * width)).to_bytes(width, "big")


def _id(ident: int) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big")


def element(ident: int, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return _id(ident) + _size(len(body)) + body


def number(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def block(frames: list[bytes], relative: int, *, track: int = 1, lacing: int = NO_LACING, flags: int = 0x80) -> bytes:
    """The body of a block with the frames laced as asked."""
    head = _size(track) + struct.pack(">hB", relative, flags | lacing << 1)
    if lacing == NO_LACING:
        return head + frames[0]
    head += bytes([len(frames) - 1])
    if lacing == XIPH:
        for f in frames[:-1]:
            head += b"\xff" * (len(f) // 255) + bytes([len(f) % 255])
    elif lacing == EBML_LACING and len(frames) > 1:
        head += _size(len(frames[0]))
        for a, b in zip(frames, frames[1:-1], strict=False):
            step, width = len(b) - len(a), 1
            while abs(step) > (1 << (7 * width - 1)) - 2:
                width += 1
            head += (step + (1 << (7 * width - 1)) - 1 | 1 << (7 * width)).to_bytes(width, "big")
    return head + b"".join(frames)


def mux(payload: bytes) -> bytes:
    """A file with one track of 8-bit PCM that holds the payload, byte for byte."""
    tick = 1000 * FRAME // SAMPLE_RATE
    head = element(EBML, element(DOC_TYPE, b"matroska"))
    info = element(INFO, number(TIMESTAMP_SCALE, 1_000_000), element(MUXER, b"typeweave"), element(WRITER, b"typeweave"))
    audio = element(AUDIO, element(RATE, struct.pack(">d", SAMPLE_RATE)), number(CHANNELS, 1), number(BIT_DEPTH, 8))
    entry = [number(TRACK_NUMBER, 1), number(TRACK_UID, 1), number(TRACK_TYPE, 2), element(CODEC_ID, b"A_PCM/INT/LIT"), number(DEFAULT_DURATION, tick * 1_000_000), audio]
    parts = [info, element(TRACKS, element(TRACK_ENTRY, *entry))]
    at, cues = sum(map(len, parts)), []
    for k, start in enumerate(range(0, len(payload), FRAME * LACED * BLOCKS)):
        base, inner = k * tick * LACED * BLOCKS, []
        for j in range(BLOCKS):
            first = start + j * FRAME * LACED
            frames = [payload[i : i + FRAME] for i in range(first, min(first + FRAME * LACED, len(payload)), FRAME)]
            if not frames:
                break
            lacing = NO_LACING if len(frames) == 1 else FIXED if len(frames[-1]) == FRAME else EBML_LACING
            inner.append(element(SIMPLE_BLOCK, block(frames, j * tick * LACED, lacing=lacing)))
        parts.append(element(CLUSTER, number(CLUSTER_TIMESTAMP, base), *inner))
        cues.append(element(CUE_POINT, number(CUE_TIME, base), element(CUE_POSITIONS, number(CUE_TRACK, 1), number(CUE_CLUSTER, at))))
        at += len(parts[-1])
    return head + element(SEGMENT, *parts, element(CUES, *cues))


def payload_of(data: bytes, media: Media, track: int = 1) -> bytes:
    """A track's packets, joined in the order of the file."""
    return b"".join([data[p.offset : p.offset + p.length] for p in media.packets if p.track == track])


PACKETS = "cluster int, track long, timestamp_ns long, keyframe boolean, lacing string, frame int, byte_offset long, byte_length long, error string"
CUE_COLUMNS = "timestamp_ns long, track long, cluster_offset long"


def packet_table(media: DataFrame, *, data: str = "data", key: str = "doc_id") -> DataFrame:
    """(key, packet columns) with a row for each packet of each file in a binary column.

    A damaged, null or empty file has the packets before the damage and one row
    with nulls and the error.  Other columns are ignored.
    """
    kind = dict(media.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, keys = [], []
            for i, x in enumerate(batch.column(1)):
                found = parse(x.as_py())
                own = [(p.cluster, p.track, p.timestamp_ns, p.keyframe, p.lacing, p.frame, p.offset, p.length, None) for p in found.packets]
                own += [(*[None] * 8, found.error)] if found.error else []
                rows += own
                keys += [i] * len(own)
            types = [pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            names = ["own_key", *[c.split()[0] for c in PACKETS.split(", ")]]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int64())), *columns], names)

    rows = media.select(F.col(key).alias("own_key"), F.col(data).cast("binary").alias("data"))
    return rows.mapInArrow(run, f"own_key {kind}, {PACKETS}").withColumnRenamed("own_key", key)


def cue_table(media: DataFrame, *, data: str = "data", key: str = "doc_id") -> DataFrame:
    """(key, cue columns) with a row for each cue of each file in a binary column: its time, track, and where its cluster begins; a time beyond 64 bits is null.

    Of a damaged file the cues before the damage; null and empty files, and files without cues, have no row.  Other columns are ignored.
    """
    kind = dict(media.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, keys = [], []
            for i, x in enumerate(batch.column(1)):
                found = parse(x.as_py())
                rows += [(time * found.scale if time * found.scale < 1 << 62 else None, track, place) for time, track, place in found.cues]
                keys += [i] * len(found.cues)
            columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int64())), *columns], ["own_key", *[c.split()[0] for c in CUE_COLUMNS.split(", ")]])

    rows = media.select(F.col(key).alias("own_key"), F.col(data).cast("binary").alias("data"))
    return rows.mapInArrow(run, f"own_key {kind}, {CUE_COLUMNS}").withColumnRenamed("own_key", key)


def _digest(text: str | None) -> tuple:
    raw = text.encode() if text else b""
    payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
    media = mux(payload)
    found = parse(media)
    back = payload_of(media, found)
    counts = np.bincount(np.frombuffer(back, np.uint8), minlength=256)
    mean = int((counts * np.arange(256)).sum()) / len(back)
    laced_packets = sum(p.lacing != "none" for p in found.packets)
    end = max(p.timestamp_ns for p in found.packets) // 1_000_000
    feature = f"clusters={found.clusters};packets={len(found.packets)};laced={laced_packets};cues={len(found.cues)};last_ms={end};mean={mean:.4f};levels={int((counts > 0).sum())}"
    return len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature


def stored_texts(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Every text stored as 8-bit PCM in Matroska and read back through its packet table.

    Null counts as empty; the payload is padded with zeros to a positive
    multiple of 64 bytes.  Equal texts give equal values.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_digest(x.as_py()) for x in batch.column(1)]
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [c.split()[0] for c in schema.split(", ")])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)
