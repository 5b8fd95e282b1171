"""MPEG audio columns.

``scan`` reads the bytes of any MPEG audio file: it skips ID3v2 tags, resynchronises on frame headers
(a header counts if it stands behind an ID3v2 tag or a frame, or if the next one or the end of the data follows it), reads Xing, Info and VBRI
tables, ID3v1 tags and the text frames of ID3v2, verifies the CRCs of protected frames of all three
layers, and returns the exact duration as samples over a sample rate, and the byte offset of every
frame, for seeking. Every read stays inside its frame or tag, so cut or forged data is read as far as
it goes.

``wrap`` stores a payload losslessly: units of 192 bytes as the ancillary data of silent MPEG-1 layer
III frames (48 kHz, mono, with CRC), four units to a 320 kbit/s frame and the rest in one smaller
frame, between an ID3v2 tag and a Xing table, and an ID3v1 tag.

Null and empty texts are 192 spaces. Data without any frame has no frames, zero samples and sample
rate 0. Null media gives nulls. Equal texts give equal bytes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import shared

UNIT = 192
# Fixed values of the format (ISO/IEC 11172-3 and 13818-3): kbit/s by index, for layers I, II, III of version 1 and layers I, II/III of version 2; sample rates.
KBPS = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
#: Units in a frame of the writer, and its bit-rate index and bytes.
FRAMES = {4: (14, 960), 3: (13, 768), 2: (10, 480), 1: (6, 240)}
SIDE, AHEAD = 17, 23


@dataclass(frozen=True)
class Header:
    version: int
    layer: int
    kbps: int
    rate: int
    size: int
    samples: int
    mono: bool
    crc: bool
    #: The subband from which joint stereo of layers I and II shares its allocation; 32: none.
    bound: int

    @property
    def side(self) -> int:
        """Bytes of a layer III frame's side information."""
        return (17 if self.mono else 32) if self.version == 1 else 9 if self.mono else 17


_headers: dict[bytes, Header | None] = {}


def header(four: bytes) -> Header | None:
    """None if the four bytes can't start a frame (or are in free format, whose size they don't tell)."""
    if four in _headers:
        return _headers[four]
    made = None
    if len(four) == 4 and four[0] == 255 and four[1] >= 224:
        v, layer, b, r = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3), four[2] >> 4, four[2] >> 2 & 3
        if v != 1 and layer != 4 and 0 < b < 15 and r != 3 and four[3] & 3 != 2:
            version, rate, pad = 1 if v == 3 else 2, RATES[v][r], four[2] >> 1 & 1
            kbps = KBPS[version, layer if version == 1 else min(layer, 2)][b]
            samples = 384 if layer == 1 else 576 if layer == 3 and version == 2 else 1152
            size = (12000 * kbps // rate + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbps // rate + pad
            made = Header(version, layer, kbps, rate, size, samples, four[3] >> 6 == 3, not four[1] & 1, 4 * ((four[3] >> 4 & 3) + 1) if four[3] >> 6 == 1 else 32)
    if len(_headers) < 1 << 16:
        _headers[four] = made
    return made


def _table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        t = np.where(t & 0x8000, t << 1 ^ 0x8005, t << 1) & 0xFFFF
    return t


CRC = _table()


def crc16(rows: np.ndarray) -> np.ndarray:
    """Of each row of bytes."""
    c = np.full(len(rows), 0xFFFF, dtype=np.uint32)
    for k in range(rows.shape[1]):
        c = (c << 8 & 0xFFFF) ^ CRC[c >> 8 ^ rows[:, k]]
    return c


@dataclass
class Scan:
    offsets: list[int] = field(default_factory=list)
    headers: list[Header] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    skipped: int = 0
    resyncs: int = 0
    id3v2_bytes: int = 0
    id3v1: bool = False
    title: str | None = None
    #: Text frames of ID3v2 by their names, the first of each.
    tags: dict[str, str] = field(default_factory=dict)
    table: str | None = None
    table_frames: int | None = None
    table_bytes: int | None = None
    seek_points: list[int] = field(default_factory=list)
    crc_ok: int = 0
    crc_bad: int = 0

    @property
    def samples(self) -> int:
        return sum(h.samples for h in self.headers)

    @property
    def rate(self) -> int:
        return self.headers[0].rate if self.headers else 0


def scan(data: bytes) -> Scan:
    out, at, end = Scan(), 0, len(data)
    while data[at : at + 3] == b"ID3" and at + 10 <= end and max(data[at + 6 : at + 10]) < 128:
        n = data[at + 6] << 21 | data[at + 7] << 14 | data[at + 8] << 7 | data[at + 9]
        for name, text in text_frames(data[at : at + 10 + n]):
            out.tags.setdefault(name, text)
        n += 10 + (10 if data[at + 5] & 16 else 0)
        at, out.id3v2_bytes = min(end, at + n), out.id3v2_bytes + n
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        out.id3v1, end = True, end - 128
        out.title = data[end + 3 : end + 33].rstrip(b"\0 ").decode("latin-1")
    out.title = out.tags.get("TIT2") or out.tags.get("TT2") or out.title
    synced = True if out.id3v2_bytes else None  # behind no tag the first header needs another one behind it, like any that is found again
    while at + 4 <= end:
        h = header(data[at : at + 4])
        if h and at + h.size <= end and (synced or at + h.size + 4 > end or header(data[at + h.size : at + h.size + 4])):
            out.resyncs += synced is False
            synced = True
            if not out.offsets and out.table is None and _vbr(out, data, at, h):
                at += h.size
                continue
            out.offsets.append(at)
            out.headers.append(h)
            out.sizes.append(h.size)
            at += h.size
            continue
        synced = False
        found = data.find(b"\xff", at + 1, end)
        step = (found if found >= 0 else end) - at
        out.skipped += step
        at += step
    out.skipped += max(0, end - at)
    _check(out, data)
    return out


def text_frames(tag: bytes) -> Iterator[tuple[str, str]]:
    """(name, text) of an ID3v2 tag's text frames, versions 2 to 4, as far as they are whole."""
    version, at = tag[3], 10
    short = version == 2
    syncsafe = lambda x: x[0] << 21 | x[1] << 14 | x[2] << 7 | x[3]
    if tag[5] & 64 and not short and len(tag) >= 14:  # an extended header
        at += syncsafe(tag[10:14]) if version == 4 else 4 + int.from_bytes(tag[10:14], "big")
    head = 6 if short else 10
    while at + head < len(tag) and tag[at]:
        name = tag[at : at + (3 if short else 4)].decode("latin-1")
        size = int.from_bytes(tag[at + 3 : at + 6], "big") if short else syncsafe(tag[at + 4 : at + 8]) if version == 4 else int.from_bytes(tag[at + 4 : at + 8], "big")
        body = tag[at + head : at + head + size]
        at += head + size
        if name[0] == "T" and name not in ("TXX", "TXXX") and len(body) == size and size > 1 and body[0] < 4:
            kind = ("latin-1", "utf-16", "utf-16-be", "utf-8")[body[0]]
            yield name, body[1:].decode(kind, "replace").rstrip("\0")


def _vbr(out: Scan, data: bytes, at: int, h: Header) -> bool:
    """Whether the frame holds a table of variable bit rate instead of sound; what it says goes to out, as far as the frame holds it."""
    if h.layer != 3:
        return False
    frame = data[at : at + h.size]
    word = lambda k: int.from_bytes(frame[k : k + 4], "big") if k + 4 <= len(frame) else None
    for start in (4 + h.side, 6 + h.side):
        if (kind := frame[start : start + 4]) in (b"Xing", b"Info") and (flags := word(start + 4)) is not None:
            start += 8
            for bit, name in ((1, "table_frames"), (2, "table_bytes")):
                if flags & bit:
                    setattr(out, name, word(start))
                    start += 4
            if flags & 4 and start + 100 <= len(frame):
                out.seek_points = list(frame[start : start + 100])
            out.table = kind.decode()
            return True
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        out.table = "VBRI"
        out.table_bytes, out.table_frames = struct.unpack_from(">II", frame, 46)
        n, scale, width, _ = struct.unpack_from(">4H", frame, 54)
        whole = min(n, (len(frame) - 62) // width) if width else 0
        out.seek_points = [int.from_bytes(frame[62 + i * width : 62 + (i + 1) * width], "big") * scale for i in range(whole)]
        return True
    return False


def allocation_bits(h: Header) -> list[int]:
    """Layer II: how many bits state each subband's allocation, by the rules of the standard's tables B.2 (and B.1 of the second version)."""
    if h.version == 2:
        return [4] * 4 + [3] * 7 + [2] * 19
    each = h.kbps // (1 if h.mono else 2)
    if each < 56:
        return [4] * 2 + [3] * (10 if h.rate == 32000 else 6)
    return [4] * 11 + [3] * 12 + [2] * (4 if h.rate == 48000 or each < 96 else 7)


def protected_bits(h: Header, body: bytes) -> int | None:
    """Layers I and II: how many bits of what follows the CRC it covers: allocations, and in layer II which scale factors are shared. None where the frame ends before."""
    channels = 1 if h.mono else 2
    if h.layer == 1:
        n = 4 * 32 if h.mono else 4 * (32 + min(h.bound, 32))
        return n if n <= 8 * len(body) else None
    bits, total = int.from_bytes(body, "big"), 8 * len(body)
    at = chosen = 0
    for sb, width in enumerate(allocation_bits(h)):
        own = channels if sb < h.bound else 1
        for _ in range(own):
            at += width
            if at > total:
                return None
            if bits >> (total - at) & ((1 << width) - 1):
                chosen += channels // own
    return at + 2 * chosen if at + 2 * chosen <= total else None


def crc16_bits(head: bytes, body: bytes, n: int) -> int:
    """Of two bytes of header and the first n bits of what follows the CRC."""
    c, whole = 0xFFFF, head + body[: n // 8]
    for x in whole:
        c = (c << 8 & 0xFFFF) ^ int(CRC[c >> 8 ^ x])
    for k in range(n % 8):
        c = (c << 1 & 0xFFFF) ^ (0x8005 if (c >> 15) ^ (body[n // 8] >> (7 - k) & 1) else 0)
    return c


def _check(out: Scan, data: bytes) -> None:
    by: dict[int, list[int]] = {}
    for o, h in zip(out.offsets, out.headers):
        if h.crc and h.layer == 3 and h.size >= 6 + h.side:
            by.setdefault(h.side, []).append(o)
        elif h.crc and h.layer < 3 and (n := protected_bits(h, body := data[o + 6 : o + min(h.size, 262)])) is not None:
            good = crc16_bits(data[o + 2 : o + 4], body, n) == int.from_bytes(data[o + 4 : o + 6], "big")
            out.crc_ok += good
            out.crc_bad += not good
    raw = np.frombuffer(data, np.uint8)
    for side, starts in by.items():
        o = np.array(starts)[:, None]
        said = raw[o + [4, 5]].astype(np.uint32)
        good = crc16(np.concatenate([raw[o + [2, 3]], raw[o + np.arange(6, 6 + side)]], axis=1)) == (said[:, 0] << 8 | said[:, 1])
        out.crc_ok += int(good.sum())
        out.crc_bad += int((~good).sum())


def padded(text: str | None) -> tuple[int, bytes]:
    """Unpadded bytes, and the payload: spaces up to a positive multiple of the unit."""
    raw = (text or "").encode("utf-8", "replace")
    return len(raw), raw + b" " * (UNIT if not raw else -len(raw) % UNIT)


def _frame(units: int) -> bytes:
    index, size = FRAMES[units]
    head = bytes([0xFF, 0xFA, index << 4 | 1 << 2, 0xC4])
    crc = int(crc16(np.frombuffer(head[2:] + bytes(SIDE), np.uint8)[None])[0])
    return (head + struct.pack(">H", crc)).ljust(size, b"\0")


EMPTY = {u: _frame(u) for u in FRAMES}
ID3V2 = b"ID3\x04\x00\x00" + bytes([0, 0, 0, 20]) + b"TSSE" + bytes([0, 0, 0, 10, 0, 0]) + b"\x03payload\x00\x00"
ID3V1 = b"TAG" + b"payload".ljust(30, b"\0") + bytes(94) + b"\xff"


def wrap(payload: bytes) -> bytes:
    units = len(payload) // UNIT
    if not units or len(payload) % UNIT:
        raise ValueError(f"a payload is a positive multiple of {UNIT} bytes")
    whole, rest = divmod(units, 4)
    body = np.tile(np.frombuffer(EMPTY[4], np.uint8), (whole, 1))
    body[:, AHEAD : AHEAD + 4 * UNIT] = np.frombuffer(payload, np.uint8, whole * 4 * UNIT).reshape(whole, 4 * UNIT)
    parts = [body.tobytes()]
    if rest:
        last, left = bytearray(EMPTY[rest]), payload[whole * 4 * UNIT :]
        last[AHEAD : AHEAD + len(left)] = left
        parts.append(bytes(last))
    n, size = whole + bool(rest), len(EMPTY[1]) + sum(map(len, parts))
    starts = [len(EMPTY[1]) + 960 * (i * n // 100) for i in range(100)]
    table = b"Xing" + struct.pack(">3I", 7, n, size) + bytes(min(255, s * 256 // size) for s in starts)
    first = bytearray(EMPTY[1])
    first[AHEAD : AHEAD + len(table)] = table
    return b"".join([ID3V2, bytes(first), *parts, ID3V1])


def unwrap(data: bytes, found: Scan) -> bytes:
    """The payload that wrap stored."""
    out = []
    for o, h in zip(found.offsets, found.headers):
        units = (h.size - AHEAD) // UNIT
        out.append(data[o + AHEAD : o + AHEAD + units * UNIT])
    return b"".join(out)


def feature(s: Scan) -> str:
    kbps = sorted({h.kbps for h in s.headers})
    return (
        f"mpeg{s.headers[0].version if s.headers else 0} layer{s.headers[0].layer if s.headers else 0} rate={s.rate} frames={len(s.offsets)} samples={s.samples} kbps={'/'.join(map(str, kbps))}"
        f" table={s.table} table_frames={s.table_frames} table_bytes={s.table_bytes} crc_ok={s.crc_ok} crc_bad={s.crc_bad} resyncs={s.resyncs} skipped={s.skipped} id3v2={s.id3v2_bytes} id3v1={int(s.id3v1)} last_frame_at={s.offsets[-1] if s.offsets else -1}"
    )


def stored(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text as an MPEG audio file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                some = b.slice(at, 256)
                n, media = zip(*((k, wrap(p)) for k, p in map(padded, some.column("text").to_pylist())))
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(n, pa.int64()), pa.array(media, pa.large_binary()).cast(pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


ANALYSED = "n_frames long, samples long, sample_rate int, duration_s double, frame_offsets array<long>, crc_ok long, crc_bad long, resyncs long, skipped_bytes long, vbr_table string, title string"


def analysed(rows: DataFrame) -> DataFrame:
    """rows with the columns of ANALYSED, from their column media."""
    kept = rows.drop(*(x.split()[0] for x in ANALYSED.split(", ")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for b in batches:
            got = []
            for m in b.column("media"):
                s = None if (m := m.as_py()) is None else scan(m)
                got.append((None,) * 11 if s is None else (len(s.offsets), s.samples, s.rate, s.samples / s.rate if s.rate else 0.0, s.offsets, s.crc_ok, s.crc_bad, s.resyncs, s.skipped, s.table, s.title))
            columns = list(zip(*got)) if got else [()] * 11
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(list(c), k) for c, k in zip(columns, kinds))], [*b.schema.names, *(x.split()[0] for x in ANALYSED.split(", "))])

    return kept.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), ANALYSED]))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for m in b.column("media"):
            media = m.as_py()
            found = scan(media)
            payload = unwrap(media, found)
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(found), found.samples / found.rate if found.rate else 0.0, found.offsets))
        p, ps, tail, m, ms, f, d, o = zip(*rows) if rows else ((),) * 8
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("n_bytes"), pa.array(p, pa.int64()), pa.array(ps, pa.string()), pa.array(tail, pa.int64()), pa.array(m, pa.int64()), pa.array(ms, pa.string()), pa.array(f, pa.string()), pa.array(d, pa.float64()), pa.array(o, pa.list_(pa.int64()))],
            ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "duration_s", "frame_offsets"],
        )


def op4_mpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = stored(shared.table(spark, sf_dir, "documents"))
    return media.mapInArrow(_digests, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, duration_s double, frame_offsets array<long>")
