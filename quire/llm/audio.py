"""MPEG audio as a media column: frames are written, found again, checked and indexed.

The writer makes valid MPEG-2 Layer III streams (16 kHz, mono, checksummed):
an ID3v2 tag, an information frame with the frame count, byte count and seek
table, and audio frames whose granules are silent and whose ancillary bytes
carry the payload, 576 bytes a frame. The reader makes no use of that origin:
it skips tags, resynchronises on chained headers, reads any layer, version and
bit rate, verifies checksums and gives exact durations and frame offsets.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quire.llm.common import column_of, per_batch, schema_with

# Fixed values of the format: kbit/s by bit-rate index 1..14.
RATES_V1_L1 = [32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448]
RATES_V1_L2 = [32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384]
RATES_V1_L3 = [32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320]
RATES_V2_L1 = [32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256]
RATES_V2_L23 = [8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160]
SAMPLE_RATES_V1 = [44100, 48000, 32000]
CRC_POLYNOMIAL = 0x8005
# Fixed values of the format, layer II: runs of (subbands, bits of their allocation).
ALLOCATION_HIGH = [(11, 4), (12, 3), (4, 2)]  # up to 80 kbit/s a channel, or 48 kHz
ALLOCATION_FULL = [(11, 4), (12, 3), (7, 2)]
ALLOCATION_LOW = [(2, 4), (6, 3)]  # up to 48 kbit/s a channel
ALLOCATION_LOW_32 = [(2, 4), (10, 3)]
ALLOCATION_V2 = [(4, 4), (7, 3), (19, 2)]

PAYLOAD = 576
HEADER = bytes([0xFF, 0xF2, 0xD8, 0xC4])  # MPEG-2, Layer III, with checksum, 144 kbit/s, 16 kHz, mono
FRAME = 648  # 72 * 144000 / 16000
SIDE = 9
TAG_TEXT = b"payload"


@dataclass
class Frame:
    offset: int
    length: int
    samples: int
    rate: int
    body: int  # offset of the side information
    version: int
    layer: int
    mono: bool
    checked: bool
    shared: int = 32  # first subband whose allocation both channels share (layers I and II)
    hertz_class: int = 0
    kbit: int = 0


@dataclass
class Stream:
    """What a media value holds. Offsets are bytes from its start."""

    frames: int = 0
    samples: int = 0
    rate: int = 0
    duration: float = 0.0
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    lengths: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    bodies: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    skipped: int = 0  # bytes between frames that belong to none
    bad_checksums: int = 0
    tag: dict = field(default_factory=dict)
    table: dict = field(default_factory=dict)  # of the information frame
    toc: bytes = b""
    version: int = 0
    layer: int = 0
    mono: bool = False


def header(data: bytes, at: int) -> Frame | None:
    """The frame whose header stands at a place, or None."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE0 != 0xE0:
        return None
    b1, b2, b3 = data[at + 1], data[at + 2], data[at + 3]
    version, layer, rate, freq = b1 >> 3 & 3, 4 - (b1 >> 1 & 3), b2 >> 4, b2 >> 2 & 3
    if version == 1 or layer == 4 or rate in (0, 15) or freq == 3:
        return None
    v1 = version == 3
    kbit = (RATES_V1_L1, RATES_V1_L2, RATES_V1_L3) if v1 else (RATES_V2_L1, RATES_V2_L23, RATES_V2_L23)
    bits, hertz, pad = kbit[layer - 1][rate - 1] * 1000, SAMPLE_RATES_V1[freq] >> {3: 0, 2: 1, 0: 2}[version], b2 >> 1 & 1
    samples = 384 if layer == 1 else 1152 if layer == 2 or v1 else 576
    length = (12 * bits // hertz + pad) * 4 if layer == 1 else samples // 8 * bits // hertz + pad
    checked = not b1 & 1
    shared = 4 * (b3 >> 4 & 3) + 4 if b3 >> 6 == 1 else 32
    return Frame(at, length, samples, hertz, at + 4 + 2 * checked, {3: 1, 2: 2, 0: 25}[version], layer, b3 >> 6 == 3, checked, shared, freq, bits // 1000)


def crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        t = np.where(t & 0x8000, t << 1 ^ CRC_POLYNOMIAL, t << 1) & 0xFFFF
    return t.astype(np.uint16)


def crc16(rows: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Checksums of the rows of a byte matrix."""
    crc = np.full(len(rows), 0xFFFF, np.uint16)
    for k in range(rows.shape[1]):
        crc = (crc << np.uint16(8)) ^ steps[(crc >> np.uint16(8)) ^ rows[:, k]]
    return crc


def allocation_bits(f: Frame) -> list[int]:
    """Bits of the allocation of each subband of a frame of layer I or II."""
    if f.layer == 1:
        return [4] * 32
    each = f.kbit // (1 if f.mono else 2)
    if f.version != 1:
        runs = ALLOCATION_V2
    elif each <= 48:
        runs = ALLOCATION_LOW_32 if f.hertz_class == 2 else ALLOCATION_LOW
    else:
        runs = ALLOCATION_HIGH if f.hertz_class == 1 or each <= 80 else ALLOCATION_FULL
    return [bits for n, bits in runs for _ in range(n)]


def crc_bits(data: bytes, bits: int, crc: int = 0xFFFF) -> int:
    """Checksum of the first bits of data."""
    for k in range(bits):
        top = crc >> 15 ^ data[k >> 3] >> 7 - (k & 7) & 1
        crc = (crc << 1 & 0xFFFF) ^ (CRC_POLYNOMIAL if top else 0)
    return crc


def allocation_intact(data: bytes, f: Frame) -> bool:
    """Whether the checksum of a frame of layer I or II holds: it covers the header's last two bytes, the allocation and, in layer II, how scale factors are shared."""
    body = data[f.body : f.offset + f.length]
    value, size, at, picks = int.from_bytes(body, "big"), 8 * len(body), 0, 0
    for band, bits in enumerate(allocation_bits(f)):
        for _ in range(1 if f.mono or band >= f.shared else 2):
            if at + bits > size:
                return False
            used = value >> size - at - bits & (1 << bits) - 1
            at += bits
            if used and f.layer == 2:
                picks += 1 if f.mono or band < f.shared else 2
    at += 2 * picks
    want = int.from_bytes(data[f.offset + 4 : f.offset + 6], "big")
    return at <= size and crc_bits(data[f.offset + 2 : f.offset + 4] + body, 16 + at) == want


def side_size(f: Frame) -> int:
    return (17 if f.mono else 32) if f.version == 1 else 9 if f.mono else 17


def syncsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def encode(payload: bytes) -> bytes:
    """A stream that carries payload, a positive multiple of 576 bytes."""
    n = len(payload) // PAYLOAD
    if not n or len(payload) % PAYLOAD:
        raise ValueError("the payload isn't a positive multiple of 576 bytes")
    text = b"TIT2" + struct.pack(">IH", len(TAG_TEXT) + 1, 0) + b"\x03" + TAG_TEXT
    tag = b"ID3\x04\x00\x00" + syncsafe(len(text)) + text
    side = np.zeros((1, 2 + SIDE), np.uint8)
    side[0, :2] = HEADER[2], HEADER[3]
    head = HEADER + struct.pack(">H", int(crc16(side, crc_table())[0])) + bytes(SIDE)
    frames = np.zeros((n + 1, FRAME), np.uint8)
    frames[:, : len(head)] = np.frombuffer(head, np.uint8)
    frames[1:, len(head) : len(head) + PAYLOAD] = np.frombuffer(payload, np.uint8).reshape(n, PAYLOAD)
    toc = bytes(min(255, (i * n // 100 + 1) * 256 // (n + 1)) for i in range(100))
    info = b"Info" + struct.pack(">III", 7, n, (n + 1) * FRAME) + toc
    frames[0, len(head) : len(head) + len(info)] = np.frombuffer(info, np.uint8)
    return tag + frames.tobytes()


def number(data: bytes, at: int, size: int, bits: int = 8) -> int:
    """Big-endian, of so many bits a byte; what lies past the end counts as 0."""
    n = 0
    for b in data[at : at + size].ljust(size, b"\0"):
        n = n << bits | b
    return n


def parse_tag(data: bytes) -> tuple[int, dict]:
    """Bytes of an ID3v2 tag at the start, and its text frames as far as they go. A tag that is cut ends with the data."""
    if len(data) < 10 or data[:3] != b"ID3" or max(data[6:10]) > 127:
        return 0, {}
    end, at, found = min(len(data), 10 + number(data, 6, 4, 7)), 10, {}
    while at + 10 < end and data[at : at + 4].isalnum():
        n = number(data, at + 4, 4, 7 if data[3] == 4 else 8)
        if data[at : at + 1] == b"T" and n > 1:
            kind = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(data[at + 10], "latin-1")
            found[data[at : at + 4].decode("latin-1")] = data[at + 11 : min(end, at + 10 + n)].decode(kind, "replace")
        at += 10 + n
    return min(len(data), end + 10 * bool(data[5] & 16)), found


def information(data: bytes, f: Frame) -> tuple[dict, bytes] | None:
    """What the first frame of a Layer III stream may hold instead of sound: numbers of frames and bytes and the seek table, which is also given as its bytes. None of a common frame."""
    frame = data[f.offset : f.offset + f.length]
    at = f.body - f.offset + side_size(f)
    if frame[at : at + 4] in (b"Info", b"Xing"):
        flags, p, found = number(frame, at + 4, 4), at + 8, {}
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                found[name] = number(frame, p, 4)
                p += 4
        return found, frame[p : p + 100] if flags & 4 else b""
    if frame[36:40] == b"VBRI":
        entries, scale, size = (number(frame, k, 2) for k in (54, 56, 58))
        steps = [number(frame, 62 + size * k, size) * scale for k in range(entries) if 62 + size * (k + 1) <= len(frame)] if 0 < size <= 4 else []
        return {"frames": number(frame, 50, 4), "bytes": number(frame, 46, 4), "each": number(frame, 60, 2), "steps": steps}, frame[62 : 62 + size * len(steps)]
    return None


def parse(data: bytes) -> Stream:
    """Reads any MPEG audio stream, cut or damaged as it may be. Never raises; what isn't a frame counts as skipped.

    A header is taken only if another of the same version, layer and sample
    rate follows where it ends, or the data end there: payloads full of sync
    bytes don't mislead it. Runs of frames of one header are walked at once.
    "TAG" 128 bytes before the end begins a tag unless a frame lies across it.
    """
    out, (at, out.tag) = Stream(), parse_tag(data)
    end = len(data) - 128 if data[-128:-125] == b"TAG" else len(data)
    raw, offs, lens, bodies = np.frombuffer(data, np.uint8), [], [], []
    found: Frame | None = None
    while at < end:
        f = header(data, at)
        if f and end < len(data) and at + f.length > end and (found is None or (f.version, f.layer, f.rate) == (found.version, found.layer, found.rate)):
            g = header(data, at + f.length)
            if at + f.length == len(data) or g and (g.version, g.layer, g.rate) == (f.version, f.layer, f.rate):
                end = len(data)  # the letters are the frame's own
        ok = f and (found is None or (f.version, f.layer, f.rate) == (found.version, found.layer, found.rate)) and f.length >= 24 and at + f.length <= end
        if ok and at + f.length < end:
            g = header(data, at + f.length)
            ok = bool(g) and (g.version, g.layer, g.rate) == (f.version, f.layer, f.rate)
        if not ok:
            to = data.find(b"\xff", at + 1, end)
            out.skipped += (to if to >= 0 else end) - at
            at = to if to >= 0 else end
            continue
        found = found or f
        # How many frames with this very header follow one another?
        most = (end - at) // f.length
        same = (raw[at : at + most * f.length].reshape(most, f.length)[:, :4] == raw[at : at + 4]).all(1)
        n = most if same.all() else int(np.argmin(same))
        if n > 1 and n == most and at + n * f.length < end and header(data, at + n * f.length) is None:
            n -= 1  # the last isn't followed by a header; it is looked at alone
        offs.append(at + f.length * np.arange(n, dtype=np.int64))
        lens.append(np.full(n, f.length))
        bodies.append(offs[-1] + (f.body - at))
        if f.checked and f.layer == 3:
            m = side_size(f)
            block = raw[at : at + n * f.length].reshape(n, f.length)
            covered = block[:, [2, 3, *range(6, 6 + m)]]
            want = block[:, 4].astype(np.uint16) << 8 | block[:, 5]
            out.bad_checksums += int((crc16(covered, crc_table()) != want).sum())
        elif f.checked:
            out.bad_checksums += sum(not allocation_intact(data, replace(f, offset=int(o), body=int(o) + f.body - at)) for o in offs[-1])
        out.samples += n * f.samples
        at += n * f.length
    if found is None:
        return out
    out.offsets, out.lengths, out.bodies = np.concatenate(offs), np.concatenate(lens), np.concatenate(bodies)
    out.rate, out.version, out.layer, out.mono = found.rate, found.version, found.layer, found.mono
    first = header(data, int(out.offsets[0]))
    if found.layer == 3 and (said := information(data, first)):
        out.table, out.toc = said
        out.samples -= first.samples
        out.offsets, out.lengths, out.bodies = out.offsets[1:], out.lengths[1:], out.bodies[1:]
    out.frames, out.duration = len(out.offsets), out.samples / out.rate
    return out


def payload_of(data: bytes, s: Stream) -> bytes:
    """The payload that encode() put in."""
    if not s.frames:
        return b""
    raw, at = np.frombuffer(data, np.uint8), int(s.bodies[0]) + SIDE
    if (np.diff(s.offsets) == FRAME).all():
        n, first = s.frames, int(s.offsets[0])
        return raw[first : first + n * FRAME].reshape(n, FRAME)[:, at - first : at - first + PAYLOAD].tobytes()
    return b"".join(raw[b + SIDE : b + SIDE + PAYLOAD].tobytes() for b in s.bodies)


def padded(text: bytes) -> bytes:
    return text + b"\xff" * (-len(text) % PAYLOAD or (0 if text else PAYLOAD))


MEDIA = "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, n_frames bigint, n_samples bigint, sample_rate int, duration double, bad_checksums int, skipped_bytes bigint, seek_offsets array<bigint>"


def text_to_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """Stores each text as an MPEG audio value, reads the value back and describes it.

    null counts as the empty text, which is one frame of padding. Rows are
    independent: repeated rows repeat, an empty table gives none, and columns
    of df besides the two are not read. keep_media adds the value itself.
    """

    def store(b: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[tuple] = []
        for text in b.column(1):
            own = (text.as_py() or "").encode()
            media = encode(padded(own))
            s = parse(media)
            back = payload_of(media, s)
            feature = f"mpeg{s.version} layer{s.layer} {'mono' if s.mono else 'stereo'} {s.rate} Hz, {s.frames} frames, {s.samples} samples, {s.bad_checksums} bad, {s.skipped} skipped, table {s.table.get('frames', 0)}/{s.table.get('bytes', 0)}"
            rows.append((len(own), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature, s.frames, s.samples, s.rate, s.duration, s.bad_checksums, s.skipped, s.offsets, *((media,) if keep_media else ())))
        cols = [*zip(*rows, strict=True)]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
        return pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=False))], names=["id", *(x.split()[0] for x in MEDIA.split(", ")), *(["media"] * keep_media)])

    picked = df.select(column_of(df, id_col).alias("id"), column_of(df, text_col).alias("text"))
    return picked.mapInArrow(per_batch(store), schema_with(picked.select("id"), MEDIA + ", media binary" * keep_media)).withColumnRenamed("id", id_col)


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as MPEG audio."""
    return text_to_media(spark.read.parquet(f"{sf_dir}/documents.parquet"))


# The tag and the head of a frame are written out; the rest is put together as hexadecimal text.
OP10_SQL = """
WITH tab AS (SELECT list(v ORDER BY n) AS tab FROM (SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) t(n))),
d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n_bytes, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, n_bytes, h || repeat('FF', CAST(CASE WHEN n_bytes = 0 THEN 576 ELSE (576 - n_bytes % 576) % 576 END AS BIGINT)) AS h FROM d),
f AS (SELECT *, length(h) // 1152 AS n, 'FFF2D8C461A6000000000000000000' AS head, '4944330400000000001254495432000000080000037061796C6F6164' AS tag FROM p),
m AS (
  SELECT *, tag || rpad(head || '496E666F00000007' || printf('%08X', n) || printf('%08X', (n + 1) * 648) || array_to_string(list_transform(range(100), lambda i: printf('%02X', least(255, (i * n // 100 + 1) * 256 // (n + 1)))), ''), 1296, '0')
    || array_to_string(list_transform(range(n), lambda i: head || substr(h, 1152 * i + 1, 1152) || repeat('0', 114)), '') AS media FROM f
)
SELECT doc_id, n_bytes, length(h) // 2 AS payload_bytes, sha256(unhex(h)) AS payload_sha256,
  xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(right(h, 64), '..'), lambda x: CAST('0x' || x AS BIGINT))), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) AS tail_crc32,
  length(media) // 2 AS media_bytes, sha256(unhex(media)) AS media_sha256,
  'mpeg2 layer3 mono 16000 Hz, ' || n || ' frames, ' || n * 576 || ' samples, 0 bad, 0 skipped, table ' || n || '/' || (n + 1) * 648 AS feature,
  n AS n_frames, n * 576 AS n_samples, 16000 AS sample_rate, n * 576 / CAST(16000 AS DOUBLE) AS duration, 0 AS bad_checksums, CAST(0 AS BIGINT) AS skipped_bytes, list_transform(range(n), lambda i: length(tag) // 2 + 648 * (i + 1)) AS seek_offsets
FROM m, tab
"""
