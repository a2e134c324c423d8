"""Media columns: bytes carried by MPEG audio streams, and their index.

A stream is an ID3v2 tag, an information frame with a variable-bitrate table (frame count,
bytes, 100 seek points), and one MPEG-2 Layer III frame for each UNIT bytes of payload.
Such a frame is 576 samples of silence at 16 kHz: a header, a CRC-16 over header and side
information, side information that claims no main data, and then UNIT bytes where a decoder
expects ancillary data.  One payload byte thus belongs to one sample.

The parser takes nothing for granted: it skips tags, looks for a sync word whose header is
valid, whose checksum holds and that is followed by another such frame or the end, reads the
table if there is one (Xing, Info or VBRI), and goes on from frame to frame by the lengths of
their headers.  After damaged bytes it looks for the next frame the same way.  Frames with a
failing checksum, of any layer, are counted, not used.  Durations are exact: samples over the
rate, in units of 1/rate seconds; what an encoder says of its delay and padding is given beside
them.  Tags are the text fields of ID3v2.2 to 2.4, and of ID3v1 where the former lack them.
Streams in free format give no frames.

Defined cases: a null or empty text is stored as one frame of padding; damaged or foreign
bytes give no frame and a duration of zero; null media gives a null index; an empty table an
empty one.  Repeated rows and ids give a row each.  Columns of `media` named like those of the
index are replaced.  A text is stored whole whatever its length, in one row's memory.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm import textkit as tk
from quillon.llm.runtime import documents, short_batches, tidy

UNIT, PAD = 576, 255
# Fixed values of the MPEG audio frame header: kbit/s by index, for versions and layers.
RATES_V1 = {1: [32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448], 2: [32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384], 3: [32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320]}
RATES_V2 = {1: [32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256], 2: [8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160], 3: [8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160]}
HERTZ = {1: [44100, 48000, 32000], 2: [22050, 24000, 16000], 25: [11025, 12000, 8000]}
# Fixed values of Layer II's allocation tables: bits of an allocation, and for how many subbands.
ALLOCATION = {"a": [(4, 11), (3, 12), (2, 4)], "b": [(4, 11), (3, 12), (2, 7)], "c": [(4, 2), (3, 6)], "d": [(4, 2), (3, 10)], "low rates": [(4, 4), (3, 7), (2, 19)]}
# Fixed values of the ID3 formats: names of ID3v2.2 text fields, and the fields of ID3v1 with their places.
OLD_NAMES = {"TT2": "TIT2", "TP1": "TPE1", "TAL": "TALB", "TYE": "TYER", "TRK": "TRCK", "TCO": "TCON", "TXX": "TXXX"}
V1_FIELDS = {"TIT2": (3, 33), "TPE1": (33, 63), "TALB": (63, 93), "TYER": (93, 97), "COMM": (97, 127)}
CODECS = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}

# What our own frames say: MPEG-2, Layer III, with CRC, 144 kbit/s, 16 kHz, one channel.
HEADER = bytes([0xFF, 0b11110010, (13 << 4) | (2 << 2), 0b11000000])
SIDE, FRAME = 9, 648
TOC = 100


def _crc_table() -> list[int]:
    out = []
    for b in range(256):
        r = b << 8
        for _ in range(8):
            r = ((r << 1) ^ 0x8005) & 0xFFFF if r & 0x8000 else (r << 1) & 0xFFFF
        out.append(r)
    return out


_CRC = _crc_table()


def crc16(data: bytes, bits: int | None = None) -> int:
    """CRC of MPEG audio over the data's first bits (all unless given): polynomial 0x8005, from all ones."""
    bits = 8 * len(data) if bits is None else bits
    r = 0xFFFF
    for b in data[: bits // 8]:
        r = ((r << 8) & 0xFFFF) ^ _CRC[(r >> 8) ^ b]
    for k in range(bits % 8):
        r = ((r << 1) & 0xFFFF) ^ (0x8005 if (r >> 15) ^ (data[bits // 8] >> (7 - k)) & 1 else 0)
    return r


@dataclass(frozen=True)
class Header:
    version: int
    layer: int
    protected: bool
    kbps: int
    hertz: int
    padding: int
    mono: bool
    bound: int = 32

    @property
    def channels(self) -> int:
        return 1 if self.mono else 2

    @property
    def widths(self) -> list[int]:
        """Bits of a bit allocation by subband, of Layer II."""
        each = self.kbps // self.channels
        if self.version != 1:
            kind = "low rates"
        elif each >= 56 and (self.hertz == 48000 or each <= 80):
            kind = "a"
        else:
            kind = "b" if each >= 96 else "d" if self.hertz == 32000 else "c"
        return [w for w, n in ALLOCATION[kind] for _ in range(n)]

    @property
    def samples(self) -> int:
        return 384 if self.layer == 1 else 1152 if self.layer == 2 or self.version == 1 else 576

    @property
    def length(self) -> int:
        if self.layer == 1:
            return (12 * self.kbps * 1000 // self.hertz + self.padding) * 4
        return self.samples // 8 * self.kbps * 1000 // self.hertz + self.padding

    @property
    def side(self) -> int:
        """Bytes of side information; of Layer III only."""
        return 0 if self.layer != 3 else (17 if self.mono else 32) if self.version == 1 else (9 if self.mono else 17)


def read_header(b: bytes) -> Header | None:
    if len(b) < 4 or b[0] != 0xFF or b[1] & 0xE0 != 0xE0:
        return None
    version, layer = {0: 25, 2: 2, 3: 1}.get((b[1] >> 3) & 3), 4 - ((b[1] >> 1) & 3)
    rate, hertz = b[2] >> 4, (b[2] >> 2) & 3
    if version is None or layer == 4 or rate in (0, 15) or hertz == 3 or b[3] & 3 == 2:
        return None
    return Header(version, layer, not b[1] & 1, (RATES_V1 if version == 1 else RATES_V2)[layer][rate - 1], HERTZ[version][hertz], (b[2] >> 1) & 1, b[3] >> 6 == 3, 4 + 4 * ((b[3] >> 4) & 3) if b[3] >> 6 == 1 else 32)


def covered(data: bytes, at: int, h: Header) -> int:
    """How many bits behind the checksum it covers: side information, or allocations and, in Layer II, what says how scale factors are sent."""
    if h.layer == 3:
        return 8 * h.side
    if h.layer == 1:
        return 4 * (32 if h.mono else 32 + h.bound)
    widths, place, sent = h.widths, 0, 0
    held = int.from_bytes(data[at + 6 : at + 6 + 32], "big") << 8 * max(0, at + 38 - len(data))
    for band, w in enumerate(widths):
        own = band < h.bound
        for _ in range(h.channels if own else 1):
            place += w
            sent += 2 * ((held >> (256 - place)) & ((1 << w) - 1) > 0) * (1 if own else h.channels)
    return place + sent


def sound(data: bytes, at: int, h: Header) -> bool:
    """Whether the frame is whole and its checksum, if it has one, holds."""
    if at + h.length > len(data):
        return False
    if not h.protected:
        return True
    bits = covered(data, at, h)
    if 48 + bits > 8 * h.length:
        return False
    return crc16(data[at + 2 : at + 4] + data[at + 6 : at + 6 + -(-bits // 8)], 16 + bits) == int.from_bytes(data[at + 4 : at + 6], "big")


@dataclass
class Stream:
    """What the parser found."""

    tags: dict[str, str] = field(default_factory=dict)
    hertz: int = 0
    samples: int = 0
    frames: int = 0
    offsets: list[int] = field(default_factory=list)
    table_frames: int = -1
    table_bytes: int = -1
    table_seek: list[int] = field(default_factory=list)
    table: str = ""
    delay: int = 0
    padding: int = 0
    skipped: int = 0
    bad_checksums: int = 0


def _size28(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def read_tag(data: bytes) -> tuple[dict[str, str], int]:
    """Text fields of an ID3v2 tag at the front (user fields by their own names), and where it ends.  Compressed and encrypted fields are left out."""
    if data[:3] != b"ID3" or len(data) < 10 or data[3] not in (2, 3, 4) or max(data[6:10]) > 127:
        return {}, 0
    version, flags, size = data[3], data[5], _size28(data[6:10])
    body, at, out = data[10 : 10 + size], 0, {}
    if flags & 0x80 and version < 4:
        body = body.replace(b"\xff\0", b"\xff")
    if flags & 0x40 and version > 2 and len(body) >= 4:
        at = 4 + int.from_bytes(body[:4], "big") if version == 3 else _size28(body)
    head = 6 if version == 2 else 10
    while at + head <= len(body) and body[at]:
        if version == 2:
            name, n, how = body[at : at + 3], int.from_bytes(body[at + 3 : at + 6], "big"), 0
        else:
            name, how = body[at : at + 4], body[at + 9]
            n = _size28(body[at + 4 : at + 8]) if version == 4 else int.from_bytes(body[at + 4 : at + 8], "big")
        held = body[at + head : at + head + n]
        at += head + n
        if name[:1] != b"T" or not held or how & (0xC0 if version == 3 else 0x0C):
            continue
        if version == 4:
            held = held[4 * (how & 1) :]
            held = held.replace(b"\xff\0", b"\xff") if how & 2 else held
        if (codec := CODECS.get(held[0] if held else -1)) is None:
            continue
        key, parts = name.decode("latin-1"), held[1:].decode(codec, "replace").rstrip("\0").split("\0")
        key = OLD_NAMES.get(key, key)
        if key == "TXXX":
            key, parts = parts[0], [x.lstrip("\ufeff") for x in parts[1:]]
        out[key] = "/".join(parts)
    return out, min(10 + size + 10 * (version == 4 and flags & 0x10 > 0), len(data))


def read_old_tag(tag: bytes) -> dict[str, str]:
    """Fields of an ID3v1 tag of 128 bytes, under the names that ID3v2.3 gives them."""
    out = {k: tag[a:b].split(b"\0")[0].rstrip().decode("latin-1") for k, (a, b) in V1_FIELDS.items()}
    if tag[125] == 0 and tag[126]:
        out["TRCK"] = str(tag[126])
    return {k: v for k, v in out.items() if v}


def read_table(data: bytes, at: int, h: Header, s: Stream) -> bool:
    """Whether the frame holds a table of the stream instead of sound; what it says goes to s.

    Seek points are 256ths of the stream for each hundredth of its time (Xing, Info), or
    bytes from this frame on to where each entry starts (VBRI).
    """
    end = at + h.length
    frame = data[at:end]
    p = 4 + 2 * h.protected + h.side
    if frame[p : p + 4] in (b"Xing", b"Info") and len(frame) >= p + 8:
        s.table, flags, p = frame[p : p + 4].decode(), int.from_bytes(frame[p + 4 : p + 8], "big"), p + 8
        if flags & 1:
            s.table_frames, p = int.from_bytes(frame[p : p + 4], "big"), p + 4
        if flags & 2:
            s.table_bytes, p = int.from_bytes(frame[p : p + 4], "big"), p + 4
        if flags & 4:
            s.table_seek, p = list(frame[p : p + TOC]), p + TOC
        p += 4 * (flags & 8 > 0)
        if frame[p : p + 4] in (b"LAME", b"Lavf", b"Lavc") and len(frame) >= p + 24:
            both = int.from_bytes(frame[p + 21 : p + 24], "big")
            s.delay, s.padding = both >> 12, both & 0xFFF
        return True
    if h.layer == 3 and frame[36:40] == b"VBRI" and len(frame) >= 62:
        word = lambda k, n=2: int.from_bytes(frame[36 + k : 36 + k + n], "big")
        s.table, s.delay, s.table_bytes, s.table_frames = "VBRI", word(6), word(10, 4), word(14, 4)
        entries, scale, size, place = word(18), word(20), word(22), 0
        for k in range(min(entries, (len(frame) - 62) // size if size else 0)):
            if place >= len(data):
                break
            s.table_seek.append(place)
            place += scale * word(26 + k * size, size)
        return True
    return False


def _next(data: bytes, at: int) -> int:
    """The next place from `at` on where a sound frame starts that another frame or the end follows; else the length."""
    while 0 <= (at := data.find(b"\xff", at)) < len(data) - 3:
        h = read_header(data[at : at + 4])
        if h and h.length and sound(data, at, h):
            after = at + h.length
            g = read_header(data[after : after + 4])
            if len(data) - after < 4 or data[after : after + 3] == b"TAG" or g and (g.version, g.layer, g.hertz) == (h.version, h.layer, h.hertz):
                return at
        at += 1
    return len(data)


def _uniform(data: bytes, at: int) -> int:
    """How many frames from `at` on repeat the frame there in header, checksum and side information, by one comparison of all."""
    h = read_header(data[at : at + 4])
    n = (len(data) - at) // h.length if h else 0
    if n < 2:
        return 0
    head = 4 + (2 + -(-covered(data, at, h) // 8) if h.protected else h.side)
    rows = np.frombuffer(data, np.uint8, n * h.length, at).reshape(n, h.length)[:, :head]
    other = np.flatnonzero((rows != rows[0]).any(axis=1))
    return int(other[0]) if len(other) else n


def parse(data: bytes) -> Stream:
    """Walk a stream from frame to frame."""
    s = Stream()
    s.tags, at = read_tag(data)
    synced, first = False, True
    while at < len(data):
        if data[at : at + 3] == b"TAG" and len(data) - at == 128:
            s.tags = read_old_tag(data[at:]) | s.tags
            break
        h = read_header(data[at : at + 4])
        if not (synced and h and h.length):
            new = _next(data, at)
            s.skipped += new - at
            at, synced = new, new < len(data)
            continue
        if not sound(data, at, h):
            s.bad_checksums += at + h.length <= len(data)
            at, synced = at + 1, False
            s.skipped += 1
            continue
        if first:
            first = False
            if read_table(data, at, h, s):
                at += h.length
                continue
        n = max(1, _uniform(data, at))
        s.hertz = s.hertz or h.hertz
        s.offsets += range(at, at + n * h.length, h.length)
        s.frames, s.samples, at = s.frames + n, s.samples + n * h.samples, at + n * h.length
    return s


def _template(body: bytes) -> bytes:
    side = bytes(SIDE)
    return HEADER + crc16(HEADER[2:] + side).to_bytes(2, "big") + side + body


_FRONT = _template(b"")


def store(raw: bytes) -> bytes:
    """The stream that carries these bytes."""
    n = max(1, -(-len(raw) // UNIT))
    payload = raw + bytes([PAD]) * (n * UNIT - len(raw))
    text = b"\0" + b"n_bytes\0" + str(len(raw)).encode()
    text2 = b"\0" + b"crc32\0" + b"%08x" % zlib.crc32(payload)
    fields = b"".join(b"TXXX" + len(t).to_bytes(4, "big") + b"\0\0" + t for t in (text, text2))
    tag = b"ID3\x03\0\0" + bytes([(len(fields) >> s) & 127 for s in (21, 14, 7, 0)]) + fields
    seek = bytes(min(255, (i * n // TOC * FRAME + FRAME) * 256 // ((n + 1) * FRAME)) for i in range(TOC))
    info = b"Xing" + (7).to_bytes(4, "big") + n.to_bytes(4, "big") + ((n + 1) * FRAME).to_bytes(4, "big") + seek
    frames = np.zeros((n + 1, FRAME), np.uint8)
    frames[:, : len(_FRONT)] = np.frombuffer(_FRONT, np.uint8)
    frames[0, len(_FRONT) : len(_FRONT) + len(info)] = np.frombuffer(info, np.uint8)
    frames[1:, len(_FRONT) : len(_FRONT) + UNIT] = np.frombuffer(payload, np.uint8).reshape(n, UNIT)
    return tag + frames.tobytes()


def load(data: bytes, s: Stream | None = None) -> tuple[bytes, int]:
    """Payload with its padding, and the number of bytes without it; of streams that store() made."""
    s = s or parse(data)
    if not s.frames:
        return b"", 0
    at = np.array(s.offsets)
    held = np.frombuffer(data, np.uint8)
    if len(at) and at[-1] - at[0] == (len(at) - 1) * FRAME:
        payload = held[at[0] : at[0] + len(at) * FRAME].reshape(-1, FRAME)[:, len(_FRONT) : len(_FRONT) + UNIT].tobytes()
    else:
        payload = b"".join(data[i + len(_FRONT) : i + len(_FRONT) + UNIT] for i in s.offsets)
    said = s.tags.get("n_bytes", "")
    return payload, min(int(said), len(payload)) if said.isascii() and said.isdigit() and len(said) < 20 else len(payload)


def attach(docs: DataFrame) -> DataFrame:
    """doc_id and `media`, the stream that carries the text."""

    @tidy("media_audio")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = tk.buffers(batch.column(1))
            for lo, hi in tk.slices(bounds):
                part = [store(data[bounds[i] : bounds[i + 1]].tobytes()) for i in range(lo, hi)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(part, pa.binary())], names=["doc_id", "media"])

    return short_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, media binary")


#: What `index` adds, by name, for Arrow and for Spark.
INDEX = {
    "n_bytes": (pa.int64(), T.LongType()), "payload": (pa.binary(), T.BinaryType()), "hertz": (pa.int32(), T.IntegerType()), "samples": (pa.int64(), T.LongType()),
    "frames": (pa.int32(), T.IntegerType()), "offsets": (pa.list_(pa.int64()), T.ArrayType(T.LongType())), "vbr": (pa.bool_(), T.BooleanType()), "seek": (pa.list_(pa.int32()), T.ArrayType(T.IntegerType())),
    "delay": (pa.int32(), T.IntegerType()), "padding": (pa.int32(), T.IntegerType()), "skipped": (pa.int64(), T.LongType()), "bad_checksums": (pa.int32(), T.IntegerType()), "tags": (pa.map_(pa.string(), pa.string()), T.MapType(T.StringType(), T.StringType())),
}


def index(media: DataFrame, offsets: bool = True) -> DataFrame:
    """The rows with `media` read back: payload, exact duration (samples over hertz), frame offsets, table and faults."""
    media = media.select([c for c in media.columns if c not in INDEX])
    keep = media.columns
    schema = T.StructType([*media.schema.fields, *(T.StructField(k, t) for k, (_, t) in INDEX.items())])

    @tidy("media_audio")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for m in batch.column(batch.schema.get_field_index("media")):
                if not m.is_valid:
                    rows.append(dict.fromkeys(INDEX))
                    continue
                b = m.as_buffer().to_pybytes()
                s = parse(b)
                payload, n = load(b, s)
                rows.append({"n_bytes": n, "payload": payload, "hertz": s.hertz, "samples": s.samples, "frames": s.frames, "offsets": s.offsets if offsets else [], "vbr": s.table in ("Xing", "VBRI"), "seek": s.table_seek, "delay": s.delay, "padding": s.padding, "skipped": s.skipped, "bad_checksums": s.bad_checksums, "tags": list(s.tags.items())})
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([r[k] for r in rows], t) for k, (t, _) in INDEX.items())], names=[*keep, *INDEX])

    return media.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = index(attach(documents(spark, sf_dir)))
    return read.select(
        "doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -32, 32)")).alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(";", F.concat(F.lit("ms="), F.expr("samples * 1000 div hertz")), F.concat(F.lit("frames="), "frames"), F.concat(F.lit("samples="), "samples"), F.concat(F.lit("hertz="), "hertz"), F.concat(F.lit("vbr="), "vbr"), F.concat(F.lit("last="), F.element_at("offsets", -1)), F.concat(F.lit("skipped="), "skipped"), F.concat(F.lit("bad="), "bad_checksums")).alias("feature"),
    )


def brute(text: str | None) -> tuple[int, int, str, int]:
    """Size, payload size, digest and tail checksum by the contract's words, for tests."""
    raw = (text or "").encode()
    payload = raw + b"\xff" * (-len(raw) % UNIT or (0 if raw else UNIT))
    return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])
