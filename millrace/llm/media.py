"""Media columns: MPEG audio.

``parse`` reads any bytes as an MPEG audio stream (versions 1, 2 and 2.5,
layers I to III).  It skips an ID3v2 tag in front and ID3v1, Lyrics3 and APEv2
tags at the end, finds the first header that another consistent header follows,
and after damage resynchronises in the same way.  It parses the tables for
variable bit rates (Xing, Info with a LAME tag, VBRI), verifies the CRC-16 of
every protected frame (layer III over header and side information), and gives
the exact number of samples, less encoder delay and padding where the tables
say so, together with the byte offset of every frame and a seek table.

``store`` writes a payload losslessly as such a stream: an ID3v2 tag, an Info
frame with the number of frames, the length and a table of contents, then MPEG-1
layer III frames of 216 bytes (48 kbit/s at 32 kHz, mono, CRC-protected), whose
side information says that there is no audio data; 192 bytes of the payload are
ancillary data in each.  ``load`` gets them back from the parsed frames.

Defined results: a null text is the empty text, whose payload is 192 spaces;
equal texts give equal bytes and values; bytes without a frame parse to an
empty stream; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import table

UNIT = 192
FRAME = 216
#: MPEG-1 layer III with CRC; 48 kbit/s, 32 kHz, no padding; mono.
_HEADER = bytes((0xFF, 0xFA, 0x38, 0xC0))
_SIDE = bytes(17)
#: Frames between two entries of a seek table.
SEEK_EVERY = 64

_RATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
_HERTZ = (44100, 48000, 32000)


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = (c << 1) ^ 0x8005 if c & 0x8000 else c << 1
        out.append(c & 0xFFFF)
    return out


_CRC = _crc_table()


def crc16(data: bytes, crc: int = 0xFFFF) -> int:
    for b in data:
        crc = ((crc << 8) & 0xFFFF) ^ _CRC[(crc >> 8) ^ b]
    return crc


def crc16_bits(value: int, n: int, crc: int) -> int:
    """``crc16`` over the lowest n bits of value, the highest of them first."""
    for k in range(n - 1, -1, -1):
        crc = (crc << 1 & 0xFFFF) ^ (0x8005 if (crc >> 15 ^ value >> k) & 1 else 0)
    return crc


#: Layer II: the bits of a subband's allocation; by bit rate a channel and sampling rate.
_ALLOCATION = {
    "a": (4,) * 11 + (3,) * 12 + (2,) * 4,
    "b": (4,) * 11 + (3,) * 12 + (2,) * 7,
    "c": (4,) * 2 + (3,) * 6,
    "d": (4,) * 2 + (3,) * 10,
    "low": (4,) * 4 + (3,) * 7 + (2,) * 19,
}


@dataclass(frozen=True)
class Header:
    version: float  # 1, 2 or 2.5
    layer: int
    protected: bool
    kbits: int
    hertz: int
    padding: int
    mono: bool
    #: The first subband that the channels share; 32 if none.
    bound: int = 32

    @property
    def samples(self) -> int:
        if self.layer == 1:
            return 384
        return 1152 if self.layer == 2 or self.version == 1 else 576

    @property
    def length(self) -> int:
        if self.layer == 1:
            return (12 * self.kbits * 1000 // self.hertz + self.padding) * 4
        return self.samples // 8 * self.kbits * 1000 // self.hertz + self.padding

    @property
    def side(self) -> int:
        """Bytes of layer III's side information."""
        if self.layer != 3:
            return 0
        return (17 if self.mono else 32) if self.version == 1 else (9 if self.mono else 17)


def checked_bits(h: Header, data: bytes, at: int) -> int:
    """How many bits after its checksum a frame's checksum covers."""
    channels = 1 if h.mono else 2
    if h.layer == 3:
        return 8 * h.side
    if h.layer == 1:
        return 4 * (h.bound * channels + 32 - h.bound)
    each = h.kbits // channels
    name = "low" if h.version != 1 else ("d" if h.hertz == 32000 else "c") if each <= 48 else "a" if each <= 80 or h.hertz == 48000 else "b"
    fields = [(bits, channels if k >= h.bound else 1) for k, bits in enumerate(_ALLOCATION[name]) for _ in range(channels if k < h.bound else 1)]
    n = sum(bits for bits, _ in fields)
    value = int.from_bytes(data[at : at + (n + 7) // 8].ljust((n + 7) // 8, b"\0"), "big") >> -n % 8
    left, selected = n, 0
    for bits, sharing in fields:
        left -= bits
        selected += sharing * ((value >> left) & ((1 << bits) - 1) != 0)
    return n + 2 * selected


def crc_is_good(h: Header, data: bytes, at: int) -> bool | None:
    """Whether the checksum of the frame at ``at`` is right; None if the frame ends before what it covers."""
    n = checked_bits(h, data, at + 6)
    whole, rest = divmod(n, 8)
    if h.length < 6 + whole + (rest > 0):
        return None
    crc = crc16(data[at + 6 : at + 6 + whole], crc16(data[at + 2 : at + 4]))
    if rest:
        crc = crc16_bits(data[at + 6 + whole] >> (8 - rest), rest, crc)
    return crc == int.from_bytes(data[at + 4 : at + 6], "big")


_KNOWN: dict[bytes, Header | None] = {}


def header(four: bytes) -> Header | None:
    """The header in four bytes, or None (also for free-format rates, whose length is not in the header)."""
    if four in _KNOWN:
        return _KNOWN[four]
    out = None
    if len(four) == 4 and four[0] == 0xFF and four[1] & 0xE0 == 0xE0:
        version, layer = {0: 2.5, 2: 2, 3: 1}.get(four[1] >> 3 & 3), 4 - (four[1] >> 1 & 3)
        rate, hertz = four[2] >> 4, four[2] >> 2 & 3
        if version and layer < 4 and 0 < rate < 15 and hertz < 3 and four[3] & 3 != 2:
            kbits = _RATES[(1, layer) if version == 1 else (2, 1 if layer == 1 else 2)][rate]
            down = {1: 1, 2: 2, 2.5: 4}[version]
            out = Header(version, layer, not four[1] & 1, kbits, _HERTZ[hertz] // down, four[2] >> 1 & 1, four[3] >> 6 == 3, 4 * (four[3] >> 4 & 3) + 4 if four[3] >> 6 == 1 and layer < 3 else 32)
    if len(_KNOWN) < 65536:
        _KNOWN[four] = out
    return out


@dataclass
class Stream:
    """What a parse found; offsets count from the first byte given."""

    offsets: list[int] = field(default_factory=list)
    headers: list[Header] = field(default_factory=list)
    tags: dict[str, int] = field(default_factory=dict)  # name: bytes
    table: str = ""  # Xing, Info, VBRI or empty
    table_frames: int | None = None
    table_bytes: int | None = None
    toc: bytes = b""
    delay: int = 0
    padding: int = 0
    n_resync: int = 0
    n_skipped: int = 0
    n_crc_ok: int = 0
    n_crc_bad: int = 0

    @property
    def samples(self) -> int:
        return max(0, sum(h.samples for h in self.headers) - self.delay - self.padding)

    @property
    def seconds(self) -> Fraction:
        """Exact, frame by frame, so also where the sampling rate changes."""
        if not self.headers:
            return Fraction(0)
        by: dict[int, int] = {}
        for h in self.headers:
            by[h.hertz] = by.get(h.hertz, 0) + h.samples
        whole = sum((Fraction(n, hertz) for hertz, n in by.items()), Fraction(0))
        return max(Fraction(0), whole - Fraction(self.delay + self.padding, self.headers[0].hertz))

    def seek(self, every: int = SEEK_EVERY) -> list[tuple[int, int]]:
        """(first sample, byte offset) of every so many frames."""
        out, at = [], 0
        for k, (offset, h) in enumerate(zip(self.offsets, self.headers)):
            if k % every == 0:
                out.append((at, offset))
            at += h.samples
        return out


def _synchsafe(b: bytes) -> int:
    return (b[0] & 127) << 21 | (b[1] & 127) << 14 | (b[2] & 127) << 7 | b[3] & 127


def _counted(data: bytes, start: int) -> int:
    """Where the frames end that the first one's table counts; ``start`` if it counts none, or they are not there."""
    h, found = header(data[start : start + 4]), Stream()
    if h is None or not _table(data, start, h, found):
        return start
    at = start + h.length
    for _ in range(found.table_frames or 0):
        b = header(data[at : at + 4])
        if b is None or not _like(b, h) or at + b.length > len(data):
            return start
        at += b.length
    return at


def _tags(data: bytes, out: Stream) -> tuple[int, int]:
    """Where the audio may begin and end; what looks like a tag inside of counted frames is none."""
    start, end = 0, len(data)
    while data[start : start + 3] == b"ID3" and start + 10 <= end:
        n = 10 + _synchsafe(data[start + 6 : start + 10]) + 10 * bool(data[start + 5] & 0x10)
        out.tags["ID3v2"] = out.tags.get("ID3v2", 0) + n
        start += n
    if end - start >= 128 and data[end - 128 : end - 125] == b"TAG" and end - 128 >= _counted(data, start):
        out.tags["ID3v1"], end = 128, end - 128
    if end - start >= 15 and data[end - 9 : end] == b"LYRICS200" and data[end - 15 : end - 9].isdigit():
        n = int(data[end - 15 : end - 9]) + 15
        if n <= end - start and end - n >= _counted(data, start):
            out.tags["Lyrics3"], end = n, end - n
    if end - start >= 32 and data[end - 32 : end - 24] == b"APETAGEX":
        size, flags = struct.unpack("<I4xI", data[end - 20 : end - 8])
        n = size + 32 * bool(flags & 0x80000000)
        if n <= end - start and end - n >= _counted(data, start):
            out.tags["APEv2"], end = n, end - n
    return min(start, end), end


def _like(a: Header, b: Header) -> bool:
    return (a.version, a.layer, a.hertz) == (b.version, b.layer, b.hertz)


def _find(data: bytes, at: int, end: int, like: Header | None) -> int:
    """The next frame: a header that is followed by another like it, or by the end."""
    while True:
        at = data.find(b"\xff", at, end)
        if at < 0 or at + 4 > end:
            return -1
        h = header(data[at : at + 4])
        if h and at + h.length <= end and (like is None or _like(h, like)):
            after = at + h.length
            if after == end or (b := header(data[after : after + 4])) and _like(h, b):
                return at
        at += 1


def _table(data: bytes, at: int, h: Header, out: Stream) -> bool:
    """Whether the frame holds a table in place of audio."""
    frame = data[at : at + h.length]
    p = 4 + h.side
    name = frame[p : p + 4]
    if name not in (b"Xing", b"Info"):  # some writers leave room for the checksum, some don't
        p += 2
        name = frame[p : p + 4]
    if h.layer == 3 and name in (b"Xing", b"Info") and len(frame) >= p + 8:
        out.table = name.decode()
        flags = int.from_bytes(frame[p + 4 : p + 8], "big")
        p += 8
        for bit, size in ((1, 4), (2, 4), (4, 100), (8, 4)):
            if flags & bit:
                part = frame[p : p + size]
                if bit == 1:
                    out.table_frames = int.from_bytes(part, "big")
                elif bit == 2:
                    out.table_bytes = int.from_bytes(part, "big")
                elif bit == 4:
                    out.toc = part
                p += size
        if len(frame) >= p + 24 and frame[p : p + 4] in (b"LAME", b"Lavc", b"Lavf"):
            packed = int.from_bytes(frame[p + 21 : p + 24], "big")
            out.delay, out.padding = packed >> 12, packed & 0xFFF
        return True
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        out.table = "VBRI"
        _, delay, _, out.table_bytes, out.table_frames = struct.unpack(">HHHII", frame[40:54])
        n, _, size = struct.unpack(">HHH", frame[54:60])
        out.toc = frame[62 : 62 + n * size]
        return True
    return False


def parse(data: bytes) -> Stream:
    out = Stream()
    at, end = _tags(data, out)
    like: Header | None = None
    looked = False
    while at + 4 <= end:
        h = header(data[at : at + 4])
        to = at
        if like is None:
            to = _find(data, at, end, None)
        elif h is None or at + h.length > end or not _like(h, like):
            to = _find(data, at + 1, end, like)
            if to < 0:
                to = _find(data, at + 1, end, None)
        if to < 0:
            out.n_skipped += end - at
            break
        if to > at:
            out.n_skipped += to - at
            out.n_resync += 1
            at, h = to, header(data[to : to + 4])
        like = h
        if h.protected and (good := crc_is_good(h, data, at)) is not None:
            out.n_crc_ok += good
            out.n_crc_bad += not good
        if looked or not _table(data, at, h, out):
            out.offsets.append(at)
            out.headers.append(h)
        looked = True
        at += h.length
    return out


_CRC_BYTES = crc16(_SIDE, crc16(_HEADER[2:])).to_bytes(2, "big")
_HEAD = _HEADER + _CRC_BYTES + _SIDE


def padded(text: str | None) -> tuple[int, bytes]:
    """Length of the text's UTF-8, and that with spaces up to a positive multiple of UNIT."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b" " * (UNIT - len(raw) if not raw else -len(raw) % UNIT)


def store(payload: bytes) -> bytes:
    """The payload, a positive multiple of UNIT bytes, as an MPEG stream."""
    n = len(payload) // UNIT
    size = FRAME * (n + 1)
    toc = bytes(min(255, 256 * (FRAME * (1 + k * n // 100)) // size) for k in range(100))
    info = b"Info" + (7).to_bytes(4, "big") + n.to_bytes(4, "big") + size.to_bytes(4, "big") + toc
    frames = np.zeros((n + 1, FRAME), dtype=np.uint8)
    frames[:, : len(_HEAD)] = np.frombuffer(_HEAD, dtype=np.uint8)
    frames[0, len(_HEAD) : len(_HEAD) + len(info)] = np.frombuffer(info, dtype=np.uint8)
    frames[1:, len(_HEAD) : len(_HEAD) + UNIT] = np.frombuffer(payload, dtype=np.uint8).reshape(n, UNIT)
    title = b"\x03payload"
    tag = b"TIT2" + bytes((0, 0, 0, len(title), 0, 0)) + title
    return b"ID3\x04\x00\x00" + bytes((0, 0, 0, len(tag))) + tag + frames.tobytes()


def load(data: bytes, stream: Stream) -> bytes:
    """The ancillary data of the stream's frames."""
    head = len(_HEAD)
    return b"".join(data[o + head : o + head + UNIT] for o in stream.offsets)


def feature(s: Stream) -> str:
    """Frames, samples, exact seconds, rates, table, checksums and the ends of the seek table."""
    seek = s.seek()
    first = s.headers[0] if s.headers else None
    return ";".join(
        (
            f"frames={len(s.offsets)}",
            f"samples={s.samples}",
            f"seconds={s.seconds}",
            f"hertz={first.hertz if first else 0}",
            f"kbits={first.kbits if first else 0}",
            f"tags={'+'.join(f'{k}:{v}' for k, v in s.tags.items())}",
            f"table={s.table}:{s.table_frames}:{s.table_bytes}",
            f"crc={s.n_crc_ok}/{s.n_crc_ok + s.n_crc_bad}",
            f"resync={s.n_resync}",
            f"seek={len(seek)}:{seek[0][1] if seek else 0}:{seek[-1][1] if seek else 0}",
        )
    )


_SCHEMA = "doc_id string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _digest(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in parts:
        out = []
        for doc_id, text in zip(rows["doc_id"], rows["text"]):
            n, payload = padded(text)
            data = store(payload)
            stream = parse(data)
            back = load(data, stream)
            out.append((doc_id, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature(stream)))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _SCHEMA.split(", ")])


def digest(docs: DataFrame) -> DataFrame:
    """Per document: its stored form's and its payload's lengths and hashes, and the parsed features."""
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(_digest, _SCHEMA).withColumn("doc_id", F.col("doc_id").cast(kind))


def media_column(docs: DataFrame) -> DataFrame:
    """doc_id, media (the stored bytes), the duration as a fraction (seconds_num, seconds_den), offsets (of every frame) and seek (array of sample, offset)."""

    def encode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            media = [store(padded(t)[1]) for t in rows["text"]]
            found = [parse(m) for m in media]
            yield pd.DataFrame(
                {
                    "doc_id": rows["doc_id"],
                    "media": media,
                    "seconds_num": [s.seconds.numerator for s in found],
                    "seconds_den": [s.seconds.denominator for s in found],
                    "offsets": [s.offsets for s in found],
                    "seek": [[{"sample": a, "offset": b} for a, b in s.seek()] for s in found],
                }
            )

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInPandas(encode, "doc_id string, media binary, seconds_num long, seconds_den long, offsets array<long>, seek array<struct<sample:long,offset:long>>")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def op9_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))
