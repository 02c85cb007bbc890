"""Media columns: signature sniffing of binary columns.

An Aho-Corasick automaton finds the magic bytes of all formats in one pass; a format's
validator then confirms structure and lengths from that place and says where the medium
ends.  The medium at the start is the value's true type; others inside are carved out.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from claimstone.session import stored
from claimstone.sources.tables import table

#: Magic bytes, the type they announce, and how far into a medium they stand.
MAGIC = (
    (b"RIFF", "riff", 0), (b"\x89PNG\r\n\x1a\n", "image/png", 0), (b"\xff\xd8\xff", "image/jpeg", 0), (b"GIF87a", "image/gif", 0),
    (b"GIF89a", "image/gif", 0), (b"%PDF-", "application/pdf", 0), (b"PK\x03\x04", "application/zip", 0), (b"\x1f\x8b\x08", "application/gzip", 0),
    (b"OggS", "audio/ogg", 0), (b"fLaC", "audio/flac", 0), (b"BM", "image/bmp", 0), (b"ftyp", "video/mp4", 4),
)


class Scan:
    """A value under scan.  What validators look for is found once for the whole value, however many hits ask for it."""

    def __init__(self, b: bytes):
        self.b = b
        self.places: dict[bytes, list[int]] = {}
        self.chains: dict[str, dict[int, tuple]] = {}
        self._archives: dict[int, int] | None = None

    def find(self, mark: bytes, start: int) -> int:
        """The first place of ``mark`` from ``start`` on; -1 if there is none."""
        at = self._places(mark)
        i = bisect_left(at, start)
        return at[i] if i < len(at) else -1

    def last(self, mark: bytes, start: int, end: int) -> int:
        """The last place of ``mark`` from ``start`` on that ends by ``end``; -1 if there is none."""
        at = self._places(mark)
        i = bisect_right(at, end - len(mark)) - 1
        return at[i] if i >= 0 and at[i] >= start else -1

    def _places(self, mark: bytes) -> list[int]:
        if mark not in self.places:
            found, p = [], self.b.find(mark)
            while p >= 0:
                found.append(p)
                p = self.b.find(mark, p + 1)
            self.places[mark] = found
        return self.places[mark]

    def archives(self) -> dict[int, int]:
        """Where ZIP archives start and end: each end record says where its directory and so its archive starts."""
        if self._archives is None:
            self._archives = {}
            for end in self._places(b"PK\x05\x06"):
                if end + 22 > len(self.b):
                    continue
                size, offset, comment = struct.unpack_from("<IIH", self.b, end + 12)
                start = end - size - offset
                if start >= 0 and self.b[start + offset : start + offset + 4] == b"PK\x01\x02" and end + 22 + comment <= len(self.b):
                    self._archives.setdefault(start, end + 22 + comment)
        return self._archives

    def walk(self, kind: str, at: int, step: Callable[[int], tuple[int | None, object]], fold: Callable[[object, object], object]) -> object:
        """Follows a chain of parts: ``step`` says where the next part starts (None at the end) and what this one adds; what ``fold`` makes of a chain's rest is kept for each of its parts."""
        known = self.chains.setdefault(kind, {})
        path: list[tuple[int, object]] = []
        p: int | None = at
        rest: object = None
        while p is not None:
            if p in known:
                rest = known[p][0]
                break
            p_next, own = step(p)
            path.append((p, own))
            p = p_next
        for q, own in reversed(path):
            rest = fold(own, rest)
            known[q] = (rest,)
        return rest


def _riff(v: Scan, at: int) -> tuple[str, int] | None:
    """RIFF: chunks that fill the stated length; WAVE needs fmt and data, WEBP a VP8 chunk."""
    b = v.b
    if at + 12 > len(b):
        return None
    end = at + 8 + int.from_bytes(b[at + 4 : at + 8], "little")
    if end > len(b):
        return None
    names, p = set(), at + 12
    while p + 8 <= end:
        names.add(b[p : p + 4])
        size = int.from_bytes(b[p + 4 : p + 8], "little")
        p += 8 + size + size % 2
    if p != end:
        return None
    form = b[at + 8 : at + 12]
    if form == b"WAVE" and {b"fmt ", b"data"} <= names:
        return "audio/wav", end
    if form == b"WEBP" and any(n.startswith(b"VP8") for n in names):
        return "image/webp", end
    return None


def _png(v: Scan, at: int) -> tuple[str, int] | None:
    """PNG: IHDR first, then chunks of sound checksums to IEND."""
    b = v.b
    if b[at + 12 : at + 16] != b"IHDR":
        return None

    def step(p: int) -> tuple[int | None, int | None]:
        size, name = int.from_bytes(b[p : p + 4], "big"), b[p + 4 : p + 8]
        end = p + 12 + size
        if p + 12 > len(b) or end > len(b) or zlib.crc32(memoryview(b)[p + 4 : end - 4]) != int.from_bytes(b[end - 4 : end], "big"):
            return None, None
        return (None, end) if name == b"IEND" else (end, None)

    end = v.walk("png", at + 8, step, lambda own, rest: own if own is not None else rest)
    return ("image/png", end) if end else None


def _jpeg(v: Scan, at: int) -> tuple[str, int] | None:
    """JPEG: segments by length up to the scan, then data to the end mark."""
    b = v.b

    def step(p: int) -> tuple[int | None, int | None]:
        if p + 4 > len(b) or b[p] != 0xFF:
            return None, None
        size = int.from_bytes(b[p + 2 : p + 4], "big")
        if size < 2:
            return None, None
        if b[p + 1] != 0xDA:
            return p + 2 + size, None
        end = v.find(b"\xff\xd9", p + 2 + size)
        return None, end + 2 if end >= 0 else None

    end = v.walk("jpeg", at + 2, step, lambda own, rest: own if own is not None else rest)
    return ("image/jpeg", end) if end else None


def _gif(v: Scan, at: int) -> tuple[str, int] | None:
    """GIF: the screen descriptor, then blocks of sub-blocks to the trailer."""
    b = v.b
    if at + 13 > len(b):
        return None

    def step(p: int) -> tuple[int | None, int | None]:
        if p >= len(b):
            return None, None
        kind = b[p]
        if kind == 0x3B:
            return None, p + 1
        if kind == 0x21:
            return blocks(p + 2), None
        if kind == 0x2C and p + 10 <= len(b):
            return blocks(p + 11 + (3 << ((b[p + 9] & 7) + 1) if b[p + 9] & 0x80 else 0)), None
        return None, None

    def blocks(p: int) -> int:
        return v.walk("gif blocks", p, lambda q: (q + 1 + b[q], None) if q < len(b) and b[q] else (None, q + 1), lambda own, rest: own if own is not None else rest)

    p = at + 13 + (3 << ((b[at + 10] & 7) + 1) if b[at + 10] & 0x80 else 0)
    end = v.walk("gif", p, step, lambda own, rest: own if own is not None else rest)
    return ("image/gif", end) if end else None


def _pdf(v: Scan, at: int) -> tuple[str, int] | None:
    """PDF: a version, an object, a cross-reference start and the last end mark before another PDF's header.

    Linearised files and saved changes have several end marks.  A header before the first
    end mark, as of an attachment, doesn't end the file.
    """
    b = v.b
    if not (b[at + 5 : at + 6].isdigit() and b[at + 6 : at + 7] == b"."):
        return None
    start = v.find(b"startxref", at)
    thing = v.find(b" obj", at)
    end = v.find(b"%%EOF", start) if start >= 0 and 0 <= thing <= start - 4 else -1
    if end < 0:
        return None
    following = v.find(b"%PDF-", end)
    return "application/pdf", v.last(b"%%EOF", end, following if following >= 0 else len(b)) + 5


def _zip(v: Scan, at: int) -> tuple[str, int] | None:
    """ZIP: the first end record whose directory lies where it says; those of stored archives inside don't fit."""
    end = v.archives().get(at)
    return ("application/zip", end) if end else None


def _gzip(v: Scan, at: int) -> tuple[str, int] | None:
    """GZIP: a stream that inflates to its checksum; it is read, and the output dropped, piece by piece."""
    b = v.b
    if at + 10 > len(b) or b[at + 3] & 0xE0:
        return None
    d, p, view = zlib.decompressobj(31), at, memoryview(b)
    try:
        while p < len(b) and not d.eof:
            piece = view[p : p + (1 << 14)]
            p += len(piece)
            d.decompress(piece, 1 << 20)
            while d.unconsumed_tail and not d.eof:
                d.decompress(d.unconsumed_tail, 1 << 20)
    except zlib.error:
        return None
    return ("application/gzip", p - len(d.unused_data)) if d.eof else None


def _ogg(v: Scan, at: int) -> tuple[str, int] | None:
    """OGG: pages that follow on each other, from a first page to a last one."""
    b = v.b
    if at + 27 > len(b) or not b[at + 5] & 2:
        return None

    def step(p: int) -> tuple[int | None, int | None]:
        if b[p : p + 5] != b"OggS\0" or p + 27 > len(b):
            return None, None
        table_end = p + 27 + b[p + 26]
        end = table_end + sum(b[p + 27 : table_end])
        if table_end > len(b) or end > len(b):
            return None, None
        return (None, end) if b[p + 5] & 4 else (end, None)

    end = v.walk("ogg", at, step, lambda own, rest: own if own is not None else rest)
    return ("audio/ogg", end) if end else None


def _flac(v: Scan, at: int) -> tuple[str, int] | None:
    """FLAC: metadata blocks, the stream info first; its frames have no stated length and run to the end."""
    b = v.b
    if at + 8 > len(b) or b[at + 4] & 0x7F or int.from_bytes(b[at + 5 : at + 8], "big") != 34:
        return None

    def step(p: int) -> tuple[int | None, int | None]:
        end = p + 4 + int.from_bytes(b[p + 1 : p + 4], "big")
        if p + 4 > len(b) or end > len(b):
            return None, None
        if b[p] & 0x80:
            return None, len(b) if b[end : end + 1] == b"\xff" else None
        return end, None

    end = v.walk("flac", at + 4, step, lambda own, rest: own if own is not None else rest)
    return ("audio/flac", end) if end else None


def _bmp(v: Scan, at: int) -> tuple[str, int] | None:
    """BMP: a file size that fits, zero reserved bytes, a known header and one plane."""
    b = v.b
    if at + 30 > len(b):
        return None
    size, reserved, offset, header = struct.unpack_from("<IIII", b, at + 2)
    sound = reserved == 0 and header in (40, 52, 56, 108, 124) and 14 + header <= offset <= size and at + size <= len(b) and b[at + 26 : at + 28] == b"\1\0"
    return ("image/bmp", at + size) if sound else None


def _mp4(v: Scan, at: int) -> tuple[str, int] | None:
    """MP4: boxes by length, of 64 bits where it is 1 and to the end where it is 0, with moov among them."""
    b = v.b

    def step(p: int) -> tuple[int | None, tuple[int, bool] | None]:
        if p + 8 > len(b):
            return None, None
        size, name, head = int.from_bytes(b[p : p + 4], "big"), b[p + 4 : p + 8], 8
        if size == 1 and p + 16 <= len(b):
            size, head = int.from_bytes(b[p + 8 : p + 16], "big"), 16
        elif size == 0 and name != b"ftyp":
            size = len(b) - p
        if size < head or p + size > len(b) or not name.isalnum():
            return None, None
        return p + size, (p + size, name == b"moov")

    # Of a chain: where its last box ends, and whether one is moov.
    found = v.walk("mp4", at, step, lambda own, rest: rest if own is None else own if rest is None else (rest[0], own[1] or rest[1]))
    return ("video/mp4", found[0]) if found and found[1] else None


VALIDATORS = {
    "riff": _riff, "image/png": _png, "image/jpeg": _jpeg, "image/gif": _gif, "application/pdf": _pdf, "application/zip": _zip,
    "application/gzip": _gzip, "audio/ogg": _ogg, "audio/flac": _flac, "image/bmp": _bmp, "video/mp4": _mp4,
}


@lru_cache(1)
def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for magic, kind, lead in MAGIC:
        a.add_word(magic.decode("latin-1"), (kind, len(magic) - 1 + lead))
    a.make_automaton()
    return a


def media_in(value: bytes) -> list[tuple[str, int, int]]:
    """The confirmed media as (type, start, end), by start; those inside a medium follow it."""
    found, scan = [], Scan(value)
    for last, (kind, back) in _automaton().iter(value.decode("latin-1")):
        start = last - back
        if start >= 0 and (hit := VALIDATORS[kind](scan, start)):
            found.append((hit[0], start, hit[1]))
    return sorted(set(found), key=lambda m: (m[1], -m[2]))


MEDIUM = StructType([StructField("type", StringType()), StructField("start", LongType()), StructField("end", LongType())])


@F.pandas_udf(ArrayType(MEDIUM))
def _media(values: pd.Series) -> pd.Series:
    return pd.Series([[{"type": t, "start": a, "end": z} for t, a, z in media_in(v)] for v in values], dtype=object)


def sniff(df: DataFrame, *, content_col: str, declared_col: str | None = None, out: str = "media") -> DataFrame:
    """``df`` with a struct ``out``: ``detected``, ``corrected``, ``embedded`` (array of type, start, end).

    ``detected`` is the type of the medium that starts the value; without one it is the
    declared type, or ``application/octet-stream`` where the declared type is one of those
    that this module can confirm or there is none.  ``corrected`` says that it differs from
    the declared type.  Media that start later are ``embedded``, nested ones included.
    Null content is empty content.
    """
    declared = F.lower(F.trim(F.col(declared_col))) if declared_col else F.lit(None).cast("string")
    known = declared.isin("audio/wav", "image/webp", *[k for k in VALIDATORS if k != "riff"])

    def judged(media: Column) -> Column:
        first = F.get(F.filter(media, lambda m: m["start"] == 0), F.lit(0))["type"]
        detected = F.coalesce(first, F.when(~known, declared), F.lit("application/octet-stream"))
        return F.struct(detected.alias("detected"), (~detected.eqNullSafe(declared)).alias("corrected"), F.filter(media, lambda m: m["start"] > 0).alias("embedded"))

    # An array of one, so that the media are found once and need no column of their own.
    return df.withColumn(out, F.transform(F.array(_media(F.coalesce(F.col(content_col), F.lit(b"")))), judged)[0])


def carve(df: DataFrame, *, content_col: str, media_col: str = "media", out: str = "carved") -> DataFrame:
    """A row for each embedded medium: the columns of ``df`` and a struct ``out`` (replaced if it is there) of ``type, start, end, bytes``."""
    cut = lambda m: F.struct(m["type"].alias("type"), m["start"].alias("start"), m["end"].alias("end"), F.substring(F.col(content_col), m["start"].cast("int") + 1, (m["end"] - m["start"]).cast("int")).alias("bytes"))
    return df.select(*[c for c in df.columns if c != out], F.explode(F.transform(f"{media_col}.embedded", cut)).alias(out))


HEADER = struct.Struct("<4sI4s4sIHHIIHH4sI")
RATE = 8000


def wav_of(payload: bytes) -> bytes:
    """A WAVE file of one channel whose 8-bit samples are the payload, zeros added to a positive multiple of 64 bytes."""
    payload += bytes(-len(payload) % 64 if payload else 64)
    return HEADER.pack(b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload)) + payload


def samples_of(wav: bytes) -> bytes:
    """The samples of a WAVE file of one channel and 8 bits, by its chunks."""
    p, end, mono = 12, 8 + int.from_bytes(wav[4:8], "little"), False
    while p + 8 <= end:
        name, size = wav[p : p + 4], int.from_bytes(wav[p + 4 : p + 8], "little")
        if name == b"fmt ":
            mono = struct.unpack_from("<HH", wav, p + 8) == (1, 1) and wav[p + 22 : p + 24] == b"\x08\0"
        if name == b"data" and mono:
            return wav[p + 8 : p + 8 + size]
        p += 8 + size + size % 2
    raise ValueError("no 8-bit samples of one channel")


@F.pandas_udf(BinaryType())
def _as_wav(texts: pd.Series) -> pd.Series:
    return pd.Series([wav_of(t.encode("utf-8", "surrogatepass")) for t in texts], dtype=object)


def text_as_wav(text: Column) -> Column:
    """The UTF-8 bytes of a whole text as a WAVE file; null is empty."""
    return _as_wav(F.coalesce(text, F.lit("")))


FEATURES = StructType([
    StructField("payload_bytes", LongType()), StructField("payload_sha256", StringType()), StructField("tail_crc32", LongType()),
    StructField("media_bytes", LongType()), StructField("media_sha256", StringType()), StructField("signal", StringType()),
])


@F.pandas_udf(FEATURES)
def wav_features(wavs: pd.Series) -> pd.DataFrame:
    """Lengths and digests of the file and its samples; ``signal``: mean, peak and sign changes of the samples."""
    rows = []
    for wav in wavs:
        data = samples_of(wav)
        x = np.frombuffer(data, np.uint8)
        turns = np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128))
        signal = f"mean={x.mean():.3f};peak={x.max()};crossings={turns}"
        rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(wav), hashlib.sha256(wav).hexdigest(), signal))
    return pd.DataFrame(rows, columns=FEATURES.names)


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts stored as WAVE files, read back, sniffed and described; their declared type is plain text."""
    docs = table(spark, sf_dir, "documents")
    files = stored(docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), text_as_wav(F.col("text")).alias("media")), "media")
    seen = sniff(files.withColumn("declared", F.lit("text/plain")), content_col="media", declared_col="declared", out="found")
    seen = seen.withColumn("f", wav_features("media"))
    held = F.transform("found.embedded", lambda m: F.concat(m["type"], F.lit("@"), m["start"].cast("string")))
    feature = F.concat_ws(";", "found.detected", "f.signal", F.concat(F.lit("embedded="), F.array_join(held, ",")))
    columns = [F.col(f"f.{c}") for c in FEATURES.names[:-1]]
    return seen.select("doc_id", "n_bytes", *columns, feature.alias("feature"), F.col("found.corrected").alias("type_corrected"))


QUERIES = {"op3_media_columns": op3_media_columns}
SQL: dict[str, str] = {}
