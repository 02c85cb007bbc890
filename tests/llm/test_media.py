import gzip
import hashlib
import io
import struct
import time
import zipfile
import zlib

import pytest

from claimstone.llm import media


def png(body=b"\0\0\0"):
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


def zipped():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "hello")
    return out.getvalue()


GIF = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0\0\0\xff\xff\xff" + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02D\x01\0" + b"\x3b"
JPEG = b"\xff\xd8\xff\xe0\x00\x10JFIF\0\1\1\0\0\1\0\1\0\0\xff\xda\x00\x08\1\1\0\0\x3f\0data\xff\xd9"
BMP = b"BM" + struct.pack("<IIIIiiHH", 58, 0, 54, 40, 1, 1, 1, 24) + bytes(24) + b"\0\0\0\0"
PDF = b"%PDF-1.4\n1 0 obj\nendobj\nstartxref\n9\n%%EOF"
OGG = b"OggS\0\2" + bytes(20) + b"\1\5hello" + b"OggS\0\4" + bytes(20) + b"\1\2ab"
FLAC = b"fLaC" + b"\x80\0\0\x22" + bytes(34) + b"\xff\xf8frames"
MP4 = struct.pack(">I", 16) + b"ftypisom\0\0\0\0" + struct.pack(">I", 8) + b"moov"
WEBP = b"RIFF" + struct.pack("<I", 4 + 8 + 4) + b"WEBPVP8 " + struct.pack("<I", 4) + b"abcd"
ALL = {
    "image/png": png(), "application/zip": zipped(), "image/gif": GIF, "image/jpeg": JPEG, "image/bmp": BMP, "application/pdf": PDF, "audio/ogg": OGG, "audio/wav": media.wav_of(b"x" * 70),
    "application/gzip": gzip.compress(b"hello" * 50), "video/mp4": MP4, "image/webp": WEBP,
}


@pytest.mark.parametrize("kind", ALL)
def test_found_at_its_length(kind):
    data = ALL[kind]
    assert (kind, 0, len(data)) in media.media_in(data)
    assert (kind, 7, 7 + len(data)) in media.media_in(b"leading" + data + b"trailing")


@pytest.mark.parametrize("kind", ALL)
def test_cut_short_is_none(kind):
    assert all(t != kind for t, _, _ in media.media_in(ALL[kind][:-3]))


def test_flac_runs_to_the_end():
    assert media.media_in(FLAC) == [("audio/flac", 0, len(FLAC))]


def test_magic_alone_is_none():
    assert media.media_in(b"BM GIF89a PK\x03\x04 RIFF %PDF-1.4 \x1f\x8b\x08 OggS ID3 \xff\xd8\xff fLaC ftyp") == []


def test_sniff_corrects_and_carves(spark):
    rows = [(1, png(), "image/jpeg"), (2, png(), " IMAGE/PNG"), (3, b"text " + GIF + b" and " + png(), "text/plain"), (4, b"no medium", "image/png"), (5, None, None), (6, b"", "text/plain")]
    df = media.sniff(spark.createDataFrame(rows, "id int, content binary, declared string"), content_col="content", declared_col="declared")
    got = {r.id: (r.media.detected, r.media.corrected) for r in df.collect()}
    assert got == {
        1: ("image/png", True), 2: ("image/png", False), 3: ("text/plain", False), 4: ("application/octet-stream", True), 5: ("application/octet-stream", True), 6: ("text/plain", False),
    }
    carved = [(r.id, r.carved.type, bytes(r.carved.bytes)) for r in media.carve(df, content_col="content").orderBy("carved.start").collect()]
    assert carved == [(3, "image/gif", GIF), (3, "image/png", png())]


def test_texts_as_samples(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in media.op3_media_columns(spark, sf_dir).collect():
        raw = texts[r.doc_id].encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        wav = media.wav_of(raw)
        assert (r.media_bytes, r.media_sha256) == (len(wav), hashlib.sha256(wav).hexdigest())
        assert r.feature.startswith("audio/wav;mean=") and r.type_corrected


@pytest.mark.parametrize("text", ["", "x", "x" * 64, "x" * 65, "é" * 100_000])
def test_round_trip(text):
    data = media.samples_of(media.wav_of(text.encode()))
    assert len(data) % 64 == 0 and len(data) >= 64 and data.rstrip(b"\0") == text.encode()


def test_zip_that_stores_a_zip():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("inner.zip", zipped())
        z.writestr("b.txt", "more")
    data = out.getvalue()
    inner = data.index(b"PK\x03\x04", 4)
    assert media.media_in(b"lead" + data + b"tail")[0] == ("application/zip", 4, 4 + len(data))
    assert ("application/zip", inner, inner + len(zipped())) in media.media_in(data)


def test_pdf_goes_on_to_its_last_end_mark():
    saved = PDF + b"\n2 0 obj\nendobj\nstartxref\n50\n%%EOF"
    assert media.media_in(saved + b"tail") == [("application/pdf", 0, len(saved))]
    assert media.media_in(saved + PDF) == [("application/pdf", 0, len(saved)), ("application/pdf", len(saved), len(saved) + len(PDF))]


def test_mp4_boxes_of_size_0_and_1():
    box = lambda name, body: struct.pack(">I", 8 + len(body)) + name + body
    ftyp, moov = box(b"ftyp", b"isom\0\0\0\0"), box(b"moov", b"")
    wide = struct.pack(">I", 1) + b"mdat" + struct.pack(">Q", 16 + 5) + b"media"
    assert media.media_in(ftyp + wide + moov + b"tail") == [("video/mp4", 0, len(ftyp + wide + moov))]
    last = ftyp + moov + struct.pack(">I", 0) + b"mdatmedia to the end"
    assert media.media_in(last) == [("video/mp4", 0, len(last))]
    assert media.media_in(ftyp + struct.pack(">I", 0) + b"mdat" + moov) == []


def test_columns_keep_their_names(spark):
    rows = [(1, b"text " + GIF, "a", "b", "c", "d")]
    df = media.sniff(spark.createDataFrame(rows, "start int, content binary, media_all string, type string, m string, bytes string"), content_col="content")
    assert df.columns == ["start", "content", "media_all", "type", "m", "bytes", "media"]
    row = media.carve(df, content_col="content").first()
    assert (row.start, row.media_all, row.type, row.m, row.bytes) == (1, "a", "b", "c", "d") and row.carved.start == 5


def test_empty_tables(spark):
    df = media.sniff(spark.createDataFrame([], "content binary"), content_col="content")
    assert df.count() == 0 and media.carve(df, content_col="content").count() == 0


@pytest.mark.parametrize("part", [
    b"PK\x03\x04abc", b"%PDF-1.", b"%PDF-1. obj startxref", b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x02", b"\x1f\x8b\x08\0\0\0\0\0\0\3", b"GIF89a\1\0\1\0\0\0\0",
    b"OggS\0\2" + bytes(20) + b"\0", b"\0\0\0\x08ftyp", b"fLaC\0\0\0\x22" + bytes(34), b"RIFF\xff\0\0\0WAVE",
])
def test_hostile_repeats_take_linear_time(part):
    began = time.process_time()
    media.media_in(part * (560_000 // len(part)))
    assert time.process_time() - began < 4
