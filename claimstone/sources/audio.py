"""Lengths of recordings by their RIFF headers, and the windows in which they are heard."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from claimstone.sources.tables import table

# --- Fixed values: seconds of a window and of the overlap of two
WINDOW, OVERLAP = 600.0, 10.0
PCM, EXTENSIBLE = 1, 0xFFFE


def riff_seconds(raw: bytes | None) -> float | None:
    """The length that a WAV file's header declares.

    Chunks are walked from one to the next, each padded to an even size, up to the data.
    0 for no bytes; null for what is no WAV, has other than PCM samples, no format before
    its data, no data, or is cut off in a header.
    """
    if not raw:
        return 0.0
    if len(raw) < 12 or raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        return None
    at, frame, rate = 12, 0, 0
    while at + 8 <= len(raw):
        name, size = raw[at : at + 4], struct.unpack_from("<I", raw, at + 4)[0]
        if name == b"fmt ":
            if size < 16 or at + 24 > len(raw):
                return None
            tag, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", raw, at + 8)
            frame = channels * ((bits + 7) // 8)
            if tag not in (PCM, EXTENSIBLE) or not frame:
                return None
        elif name == b"data":
            return size // frame / rate if frame and rate else None
        at += 8 + size + size % 2
    return None


@F.pandas_udf(DoubleType())
def _seconds(raw: pd.Series) -> pd.Series:
    return pd.Series([riff_seconds(r) for r in raw], dtype="float64")


def seconds(raw: Column) -> Column:
    """Seconds of a recording; 0 for null and empty, null where the header doesn't tell."""
    told = _seconds(F.coalesce(raw, F.lit(b"")))
    return F.when(~F.isnan(told), told)


def windows(length: Column) -> Column:
    """``index, start, end``: windows of WINDOW seconds that overlap by OVERLAP; a rest shorter than the overlap is no window."""
    step = WINDOW - OVERLAP
    starts = F.filter(F.transform(F.sequence(F.lit(0), F.floor(F.greatest(length, F.lit(0.0)) / step).cast("int")), lambda i: F.struct(i.alias("index"), (i * F.lit(step)).alias("start"))), lambda w: (w["start"] < length) & ((w["index"] == 0) | (length - w["start"] >= OVERLAP)))
    return F.transform(F.when(length > 0, starts).otherwise(F.array().cast("array<struct<index:int,start:double>>")), lambda w: F.struct(w["index"].alias("index"), w["start"].alias("start"), F.least(w["start"] + WINDOW, length).alias("end")))


def audio_seconds_of_jobs(files: DataFrame) -> DataFrame:
    """``job_id, seconds, unknown``: what the recordings of a job last together, and how many don't tell; ``files``: ``job_id, content``."""
    told = files.select("job_id", seconds(F.col("content")).alias("x"))
    return told.groupBy("job_id").agg(F.coalesce(F.sum("x"), F.lit(0.0)).alias("seconds"), F.count_if(F.col("x").isNull()).alias("unknown"))


# --- Queries --------------------------------------------------------------------------


def _little(c: Column, size: int) -> Column:
    """A number as bytes, the lowest first."""
    whole = F.lpad(F.hex(c.cast("long")), 2 * size, "0")
    return F.unhex(F.concat(*[F.substr(whole, F.lit(2 * i + 1), F.lit(2)) for i in reversed(range(size))]))


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A header of a recording for each document: 8,000 frames for each 10 characters; some with a chunk of odd size before the data, cut off, of other samples, or no recording."""
    docs = table(spark, sf_dir, "documents")
    n, at = F.coalesce(F.length("text"), F.lit(0)).cast("long"), F.pmod("doc_id", F.lit(9))
    tag = F.when(at == 4, 3).otherwise(1)
    fmt = F.concat(F.lit(b"fmt "), _little(F.lit(16), 4), _little(tag, 2), _little(F.lit(2), 2), _little(F.lit(8000), 4), _little(F.lit(32000), 4), _little(F.lit(4), 2), _little(F.lit(16), 2))
    extra = F.when(at == 2, F.concat(F.lit(b"LIST"), _little(F.lit(3), 4), F.lit(b"abc\0"))).otherwise(F.lit(b""))
    whole = F.concat(F.lit(b"RIFF"), _little(F.lit(0), 4), F.lit(b"WAVE"), fmt, extra, F.lit(b"data"), _little(n * 3200, 4))
    raw = F.when(at == 5, F.substring(whole, 1, 30)).when(at == 6, F.encode(F.lit("ID3 no recording"), "utf-8")).when(at == 7, F.lit(None).cast("binary")).otherwise(whole)
    return docs.select("doc_id", F.coalesce("source", F.lit("")).alias("job_id"), raw.alias("content"))


def audio_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = recordings(spark, sf_dir).select("doc_id", seconds(F.col("content")).alias("seconds"))
    return told.select("doc_id", "seconds", F.explode_outer(windows(F.col("seconds"))).alias("w")).select("doc_id", "seconds", "w.index", "w.start", "w.end")


def audio_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio_seconds_of_jobs(recordings(spark, sf_dir))


_LENGTHS = """r AS (SELECT doc_id, coalesce(source, '') AS job_id, CASE WHEN doc_id % 9 IN (4, 5, 6) THEN NULL WHEN doc_id % 9 = 7 THEN 0 ELSE floor(coalesce(length(text), 0) * 3200 / 4) / 8000 END::DOUBLE AS seconds FROM documents)"""
SQL = {
    "audio_seconds": f"WITH {_LENGTHS} SELECT job_id, coalesce(sum(seconds), 0)::DOUBLE AS seconds, count(*) FILTER (seconds IS NULL) AS unknown FROM r GROUP BY job_id",
    "audio_windows": f"""WITH {_LENGTHS}, w AS (SELECT doc_id, seconds, unnest(range(0, (floor(coalesce(seconds, 0) / 590) + 1)::BIGINT)) AS i FROM r),
        k AS (SELECT doc_id, i FROM w WHERE seconds > 0 AND i * 590 < seconds AND (i = 0 OR seconds - i * 590 >= 10))
        SELECT r.doc_id, r.seconds, k.i::INTEGER AS index, (k.i * 590)::DOUBLE AS start, CASE WHEN k.i IS NOT NULL THEN least(k.i * 590 + 600, r.seconds) END::DOUBLE AS "end" FROM r LEFT JOIN k USING (doc_id)""",
}
QUERIES = {"audio_windows": audio_windows, "audio_seconds": audio_seconds}
