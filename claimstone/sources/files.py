"""Files as rows: what they are by their bytes, and their text."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from claimstone.sources.tables import table

# --- Fixed values: extensions by kind, those that are never read, limits ------------------------
EXTENSIONS = {"pdf": [".pdf"], "docx": [".docx"], "mp3": [".mp3"], "wav": [".wav"], "ogg": [".ogg"], "m4a": [".m4a", ".mp4"], "webm": [".webm"], "text": [".txt", ".md", ".csv", ".json", ".log"]}
NEVER = [".html", ".htm", ".js", ".exe", ".sh", ".bat", ".php"]
MEMBERS, UNPACKED, RATIO = 500, 50 << 20, 100


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, content`` of all files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "content")


@F.pandas_udf(BooleanType())
def _is_docx(contents: pd.Series) -> pd.Series:
    """A zip of few members and sane sizes that holds a document's parts."""

    def sound(data: bytes) -> bool:
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                parts = z.infolist()
        except (zipfile.BadZipFile, ValueError):
            return False
        size = sum(p.file_size for p in parts)
        packed = max(1, sum(p.compress_size for p in parts))
        names = {p.filename for p in parts}
        return len(parts) <= MEMBERS and size <= UNPACKED and not (size > 1 << 20 and size > RATIO * packed) and {"[Content_Types].xml", "word/document.xml"} <= names

    return pd.Series([sound(c) for c in contents])


def is_text(content: Column) -> Column:
    """UTF-8 without a NUL among the first 4096 bytes, and at most 5 % control characters."""
    text = F.try_validate_utf8(content.cast("string"))
    control = F.regexp_count(text, F.lit(r"[\x01-\x08\x0B\x0C\x0E-\x1F]"))
    # In hexadecimal a byte is two digits, so only every other place counts.
    nul = F.regexp_extract(F.hex(F.substring(content, 1, 4096)), "^(?:..)*?(00)", 1) == "00"
    return F.coalesce(text.isNotNull() & ~nul & (control <= 0.05 * F.length(text)), F.lit(False))


def kind(content: Column) -> Column:
    """What a file is by its bytes; the first kind that fits, null for none."""
    head = F.hex(F.substring(content, 1, 1024))
    at = lambda offset, size: F.substring(head, 2 * offset + 1, 2 * size)
    is_zip = at(0, 4) == "504B0304"
    # A file that starts as one of these isn't a PDF, whatever its first KB holds.
    other = at(0, 2).isin("4D5A") | at(0, 4).isin("504B0304", "52494646", "4F676753", "7F454C46", "1A45DFA3") | (at(0, 3) == "494433")
    return (
        F.when(F.length(content) == 0, F.lit(None).cast("string")).when((F.regexp_extract(head, "^(?:..)*?(255044462D)", 1) != "") & ~other, "pdf").when(is_zip, F.when(_is_docx(F.when(is_zip, content).otherwise(F.lit(b""))), "docx"))
        .when((at(0, 3) == "494433") | at(0, 2).isin("FFFB", "FFF3", "FFF2"), "mp3").when((at(0, 4) == "52494646") & (at(8, 4) == "57415645"), "wav").when(at(0, 4) == "4F676753", "ogg")
        .when(at(4, 4) == "66747970", "m4a").when(at(0, 4) == "1A45DFA3", "webm").when(is_text(content), "text")
    )


def inspected(files: DataFrame, *, name_col: str, content_col: str = "content") -> DataFrame:
    """``files`` with ``kind``, ``rejected`` (why, or null), ``sha256`` and ``document_id``."""
    suffix = F.lower(F.regexp_extract(F.col(name_col), r"(\.[^./?#]+)(?:[?#].*)?$", 1))
    fits = F.coalesce(F.array_contains(F.try_element_at(F.create_map(*[x for k, v in EXTENSIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), F.col("kind")), suffix), F.lit(False))
    why = F.when(suffix.isin(NEVER), "blocked extension").when(F.col("kind").isNull(), "unknown content").when((suffix != "") & ~fits, "content is not what the name says")
    content = F.coalesce(F.col(content_col), F.lit(b""))
    return files.withColumn("kind", kind(content)).withColumn("rejected", why).withColumn("sha256", F.sha2(content, 256)).withColumn("document_id", F.concat(F.lit("doc_"), F.left("sha256", F.lit(16))))


def decoded(content: Column) -> Column:
    """The text of bytes: UTF-8, or Latin-1 where they aren't."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))


# --- Queries --------------------------------------------------------------------------


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as files."""
    rows = table(spark, sf_dir, "pages").select("page_id", "url", F.col("html").cast("binary").alias("content"))
    return inspected(rows, name_col="url").select("page_id", "kind", "rejected", "document_id")


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as files of plain text."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.col("text").cast("binary").alias("content"))
    return inspected(rows, name_col="name").select("doc_id", "kind", "rejected", "document_id", F.md5(decoded(F.col("content"))).alias("text_md5"))


SQL = {
    "document_files": r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        k AS (SELECT *, CASE WHEN t = '' THEN NULL WHEN contains(t[1:1024], '%PDF-') AND NOT regexp_matches(t, '^(?:MZ|RIFF|ID3|OggS)') THEN 'pdf' WHEN starts_with(t, 'ID3') THEN 'mp3' WHEN len(regexp_extract_all(t, '[\x01-\x08\x0B\x0C\x0E-\x1F]')) <= 0.05 * length(t) THEN 'text' END AS kind FROM d)
        SELECT doc_id, kind, CASE WHEN kind IS NULL THEN 'unknown content' WHEN kind <> 'text' THEN 'content is not what the name says' END AS rejected, 'doc_' || left(sha256(t), 16) AS document_id, md5(t) AS text_md5 FROM k""",
}
QUERIES = {"page_files": page_files, "document_files": document_files}
