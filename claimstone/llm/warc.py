"""Content-addressed WARC archive.

Two Parquet tables hold an archive: ``payloads`` (each distinct payload once, keyed by its
SHA-256) and ``records`` (the exact header block of every record).  A record is its header,
its payload if it is a response, and the closing blank lines; joins put it together again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimstone.session import shared_dir
from claimstone.sources.tables import table

CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _urn(record_id: Column) -> Column:
    return F.concat(F.lit("<urn:record:"), record_id.cast("string"), F.lit(">"))


def _field(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null.  Line ends inside are escaped."""
    safe = F.regexp_replace(F.regexp_replace(value, "\r", "%0D"), "\n", "%0A")
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit(CRLF)), F.lit(""))


def _value(header: Column, name: str) -> Column:
    """The value of a header line; null if there is none."""
    found = F.regexp_extract(header, f"\r\n{name}: ([^\r]*)\r\n", 1)
    return F.when(found != "", found)


def write_archive(
    rows: DataFrame, root: str, *, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html",
    min_revisit_bytes: int = 100, date: str = "1970-01-01T00:00:00Z", content_type: str = "text/html",
) -> None:
    """Archive one record per row below ``root``.

    Of rows with equal payloads of at least ``min_revisit_bytes`` the one with the smallest
    id is a ``response`` and the others are ``revisit`` records that refer to it; all
    smaller payloads are responses.  A null payload is an empty one; a null id sorts last
    and has no record id; a null URI has no header line; rows that repeat the smallest id
    are responses too; other columns are ignored; no rows give two empty tables.

    Payload bytes cross the shuffle at most once for each digest and task; the record side
    moves digests and headers only, and a hot digest joins a stored table, which adaptive
    execution can split.
    """
    spark = rows.sparkSession
    base = rows.select(
        F.col(id_col).cast("long").alias("id"), F.col(uri_col).cast("string").alias("uri"),
        F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    base.groupBy("digest").agg(F.min("id").alias("first_id"), F.first("payload").alias("payload")).write.option("compression", "zstd").parquet(f"{root}/payloads")
    firsts = spark.read.parquet(f"{root}/payloads").select("digest", "first_id")
    again = (F.col("n") >= min_revisit_bytes) & F.col("first_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id"))
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.when(again, "revisit").otherwise("response"), F.lit(CRLF),
        _field("WARC-Record-ID", _urn(F.col("id"))), F.lit(f"WARC-Date: {date}{CRLF}"), _field("WARC-Target-URI", F.col("uri")),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(again, F.concat(_field("WARC-Refers-To", _urn(F.col("first_id"))), F.lit(f"WARC-Profile: {PROFILE}{CRLF}"))).otherwise(""),
        F.lit(f"Content-Type: {content_type}{CRLF}Content-Length: "),
        F.when(again, F.lit(0)).otherwise(F.col("n")).cast("string"), F.lit(CRLF + CRLF),
    )
    heads = base.select("id", "uri", "digest", F.length("payload").cast("long").alias("n"))
    heads.join(firsts, "digest").select(F.col("id").alias("record_id"), header.cast("binary").alias("header")).write.option("compression", "zstd").parquet(f"{root}/records")


def _headers(spark: SparkSession, root: str) -> DataFrame:
    """What the header blocks say."""
    text = F.decode("header", "UTF-8")
    number = lambda name: F.regexp_extract(_value(text, name), r"<urn:record:(-?\d+)>", 1).cast("long")
    return spark.read.parquet(f"{root}/records").select(
        "header", _value(text, "WARC-Type").alias("record_type"), number("WARC-Record-ID").alias("record_id"), number("WARC-Refers-To").alias("refers_to"),
        F.substring_index(_value(text, "WARC-Payload-Digest"), ":", -1).alias("digest"), _value(text, "Content-Length").cast("long").alias("content_length"),
    )


def _payloads(spark: SparkSession, root: str) -> DataFrame:
    """The payloads; reading one whose bytes don't have its digest fails."""
    stored = spark.read.parquet(f"{root}/payloads")
    sound = F.sha2("payload", 256) == F.col("digest")
    return stored.select("payload", F.when(sound, F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("digest")))).alias("digest"))


def read_index(spark: SparkSession, root: str) -> DataFrame:
    """One row per record, from its header and its verified payload.

    A response whose Content-Length isn't that of its payload fails the query.
    """
    sizes = _payloads(spark, root).select("digest", F.length("payload").cast("long").alias("payload_bytes"))
    whole = (F.col("record_type") == "revisit") | (F.col("content_length") == F.col("payload_bytes"))
    return _headers(spark, root).drop("header").join(sizes, "digest").select(
        "record_id", F.when(whole, F.col("payload_bytes")).otherwise(F.raise_error(F.lit("Content-Length differs"))).alias("payload_bytes"),
        F.col("digest").alias("payload_digest"), "record_type", "refers_to",
    )


def read_records(spark: SparkSession, root: str) -> DataFrame:
    """``record_id, record`` (the record's exact bytes) and ``payload``, of every record.

    A revisit's record has no payload of its own; its ``payload`` is that of the response.
    """
    heads = _headers(spark, root)
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return heads.join(_payloads(spark, root), "digest").select("record_id", "record_type", F.concat("header", body, F.lit((CRLF + CRLF).encode())).alias("record"), "payload")


def op1_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive all pages, read the archive back, one row per page."""
    root = shared_dir(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), root)
    return read_index(spark, root).withColumnRenamed("record_id", "page_id")


SQL = {
    "op1_warc_archive": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT payload_digest, min(page_id) AS first_id FROM p GROUP BY payload_digest)
        SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
        FROM p JOIN f USING (payload_digest)""",
}
QUERIES = {"op1_warc_archive": op1_warc_archive}
