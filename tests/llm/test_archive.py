import hashlib

import pytest
from pyspark.sql import functions as F

from claimstone.llm import warc
from claimstone.session import shared_dir
from tests.compare import duck_rows, spark_rows

SCHEMA = "page_id long, url string, html string, digest string, payload long"


def archived(spark, rows):
    root = shared_dir(spark, "warc")
    warc.write_archive(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA), root)
    return root


def test_sql(spark, sf_dir, duck):
    df = warc.op1_warc_archive(spark, sf_dir)
    columns, want = duck_rows(duck, warc.SQL["op1_warc_archive"])
    assert sorted(columns) == sorted(df.columns) and spark_rows(df) == want


def test_rules_and_odd_rows(spark):
    big, small = "é" * 60, "s" * 99
    rows = [(5, "http://a", big), (3, "http://b", big), (9, None, big), (None, "http://n", big), (1, "u", small), (2, "u", small), (4, "u\r\nX: y", None), (6, "u", ""), (3, "http://b", big), (7, "u", "z" * 200_000)]
    got = sorted(tuple(r) for r in warc.read_index(spark, archived(spark, rows)).select(F.coalesce("record_id", F.lit(-1)), "payload_bytes", "record_type", F.coalesce("refers_to", F.lit(-1))).collect())
    want = [(-1, 120, "revisit", 3), (1, 99, "response", -1), (2, 99, "response", -1), (3, 120, "response", -1), (3, 120, "response", -1), (4, 0, "response", -1), (5, 120, "revisit", 3), (6, 0, "response", -1), (7, 200_000, "response", -1), (9, 120, "revisit", 3)]
    assert got == want


def test_records_are_exact(spark):
    page = "<p>ü</p>" * 20
    root = archived(spark, [(1, "http://a/", page), (2, "http://b/", page)])
    assert spark.read.parquet(f"{root}/payloads").count() == 1
    digest, n = hashlib.sha256(page.encode()).hexdigest(), len(page.encode())
    date = "WARC-Date: 1970-01-01T00:00:00Z\r\n"
    first = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:record:1>\r\n{date}WARC-Target-URI: http://a/\r\nWARC-Payload-Digest: sha256:{digest}\r\nContent-Type: text/html\r\nContent-Length: {n}\r\n\r\n{page}\r\n\r\n"
    second = f"WARC/1.1\r\nWARC-Type: revisit\r\nWARC-Record-ID: <urn:record:2>\r\n{date}WARC-Target-URI: http://b/\r\nWARC-Payload-Digest: sha256:{digest}\r\nWARC-Refers-To: <urn:record:1>\r\nWARC-Profile: {warc.PROFILE}\r\nContent-Type: text/html\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    got = {r.record_id: (bytes(r.record), bytes(r.payload)) for r in warc.read_records(spark, root).collect()}
    assert got == {1: (first.encode(), page.encode()), 2: (second.encode(), page.encode())}


def test_damage_is_found(spark):
    root = archived(spark, [(1, "u", "x" * 300)])
    other = shared_dir(spark, "warc")
    spark.read.parquet(f"{root}/payloads").withColumn("payload", F.lit(b"forged")).write.parquet(f"{other}/payloads")
    spark.read.parquet(f"{root}/records").write.parquet(f"{other}/records")
    with pytest.raises(Exception, match="damaged payload"):
        warc.read_index(spark, other).collect()


def test_empty(spark):
    assert warc.read_index(spark, archived(spark, [])).count() == 0
