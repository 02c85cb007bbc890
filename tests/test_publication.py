"""Public forms, loose JSON, and job rows."""

import datetime

from pyspark.sql import functions as F

from claimstone.operators import jobs, publication as P


def test_published_issues(spark):
    rows = [
        ("story", 1, "AC_QUALITY", "generic", "low", "b", 1), ("story", 1, "AC_QUALITY", "worse", "high", "a", 2), ("story", 1, "AC_QUALITY", "same", "high", "b", 3), ("story", 2, "COMPLEMENTARY", "x", "high", "c", 4),
        ("requirement", 3, "EVIDENCE_NOT_GROUNDED", "missing_evidence", "high", "d", 5), ("requirement", 4, "other", "other", "low", "", 6),
    ]
    df = spark.createDataFrame(rows, "item_type string, item_id long, cause string, rule string, severity string, details string, ord int")
    got = {(r.item_type, r.item_id): (r.rule, r.severity, r.details) for r in P.published_issues(df).collect()}
    assert got == {("story", 1): ("worse", "high", "b a"), ("requirement", 3): (P.UNVERIFIED, "high", P.UNVERIFIED_DETAILS), ("requirement", 4): ("other", "low", "")}
    first = P.distinct_issues(df, ["item_type", "item_id"], "ord").collect()
    assert {(r.item_id, r.rule) for r in first} == {(1, "generic"), (2, "x"), (3, "missing_evidence"), (4, "other")} and P.distinct_issues(df, ["item_id"], "ord").columns == df.columns


def test_published_citations(spark):
    rows = [(1, "document", "d", "n", "A  b", "c1", 0.2, 1), (1, "document", "d", "n", "a b", "c2", 0.9, 2), (1, "audio", "d", "n", "a", "c1", 0.5, 3), (1, "audio", "d", "n", "a", "c2", 0.5, 4), (2, "document", "d", "n", None, None, 0.1, 5)]
    df = spark.createDataFrame(rows, "req int, source_type string, source_id string, document_name string, quote string, chunk_id string, confidence double, ord int")
    assert sorted((r.req, r.ord, r.quote, r.confidence) for r in P.published_citations(df, "req").collect()) == [(1, 1, "a b", 0.9), (1, 3, "a", 0.5), (1, 4, "a", 0.5), (2, 5, None, 0.1)]


def test_calibrated(spark):
    rows = [(0.8, 0.9, False, 0.87), (0.8, 0.9, True, 0.79), (0.8, None, False, 0.49), (None, 0.5, None, 0.35), (2.0, 1.0, False, 1.0)]
    df = spark.createDataFrame(rows, "e double, s double, r boolean, want double")
    assert all(r.got == r.want for r in df.withColumn("got", P.calibrated(F.col("e"), F.col("s"), F.col("r"))).collect())


def test_sound_json(spark):
    rows = [("{\"a\": 1}", "{\"a\": 1}"), ("```json\n[1, 2]\n```", "[1, 2]"), ("so: {\"a\": \"}\"} end", "{\"a\": \"}\"}"), ("nothing", None), ("{broken", None), (None, None), ("", None)]
    df = spark.createDataFrame(rows, "t string, want string")
    assert [r.got for r in df.withColumn("got", P.sound_json(F.col("t"))).collect()] == [w for _, w in rows]


def test_jira_rows(spark):
    df = spark.createDataFrame([("t", "d", ["a", "b"], "High", ["x"], 3, "REQ-001", ["q", "r"])], "title string, description string, criteria array<string>, priority string, labels array<string>, points int, requirement_id string, quotes array<string>")
    row = P.jira_rows(df).first()
    assert (row.summary, row.acceptance_criteria, row.story_points, row.source_quotes, row.components) == ("t", "a\nb", 3, "q | r", [])


def test_requeued(spark):
    t = datetime.datetime(2026, 1, 1)
    rows = [("a", "FAILED", "f", 1, 50, t, t, t, "x"), ("b", "FAILED", "other", 1, 50, t, t, t, "x"), ("c", "COMPLETED", "f", 1, 100, t, t, t, None), ("d", "CANCELLED", "f", 2, 10, t, None, t, None)]
    df = spark.createDataFrame(rows, "job_id string, status string, fingerprint string, attempt int, progress int, queued_at timestamp, started_at timestamp, ended_at timestamp, error string")
    asked = spark.createDataFrame([(j, "f") for j in "abcdd"], "job_id string, fingerprint string")
    got = {r.job_id: (r.status, r.attempt, r.progress, r.ended_at is None, r.error) for r in jobs.requeued(df, asked, F.lit(t)).collect()}
    assert got == {"a": ("QUEUED", 2, 0, True, None), "b": ("FAILED", 1, 50, False, "x"), "c": ("COMPLETED", 1, 100, False, None), "d": ("QUEUED", 3, 0, True, None)}


def test_progress_and_ids(spark):
    row = spark.range(1).select(jobs.progress_of(F.lit("extract")).alias("a"), jobs.progress_of(F.lit("?")).alias("b"), jobs.valid_job_id(F.lit("a.b-1_")).alias("c"), jobs.valid_job_id(F.lit("a b")).alias("d"), jobs.valid_job_id(F.lit("a\n")).alias("e")).first()
    assert tuple(row) == (45, None, True, False, False)
