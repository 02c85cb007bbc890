"""Whole results of jobs, replaced by version.

Rows of a table lie below ``root/rows/table/version=N``, dealt and sorted by job, so that
the files' statistics find a job's rows.  Which version of a job counts is said by one
small table, ``root/valid``, whose part for a version is written last: a write that is lost
half-way is not seen, and the next one takes its number and its place.  A job without rows
is named there like any other, so an empty result replaces a full one.  One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimstone.plans import derived
from claimstone.session import shared_dir, stored

VALID = "job_id string, version long"
#: What a result holds: its tables by the field of the result, each field's type.
FIELDS = {
    "requirements": "array<struct<id:string,description:string,actor:string,type:string,labels:array<string>,priority:string,confidence_score:double,deduplication_key:string,source_refs:array<struct<chunk_id:string,quote:string,page:int,confidence_score:double>>>>",
    "user_stories": "array<struct<id:string,requirement_id:string,title:string,user_story:string,priority:string,type:string,deduplication_key:string,acceptance_criteria:array<struct<id:string,text:string,criterion_type:string>>>>",
    "requirement_coverages": "array<struct<requirement_id:string,coverage_type:string,story_ids:array<string>,acceptance_criteria_ids:array<string>,reason:string>>",
    "quality_issues": "array<struct<item_id:string,item_type:string,severity:string,rule_violated:string,details:string>>",
    "warnings": "array<struct<node_name:string,code:string,message:string>>",
    "quality_report": "struct<overall_score:double,traceability_coverage:double,groundedness_score:double,requirement_count:int,story_count:int,high_severity_issue_count:int>",
    "tenant_id": "string", "project_id": "string",
}


def decomposed(results: DataFrame) -> dict[str, DataFrame]:
    """The tables of ``job_id, result`` (JSON): requirements, evidence, stories, criteria, coverages, issues, warnings, reports.

    Missing fields take their defaults; a result that is no JSON object has no row in any.
    """
    r = results.select("job_id", F.from_json("result", ", ".join(f"{n} {t}" for n, t in FIELDS.items())).alias("r")).select("job_id", "r.*")
    of = lambda name: r.select("job_id", "tenant_id", "project_id", F.posexplode(name).alias("place", "x")).where("x is not null")
    text = lambda c, default="": F.coalesce(F.col(c), F.lit(default))
    score = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    requirements, stories = of("requirements"), of("user_stories")
    owner = ["job_id", "tenant_id", "project_id"]
    return {
        "requirements": requirements.select(*owner, text("x.id").alias("requirement_key"), text("x.description").alias("text"), "x.actor", "x.type", F.coalesce("x.labels", F.array().cast("array<string>")).alias("labels"), text("x.priority", "Medium").alias("priority"), score("x.confidence_score").alias("confidence"), text("x.deduplication_key").alias("deduplication_key")),
        "evidence": requirements.select("job_id", text("x.id").alias("requirement_key"), F.explode("x.source_refs").alias("e")).select("job_id", "requirement_key", "e.chunk_id", text("e.quote").alias("quote"), F.col("e.page").alias("page_number"), score("e.confidence_score").alias("confidence")),
        "stories": stories.select(*owner, text("x.id").alias("story_key"), "x.requirement_id", text("x.title").alias("title"), text("x.user_story").alias("description"), text("x.priority", "Medium").alias("priority"), "x.type", text("x.deduplication_key").alias("deduplication_key")),
        "criteria": stories.select("job_id", text("x.id").alias("story_key"), F.explode("x.acceptance_criteria").alias("c")).select("job_id", "story_key", text("c.id").alias("criterion_key"), text("c.text").alias("text"), text("c.criterion_type", "plain").alias("criterion_type")),
        "coverages": of("requirement_coverages").select("job_id", text("x.requirement_id").alias("requirement_id"), text("x.coverage_type").alias("coverage_type"), F.coalesce("x.story_ids", F.array().cast("array<string>")).alias("story_ids"), "x.reason"),
        "issues": of("quality_issues").select("job_id", text("x.item_id").alias("item_id"), "x.item_type", text("x.severity", "low").alias("severity"), text("x.rule_violated").alias("rule"), text("x.details").alias("details")),
        "warnings": of("warnings").select("job_id", "x.node_name", text("x.code").alias("code"), text("x.message").alias("message")),
        "reports": r.where("quality_report is not null").select("job_id", *[F.coalesce(F.col(f"quality_report.{n}"), F.lit(d)).alias(n) for n, d in (("overall_score", 1.0), ("traceability_coverage", 1.0), ("groundedness_score", 1.0), ("requirement_count", 0), ("story_count", 0), ("high_severity_issue_count", 0))]),
    }


def _path(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, path: str) -> list[int]:
    """The versions below a folder whose write was completed."""
    place, files = _path(spark, path)
    found = files.listStatus(place) if files.exists(place) else []
    done = [x.getPath().toString() for x in found if files.exists(_path(spark, f"{x.getPath().toString()}/_SUCCESS")[0])]
    return sorted(int(p.rpartition("version=")[2]) for p in done if "version=" in p)


def valid(spark: SparkSession, root: str) -> DataFrame:
    """``job_id, version``: which version counts of each job."""
    versions = _versions(spark, f"{root}/valid")
    if not versions:
        return spark.createDataFrame([], VALID)
    rows = spark.read.schema("job_id string").option("basePath", f"{root}/valid").parquet(*[f"{root}/valid/version={v}" for v in versions])
    return rows.groupBy("job_id").agg(F.max("version").cast("long").alias("version"))


def replace(tables: dict[str, DataFrame], jobs: DataFrame, root: str, *, files: int = 8) -> int:
    """Make ``tables`` the whole of what is stored about ``jobs`` (``job_id``), and return the version.

    Rows of jobs that aren't among ``jobs`` don't get in.  Every write must name every table.
    """
    spark = jobs.sparkSession
    version = max(_versions(spark, f"{root}/valid"), default=0) + 1
    named = stored(jobs.where("job_id is not null").select(F.col("job_id").cast("string").alias("job_id")).distinct(), "replaced-jobs")
    for name, rows in tables.items():
        own = rows.withColumn("job_id", F.col("job_id").cast("string")).join(named, "job_id", "left_semi")
        own.repartition(files, "job_id").sortWithinPartitions("job_id").write.mode("overwrite").parquet(f"{root}/rows/{name}/version={version}")
    named.repartition(1).write.mode("overwrite").parquet(f"{root}/valid/version={version}")
    return version


def current(spark: SparkSession, root: str, name: str, jobs: DataFrame | None = None) -> DataFrame:
    """The rows of a table that count, of all jobs or of ``jobs`` (``job_id``)."""
    which = valid(spark, root)
    if jobs is not None:
        which = which.join(jobs.select(F.col("job_id").cast("string").alias("job_id")).distinct(), "job_id", "left_semi")
    versions = _versions(spark, f"{root}/rows/{name}")
    rows = spark.read.option("basePath", f"{root}/rows/{name}").parquet(*[f"{root}/rows/{name}/version={v}" for v in versions])
    return rows.withColumn("version", F.col("version").cast("long")).join(which, ["job_id", "version"], "left_semi").drop("version")


def ordered(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``keys`` (``place``, key) with the rows that they name, those that are there, by ``place``."""
    return keys.select("place", key).join(rows, key).orderBy("place")


def compacted(spark: SparkSession, root: str, names: list[str], *, files: int = 8) -> int:
    """Write what counts as one new version, then remove the older ones; readers that began before must be done."""
    jobs = stored(valid(spark, root).select("job_id"), "valid-jobs")
    version = replace({n: current(spark, root, n) for n in names}, jobs, root, files=files)
    for folder in [f"{root}/valid", *[f"{root}/rows/{n}" for n in names]]:
        for old in [v for v in _versions(spark, folder) if v < version]:
            place, fs = _path(spark, f"{folder}/version={old}")
            fs.delete(place, True)
    return version


# --- Queries --------------------------------------------------------------------------


def results_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``job_id, result``: a result for each customer with orders, in JSON."""
    r, s = derived.requirements(spark, sf_dir), derived.stories(spark, sf_dir)
    refs = F.transform("evidence", lambda e: F.struct(e["chunk_id"].alias("chunk_id"), e["quote"].alias("quote"), F.lit(1).alias("page"), e["support_score"].alias("confidence_score")))
    of_r = r.groupBy("scope").agg(F.sort_array(F.collect_list(F.struct(F.col("id").cast("string").alias("id"), F.col("text").alias("description"), "actor", "labels", F.nullif("priority", F.lit("Medium")).alias("priority"), F.col("confidence").alias("confidence_score"), refs.alias("source_refs")))).alias("requirements"))
    ac = F.array(F.struct(F.lit("a1").alias("id"), F.col("description").alias("text")))
    of_s = s.groupBy("scope").agg(F.sort_array(F.collect_list(F.struct(F.col("id").cast("string").alias("id"), "title", F.col("description").alias("user_story"), ac.alias("acceptance_criteria")))).alias("user_stories"))
    whole = of_r.join(of_s, "scope", "left")
    return whole.select(F.col("scope").cast("string").alias("job_id"), F.to_json(F.struct("requirements", "user_stories", F.struct(F.size("requirements").alias("requirement_count")).alias("quality_report"))).alias("result"))


def replaced_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is stored of each job after all were written, every third one again without stories, every fifth by nothing, and the versions compacted."""
    root = shared_dir(spark, "results")
    results = stored(results_of(spark, sf_dir), "results")
    tables = decomposed(results)
    replace(tables, results, root)
    third = results.where("job_id % 3 = 0")
    again = decomposed(third)
    replace(again | {"stories": again["stories"].limit(0), "criteria": again["criteria"].limit(0)}, third, root)
    replace({n: t.limit(0) for n, t in tables.items()}, results.where("job_id % 5 = 0"), root)
    compacted(spark, root, list(tables))
    counts = [current(spark, root, n).groupBy("job_id").agg(F.count("*").alias(n)) for n in ("requirements", "evidence", "stories", "criteria", "reports")]
    out = valid(spark, root).select("job_id")
    for c in counts:
        out = out.join(c, "job_id", "left")
    return out.fillna(0).withColumn("job_id", F.col("job_id").cast("long"))


QUERIES = {"replaced_results": replaced_results}
SQL = {
    "replaced_results": """
        WITH k AS (SELECT o_custkey AS job_id, o_orderkey AS k, job_id % 3 = 0 AS third, job_id % 5 = 0 AS fifth FROM orders)
        SELECT job_id, count(*) FILTER (NOT fifth) AS requirements,
            count(*) FILTER (NOT fifth AND CASE WHEN k % 5 = 1 THEN '' WHEN k % 7 = 3 THEN 'x' WHEN k % 13 = 5 THEN '' ELSE 'x' END <> '') AS evidence,
            count(*) FILTER (NOT fifth AND NOT third AND k % 8 <> 5) AS stories, count(*) FILTER (NOT fifth AND NOT third AND k % 8 <> 5) AS criteria, (NOT bool_or(fifth))::BIGINT AS reports
        FROM k GROUP BY job_id""",
}
