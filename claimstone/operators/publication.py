"""What leaves the engine: issues and citations in their public form, calibrated confidence, loose JSON made sound."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from claimstone.sources.tables import table

# --- Fixed values: what unverified evidence is called in public ---------------------------
UNVERIFIED, UNVERIFIED_DETAILS = "missing_verified_evidence", "Requirement evidence could not be verified against the uploaded sources."


def distinct_issues(issues: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first issue, by ``order``, of those with equal ``keys``."""
    rest = [c for c in issues.columns if c not in keys]
    return issues.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("r")).select(*[F.col(f"r.{c}").alias(c) if c in rest else F.col(c) for c in issues.columns])


def published_issues(issues: DataFrame) -> DataFrame:
    """One issue for each item and cause of ``item_type, item_id, cause, rule, severity, details, ord``.

    It has the rule of the first most severe one and all different details in order; those
    of complementary statements go, and unverified evidence is told in fixed words.
    """
    rank = F.array_position(F.array(*map(F.lit, ["low", "medium", "high"])), F.col("severity"))
    open_issues = issues.where("cause <> 'COMPLEMENTARY'")
    worst = open_issues.groupBy("item_type", "item_id", "cause").agg(F.max_by(F.struct("rule", "severity"), F.struct(rank.alias("rank"), (-F.col("ord")).alias("first"))).alias("w"))
    told = open_issues.where("details <> ''").groupBy("item_type", "item_id", "cause", "details").agg(F.min("ord").alias("at"))
    told = told.groupBy("item_type", "item_id", "cause").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "details"))), lambda x: x["details"]), " ").alias("details"))
    fixed = (F.col("cause") == "EVIDENCE_NOT_GROUNDED") & (F.col("w.severity") == "high")
    return worst.join(told, ["item_type", "item_id", "cause"], "left").select(
        "item_type", "item_id", F.when(fixed, UNVERIFIED).otherwise(F.col("w.rule")).alias("rule"), "w.severity", F.when(fixed, UNVERIFIED_DETAILS).otherwise(F.coalesce("details", F.lit(""))).alias("details"))


def published_citations(citations: DataFrame, owner: str) -> DataFrame:
    """Of an owner's citations (``source_type, source_id, document_name, quote, chunk_id, confidence, ord``) one of those that say the same, the surest; it takes the place of the first.

    Quotes are equal but for case and white space; those of recordings differ by their chunk.
    """
    said = F.trim(F.lower(F.regexp_replace(F.coalesce("quote", F.lit("")), r"\s+", " ")))
    chunk = F.when(F.col("source_type") == "audio", F.col("chunk_id"))
    keys = [owner, "source_type", "source_id", "document_name", "_said", "_chunk"]
    rest = ["quote", "chunk_id", "confidence"]
    best = F.max_by(F.struct(*rest), F.struct("confidence", (-F.col("ord")).alias("first")))
    grouped = citations.withColumn("_said", said).withColumn("_chunk", chunk).groupBy(*keys).agg(best.alias("b"), F.min("ord").alias("ord"))
    return grouped.select(*keys[:4], *[F.col(f"b.{c}") for c in rest], "ord")


def calibrated(extraction: Column, strongest: Column, needs_review: Column) -> Column:
    """Confidence in public: 0.30 of the extraction's and 0.70 of the strongest citation's, at most 0.79 for what needs a review; without a citation (null) at most 0.49."""
    own = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(extraction, F.lit(0.0))))
    both = 0.30 * own + 0.70 * strongest
    capped = F.when(F.coalesce(needs_review, F.lit(False)), F.least(both, F.lit(0.79))).otherwise(both)
    return F.round(F.when(strongest.isNull(), F.least(own, F.lit(0.49))).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), capped))), 4)


def jira_rows(stories: DataFrame) -> DataFrame:
    """The import rows of stories (``title, description, criteria, priority, labels, points, requirement_id, quotes``)."""
    return stories.select(
        F.lit("Story").alias("issue_type"), F.col("title").alias("summary"), "description", F.array_join("criteria", "\n").alias("acceptance_criteria"), "priority", "labels", F.array().cast("array<string>").alias("components"),
        F.lit("").alias("epic_name"), F.col("points").alias("story_points"), F.col("requirement_id").alias("source_requirement_id"), F.array_join("quotes", " | ").alias("source_quotes"))


# --- Loose JSON -----------------------------------------------------------------------


def first_block(text: str | None) -> str | None:
    """The first bracketed block that closes, brackets in strings aside."""
    text = text or ""
    start = min((i for i in (text.find("{"), text.find("[")) if i >= 0), default=-1)
    if start < 0:
        return None
    try:  # the decoder reads one sound value and says where it ends
        return text[start : json.JSONDecoder(strict=False).raw_decode(text, start)[1]]
    except (json.JSONDecodeError, RecursionError):
        return None


@F.pandas_udf(StringType())
def _blocks(texts: pd.Series) -> pd.Series:
    return texts.map(first_block)


def sound_json(text: Column) -> Column:
    """The JSON value in a model's answer, as text: all of it without a code fence, or its first sound block; null if there is none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\r\n"))
    unfenced = F.btrim(F.regexp_replace(F.regexp_replace(bare, r"^```[^\n]*\n?", ""), r"\n?```[^\n]*$", ""), F.lit(" \t\r\n"))
    clean = F.when(bare.startswith("```"), unfenced).otherwise(bare)
    whole = F.when(F.try_parse_json(clean).isNotNull(), clean)
    return F.coalesce(whole, _blocks(F.when(whole.isNull(), clean)))


# --- Queries --------------------------------------------------------------------------


def repaired_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as answers in three loose forms, read back."""
    o = table(spark, sf_dir, "orders")
    value = F.to_json(F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("priority"), F.concat(F.lit('a "brace" } in '), F.col("o_orderstatus")).alias("note")))
    answer = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("```json\n"), value, F.lit("\n```"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("Here it is: "), value, F.lit(" Anything else?"))).otherwise(value)
    read = o.select("o_orderkey", F.from_json(sound_json(answer), "key long, priority string, note string").alias("j"))
    return read.select("o_orderkey", "j.key", "j.priority", F.md5("j.note").alias("note_md5"))


def calibrated_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' discounts and taxes as the confidence of extractions and citations."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max(F.when(F.col("l_returnflag") != "N", F.round(F.col("l_discount") * 10, 2).cast("double"))).alias("strongest"), F.max(F.round(F.col("l_tax") * 12, 2).cast("double")).alias("own"))
    return li.select("l_orderkey", calibrated(F.col("own"), F.col("strongest"), F.col("l_orderkey") % 3 == 0).alias("confidence"))


SQL = {
    "repaired_json": """SELECT o_orderkey, o_orderkey AS key, o_orderpriority AS priority, md5('a "brace" } in ' || o_orderstatus) AS note_md5 FROM orders""",
    "calibrated_requirements": """WITH g AS (SELECT l_orderkey, max(round(l_discount * 10, 2)) FILTER (WHERE l_returnflag <> 'N')::DOUBLE AS s, greatest(0, least(1, max(round(l_tax * 12, 2))))::DOUBLE AS o FROM lineitem GROUP BY l_orderkey),
        b AS (SELECT *, 0.30::DOUBLE * o + 0.70::DOUBLE * s AS v FROM g)
        SELECT l_orderkey, round(CASE WHEN s IS NULL THEN least(o, 0.49::DOUBLE) ELSE least(1::DOUBLE, CASE WHEN l_orderkey % 3 = 0 THEN least(v, 0.79::DOUBLE) ELSE v END) END, 4)::DOUBLE AS confidence FROM b""",
}
QUERIES = {"repaired_json": repaired_json, "calibrated_requirements": calibrated_requirements}
