"""The quality score of each scope: how well its requirements, stories and criteria hold together.

Five parts, each no better than its weakest link, a penalty for what the gate found beside
them, and caps for what must not pass as good.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimstone.functions import claims as C
from claimstone.functions import values as V
from claimstone.functions.text import meaningful_tokens
from claimstone.operators.similarity import prior_duplicates
from claimstone.plans import gate
from claimstone.plans.verdicts import cover_pairs, covered, judged, mark, of, pair, to_cover
from claimstone.session import stored

# --- Fixed values: weights of the parts, penalties of issues, and caps
WEIGHTS = {"groundedness": 0.30, "traceability": 0.25, "completeness": 0.15, "criteria_quality": 0.20}
DISTINCTNESS = 0.10
PENALTIES = {"high": 0.15, "medium": 0.05, "low": 0.01}
MOST_PENALTY, WITH_HIGH, WITH_MEDIUM, REPORTED_HIGH, DEGRADED = 0.70, 0.59, 0.79, 0.89, 0.89


def _share(part: Column, whole: Column, none: float) -> Column:
    return F.when(whole > 0, part / F.greatest(whole, F.lit(1))).otherwise(none)


def judged_stories(stories: DataFrame, criteria: DataFrame, requirements: DataFrame, again: DataFrame | None = None) -> DataFrame:
    """``s, id, source_ids``, whether a story is traceable and complete, its criteria, those that sources bear, those that repeat, and the share of clauses that criteria cover."""
    rows = gate.with_criteria(gate.with_requirements(stories, requirements), criteria)
    said = F.transform("ac", lambda c: F.coalesce(c["text"], F.lit("")))
    rows = rows.withColumn("said", said).withColumn("whole", F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit("")), F.array_join("said", " ")))
    rows = stored(rows.withColumns({f"{c}_mark": mark(F.col(c)) for c in ("whole", "texts", "facts", "said")}), "scored-stories")
    each = rows.select("s", "id", "facts", "facts_mark", F.explode("said").alias("text"))
    cover = to_cover(rows)
    pairs = [rows.select(*pair(F.col("whole"), F.col("texts"))), rows.select(*pair(F.col("whole"), F.col("facts"))), each.select(*pair(F.col("text"), F.col("facts"))), cover_pairs(cover)]
    verdicts = judged(reduce(DataFrame.unionByName, (p.distinct() for p in pairs)))
    complete = (C.bare(F.col("title")) != "") & (F.size("ac") >= 1) & (F.coalesce(F.size("source_ids"), F.lit(0)) > 0)
    some = F.exists("texts", lambda t: F.size(meaningful_tokens(t)) >= 3)
    told = rows.select("s", "id", "source_ids", "texts_mark", "said_mark", F.col("whole_mark").alias("t_claim"), F.col("texts_mark").alias("t_sources"), F.col("whole_mark").alias("f_claim"), F.col("facts_mark").alias("f_sources"),
                       (F.size("texts") > 0).alias("linked"), some.alias("some"), complete.alias("complete"), F.size("ac").alias("criteria"))
    told = told.join(of(verdicts, "t"), ["t_claim", "t_sources"]).join(of(verdicts, "f"), ["f_claim", "f_sources"]).join(covered(cover, verdicts), ["texts_mark", "said_mark"])
    bears = (F.col("t.aligned") >= V.ALIGNED) & ~F.col("f.terms") & ~F.col("f.conflicts")
    traceable = F.when(~F.col("linked"), False).when(~F.col("some"), True).otherwise(bears)
    told = told.select("s", "id", "source_ids", traceable.alias("traceable"), "complete", "criteria", "covered")
    each = each.select("s", "id", C.generic_criterion(F.col("text")).alias("generic"), mark(F.col("text")).alias("c_claim"), F.col("facts_mark").alias("c_sources")).join(of(verdicts, "c"), ["c_claim", "c_sources"])
    best, wrong = F.col("c.best"), F.col("c.numbers") | F.col("c.terms") | F.col("c.conflicts") | F.col("c.approval")
    holds = ~F.col("generic") & (best.isNull() | (~wrong & (best >= V.CRITERION_SUPPORT)))
    supported = each.select("s", "id", holds.alias("holds")).groupBy("s", "id").agg(F.count_if("holds").alias("supported"))
    again = (gate.repeated_criteria(rows) if again is None else again).groupBy("s", "id").agg(F.count("*").alias("repeated"))
    return told.join(supported, ["s", "id"], "left").join(again, ["s", "id"], "left").fillna(0, ["supported", "repeated"])


def quality(requirements: DataFrame, stories: DataFrame, criteria: DataFrame, issues: DataFrame, again: DataFrame | None = None, copies: DataFrame | None = None) -> DataFrame:
    """A row for each scope that has a requirement or a story: its score, the parts, and the counts.

    ``issues``: those of the gate and others (``scope, item_type, item_id, rule, severity``);
    ``again`` and ``copies`` as in ``gate.story_issues``.
    Without stories traceability, completeness and the quality of criteria are 0; without
    requirements groundedness is; a part is as good as its weakest link.  A null scope is a
    scope of its own; without requirements and stories there is no row.
    """
    actionable = ~F.arrays_overlap(F.coalesce("labels", F.array().cast("array<string>")), F.array(*map(F.lit, V.SPECIAL_LABELS)))
    r = gate.keyed(requirements).select("scope", "s", "id", actionable.alias("actionable"), (F.coalesce(F.size("evidence"), F.lit(0)) > 0).alias("proved"))
    told = stored(judged_stories(stories, criteria, requirements, again), "judged-stories")
    aligned = told.where("traceable").select("s", F.explode("source_ids").alias("id")).distinct().withColumn("aligned", F.lit(True))
    of_requirements = r.join(aligned, ["s", "id"], "left").groupBy("s").agg(
        F.first("scope").alias("scope"), F.count("*").alias("requirements"), F.count_if("actionable").alias("actionable"), F.count_if(F.col("actionable") & F.col("aligned")).alias("aligned"), F.count_if(F.col("actionable") & F.col("proved")).alias("proved"))
    grounded = gate.keyed(gate.groundedness(requirements)).groupBy("s").agg(F.avg("groundedness").alias("groundedness"))
    repeated = gate.keyed(prior_duplicates(requirements, id_col="id", scope_col="scope")).groupBy("s").agg(F.count("*").alias("repeated_requirements"))
    scope_of = gate.keyed(stories).groupBy("s").agg(F.first("scope").alias("story_scope"))
    copies = (gate.repeated_stories(stories) if copies is None else copies).groupBy("s").agg(F.count("*").alias("repeated_stories"))
    of_stories = told.groupBy("s").agg(
        F.count("*").alias("stories"), F.count_if("traceable").alias("traceable"), F.count_if("complete").alias("complete"), F.sum("criteria").alias("criteria"), F.sum("supported").alias("supported"), F.sum("repeated").alias("repeated"), F.avg("covered").alias("covered"))
    cost = gate.keyed(gate.penalties(issues)).drop("scope")
    q = of_requirements.join(of_stories, "s", "full").join(scope_of, "s", "left").join(grounded, "s", "left").join(repeated, "s", "left").join(copies, "s", "left").join(cost, "s", "left")
    counts = ["requirements", "actionable", "aligned", "proved", "stories", "traceable", "complete", "criteria", "supported", "repeated", "repeated_requirements", "repeated_stories", "high", "medium", "low", "reported"]
    q = q.withColumn("scope", F.coalesce("scope", "story_scope")).fillna(0, counts).fillna(0.0, ["groundedness", "covered"]).fillna(False, ["degraded"])
    c = {n: F.col(n) for n in counts}
    some = c["stories"] > 0
    traceability = F.when(some, F.least(_share(c["traceable"], c["stories"], 0.0), _share(c["aligned"], c["actionable"], 1.0), _share(c["proved"], c["actionable"], 1.0))).otherwise(0.0)
    of_criteria = F.when(c["criteria"] > 0, F.least(_share(c["supported"], c["criteria"], 0.0), F.col("covered"), _share(c["criteria"] - c["repeated"], c["criteria"], 0.0))).otherwise(0.0)
    risk = F.greatest(_share(c["repeated_stories"], c["stories"], 0.0), _share(c["repeated_requirements"], c["requirements"], 0.0))
    q = q.withColumns({"traceability": traceability, "completeness": _share(c["complete"], c["stories"], 0.0), "criteria_quality": of_criteria, "duplicate_risk": risk})
    plain = sum((F.col(n) * w for n, w in WEIGHTS.items()), (1 - F.col("duplicate_risk")) * DISTINCTNESS)
    cut = F.greatest(F.lit(0.0), plain - F.least(F.lit(MOST_PENALTY), sum((c[n] * w for n, w in PENALTIES.items()), F.lit(0.0))))
    capped = F.when(c["high"] > 0, F.least(cut, F.lit(WITH_HIGH))).when(c["medium"] > 0, F.least(cut, F.lit(WITH_MEDIUM))).otherwise(cut)
    capped = F.when(c["reported"] > 0, F.least(capped, F.lit(REPORTED_HIGH))).otherwise(capped)
    q = q.withColumn("overall", F.when(F.col("degraded"), F.least(capped, F.lit(DEGRADED))).otherwise(capped))
    parts = ["overall", "traceability", "groundedness", "completeness", "criteria_quality", "duplicate_risk"]
    return stored(q.select("scope", *[F.round(n, 4).alias(n) for n in parts], "requirements", "stories", F.col("reported").alias("high_issues")), "scores")


# --- Queries --------------------------------------------------------------------------


def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of each scope, its gate's issues among them."""
    requirements, stories, criteria, coverages = gate.tables(spark, sf_dir)
    rows = gate.with_criteria(gate.with_requirements(stories, requirements), criteria)
    again, copies = stored(gate.repeated_criteria(rows), "repeated-criteria"), stored(gate.repeated_stories(stories), "repeated-stories")
    return quality(requirements, stories, criteria, stored(gate.all_issues(requirements, stories, criteria, coverages, again, copies), "issues"), again, copies)


def repeated_story_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of stories worded by the documents' first sentences, in scopes by source, those that repeat an earlier one that stays."""
    docs = gate.table(spark, sf_dir, "documents")
    first = F.split(F.btrim(F.coalesce("text", F.lit("")), F.lit(" \t\r\n")), r"[.!?]\s+|\n", 2)[0]
    return gate.repeated_stories(docs.select(F.col("source").alias("scope"), F.col("doc_id").alias("id"), F.lit("").alias("title"), first.alias("description"))).select(F.get_json_object("s", "$.scope").alias("scope"), "id")


QUERIES = {"quality_scores": quality_scores, "repeated_story_rows": repeated_story_rows}
SQL: dict[str, str] = {}
