"""From statements and documents to evidence, stories, issues, scores and exports.

A statement is a row of ``item_id, text``.  Documents are searched for its evidence; what
is derived after that follows fixed rules, and no model is called.  Every step is a
DataFrame of its own, so a chain of steps is one plan until it is stored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimstone.functions import values as V
from claimstone.functions.facts import facts_sql, has_cue, label, needs_review, review_sql, sentences, sentences_sql, supported
from claimstone.functions.text import category, category_sql, match_key, meaning_sql, meaningful_tokens, priority, priority_sql, slug
from claimstone.operators.retrieval import BM25_SQL, bm25_top_k, numbers_sql
from claimstone.session import stored
from claimstone.sources.tables import table


def extract(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", most: int | None = None) -> DataFrame:
    """Statements of documents: their sentences that hold a cue word, numbered from 1, with a label; only the first ``most`` if that is given."""
    found = F.filter(sentences(F.col(text_col)), lambda x: has_cue(x, V.CUES))
    s = docs.select(F.col(id_col).alias("doc_id"), (found if most is None else F.slice(found, 1, most)).alias("s"))
    rows = s.select("doc_id", F.posexplode("s").alias("i", "statement"))
    return rows.select("doc_id", (F.col("i") + 1).alias("number"), "statement", label(F.col("statement")).alias("label"), F.lit(0.9).alias("confidence"))


def requirements(items: DataFrame) -> DataFrame:
    """Statements with what their wording says: label, priority, category, whether they can stand alone."""
    text = F.col("text")
    return items.select(
        "item_id", F.coalesce("text", F.lit("")).alias("text"), label(F.coalesce(text, F.lit(""))).alias("label"), priority(text).alias("priority"), category(text).alias("category"),
        needs_review(text).alias("needs_review"), slug(text, 80).alias("title"))


def evidence(docs: DataFrame, items: DataFrame, hits: int = 3) -> DataFrame:
    """``item_id, doc_id, quote, support, grade``: of each of a statement's best documents the sentence that supports it most.

    Ties go to the shorter and then the earlier sentence.  ``grade``: verified, partial or none.
    """
    best = bm25_top_k(docs, items, hits, doc_id="doc_id", query_id="item_id").select(F.col("query_id").alias("item_id"), "doc_id")
    best = stored(best, "hits")
    found = docs.select("doc_id", F.col("text").alias("doc_text")).join(best.select("doc_id").distinct(), "doc_id", "left_semi")
    parts = found.select("doc_id", F.posexplode(sentences(F.col("doc_text"))).alias("i", "quote")).where(~needs_review(F.col("quote")))
    pairs = parts.join(best, "doc_id").join(items.select("item_id", F.col("text").alias("claim")), "item_id")
    order = F.struct(F.col("support"), (-F.length("quote")).alias("n"), (-F.col("i")).alias("i"))
    top = supported(pairs, "claim", "quote").groupBy("item_id", "doc_id").agg(F.max_by(F.struct("quote", "support"), order).alias("b"))
    grade = F.when(F.col("support") >= V.STRICT_SUPPORT, "verified").when(F.col("support") >= V.PARTIAL_SUPPORT, "partial").otherwise("none")
    return top.select("item_id", "doc_id", "b.quote", "b.support").withColumn("grade", grade)


def grounded(reqs: DataFrame, found: DataFrame) -> DataFrame:
    """Requirements with ``evidence`` (verified quotes), ``groundedness`` (best support, x 0.8 for those to review) and ``duplicate`` (its key is an earlier one's)."""
    proofs = found.groupBy("item_id").agg(F.count_if(F.col("grade") == "verified").alias("evidence"), F.max("support").alias("best"))
    first = F.min("item_id").over(Window.partitionBy("key"))
    own = F.coalesce("best", F.lit(0.0)) * F.when(F.col("needs_review"), 0.8).otherwise(1.0)
    joined = reqs.withColumn("key", match_key(F.col("text"))).withColumn("duplicate", (F.col("key") != "") & (F.col("item_id") > first)).drop("key").join(proofs, "item_id", "left")
    return joined.withColumn("groundedness", F.round(own, 6)).withColumn("evidence", F.coalesce("evidence", F.lit(0))).drop("best")


def stories(reqs: DataFrame) -> DataFrame:
    """One story for each requirement with its criteria: a sentence each that says enough; points by their number and length."""
    criteria = F.filter(sentences(F.col("text")), lambda s: F.size(meaningful_tokens(s)) >= 2)
    n, size = F.size("criteria"), F.size(meaningful_tokens(F.col("text")))
    points = F.when((size <= 6) & (n <= 1), 1).when((size <= 12) & (n <= 1), 2).when((size <= 24) & (n <= 2), 3).when((size <= 45) & (n <= 4), 5).otherwise(8)
    return reqs.withColumn("criteria", criteria).select(F.format_string("story_%d", F.col("item_id")).alias("story_id"), "item_id", "title", "label", "priority", "criteria", points.alias("points"))


def issues(reqs: DataFrame, tales: DataFrame) -> DataFrame:
    """``item_type, item_id, rule, severity`` of everything the gate finds; each rule is a filter."""
    def rule(df: DataFrame, kind: str, name: str, severity: str) -> DataFrame:
        return df.select(F.lit(kind).alias("item_type"), "item_id", F.lit(name).alias("rule"), F.lit(severity).alias("severity"))

    return (
        rule(reqs.where("evidence = 0"), "requirement", "missing_evidence", "high")
        .unionByName(rule(reqs.where("duplicate"), "requirement", "duplicate_requirement", "high"))
        .unionByName(rule(reqs.where("trim(text) = ''"), "requirement", "requirement_empty_text", "high"))
        .unionByName(rule(reqs.where("needs_review"), "requirement", "requirement_incomplete", "medium"))
        .unionByName(rule(tales.where("title = ''"), "story", "story_empty_title", "medium"))
        .unionByName(rule(tales.where("size(criteria) = 0"), "story", "story_missing_acceptance", "medium"))
        .unionByName(rule(tales.where("points = 8"), "story", "story_too_large", "low"))
    )


def excel_rows(reqs: DataFrame, tales: DataFrame, proofs: DataFrame) -> DataFrame:
    """The export of stories with their requirement: texts joined for one cell each."""
    quotes = proofs.where("grade = 'verified'").groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("doc_id", "quote"))).alias("q"))
    joined = tales.join(reqs.select("item_id", "groundedness", "category"), "item_id").join(quotes, "item_id", "left")
    kind = F.when(F.col("label") == "NFR", "Non-Functional").when(F.col("label") == "BR", "Business").otherwise("Functional")
    return joined.select(
        F.format_string("US-%03d", F.col("item_id")).alias("id"), F.format_string("REQ-%03d", F.col("item_id")).alias("requirement_id"), "title", F.array_join("criteria", "; ").alias("acceptance_criteria"), kind.alias("type"),
        "priority", "category", F.round("groundedness", 4).alias("confidence"), F.coalesce(F.array_join(F.transform("q", lambda x: x["quote"]), " | "), F.lit("")).alias("source_quotes"))


def result_json(reqs: DataFrame, tales: DataFrame) -> DataFrame:
    """``item_id, result``: a requirement and its stories as JSON, nulls written."""
    own = tales.groupBy("item_id").agg(F.collect_list(F.struct("story_id", "title", "criteria", "points")).alias("stories"))
    return reqs.join(own, "item_id", "left").select("item_id", F.to_json(F.struct("item_id", "text", "label", "priority", "category", "evidence", "groundedness", "stories"), {"ignoreNullFields": "false"}).alias("result"))


# --- Queries: benchmark items as statements, all documents as their sources --------------------


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    proofs = stored(evidence(docs, items), "evidence")
    reqs = stored(grounded(requirements(items), proofs), "requirements")
    return reqs, proofs, stories(reqs)


def extracted_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "documents"))


def best_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("item_id", "doc_id", F.md5("quote").alias("quote_md5"), "support", "grade")


def requirement_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir)[0].drop("text")


def gate_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    reqs, _, tales = _parts(spark, sf_dir)
    return issues(reqs, tales)


def export_excel_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    reqs, proofs, tales = _parts(spark, sf_dir)
    return excel_rows(reqs, tales, proofs)


def export_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    reqs, _, tales = _parts(spark, sf_dir)
    return result_json(reqs, tales)


def _cue_sql(column: str, cues: list[str]) -> str:
    return f"regexp_matches(lower({column}), '{'|'.join(cues)}')"


def _label_sql(column: str) -> str:
    return f"CASE WHEN {_cue_sql(column, V.RULE_CUES)} THEN 'BR' WHEN {_cue_sql(column, V.QUALITY_CUES)} THEN 'NFR' ELSE 'FR' END"


_KEY = "trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g'))"
_EVIDENCE = f"""
    {BM25_SQL},
    sen AS (SELECT doc_id, generate_subscripts(s, 1) AS i, unnest(s) AS quote FROM (SELECT doc_id, {sentences_sql('text')} AS s FROM documents)),
    pr AS (SELECT b.item_id, sen.doc_id, sen.i, sen.quote, {meaning_sql('b.text')} AS ms, {meaning_sql('sen.quote')} AS mc, {facts_sql('b.text')} AS fs, {facts_sql('sen.quote')} AS fc,
           {numbers_sql('b.text')} AS ns, {numbers_sql('sen.quote')} AS nc
           FROM bm JOIN benchmark b ON b.item_id = bm.query_id JOIN sen ON sen.doc_id = bm.doc_id WHERE bm.rank <= 3 AND NOT {review_sql('sen.quote')}),
    lx AS (SELECT *, len(ns) > 0 AND len(nc) > 0 AND NOT list_has_any(ns, nc) AS apart FROM pr),
    ly AS (SELECT *, CASE WHEN len(ms) = 0 OR len(mc) = 0 OR apart THEN 0 ELSE round(0.75 * len(list_intersect(ms, mc)) / len(ms) + 0.25 * len(list_intersect(ms, mc)) / len(mc), 4) END::DOUBLE AS lexical FROM lx),
    su AS (SELECT *, CASE WHEN len(fs) = 0 OR len(fc) = 0 THEN lexical WHEN apart THEN 0 ELSE round(greatest(lexical, 0.80 * len(list_intersect(fs, fc)) / len(fs) + 0.20 * len(list_intersect(fs, fc)) / len(fc)), 4) END::DOUBLE AS support FROM ly),
    ev AS (SELECT item_id, doc_id, quote, support, CASE WHEN support >= 0.6 THEN 'verified' WHEN support >= 0.25 THEN 'partial' ELSE 'none' END AS grade
           FROM (SELECT *, row_number() OVER (PARTITION BY item_id, doc_id ORDER BY support DESC, length(quote), i) AS rk FROM su) WHERE rk = 1)"""
_REQUIREMENTS = f"""
    {_EVIDENCE},
    px AS (SELECT item_id, count(*) FILTER (WHERE grade = 'verified') AS evidence, max(support) AS best FROM ev GROUP BY item_id),
    rq AS (SELECT item_id, coalesce(text, '') AS text, {_label_sql("coalesce(text, '')")} AS label, {priority_sql('text')} AS priority, {category_sql('text')} AS category, {review_sql("coalesce(text, '')")} AS needs_review,
           left(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 80) AS title, {_KEY} <> '' AND item_id > min(item_id) OVER (PARTITION BY {_KEY}) AS duplicate,
           coalesce(evidence, 0) AS evidence, round(coalesce(best, 0) * CASE WHEN {review_sql("coalesce(text, '')")} THEN 0.8 ELSE 1.0 END, 6)::DOUBLE AS groundedness FROM benchmark LEFT JOIN px USING (item_id)),
    st1 AS (SELECT item_id, title, label, priority, list_filter({sentences_sql('text')}, lambda q: len({meaning_sql('q')}) >= 2) AS criteria, len({meaning_sql('text')}) AS size FROM rq),
    sto AS (SELECT *, CASE WHEN size <= 6 AND len(criteria) <= 1 THEN 1 WHEN size <= 12 AND len(criteria) <= 1 THEN 2 WHEN size <= 24 AND len(criteria) <= 2 THEN 3 WHEN size <= 45 AND len(criteria) <= 4 THEN 5 ELSE 8 END AS points FROM st1),
    iss AS (SELECT 'requirement' AS item_type, item_id, 'missing_evidence' AS rule, 'high' AS severity FROM rq WHERE evidence = 0
        UNION ALL SELECT 'requirement', item_id, 'duplicate_requirement', 'high' FROM rq WHERE duplicate
        UNION ALL SELECT 'requirement', item_id, 'requirement_empty_text', 'high' FROM rq WHERE trim(text, ' ') = ''
        UNION ALL SELECT 'requirement', item_id, 'requirement_incomplete', 'medium' FROM rq WHERE needs_review
        UNION ALL SELECT 'story', item_id, 'story_empty_title', 'medium' FROM sto WHERE title = ''
        UNION ALL SELECT 'story', item_id, 'story_missing_acceptance', 'medium' FROM sto WHERE len(criteria) = 0
        UNION ALL SELECT 'story', item_id, 'story_too_large', 'low' FROM sto WHERE points = 8)"""
SQL = {
    "extracted_statements": f"""WITH s AS (SELECT doc_id, list_filter({sentences_sql('text')}, lambda x: {_cue_sql('x', V.CUES)}) AS s FROM documents),
        x AS (SELECT doc_id, generate_subscripts(s, 1)::INT AS number, unnest(s) AS statement FROM s) SELECT doc_id, number, statement, {_label_sql('statement')} AS label, 0.9::DOUBLE AS confidence FROM x""",
    "best_evidence": f"WITH {_EVIDENCE} SELECT item_id, doc_id, md5(quote) AS quote_md5, support, grade FROM ev",
    "requirement_rows": f"WITH {_REQUIREMENTS} SELECT * EXCLUDE (text) FROM rq",
    "gate_issues": f"WITH {_REQUIREMENTS} SELECT * FROM iss",
    "export_excel_rows": f"""WITH {_REQUIREMENTS},
        qu AS (SELECT item_id, string_agg(quote, ' | ' ORDER BY doc_id, quote) AS q FROM ev WHERE grade = 'verified' GROUP BY item_id)
        SELECT printf('US-%03d', item_id) AS id, printf('REQ-%03d', item_id) AS requirement_id, sto.title, array_to_string(criteria, '; ') AS acceptance_criteria,
        CASE sto.label WHEN 'NFR' THEN 'Non-Functional' WHEN 'BR' THEN 'Business' ELSE 'Functional' END AS type, sto.priority, category, round(groundedness, 4) AS confidence, coalesce(q, '') AS source_quotes
        FROM sto JOIN rq USING (item_id) LEFT JOIN qu USING (item_id)""",
}
QUERIES = {
    "extracted_statements": extracted_statements, "best_evidence": best_evidence, "requirement_rows": requirement_rows, "gate_issues": gate_issues,
    "export_excel_rows": export_excel_rows, "export_json": export_json,
}
