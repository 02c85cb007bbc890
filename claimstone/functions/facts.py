"""Facts of statements: their tokens, support by others, and clauses that can't stand alone."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimstone.functions import values as V
from claimstone.functions.text import meaningful_tokens, numbers, strings
from claimstone.sources.tables import table


def _map(values: dict[str, str]) -> Column:
    """A constant, written as one literal so that plans stay small."""
    return F.from_json(F.lit(json.dumps(values)), "map<string,string>")


def stem(token: Column) -> Column:
    """A word without a frequent English ending, if enough of it is left."""
    n = F.length(token)
    cut = lambda k: F.left(token, n - k)
    return (
        F.when((n > 5) & token.endswith("ing"), cut(3)).when((n > 4) & token.endswith("ied"), F.concat(cut(3), F.lit("y"))).when((n > 4) & token.endswith("ed"), cut(2))
        .when((n > 4) & token.endswith("es"), cut(2)).when((n > 3) & token.endswith("s"), cut(1)).otherwise(token)
    )


def named(stemmed: Column) -> Column:
    """The one name of a stem and its synonyms."""
    return F.coalesce(F.try_element_at(_map(V.FACT_ALIASES), stemmed), stemmed)


def fact_tokens(text: Column) -> Column:
    """The distinct fact tokens: stems by one name for synonyms, without scaffolding; units written out beside their number."""
    low = F.lower(F.coalesce(text, F.lit("")))
    plain = F.array_except(F.regexp_extract_all(low, F.lit("([a-z0-9]{2,})"), F.lit(1)), strings(V.FACT_SCAFFOLDING))
    plain = F.transform(plain, lambda t: named(stem(t)))
    compact = F.regexp_extract_all(low, F.lit(f"({V.COMPACT})"), F.lit(1))
    amounts = F.transform(compact, lambda c: F.regexp_extract(c, r"^\d+(?:\.\d+)?", 0))
    units = F.transform(compact, lambda c: F.try_element_at(_map(V.UNITS), F.regexp_extract(c, "[a-z]+$", 0)))
    factor = F.when(low.rlike(r"\bmulti[-\s]+factor\s+authentication\b"), F.array(F.lit("authentication"))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(plain, amounts, units, factor))


def _share(shared: Column, whole: Column) -> Column:
    return shared / F.greatest(F.size(whole), F.lit(1))


def supported(df: DataFrame, source: str, candidate: str) -> DataFrame:
    """``df`` with ``lexical``, ``support`` and ``coverage`` of the text ``candidate`` by ``source``.

    ``lexical``: 0.75 recall + 0.25 precision of meaningful tokens.  ``support``: the larger
    of it and 0.80 recall + 0.20 precision of fact tokens; ``lexical`` alone if one side has
    no fact.  Both are 0 if the two have numbers and none in common.  ``coverage``: the share
    of the source's facts, modals aside, in the candidate; 1 if it has none.
    """
    s, c = F.col(source), F.col(candidate)
    df = df.withColumns({"_ms": meaningful_tokens(s), "_mc": meaningful_tokens(c), "_fs": fact_tokens(s), "_fc": fact_tokens(c), "_ns": numbers(s), "_nc": numbers(c)})
    apart = (F.size("_ns") > 0) & (F.size("_nc") > 0) & ~F.arrays_overlap("_ns", "_nc")
    words = F.size(F.array_intersect("_ms", "_mc"))
    lexical = F.when((F.size("_ms") == 0) | (F.size("_mc") == 0) | apart, 0.0).otherwise(F.round(0.75 * _share(words, F.col("_ms")) + 0.25 * _share(words, F.col("_mc")), 4))
    facts = F.size(F.array_intersect("_fs", "_fc"))
    none = (F.size("_fs") == 0) | (F.size("_fc") == 0)
    score = F.when(none, F.col("lexical")).when(apart, 0.0).otherwise(F.round(F.greatest("lexical", 0.80 * _share(facts, F.col("_fs")) + 0.20 * _share(facts, F.col("_fc"))), 4))
    material = F.array_except("_fs", strings(V.MODALS))
    coverage = F.when(F.size(material) == 0, 1.0).otherwise(F.round(_share(F.size(F.array_intersect(material, F.col("_fc"))), material), 4))
    df = df.withColumn("lexical", lexical)
    return df.withColumn("support", score).withColumn("coverage", coverage).drop("_ms", "_mc", "_fs", "_fc", "_ns", "_nc")


def needs_review(text: Column) -> Column:
    """Whether a clause can't stand alone: short, led by a conjunction or a pronoun, ending in a preposition, or a heading."""
    compact = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"\s+", " ")
    bare = F.btrim(F.lower(compact), F.lit(" .;:,"))
    return (F.length(compact) < 8) | (bare == "") | bare.rlike(V.LEADING) | bare.rlike(V.DANGLING) | bare.rlike(V.PRONOUN) | compact.rlike(V.HEADING)


def sentences(text: Column) -> Column:
    """The sentences of a text: cut after . ! ? and white space; bare, none empty."""
    parts = F.split(F.trim(F.coalesce(text, F.lit(""))), r"(?<=[.!?])\s+")
    return F.filter(F.transform(parts, lambda p: F.btrim(p, F.lit(" \t\n\r"))), lambda p: p != "")


def has_cue(text: Column, cues: list[str]) -> Column:
    return F.lower(text).rlike("|".join(map(re.escape, cues)))


def label(text: Column) -> Column:
    """Business rule, quality attribute or function, by cue words, in this order."""
    return F.when(has_cue(text, V.RULE_CUES), "BR").when(has_cue(text, V.QUALITY_CUES), "NFR").otherwise("FR")


def numeric_values(text: Column) -> Column:
    """Distinct numbers by value: thousands separators and trailing zeros don't count."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\b((?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?)\b"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda n: F.regexp_replace(F.regexp_replace(F.regexp_replace(n, ",", ""), r"(\.\d*?)0+$", "$1"), r"\.$", "")))


# --- Queries --------------------------------------------------------------------------


def fact_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", fact_tokens(F.col("text")).alias("f"))
    return docs.select("doc_id", F.size("f").alias("facts"), F.md5(F.array_join(F.array_sort("f"), " ")).alias("facts_md5"))


def reviewed_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each source: how many sentences can't stand alone, and how many deny something."""
    s = table(spark, sf_dir, "documents").select("source", F.explode(sentences(F.col("text"))).alias("s"))
    return s.groupBy("source").agg(F.count("*").alias("sentences"), F.count_if(needs_review(F.col("s"))).alias("for_review"), F.count_if(F.col("s").rlike(V.NEGATION)).alias("negative"))


def unsupported_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of a conversation's answers that none of its questions has."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "role", F.explode(numeric_values(F.col("text"))).alias("n"))
    asked = turns.where("role = 'user'").select("conv_id", "n").distinct()
    told = turns.where("role = 'assistant'").select("conv_id", "n").distinct()
    return told.join(asked, ["conv_id", "n"], "left_anti").groupBy("conv_id").agg(F.count("*").alias("unsupported"))


def facts_sql(column: str) -> str:
    """DuckDB's expression for fact_tokens()."""
    scaffolding = ", ".join(f"'{w}'" for w in V.FACT_SCAFFOLDING)
    aliases = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in V.FACT_ALIASES.items()) + "}"
    units = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in V.UNITS.items()) + "}"
    low = f"lower(coalesce({column}, ''))"
    stemmed = """CASE WHEN len(t) > 5 AND t LIKE '%ing' THEN t[:-4] WHEN len(t) > 4 AND t LIKE '%ied' THEN t[:-4] || 'y' WHEN len(t) > 4 AND t LIKE '%ed' THEN t[:-3]
        WHEN len(t) > 4 AND t LIKE '%es' THEN t[:-3] WHEN len(t) > 3 AND t LIKE '%s' THEN t[:-2] ELSE t END"""
    plain = f"list_filter(regexp_extract_all({low}, '[a-z0-9]{{2,}}'), lambda t: NOT list_contains([{scaffolding}], t))"
    named = f"list_transform(list_transform({plain}, lambda t: {stemmed}), lambda s: coalesce({aliases}[s], s))"
    compact = f"regexp_extract_all({low}, '{V.COMPACT}')"
    amounts = rf"list_transform({compact}, lambda c: regexp_extract(c, '^\d+(?:\.\d+)?'))"
    written = f"list_transform({compact}, lambda c: {units}[regexp_extract(c, '[a-z]+$')])"
    factor = rf"CASE WHEN regexp_matches({low}, '\bmulti[-\s]+factor\s+authentication\b') THEN ['authentication'] ELSE []::VARCHAR[] END"
    return f"list_distinct(list_concat(list_concat({named}, {amounts}), list_concat({written}, {factor})))"


def review_sql(s: str) -> str:
    """DuckDB's word boundary knows ASCII letters only, so the ends of words are spelled out."""
    start, end = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"
    leading, pronoun, dangling = V.LEADING.removesuffix(r"\b") + end, V.PRONOUN.removesuffix(r"\b") + end, start + V.DANGLING.removeprefix(r"\b")
    compact = rf"regexp_replace(trim({s}, ' '), '\s+', ' ', 'g')"
    bare = f"trim(lower({compact}), ' .;:,')"
    return f"(length({compact}) < 8 OR {bare} = '' OR regexp_matches({bare}, '{leading}') OR regexp_matches({bare}, '{dangling}') OR regexp_matches({bare}, '{pronoun}') OR regexp_matches({compact}, '{V.HEADING}'))"


#: Sentences without look-behind: a mark after each end of a sentence, and a cut at the marks.
def sentences_sql(column: str) -> str:
    marked = rf"regexp_replace(trim(coalesce({column}, ''), ' '), '([.!?])\s+', '\1' || chr(1), 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda p: trim(p, ' ' || chr(9) || chr(10) || chr(13))), lambda p: p <> '')"


_NEGATION_SQL = V.NEGATION.replace("'", "''").replace(r"(?i)\b", r"(?i)(?:^|[^\p{L}\p{N}_])").removesuffix(r"\b") + r"(?:$|[^\p{L}\p{N}_])"
_VALUES_SQL = r"list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '\b(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?\b'), lambda n: regexp_replace(regexp_replace(replace(n, ',', ''), '(\.\d*?)0+$', '\1'), '\.$', '')))"
SQL = {
    "fact_counts": f"WITH d AS (SELECT doc_id, {facts_sql('text')} AS f FROM documents) SELECT doc_id, len(f)::INT AS facts, md5(array_to_string(list_sort(f), ' ')) AS facts_md5 FROM d",
    "reviewed_sentences": f"""WITH s AS (SELECT source, unnest({sentences_sql('text')}) AS s FROM documents)
        SELECT source, count(*) AS sentences, count(*) FILTER (WHERE {review_sql('s')}) AS for_review, count(*) FILTER (WHERE regexp_matches(s, '{_NEGATION_SQL}')) AS negative FROM s GROUP BY source""",
    "unsupported_numbers": f"""WITH t AS (SELECT conv_id, role, unnest({_VALUES_SQL}) AS n FROM conversations),
        u AS (SELECT DISTINCT conv_id, n FROM t WHERE role = 'assistant' EXCEPT SELECT conv_id, n FROM t WHERE role = 'user') SELECT conv_id, count(*) AS unsupported FROM u GROUP BY conv_id""",
}
QUERIES = {"fact_counts": fact_counts, "reviewed_sentences": reviewed_sentences, "unsupported_numbers": unsupported_numbers}
