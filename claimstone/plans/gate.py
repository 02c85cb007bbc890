"""The quality gate and the score: what is wrong with requirements, stories and coverages, and how good all are together.

Tables are those of ``plans.derived``.  Stories meet their requirements in one join; rules
about wording then look at a story's row, and rules about criteria at one row for each.
What claims and sources make of each other comes from ``plans.verdicts``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimstone.functions import claims as C
from claimstone.functions import values as V
from claimstone.functions.text import meaningful_tokens, priority
from claimstone.operators.selection import repeated, similar_sets
from claimstone.operators.similarity import prior_duplicates
from claimstone.plans import derived
from claimstone.plans.verdicts import PAIR, cover_pairs, covered, judged, mark, of, pair, to_cover
from claimstone.session import stored
from claimstone.sources.tables import table

# --- Fixed values: causes of issues --------------------------------------------------------
CAUSES = {
    "missing_evidence": "EVIDENCE_NOT_GROUNDED", "missing_verified_evidence": "EVIDENCE_NOT_GROUNDED", "evidence_semantic_mismatch": "EVIDENCE_NOT_GROUNDED", "evidence_not_grounded": "EVIDENCE_NOT_GROUNDED",
    "evidence_chunk_mismatch": "EVIDENCE_NOT_GROUNDED", "evidence_document_mismatch": "EVIDENCE_NOT_GROUNDED", "evidence_low_transcription_confidence": "EVIDENCE_NOT_GROUNDED",
    "duplicate_requirement": "DUPLICATE_CONTENT", "duplicate_story": "DUPLICATE_CONTENT", "semantic_conflict_duplicate": "DUPLICATE_CONTENT",
    "acceptance_criterion_unsupported_fact": "AC_QUALITY", "acceptance_criterion_not_source_aligned": "AC_QUALITY", "acceptance_criteria_missing_source_clause": "AC_QUALITY", "generic_acceptance_criteria": "AC_QUALITY", "duplicate_acceptance_criterion": "AC_QUALITY",
    "incorrect_story_requirement_mapping": "STORY_TRACEABILITY", "story_missing_source_ids": "STORY_TRACEABILITY", "story_unsupported_fact": "STORY_TRACEABILITY",
    "story_empty_title": "STORY_COMPLETENESS", "story_missing_acceptance": "STORY_COMPLETENESS", "generation_degraded": "GENERATION_DEGRADED",
}
OWNED = ["EVIDENCE_NOT_GROUNDED", "DUPLICATE_CONTENT", "AC_QUALITY", "STORY_TRACEABILITY", "STORY_COMPLETENESS"]
DIAGNOSTIC = [
    "priority_not_source_supported", "requirement_confidence_invalid", "low_confidence_classification", "requirement_missing_labels", "non_human_story_persona", "story_description_shape",
    "story_missing_evidence_reference", "story_behavior_needs_review", "coverage_bad_story_id", "coverage_bad_requirement_id", "out_of_scope_covered_by_story", "open_question_covered_by_story",
]
LOW_CONFIDENCE = 0.4
#: Of two criteria that repeat each other the smaller one shares so much of its facts at least.
LEAST_HELD = 0.65
TECHNICAL_PERSONAS = ["system", "service", "application", "portal", "workspace", "database", "api"]


def _has(array: str, names: list[str]) -> Column:
    return F.arrays_overlap(F.coalesce(F.col(array), F.array().cast("array<string>")), F.array(*map(F.lit, names)))


def _facts(text: Column, evidence: Column) -> Column:
    """A requirement's quotes; its text where it has none."""
    quotes = F.filter(F.transform(evidence, lambda e: C.bare(e["quote"])), lambda q: q != "")
    own = C.bare(text)
    return F.when(F.size(quotes) > 0, quotes).when(own != "", F.array(own)).otherwise(F.array().cast("array<string>"))


def keyed(df: DataFrame) -> DataFrame:
    """``df`` with ``s``, its scope as a key that is never null; ids are those of a scope."""
    return df.withColumn("s", F.to_json(F.struct("scope")))


def with_requirements(stories: DataFrame, requirements: DataFrame) -> DataFrame:
    """``stories`` with their requirements' ``texts`` (in the order of ``source_ids``; missing ones left out), ``facts``, ``quotes`` and ``first_evidence``: how many quotes the first one has.

    Stories meet requirements of their own scope; of rows that share an id the first by text counts.
    """
    of = keyed(requirements).select("s", F.col("id").alias("rid"), F.coalesce("text", F.lit("")).alias("text"), _facts(F.col("text"), F.col("evidence")).alias("facts"), F.transform(F.coalesce("evidence", F.array().cast(requirements.schema["evidence"].dataType)), lambda e: F.coalesce(e["quote"], F.lit(""))).alias("quotes"))
    of = of.groupBy("s", "rid").agg(F.min(F.struct("text", "facts", "quotes")).alias("r")).select("s", "rid", "r.*")
    pairs = keyed(stories).select("s", "id", F.posexplode("source_ids").alias("i", "rid")).distinct().join(of, ["s", "rid"])
    one = F.struct("i", "text", "facts", "quotes", F.size("quotes").alias("n"))
    rows = pairs.groupBy("s", "id").agg(F.array_sort(F.collect_list(one)).alias("r"))
    first = F.get(F.filter("r", lambda x: x["i"] == 0), F.lit(0))["n"]
    told = rows.select("s", "id", F.transform("r", lambda x: x["text"]).alias("texts"), F.array_distinct(F.flatten(F.transform("r", lambda x: x["facts"]))).alias("facts"), F.flatten(F.transform("r", lambda x: x["quotes"])).alias("quotes"), first.alias("first_evidence"))
    none = F.array().cast("array<string>")
    return keyed(stories).join(told, ["s", "id"], "left").withColumns({"texts": F.coalesce("texts", none), "facts": F.coalesce("facts", none), "quotes": F.coalesce("quotes", none)})


def _found(df: DataFrame, kind: str, rules: list[tuple[str, Column, Column | str]], item: str = "id") -> DataFrame:
    """A row for each rule that a row of ``df`` breaks, from one pass over it."""
    severity = lambda s: s if isinstance(s, Column) else F.lit(s)
    hits = F.array(*[F.when(F.coalesce(why, F.lit(False)), F.struct(F.lit(rule).alias("rule"), severity(how).alias("severity"))) for rule, why, how in rules])
    return df.select("scope", F.lit(kind).alias("item_type"), F.col(item).cast("long").alias("item_id"), F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("h")).select("scope", "item_type", "item_id", "h.rule", "h.severity")


def requirement_issues(requirements: DataFrame) -> DataFrame:
    r = requirements.withColumns({"labels": F.coalesce("labels", F.array().cast("array<string>")), "candidate_labels": F.coalesce("candidate_labels", F.array().cast("array<string>"))})
    special = _has("labels", V.SPECIAL_LABELS) | _has("candidate_labels", V.SPECIAL_LABELS)
    unlabelled = F.size("labels") == 0
    confidence = F.coalesce("classification_confidence", "confidence")
    own = _found(r, "requirement", [
        ("requirement_empty_text", C.bare(F.col("text")) == "", "high"), ("requirement_missing_labels", unlabelled & (F.size("candidate_labels") == 0), "high"), ("requirement_missing_labels", unlabelled & _has("candidate_labels", V.SPECIAL_LABELS), "medium"),
        ("priority_not_source_supported", F.col("priority") != priority(F.col("text")), "medium"), ("requirement_confidence_invalid", confidence.isNull() | (confidence < 0) | (confidence > 1), "medium"),
        ("missing_evidence", ~special & (F.coalesce(F.size("evidence"), F.lit(0)) <= 0), "high"), ("low_confidence_classification", ~special & (F.col("classification_confidence") < LOW_CONFIDENCE), "medium"),
    ])
    enough = r.where(F.size(meaningful_tokens(F.col("text"))) >= 4)
    again = prior_duplicates(enough, id_col="id", scope_col="scope")
    return own.unionByName(again.select("scope", F.lit("requirement").alias("item_type"), F.col("id").alias("item_id"), F.lit("duplicate_requirement").alias("rule"), F.lit("high").alias("severity")))


def with_criteria(stories: DataFrame, criteria: DataFrame) -> DataFrame:
    """``with_requirements`` rows with ``ac``: ``number, criterion_id, text`` of their criteria (``scope, story, number, criterion_id, text``), in order."""
    told = keyed(criteria).groupBy("s", F.col("story").alias("id")).agg(F.array_sort(F.collect_list(F.struct("number", "criterion_id", "text"))).alias("ac"))
    return stories.join(told, ["s", "id"], "left").withColumn("ac", F.coalesce("ac", F.array().cast(told.schema["ac"].dataType)))


def repeated_criteria(stories: DataFrame) -> DataFrame:
    """``s, id, number``: criteria that state the outcome of an earlier one of their story.  ``stories``: with requirements and criteria.

    Criteria with other numbers, other outcomes or a negation more are different.  Where the
    story's requirements have clauses, two repeat each other if their facts are nearly the
    same or one's are in the other's, and they don't each have a fact of the sources that
    the other lacks; without clauses only equal wording or equal measurements count.

    Stories with the same texts and criteria are judged once, and so are criteria of one
    wording.  Others meet by the rarer facts of the smaller: what repeats shares LEAST_HELD
    of them.
    """
    said = F.transform("ac", lambda c: F.struct(c["number"].alias("number"), F.coalesce(c["text"], F.lit("")).alias("text")))
    rows = stories.select("s", "id", "texts", said.alias("said")).withColumn("of", mark(F.struct("texts", "said")))
    rows = stored(rows, "stories-of-criteria")
    told = stored(rows.select("of", "texts", "said").distinct(), "criteria-of-stories")
    each = told.select("of", F.explode("said").alias("c")).select("of", "c.number", "c.text")
    each = stored(each.withColumn("mark", F.md5("text")), "criteria-texts")
    one = each.groupBy("of", "mark").agg(F.min("number").alias("first"), F.first("text").alias("text"))
    wording = stored(each.select("mark", "text").distinct(), "wordings")
    outcome = F.concat(*[F.regexp_count("text", F.lit(p)).cast("boolean").cast("string") for p in (V.POSITIVE_OUTCOME, V.NEGATIVE_OUTCOME)])
    described = wording.select("mark", C.described(F.col("text")).alias("d"), outcome.alias("outcome")).withColumn("numbers", F.array_join(F.array_sort(F.array_distinct("d.numbers")), "|"))
    known = stored(told.select("of", C.all_described(F.flatten(F.transform("texts", C.clauses))).alias("known")), "clauses-of-stories")
    one = one.join(stored(described.where(F.size("d.facts") > 0), "wordings-described"), "mark").join(known, "of")
    nearest = F.array_max(F.transform("known", lambda k, i: F.struct(C.alignment(F.array(k["text"]), F.col("d")).alias("score"), (-i).alias("i"))))
    one = stored(one.withColumn("nearest", nearest).withColumn("node", F.monotonically_increasing_id()), "criteria-judged")
    key = ["of", "numbers", "outcome"]
    flat = stored(one.select(*key, "node", F.size("d.facts").alias("n"), F.explode("d.facts").alias("t")), "criteria-facts")
    often = flat.groupBy(*key, "t").agg(F.count("*").alias("df")).where("df > 1")
    ranked = flat.join(often, [*key, "t"]).withColumn("i", F.row_number().over(Window.partitionBy("node").orderBy("df", "t")) + F.col("n") - F.count("*").over(Window.partitionBy("node")))
    rare = ranked.where(F.col("i") <= F.col("n") - F.ceil(F.col("n") * LEAST_HELD - 1e-9) + 1)
    met = rare.select(*key, "t", F.col("node").alias("a"), F.col("n").alias("na")).join(flat.select(*key, "t", F.col("node").alias("b"), F.col("n").alias("nb")), [*key, "t"]).where("a <> b and nb >= na")
    met = stored(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "criteria-met")
    side = lambda k: one.select(F.col("node").alias(k), F.struct("mark", "first", "text", "d", "nearest", "known", "numbers").alias(f"r{k}"), "of")
    p = met.join(side("a"), "a").join(side("b").drop("of"), "b")
    a, b = F.col("ra"), F.col("rb")
    shared, x, y = F.size(F.array_intersect(a["d"]["facts"], b["d"]["facts"])), F.size(a["d"]["facts"]), F.size(b["d"]["facts"])
    alike, held = shared / (x + y - shared), shared / F.least(x, y)
    measured = (a["numbers"] != "") & (alike >= 0.50 - 1e-9) & (held >= LEAST_HELD - 1e-9)
    fact = (a["nearest"]["i"] == b["nearest"]["i"]) & (a["nearest"]["score"] >= 0.55) & (b["nearest"]["score"] >= 0.55)
    listed = F.array_except(F.flatten(F.transform(a["known"], lambda k: k["facts"])), F.array(*map(F.lit, V.NO_DIMENSION)))
    own = lambda u, v: F.size(F.array_intersect(F.array_except(u["d"]["facts"], v["d"]["facts"]), listed)) > 0
    sourced = ~(own(a, b) & own(b, a)) & ((alike >= 0.82 - 1e-9) | (held >= 0.90 - 1e-9) | (fact & (alike >= 0.40 - 1e-9) & (held >= 0.78 - 1e-9)))
    same = F.when(F.size(a["known"]) > 0, sourced).otherwise((C.compact(a["text"]) == C.compact(b["text"])) | measured)
    # A criterion that repeats another may itself repeat: each way, and to itself.
    ends = [p.where(same).select("of", F.col(f"r{k}.mark").alias("mark"), F.col(f"r{j}.first").alias("prior"), F.col(f"r{k}.text").alias("text"), F.col(f"r{j}.text").alias("other")) for k, j in ("ab", "ba")]
    itself = one.select("of", "mark", F.col("first").alias("prior"), "text", F.col("text").alias("other"))
    alike = stored(ends[0].unionByName(ends[1]).unionByName(itself), "criteria-alike")
    texts = alike.select("text", "other").distinct()
    both = texts.unionByName(texts.select(F.col("other").alias("text"), F.col("text").alias("other"))).distinct()
    against = judged(both.select(*pair(F.col("text"), F.array("other")))).select(*PAIR, "conflicts")
    opposed = stored(both.select("text", "other", *pair(F.col("text"), F.array("other"))[2:]).join(against, PAIR).where("conflicts").select("text", "other"), "criteria-opposed")
    opposed = opposed.unionByName(opposed.select(F.col("other").alias("text"), F.col("text").alias("other"))).distinct()
    prior = alike.join(opposed, ["text", "other"], "left_anti").groupBy("of", "mark").agg(F.min("prior").alias("prior"))
    found = stored(each.join(prior, ["of", "mark"]).where("number > prior").select("of", "number"), "criteria-repeated")
    return rows.select("s", "id", "of").join(found, "of").select("s", "id", "number")


def repeated_stories(stories: DataFrame) -> DataFrame:
    """``s, id``: stories whose title and description, or whose description's tokens by a Jaccard of 0.90, repeat an earlier story of their scope that isn't repeated itself."""
    told = F.concat(C.compact(F.col("title")), F.lit("||"), C.compact(F.col("description")))
    rows = keyed(stories).select("s", "id", told.alias("key"), F.array_sort(meaningful_tokens(F.col("description"))).alias("tokens"), F.monotonically_increasing_id().alias("node"))
    rows = stored(rows.withColumn("mark", F.md5(F.when(F.size("tokens") > 0, F.concat(F.lit("t"), F.array_join("tokens", " "))).otherwise(F.concat(F.lit("k"), "key")))), "story-tokens")
    # Of stories with the same tokens all but the first go with it, or with what it repeats.
    firsts = stored(rows.groupBy("s", "mark").agg(F.min(F.struct("id", "node")).alias("first")), "story-classes")
    heads = stored(rows.join(firsts.select("s", "mark", "first.node"), ["s", "mark", "node"], "left_semi"), "story-heads")
    pairs = similar_sets(heads.select("node", F.transform("tokens", lambda t: F.concat("s", F.lit("|"), t)).alias("s")), 0.90)
    at = heads.select("node", F.struct("id", "node").alias("at"))
    placed = pairs.join(at.select(F.col("node").alias("a"), F.col("at").alias("at_a")), "a").join(at.select(F.col("node").alias("b"), F.col("at").alias("at_b")), "b")
    later = repeated(placed.select(F.least("at_a", "at_b")["node"].alias("a"), F.greatest("at_a", "at_b")["node"].alias("b")))
    copies = rows.join(firsts.select("s", "mark", "first.node"), ["s", "mark", "node"], "left_anti")
    return rows.join(later, "node", "left_semi").select("s", "id").unionByName(copies.select("s", "id"))


def story_issues(stories: DataFrame, criteria: DataFrame, again: DataFrame | None = None, copies: DataFrame | None = None) -> DataFrame:
    """Of stories with their requirements (``with_requirements``) and criteria (``scope, story, criterion_id, text``).

    ``again`` and ``copies`` are what ``repeated_criteria`` and ``repeated_stories`` find, where that is known already.
    """
    s = with_criteria(stories, criteria)
    title, about = C.bare(F.col("title")), C.bare(F.col("description"))
    said = F.transform("ac", lambda c: F.coalesce(c["text"], F.lit("")))
    claim = C.bare(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("description", F.lit(""))))
    whole = F.concat_ws(" ", "title", "description", F.array_join(F.transform("ac", lambda c: c["text"]), " "))
    s = s.withColumns({"claim": claim, "whole": whole, "said": said, "sources": F.concat("texts", "quotes")})
    s = stored(s.withColumns({f"{c}_mark": mark(F.col(c)) for c in ("claim", "whole", "texts", "facts", "sources", "said")}), "stories")
    each = s.select("scope", "id", "sources", "sources_mark", F.explode("said").alias("text"))
    cover = to_cover(s)
    pairs = [s.select(*pair(F.col("claim"), F.col("facts"))), s.select(*pair(F.col("whole"), F.col("texts"))), each.select(*pair(F.col("text"), F.col("sources"))), cover_pairs(cover)]
    verdicts = judged(reduce(DataFrame.unionByName, (p.distinct() for p in pairs)))
    agile = about.rlike(V.AGILE) & ~F.lower(about).contains("none")
    role = F.lower(F.substring_index(about, ",", 1))
    machine = ~role.contains("system operator") & role.rlike(rf"\b(?:{'|'.join(TECHNICAL_PERSONAS)})\b")
    some = F.exists("texts", lambda t: F.size(meaningful_tokens(t)) >= 3)
    own = _found(s, "story", [
        ("story_empty_title", title == "", "medium"), ("story_description_shape", ~agile, "low"), ("non_human_story_persona", agile & machine, "medium"), ("story_missing_acceptance", F.size("ac") == 0, "medium"),
        ("acceptance_criterion_missing_id", F.exists("ac", lambda c: C.bare(c["criterion_id"]) == ""), "low"), ("story_missing_source_ids", F.coalesce(F.size("source_ids"), F.lit(0)) <= 0, "high"),
        ("story_missing_evidence_reference", (F.col("first_evidence") > 0) & (F.coalesce(F.size("evidence_reference"), F.lit(0)) <= 0), "medium"),
        ("invalid_story_points", ~F.coalesce(F.col("points").isin(V.STORY_POINTS), F.lit(False)), "medium"), ("generic_acceptance_criteria", F.exists("ac", lambda c: C.generic_criterion(c["text"])), "medium"),
    ])
    # What was judged joins rows without their texts.
    j = s.select("scope", "id", F.col("claim_mark").alias("t_claim"), F.col("facts_mark").alias("t_sources"), F.col("whole_mark").alias("w_claim"), F.col("texts_mark").alias("w_sources"), "texts_mark", "said_mark", some.alias("some"), (F.size("texts") > 0).alias("linked"))
    j = j.join(of(verdicts, "t"), ["t_claim", "t_sources"]).join(of(verdicts, "w"), ["w_claim", "w_sources"]).join(covered(cover, verdicts), ["texts_mark", "said_mark"])
    unsupported, clear = F.col("t.terms") | F.col("t.conflicts"), F.col("w.numbers") | F.col("w.conflicts") | F.col("w.terms")
    told = _found(j, "story", [
        ("story_unsupported_fact", unsupported, "high"), ("story_behavior_needs_review", ~unsupported & F.col("t.review"), "medium"),
        ("incorrect_story_requirement_mapping", F.col("some") & (F.col("w.aligned") < V.ALIGNED), F.when(clear, "high").otherwise("medium")), ("acceptance_criteria_missing_source_clause", F.col("linked") & (F.col("covered") < 1), "medium"),
    ])
    each = each.select("scope", "id", mark(F.col("text")).alias("c_claim"), F.col("sources_mark").alias("c_sources")).join(of(verdicts, "c"), ["c_claim", "c_sources"])
    wrong = F.col("c.numbers") | F.col("c.terms") | F.col("c.review") | F.col("c.conflicts") | F.col("c.approval")
    again = s.join((repeated_criteria(s) if again is None else again).select("s", "id").distinct(), ["s", "id"], "left_semi")
    copies = s.join(repeated_stories(stories) if copies is None else copies, ["s", "id"], "left_semi")
    own = own.unionByName(told).unionByName(_found(again, "story", [("duplicate_acceptance_criterion", F.lit(True), "medium")])).unionByName(_found(copies, "story", [("duplicate_story", F.lit(True), "medium")]))
    return own.unionByName(_found(each, "story", [("acceptance_criterion_unsupported_fact", wrong, "high"), ("acceptance_criterion_not_source_aligned", ~wrong & (F.col("c.best") < V.CRITERION_SUPPORT), "medium")]))


def coverage_issues(coverages: DataFrame, requirements: DataFrame, stories: DataFrame) -> DataFrame:
    """Of ``scope, requirement_id, coverage_type, story_ids``, each against its own scope."""
    every = F.concat(F.coalesce("labels", F.array().cast("array<string>")), F.coalesce("candidate_labels", F.array().cast("array<string>")))
    of = keyed(requirements).select("s", F.col("id").alias("requirement_id"), F.explode_outer(every).alias("label")).groupBy("s", "requirement_id").agg(F.collect_set("label").alias("all_labels"))
    c = keyed(coverages).join(of, ["s", "requirement_id"], "left").withColumn("known", F.col("all_labels").isNotNull())
    dangling = keyed(coverages).select("scope", "s", F.explode("story_ids").alias("id")).join(keyed(stories).select("s", "id"), ["s", "id"], "left_anti").withColumn("none", F.lit(0).cast("long"))
    covered = F.col("known") & (F.col("coverage_type") == "covered_by_story")
    out = covered & _has("all_labels", ["Out-of-Scope"])
    return (
        _found(dangling, "coverage", [("coverage_bad_story_id", F.lit(True), "medium")], "none").unionByName(_found(c, "coverage", [("coverage_bad_requirement_id", ~F.col("known"), "medium")], "requirement_id"))
        .unionByName(_found(c, "requirement", [("out_of_scope_covered_by_story", out, "high"), ("open_question_covered_by_story", covered & ~out & _has("all_labels", ["Open Question"]), "high")], "requirement_id"))
    )


def all_issues(requirements: DataFrame, stories: DataFrame, criteria: DataFrame, coverages: DataFrame, again: DataFrame | None = None, copies: DataFrame | None = None) -> DataFrame:
    """``scope, item_type, item_id, rule, severity`` of everything that the gate finds, each scope by itself."""
    linked = with_requirements(stories, requirements)
    return requirement_issues(requirements).unionByName(story_issues(linked, criteria, again, copies)).unionByName(coverage_issues(coverages, requirements, stories))


def groundedness(requirements: DataFrame) -> DataFrame:
    """``scope, id, groundedness``: the strongest support of a requirement's evidence or, where it is given, its ``quote_support_score``; one half where evidence has no score; x 0.8 for those to review."""
    within = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(x, F.lit(0.0))))
    best = F.greatest(F.lit(0.0), F.coalesce(F.array_max(F.transform("evidence", lambda e: within(e["support_score"]))), F.lit(0.0)))
    quoted = F.col("quote_support_score").cast("double") if "quote_support_score" in requirements.columns else F.lit(None).cast("double")
    strongest = F.greatest(best, within(quoted))
    grounded = F.when((strongest == 0) & quoted.isNull() & (F.coalesce(F.size("evidence"), F.lit(0)) > 0), 0.5).otherwise(strongest) * F.when(F.col("needs_review"), 0.8).otherwise(1.0)
    return requirements.select("scope", "id", grounded.alias("groundedness"))


def penalties(found: DataFrame) -> DataFrame:
    """A row for each scope: issues by severity that cost something, high ones that are reported, and whether stories are fallbacks; an item's issues of one cause count once, as the highest.

    A scope whose issues cost nothing has a row of zeros; one without an issue has none.
    """
    named = F.create_map(*[F.lit(x) for pair in CAUSES.items() for x in pair])
    cause = F.when(F.lower("rule").contains("complementary"), "COMPLEMENTARY").otherwise(F.coalesce(F.try_element_at(named, F.col("rule")), F.col("rule")))
    rank = F.array_position(F.array(*map(F.lit, ["low", "medium", "high"])), F.lower("severity"))
    grouped = found.withColumn("cause", cause).groupBy("scope", "item_type", "item_id", "cause").agg(F.max(rank).alias("rank"))
    counted = ~F.col("cause").isin("COMPLEMENTARY", *DIAGNOSTIC)
    costs = counted & ~F.col("cause").isin(OWNED)
    count = {name: F.count_if(costs & (F.col("rank") == k)).alias(name) for k, name in ((3, "high"), (2, "medium"), (1, "low"))}
    return grouped.groupBy("scope").agg(*count.values(), F.count_if(counted & (F.col("rank") == 3)).alias("reported"), (F.count_if(F.col("cause") == "GENERATION_DEGRADED") > 0).alias("degraded"))


# --- Queries --------------------------------------------------------------------------


def tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    return tuple(make(spark, sf_dir) for make in (derived.requirements, derived.stories, derived.criteria, derived.coverages))  # type: ignore[return-value]


def gate_rule_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each rule is broken."""
    found = stored(all_issues(*tables(spark, sf_dir)), "issues")
    return found.groupBy("item_type", "rule", "severity").agg(F.count("*").alias("issues"), F.count_distinct("scope", "item_id").alias("items"))


def gate_requirement_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    requirements, stories, _, coverages = tables(spark, sf_dir)
    return stored(requirement_issues(requirements).where("rule <> 'duplicate_requirement'").unionByName(coverage_issues(coverages, requirements, stories)), "issues")


def gate_penalties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over the issues of requirements and coverages, how many scopes have how many of each kind."""
    requirements, stories, _, coverages = tables(spark, sf_dir)
    found = penalties(stored(requirement_issues(requirements).unionByName(coverage_issues(coverages, requirements, stories)), "issues"))
    return found.groupBy("high", "medium", "low", "reported", "degraded").agg(F.count("*").alias("scopes"))


def groundedness_of_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groundedness(derived.requirements(spark, sf_dir)).select("scope", "id", F.round("groundedness", 4).alias("groundedness"))


def requirement_wording(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the wording of requirements says: clauses, disposition, labels that it bears out, points."""
    r = derived.requirements(spark, sf_dir)
    parts = C.clauses(F.col("text"))
    return r.select("scope", "id", F.size(parts).alias("clauses"), F.md5(F.array_join(parts, "|")).alias("clauses_md5"), C.disposition(F.col("text")).alias("wording"), F.array_join(C.settled_labels(F.col("text"), F.col("labels")), ",").alias("labels"),
                    C.story_points(F.lit(0), F.array("text")).alias("points"))


def quotable_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many parts of each document may be quoted, and how long they are together."""
    parts = table(spark, sf_dir, "documents").select("doc_id", C.quotable(F.col("text")).alias("p"))
    return parts.select("doc_id", F.size("p").alias("parts"), F.aggregate("p", F.lit(0), lambda n, x: n + F.length(x)).alias("chars"))


_KEYS = """k AS (SELECT o_custkey AS scope, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS id, o_orderkey AS k, CASE WHEN o_orderkey % 5 = 1 THEN '' WHEN o_orderkey % 7 = 3 THEN 'x' WHEN o_orderkey % 13 = 5 THEN '' ELSE 'x' END <> '' AS quoted,
    o_orderkey % 11 <> 0 AND o_orderkey % 13 = 1 AS out_of_scope, o_orderkey % 11 <> 0 AND o_orderkey % 13 = 2 AS open_question, o_orderkey % 22 <> 0 AND o_orderkey % 33 = 0 AS assumed FROM orders)"""
SQL = {
    "groundedness_of_requirements": f"""WITH {_KEYS} SELECT scope, id, round(CASE WHEN NOT quoted THEN 0 WHEN k % 10 = 0 THEN 0.5 ELSE round((k % 10) / 10.0, 2) END * CASE WHEN k % 6 = 0 THEN 0.8 ELSE 1 END, 4)::DOUBLE AS groundedness FROM k""",
    "gate_requirement_issues": f"""WITH {_KEYS},
        r AS (SELECT *, out_of_scope OR open_question OR assumed AS special FROM k)
        SELECT scope, 'requirement' AS item_type, id AS item_id, 'requirement_empty_text' AS rule, 'high' AS severity FROM r WHERE k % 13 = 5
        UNION ALL SELECT scope, 'requirement', id, 'requirement_missing_labels', 'high' FROM r WHERE k % 11 = 0 AND k % 22 = 0
        UNION ALL SELECT scope, 'requirement', id, 'requirement_missing_labels', 'medium' FROM r WHERE k % 11 = 0 AND assumed
        UNION ALL SELECT scope, 'requirement', id, 'priority_not_source_supported', 'medium' FROM r WHERE ['Medium', 'Medium', 'High', 'Medium', 'Critical'][k % 5 + 1] <> CASE WHEN k % 13 = 9 THEN 'Critical' ELSE 'Medium' END
        UNION ALL SELECT scope, 'requirement', id, 'requirement_confidence_invalid', 'medium' FROM r WHERE k % 23 = 0
        UNION ALL SELECT scope, 'requirement', id, 'missing_evidence', 'high' FROM r WHERE NOT special AND NOT quoted
        UNION ALL SELECT scope, 'requirement', id, 'low_confidence_classification', 'medium' FROM r WHERE NOT special AND k % 23 <> 0 AND k % 29 = 0
        UNION ALL SELECT scope, 'coverage', 0, 'coverage_bad_story_id', 'medium' FROM r WHERE k % 8 = 5
        UNION ALL SELECT scope, 'coverage', -id, 'coverage_bad_requirement_id', 'medium' FROM r WHERE k % 47 = 0
        UNION ALL SELECT scope, 'requirement', id, 'out_of_scope_covered_by_story', 'high' FROM r WHERE k % 47 <> 0 AND k % 3 <> 1 AND out_of_scope
        UNION ALL SELECT scope, 'requirement', id, 'open_question_covered_by_story', 'high' FROM r WHERE k % 47 <> 0 AND k % 3 <> 1 AND open_question""",
}
QUERIES = {"gate_rule_issues": gate_rule_issues, "gate_requirement_issues": gate_requirement_issues, "gate_penalties": gate_penalties, "requirement_wording": requirement_wording, "quotable_parts": quotable_parts, "groundedness_of_requirements": groundedness_of_requirements}
