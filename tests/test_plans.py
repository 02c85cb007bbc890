"""Canonical requirements and the gate, against rules stated one requirement or story at a time."""

import itertools
import re

from pyspark.sql import functions as F

from claimstone.functions.facts import fact_tokens
from claimstone.functions.text import match_key, meaningful_tokens
from claimstone.plans import canonical, derived, gate
from claimstone.session import stored

SCHEMA = "scope long, id long, text string, actor string, goal string, disposition string, labels array<string>, priority string, confidence double, needs_review boolean, evidence array<struct<chunk_id:string,document_id:string,quote:string,support_score:double>>"


STORIES = "scope long, id long, title string, description string, source_ids array<long>, evidence_reference array<string>, points int"


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def differ(a, b):
    technical = ("system", "service", "application", "workspace", "portal", "platform", "api", "database")
    return bool(a and b and a != b and a.rstrip("s") != b.rstrip("s") and not (any(t in a for t in technical) and any(t in b for t in technical)))


def brute_pairs(rows):
    out = {}
    for a, b in itertools.combinations(sorted(rows, key=lambda r: r.id), 2):
        if a.scope != b.scope or {a.disposition, b.disposition} == {"accepted", "rejected"}:
            continue
        fa, fb = set(a.facts), set(b.facts)
        exact = bool(a.key) and a.key == b.key
        near = min(len(fa), len(fb)) >= 4 and jaccard(fa, fb) >= 0.8
        larger = b.text if len(fa) < len(fb) else a.text
        shared = len(fa & fb)
        contained = min(len(fa), len(fb)) >= 4 and len(fa) != len(fb) and bool(re.search(r"[;,]|\b(?:and|or)\b", larger, re.I)) and shared >= 4 and shared / min(len(fa), len(fb)) >= 0.6
        da, db = ({e.document_id for e in x.evidence if e.document_id} for x in (a, b))
        ga, gb = set(a.goals), set(b.goals)
        conflict = differ((a.actor or "").lower(), (b.actor or "").lower())
        intent = not da or not db or bool(da & db) or a.key == b.key or (not conflict and bool(ga) and bool(gb) and jaccard(ga, gb) >= 0.75)
        if (exact or contained) and intent:
            out[a.id, b.id] = "merged"
        elif near and intent:
            out[a.id, b.id] = "actor" if conflict else "merged"
        elif exact or contained or near:
            out[a.id, b.id] = "source"
    return out


def described(df):
    return df.withColumns({"facts": fact_tokens(F.col("text")), "key": match_key(F.col("text")), "goals": fact_tokens(F.col("goal")), "words": F.size(meaningful_tokens(F.col("text")))}).collect()


def brute_groups(rows):
    """Members of each group, and which groups need a review for what is close to them."""
    pairs = brute_pairs(rows)
    of = {r.id: r.id for r in rows}
    for (a, b), verdict in sorted(pairs.items()):
        if verdict == "merged":
            low, high = sorted((of[a], of[b]))
            of = {k: low if v == high else v for k, v in of.items()}
    close = {b for (_, b), verdict in pairs.items() if verdict != "merged"}
    groups = {}
    for k, v in of.items():
        groups.setdefault(v, set()).add(k)
    return {frozenset(g): bool(g & close) for g in groups.values()}


def test_groups_against_all_pairs(spark, sf_dir):
    r = derived.requirements(spark, sf_dir).drop("id").withColumn("id", F.monotonically_increasing_id()).limit(700)
    r = stored(r, "some")
    rows = described(r.withColumn("disposition", F.when(F.col("id") % 9 == 0, F.lit(None)).otherwise(F.col("disposition"))))
    want = brute_groups(rows)
    assert {v for v in brute_pairs(rows).values()} == {"merged", "actor", "source"}
    calm = spark.createDataFrame([x.asDict(recursive=True) for x in rows], r.schema).withColumn("needs_review", F.lit(False))
    found, ids = canonical.canonical(calm)
    reviewed = {(x.scope, x.id): x.needs_review for x in found.collect()}
    members = {}
    for x in ids.collect():
        members.setdefault((x.scope, x.id), set()).add(x.old_id)
    assert {frozenset(m) for m in members.values()} == set(want)
    split = {x.scope for x in rows if x.disposition == "accepted"} & {x.scope for x in rows if x.disposition == "rejected"}
    by_id = {x.id: x for x in rows}
    for key, m in members.items():
        torn = key[0] in split and any(by_id[i].disposition in ("accepted", "rejected") for i in m)
        assert reviewed[key] == (want[frozenset(m)] or torn), (key, m)


def test_scopes_with_the_same_ids_stay_apart(spark):
    """Two jobs, each with ids from 1, and a null scope."""
    rows = []
    for scope, texts in ((1, ["Managers approve large refunds promptly"] * 2), (2, ["Invoices are exported nightly as files", "Clerks archive closed orders every month"]), (None, ["Managers approve large refunds promptly", "Clerks archive closed orders every month"])):
        rows += [(scope, i + 1, t, None, None, "accepted", ["FR"], "Low", 0.5, False, []) for i, t in enumerate(texts)]
    found, ids = canonical.canonical(spark.createDataFrame(rows, SCHEMA))
    assert sorted((r.scope or 0, r.number, r.members, r.text[:8]) for r in found.collect()) == [(0, 1, 1, "Managers"), (0, 2, 1, "Clerks a"), (1, 1, 2, "Managers"), (2, 1, 1, "Invoices"), (2, 2, 1, "Clerks a")]
    assert sorted((r.scope or 0, r.old_id, r.number) for r in ids.collect()) == [(0, 1, 1), (0, 2, 2), (1, 1, 1), (1, 2, 1), (2, 1, 1), (2, 2, 2)]
    stories = spark.createDataFrame([(1, 1, "t", "As a clerk, I want a, so that b", [1], ["c"], 1), (2, 1, "t", "As a clerk, I want a, so that b", [1], ["c"], 1), (None, 1, "t", "d", [2], ["c"], 1)], STORIES)
    linked = {r.scope: r.texts for r in gate.with_requirements(stories, spark.createDataFrame(rows, SCHEMA)).collect()}
    assert linked == {1: [rows[0][2]], 2: [rows[2][2]], None: [rows[5][2]]}
    r = spark.createDataFrame(rows, SCHEMA).withColumn("candidate_labels", F.col("labels")).withColumn("classification_confidence", F.lit(0.8))
    again = [(x.scope, x.item_id) for x in gate.requirement_issues(r).where("rule = 'duplicate_requirement'").collect()]
    assert again == [(1, 2)]
    cover = spark.createDataFrame([(1, 1, "covered_by_story", [1]), (2, 1, "merged", [2]), (3, 1, "merged", []), (None, 2, "merged", [1])], "scope long, requirement_id long, coverage_type string, story_ids array<long>")
    got = sorted((x.scope, x.item_id, x.rule) for x in gate.coverage_issues(cover, r, stories).collect())
    assert got == [(2, 0, "coverage_bad_story_id"), (3, 1, "coverage_bad_requirement_id")]


def test_many_copies_give_no_pairs(spark):
    rows = [(1, i, "Managers approve large refunds promptly", "manager", None, "accepted", ["FR"], "Low", 0.5, False, [("c", f"d{i}", "q", 0.5)]) for i in range(400)]
    classes, close = canonical.close_pairs(spark.createDataFrame(rows, SCHEMA))
    assert classes.count() == 400 and close.count() == 399
    found, ids = canonical.canonical(spark.createDataFrame(rows, SCHEMA))
    assert [(r.id, r.members) for r in found.collect()] == [(0, 400)] and ids.count() == 400


def test_maps_of_several_passes(spark):
    schema = "scope long, old_id long, new_id long"
    passes = [[(1, 1, 1), (1, 2, 1), (1, 3, 2), (2, 1, 1), (2, 2, 2), (None, 5, 1)], [(1, 1, 2), (1, 2, 1), (2, 1, 1), (2, 2, 1), (None, 1, 9)], [(1, 2, 7)]]
    got = sorted(map(tuple, canonical.composed([spark.createDataFrame(p, schema) for p in passes]).collect()), key=str)
    want = []
    for scope, old, new in passes[0]:
        for later in passes[1:]:
            new = next((n for s, o, n in later if (s, o) == (scope, new)), new)
        want.append((scope, old, new))
    assert got == sorted(want, key=str)


def test_issues_move_to_new_ids(spark):
    issues = spark.createDataFrame([
        (1, "requirement", 2, "missing_evidence", "x", 0), (1, "requirement", 3, "missing_evidence", "x", 1), (1, "requirement", 2, "duplicate_requirement", "x", 2), (1, "requirement", 1, "low", "d", 3),
        (1, "requirement", 2, "low", "d", 4), (1, "story", 2, "low", "d", 5), (2, "requirement", 2, "low", "d", 6), (None, "coverage", 2, "low", "d", 7),
    ], "scope long, item_type string, item_id long, rule string, details string, seq long")
    ids = spark.createDataFrame([(1, 1, 1), (1, 2, 1), (1, 3, 2), (None, 2, 5)], "scope long, old_id long, new_id long")
    reqs = spark.createDataFrame([(1, 1, ["q"]), (1, 2, [])], "scope long, id long, evidence array<string>")
    got = sorted(map(tuple, canonical.remapped_issues(issues, ids, reqs).collect()), key=lambda r: r[-1])
    assert got == [(1, "requirement", 2, "missing_evidence", "x", 1), (1, "requirement", 1, "low", "d", 3), (1, "story", 2, "low", "d", 5), (2, "requirement", 2, "low", "d", 6), (None, "coverage", 5, "low", "d", 7)]


def test_groups_keep_what_their_members_know(spark):
    e = lambda chunk, quote: (chunk, "d", quote, 0.5)
    rows = [
        (1, 1, "Managers approve large refunds promptly", "manager", None, "proposed", ["FR"], "Low", 0.5, False, [e("c1", "q1")]), (1, 2, "Managers approve large refunds promptly!", None, "speed", "accepted", ["BR", "FR"], "High", 0.9, True, [e("c1", "q1"), e("c2", "q2")]),
        (1, 3, "Invoices are exported nightly as files", None, None, "accepted", None, None, 0.1, False, None), (1, 4, "", "x", None, "accepted", [], "Medium", 0.2, False, []), (2, 5, "Managers approve large refunds promptly", None, None, "rejected", ["FR"], "Medium", 0.3, False, []),
    ]
    got = {r.id: r for r in canonical.canonical(spark.createDataFrame(rows, SCHEMA))[0].collect()}
    assert set(got) == {2, 3, 4, 5} and {r.number for r in got.values() if r.scope == 1} == {1, 2, 3}
    one = got[2]
    assert (one.members, one.actor, one.goal, one.priority, one.disposition, one.confidence, one.needs_review) == (2, "manager", "speed", "High", "accepted", 0.9, True)
    assert one.labels == ["BR", "FR"] and [(x.chunk_id, x.quote) for x in one.evidence] == [("c1", "q1"), ("c2", "q2")]
    assert (got[3].priority, got[3].labels, got[5].members) == ("Low", None, 1)


def test_opposed_requirements_stay_apart_and_are_reviewed(spark):
    rows = [(1, i, "Managers approve large refunds promptly", None, None, d, [], "Low", 0.5, False, []) for i, d in ((1, "accepted"), (2, "rejected"))]
    got = canonical.canonical(spark.createDataFrame(rows, SCHEMA))[0].collect()
    assert len(got) == 2 and all(r.needs_review for r in got)


def test_numeric_contexts(spark):
    value = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert value(canonical.orthogonal(F.lit("Refunds above 500 dollars need approval"), F.lit("Pages load within 2 seconds")))
    assert not value(canonical.orthogonal(F.lit("Pages load within 2 seconds"), F.lit("Pages load within 5 seconds")))
    assert value(canonical.composable(F.lit("Approval is needed above 500"), F.lit("Staff take up to 3 assets"))) and not value(canonical.composable(F.lit("No approval above 500"), F.lit("up to 3 assets")))


def test_requirement_rules_row_by_row(spark, sf_dir):
    r = derived.requirements(spark, sf_dir)
    special = {"Open Question", "Out-of-Scope", "Assumption"}
    want = []
    for x in r.collect():
        labels, candidates = set(x.labels), set(x.candidate_labels)
        said = [("requirement_empty_text", "high", not x.text.strip()), ("requirement_missing_labels", "high", not labels and not candidates), ("requirement_missing_labels", "medium", not labels and bool(candidates & special))]
        expected = "Critical" if "usiness-critical" in x.text else "Medium"
        said += [("priority_not_source_supported", "medium", x.priority != expected), ("requirement_confidence_invalid", "medium", not 0 <= x.classification_confidence <= 1)]
        exempt = (labels | candidates) & special
        said += [("missing_evidence", "high", not exempt and not x.evidence), ("low_confidence_classification", "medium", not exempt and x.classification_confidence < 0.4)]
        want += [(x.scope, "requirement", x.id, rule, severity) for rule, severity, hit in said if hit]
    got = [tuple(i) for i in gate.requirement_issues(r).where("rule <> 'duplicate_requirement'").collect()]
    assert sorted(got) == sorted(want) and len({i[3] for i in got}) == 6


def test_coverage_rules(spark):
    reqs = spark.createDataFrame([(0, 1, ["Out-of-Scope"], []), (0, 2, ["FR"], ["Open Question"]), (0, 3, None, None)], "scope long, id long, labels array<string>, candidate_labels array<string>")
    cover = spark.createDataFrame([(0, 1, "covered_by_story", [7]), (0, 2, "covered_by_story", [8]), (0, 3, "covered_by_story", []), (0, 4, "merged", [7])], "scope long, requirement_id long, coverage_type string, story_ids array<long>")
    got = sorted(tuple(r)[1:] for r in gate.coverage_issues(cover, reqs, spark.createDataFrame([(0, 7)], "scope long, id long")).collect())
    assert got == [("coverage", 0, "coverage_bad_story_id", "medium"), ("coverage", 4, "coverage_bad_requirement_id", "medium"), ("requirement", 1, "out_of_scope_covered_by_story", "high"), ("requirement", 2, "open_question_covered_by_story", "high")]


def test_penalties(spark):
    rows = [("story", 1, "story_empty_title", "medium"), ("story", 1, "story_missing_acceptance", "high"), ("requirement", 2, "invalid_story_points", "low"), ("requirement", 2, "invalid_story_points", "medium"), ("x", 3, "low_confidence_classification", "high"), ("x", 4, "semantic_complementary", "high"), ("x", 5, "requirement_empty_text", "high")]
    rows = [(9, *r) for r in rows] + [(8, "story", 1, "story_empty_title", "low")]
    by_scope = {r.scope: r for r in gate.penalties(spark.createDataFrame(rows, "scope long, item_type string, item_id long, rule string, severity string")).collect()}
    got = by_scope[9]
    assert (by_scope[8].high, by_scope[8].low, by_scope[8].reported) == (0, 0, 0)
    assert (got.high, got.medium, got.low, got.reported, got.degraded) == (1, 1, 0, 2, False)


def test_groundedness(spark):
    rows = [(1, False, [(0.4,), (0.9,)]), (2, True, [(1.5,)]), (3, False, [(0.0,)]), (4, False, []), (5, False, None)]
    got = {r.id: r.groundedness for r in gate.groundedness(spark.createDataFrame(rows, "id long, needs_review boolean, evidence array<struct<support_score:double>>").withColumn("scope", F.lit(1))).collect()}
    assert got == {1: 0.9, 2: 0.8, 3: 0.5, 4: 0.0, 5: 0.0}


def test_every_rule_of_the_plain_gate(spark):
    """Statements to review and stories of 8 points are issues too."""
    from claimstone.plans import requirements as R

    reqs = spark.createDataFrame([(1, "x", 1, False, True), (2, "y", 1, False, False)], "item_id long, text string, evidence long, duplicate boolean, needs_review boolean")
    tales = spark.createDataFrame([(1, "t", ["c"], 8), (2, "t", ["c"], 5)], "item_id long, title string, criteria array<string>, points int")
    assert sorted(tuple(r) for r in R.issues(reqs, tales).collect()) == [("requirement", 1, "requirement_incomplete", "medium"), ("story", 1, "story_too_large", "low")]


def test_each_different_text_is_described_once(spark, monkeypatch):
    """Few texts are described by themselves, many in place; the groups are the same."""
    texts = ["Managers approve large refunds promptly", "Managers approve large refunds promptly!", "Clerks archive closed orders every month", "", None]
    rows = [(s, i, t, None, "speed" if i % 2 else None, "accepted", ["FR"], "Low", 0.5, False, []) for s in (1, 2, None) for i, t in enumerate(texts * 4)]
    df, kept, known = spark.createDataFrame(rows, SCHEMA), canonical.stored, []

    def stored(frame, label):
        out = kept(frame, label)
        if label == "known-texts":
            known.append(out.count())
        return out

    monkeypatch.setattr(canonical, "stored", stored)
    once = [sorted(map(tuple, x.collect()), key=str) for x in canonical.canonical(df)]
    assert known == [4, 2, 4]
    monkeypatch.setattr(canonical, "KNOWN", 0)
    assert [sorted(map(tuple, x.collect()), key=str) for x in canonical.canonical(df)] == once and len(known) == 3 and len(once[1]) == 60
