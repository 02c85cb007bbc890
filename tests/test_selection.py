"""Rows that earlier kept rows repeat, and the rules and scores built on them, against folds over lists."""

import random

import pytest
from pyspark.sql import functions as F

from claimstone.functions import claims as C
from claimstone.functions import values as V
from claimstone.functions.facts import fact_tokens
from claimstone.functions.text import meaningful_tokens, numbers
from claimstone.operators import selection
from claimstone.plans import gate, scoring
from tests.test_plans import STORIES


def fold(pairs):
    kept, gone = set(), set()
    for row in sorted({x for p in pairs for x in p}):
        (gone if any(a in kept for a, b in pairs if b == row) else kept).add(row)
    return gone


@pytest.mark.parametrize("last", [200_000, 0, 5])
def test_repeated_is_a_fold(spark, last):
    r = random.Random(last)
    chain = [(i, i + 1) for i in range(1, 14)]
    random_pairs = [tuple(sorted(r.sample(range(100, 160), 2))) for _ in range(90)]
    star = [(200, i) for i in range(201, 230)] + [(i, 300) for i in range(201, 230)]
    pairs = sorted({*chain, *random_pairs, *star})
    got = sorted(x.node for x in selection.repeated(spark.createDataFrame([*pairs, *pairs[:3], (7, 7)], "a long, b long"), last_pairs=last).collect())
    assert got == sorted(fold(pairs))
    assert selection.repeated(spark.createDataFrame([], "a long, b long"), last_pairs=last).count() == 0


@pytest.mark.parametrize("least", [0.3, 0.8, 0.9, 1.0])
def test_similar_sets(spark, least):
    r = random.Random(int(least * 10))
    sets = {i: sorted(r.sample("abcdefghijklmnopqrst", r.randint(0, 14))) for i in range(120)}
    sets |= {200 + i: sorted(set(s) ^ {r.choice("abcdefghijklmnopqrst")}) for i, s in sets.items()}
    ids = sorted(sets)
    want = {(a, b) for i, b in enumerate(ids) for a in ids[:i] if sets[a] and sets[b] and len(set(sets[a]) & set(sets[b])) >= least * len(set(sets[a]) | set(sets[b])) - 1e-9}
    df = spark.createDataFrame(list(sets.items()), "node long, s array<string>")
    assert {tuple(x) for x in selection.similar_sets(df, least).collect()} == want


def compact(text):
    return " ".join((text or "").split()).lower()


def test_repeated_stories_against_the_fold(spark):
    r = random.Random(3)
    words = "customer portal exports invoices monthly reports managers approve refunds quickly orders shipping status audit".split()
    base = [r.sample(words, 10) for _ in range(12)]
    rows = []
    for i in range(150):
        w = list(r.choice(base))
        for _ in range(r.randint(0, 3)):
            w[r.randrange(10)] = r.choice(words)
        rows.append((r.choice([1, 2, None]), i // 2, r.choice(["A", "a ", "B", None]), r.choice([" ".join(w), "", None, "the of", "  ".join(w).upper()]), [], [], 1))
    rows = [x for i, x in enumerate(rows) if (x[0], x[1]) not in {(y[0], y[1]) for y in rows[:i]}]
    tokens = {x.d: set(x.t) for x in spark.createDataFrame([(x[3] or "",) for x in rows], "d string").distinct().select("d", meaningful_tokens(F.col("d")).alias("t")).collect()}
    want = set()
    for scope in {x[0] for x in rows}:
        seen, prior = set(), []
        for x in sorted((x for x in rows if x[0] == scope), key=lambda x: x[1]):
            key, t = (compact(x[2]), compact(x[3])), tokens[x[3] or ""]
            if key in seen or (t and any(len(t & p) / len(t | p) >= 0.90 for p in prior)):
                want.add((scope, x[1]))
            else:
                seen.add(key)
                prior.append(t)
    df = gate.repeated_stories(spark.createDataFrame(rows, STORIES))
    got = {(None if x.scope is None else int(x.scope), x.id) for x in df.select(F.get_json_object("s", "$.scope").alias("scope"), "id").collect()}
    assert want and got == want and df.count() == len(want)


class Rules:
    """The functions of ``claims`` on some texts, taken at once."""

    def __init__(self, spark, criteria, sources):
        texts = spark.createDataFrame([(t,) for t in sorted(set(criteria))], "t string")
        self.own = {r.t: r for r in texts.select("t", fact_tokens(F.col("t")).alias("facts"), numbers(F.col("t")).alias("numbers"), F.array(*[F.col("t").rlike(p) for p in (V.POSITIVE_OUTCOME, V.NEGATIVE_OUTCOME)]).alias("outcome")).collect()}
        both = texts.join(texts.withColumnRenamed("t", "u"), F.lit(True))
        self.against = {(r.t, r.u): r.x for r in both.select("t", "u", C.conflicts_with(C.described(F.col("t")), F.array(C.described(F.col("u")))).alias("x")).collect()}
        said = spark.createDataFrame([(t,) for t in sources], "s string").select("s", C.clauses(F.col("s")).alias("c"))
        self.parts = {r.s: r.c for r in said.collect()}
        each = said.select(F.explode("c").alias("c")).distinct()
        self.source_facts = {r.c: set(r.f) for r in each.select("c", fact_tokens(F.col("c")).alias("f")).collect()}
        self.near = {(r.c, r.t): r.x for r in each.join(texts, F.lit(True)).select("c", "t", C.alignment(F.array("c"), C.described(F.col("t"))).alias("x")).collect()}

    def facts(self, t):
        return set(self.own[t].facts) if t in self.own else self.source_facts[t]

    def numbers(self, t):
        return set(self.own[t].numbers)

    def outcome(self, t):
        return tuple(self.own[t].outcome)

    def conflict(self, a, b):
        return self.against[a, b]

    def clauses(self, t):
        return self.parts[t]

    def align(self, clause, t):
        return self.near[clause, t]


def repeats(rules, criteria, texts):
    known = [c for t in texts for c in rules.clauses(t)]
    listed = set().union(*[rules.facts(c) for c in known]) - {"every", "each", "all", "any", "multiple", "other"} if known else set()

    def nearest(t):
        scores = [rules.align(c, t) for c in known]
        return scores.index(max(scores)), max(scores)

    out = []
    for i, text in enumerate(criteria):
        tokens = rules.facts(text)
        for prior in criteria[:i] if tokens else []:
            before = rules.facts(prior)
            if not before or rules.numbers(text) != rules.numbers(prior) or rules.outcome(text) != rules.outcome(prior) or rules.conflict(text, prior) or rules.conflict(prior, text):
                continue
            alike, held = len(tokens & before) / len(tokens | before), len(tokens & before) / min(len(tokens), len(before))
            if not known:
                if compact(text) == compact(prior) or (rules.numbers(text) and alike >= 0.50 and held >= 0.65):
                    out.append(i)
                    break
                continue
            (a, x), (b, y) = nearest(text), nearest(prior)
            if (tokens - before) & listed and (before - tokens) & listed:
                continue
            if alike >= 0.82 or held >= 0.90 or (a == b and x >= 0.55 and y >= 0.55 and alike >= 0.40 and held >= 0.78):
                out.append(i)
                break
    return out


CRITERIA = [
    "Then the order status is shown within 5 seconds.", "Given a user, then the order status is shown within 5 seconds", "Then the order status is shown within 7 seconds.", "then  the order status is shown within 5 seconds.",
    "Then the refund is rejected for clerks.", "Then the refund is accepted for clerks.", "Then clerks archive closed orders every month.", "Then clerks archive closed orders every month and notify managers.", "", "It",
    "Then reports are filtered by team for managers.", "Then reports are filtered by priority for managers.", "Then customers cannot cancel their own open orders.", "Then customers cancel their own open orders.",
]


def test_repeated_criteria_against_the_fold(spark):
    r = random.Random(11)
    texts = {1: ["Managers filter reports by team, priority, and region.", "The order status is shown within 5 seconds."], 2: ["Clerks archive closed orders every month and notify managers."], 3: [], 4: ["It"]}
    rules = Rules(spark, CRITERIA, [t for own in texts.values() for t in own])
    reqs, stories, criteria, want = [], [], [], set()
    for k, (story, own) in enumerate(texts.items()):
        for scope in (1, 2, None):
            picked = [r.choice(CRITERIA) for _ in range(9)] + [CRITERIA[0], CRITERIA[3]]
            reqs += [(scope, 10 * k + i, t, []) for i, t in enumerate(own)]
            stories.append((scope, story, "t", "d", [10 * k + i for i in range(len(own))], [], 1))
            criteria += [(scope, story, i, f"a{i}", t) for i, t in enumerate(picked)]
            want |= {(scope, story, i) for i in repeats(rules, picked, own)}
    linked = gate.with_requirements(spark.createDataFrame(stories, STORIES), spark.createDataFrame(reqs, "scope long, id long, text string, evidence array<struct<quote:string>>"))
    rows = gate.with_criteria(linked, spark.createDataFrame(criteria, "scope long, story long, number long, criterion_id string, text string"))
    got = gate.repeated_criteria(rows).select(F.get_json_object("s", "$.scope").cast("long").alias("scope"), "id", "number").collect()
    assert {tuple(x) for x in got} == want and len(want) > 12


def test_all_28_rules_are_found(spark, sf_dir):
    got = {r.rule for r in gate.gate_rule_issues(spark, sf_dir).collect()}
    assert {"duplicate_acceptance_criterion", "duplicate_requirement"} <= got and len(got) >= 24




def test_quality_of_small_scopes(spark):
    text = "Clerks archive closed orders every month."
    reqs = spark.createDataFrame([
        (1, 1, text, ["FR"], False, [("c", "d", text, 0.9)]), (1, 2, "Managers approve large refunds promptly after review.", ["Open Question"], False, []), (2, 1, text, ["FR"], True, []),
        (None, 1, text, None, False, [("c", "d", text, 0.0)]),
    ], "scope long, id long, text string, labels array<string>, needs_review boolean, evidence array<struct<chunk_id:string,document_id:string,quote:string,support_score:double>>")
    told = "As a clerk, I want to archive closed orders every month, so that closed orders are archived"
    stories = spark.createDataFrame([(1, 1, "Archive orders", told, [1], ["c"], 1), (3, 1, "Archive orders", told, [7], [], 1), (3, 2, "Archive orders", told, [], [], 1)], STORIES)
    criteria = spark.createDataFrame([(1, 1, 1, "a", "Then clerks archive closed orders every month."), (1, 1, 2, "b", "Then clerks archive closed orders every month.")], "scope long, story long, number long, criterion_id string, text string")
    issues = spark.createDataFrame([(2, "requirement", 1, "invalid", "medium"), (2, "requirement", 1, "missing_evidence", "high"), (1, "story", 1, "generation_degraded", "low")], "scope long, item_type string, item_id long, rule string, severity string")
    got = {r.scope: r for r in scoring.quality(reqs, stories, criteria, issues).collect()}
    assert set(got) == {1, 2, 3, None}
    one = got[1]
    # One actionable requirement, aligned and proved; of two criteria one repeats the other.
    assert (one.traceability, one.groundedness, one.completeness, one.criteria_quality, one.duplicate_risk) == (1.0, 0.45, 1.0, 0.5, 0.0)
    assert one.overall == round(min(0.89, 0.3 * 0.45 + 0.25 + 0.15 + 0.2 * 0.5 + 0.1 - 0.01), 4)
    two = got[2]
    assert (two.requirements, two.stories, two.groundedness, two.traceability, two.high_issues) == (1, 0, 0.0, 0.0, 1) and two.overall == round(0.1 - 0.05, 4)
    three = got[3]
    assert (three.requirements, three.stories, three.traceability, three.completeness, three.duplicate_risk) == (0, 2, 0.0, 0.0, 0.5) and three.overall == round(0.1 * 0.5, 4)
    assert got[None].groundedness == 0.5


def test_no_rows(spark):
    reqs = spark.createDataFrame([], "scope long, id long, text string, labels array<string>, needs_review boolean, evidence array<struct<chunk_id:string,document_id:string,quote:string,support_score:double>>")
    criteria = spark.createDataFrame([], "scope long, story long, number long, criterion_id string, text string")
    issues = spark.createDataFrame([], "scope long, item_type string, item_id long, rule string, severity string")
    assert scoring.quality(reqs, spark.createDataFrame([], STORIES), criteria, issues).count() == 0
