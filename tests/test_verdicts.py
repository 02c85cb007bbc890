"""Verdicts on different pairs only, against the rules taken row by row."""

from pyspark.sql import functions as F

from claimstone.functions import claims as C
from claimstone.plans import gate, verdicts
from tests.test_plans import STORIES

REQUIREMENTS = "scope long, id long, text string, actor string, goal string, disposition string, labels array<string>, candidate_labels array<string>, priority string, confidence double, classification_confidence double, needs_review boolean, evidence array<struct<chunk_id:string,document_id:string,quote:string,support_score:double>>"


def test_verdicts_are_what_the_rules_say(spark):
    claims = ["Users cannot delete their own comments", "Given a non-manager, approval of refunds is denied", "The system shall notify managers", "Then the request is approved within 5 seconds", "", None, "Unlimited downloads are listed; clerks archive closed orders."]
    sources = [["Users may delete their own comments."], ["Only managers may approve refunds.", "Users may take up to 3 files."], [], ["Refunds require manager approval within 2 seconds; clerks archive closed orders"], [""]]
    df = spark.createDataFrame([(c, s) for c in claims for s in sources], "c string, s array<string>")
    d, src = C.described(F.col("c")), C.all_described(F.col("s"))
    support = lambda many: F.array_max(F.transform(many, lambda x: C.support(x, F.col("d"))))
    df = df.withColumn("d", d).withColumn("src", src)
    rules = {
        "terms": F.size(C.unsupported_terms(F.col("d"), F.col("src"))) > 0, "review": F.size(C.terms_for_review(F.col("d"), F.col("src"))) > 0, "numbers": F.size(C.unsupported_numbers_of(F.col("d"), F.col("src"))) > 0,
        "conflicts": C.conflicts_with(F.col("d"), F.col("src")), "entailed": C.polarity(F.col("d"), F.col("src")) == "ENTAILED", "denies": C.denies_others(F.col("d"), F.col("src")), "approval": C.invents_approval(F.col("d"), F.col("src")),
        "lost": F.exists("src", lambda x: F.size(C.missing_numbers(x, F.col("d"))) > 0), "best": support(F.filter("src", C.substantive)), "held": support(F.col("src")), "aligned": C.alignment(F.col("s"), F.col("d")),
    }
    want = df.select(*verdicts.pair(F.col("c"), F.col("s"))[2:], *[r.alias(n) for n, r in rules.items()]).distinct().collect()
    got = verdicts.judged(df.unionAll(df).select(*verdicts.pair(F.col("c"), F.col("s")))).select(*verdicts.PAIR, *rules).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr) and len(got) == 30
    assert {n for n in rules if len({r[n] for r in got}) > 1} == set(rules)


def test_stories_of_one_content_are_judged_once(spark, monkeypatch):
    """Thirty jobs with the same statements used to be judged thirty times."""
    counts = []

    def judged(pairs):
        found = verdicts.judged(pairs)
        counts.append(found.count())
        return found

    monkeypatch.setattr(gate, "judged", judged)
    text, told = "Clerks archive closed orders every month.", "As a clerk, I want to archive closed orders, so that the system notifies managers"
    scopes = range(30)
    reqs = spark.createDataFrame([(s, 1, text, "clerk", None, "accepted", ["FR"], [], "Medium", 0.5, 0.5, False, [("c", "d", text, 0.9)]) for s in scopes], REQUIREMENTS)
    stories = spark.createDataFrame([(s, 1, "Archive orders", told, [1], ["c"], 1) for s in scopes], STORIES)
    said = ["Then clerks archive closed orders every month.", "Then clerks archive closed orders every month", "Then a virus scan is run within 5 seconds."]
    criteria = spark.createDataFrame([(s, 1, i, f"a{i}", t) for s in scopes for i, t in enumerate(said)], "scope long, story long, number long, criterion_id string, text string")
    got = {}
    for x in gate.story_issues(gate.with_requirements(stories, reqs), criteria).collect():
        got.setdefault(x.scope, []).append((x.rule, x.severity))
    assert set(got) == set(scopes) and len({tuple(sorted(v)) for v in got.values()}) == 1
    assert {"duplicate_acceptance_criterion", "acceptance_criterion_unsupported_fact"} <= {rule for rule, _ in got[0]}
    assert len(counts) == 2 and max(counts) <= 9
