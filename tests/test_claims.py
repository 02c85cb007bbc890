"""Rules about claims, each on statements that hit it and on near misses."""

import pytest
from pyspark.sql import functions as F

from claimstone.functions import claims as C


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def check(spark, cases, column):
    """A column of the cases' first values against their last ones; cases are rows of one table."""
    kinds = ["array<string>" if any(isinstance(c[k], list) for c in cases) else "string" for k in range(len(cases[0]) - 1)]
    schema = ", ".join(["i int", *(f"c{k} {kind}" for k, kind in enumerate(kinds))])
    df = spark.createDataFrame([(i, *c[:-1]) for i, c in enumerate(cases)], schema)
    got = {r.i: r.x for r in df.select("i", column(*(F.col(f"c{k}") for k in range(len(kinds)))).alias("x")).collect()}
    for i, case in enumerate(cases):
        assert got[i] == case[-1], (case, got[i])


def said(text):
    return C.described(F.lit(text))


def sources(*texts):
    return C.all_described(F.array(*map(F.lit, texts)) if texts else F.array().cast("array<string>"))


def test_clauses(spark):
    cases = [
        ("Records cannot be permanently deleted. They must be soft-deleted.", ["Records cannot be permanently deleted", "They must be soft-deleted"]),
        ("The system shall send a receipt and must record the payment; managers approve refunds", ["The system shall send a receipt", "must record the payment", "managers approve refunds"]),
        ("Filter assets by status, owner, and location", ["Filter assets by status", "Filter assets by owner", "Filter assets by and location"]),
        ("Latency under 2.0 seconds for 99.9% of calls", ["Latency under 2.0 seconds for 99.9% of calls"]), ("", []), (None, []), ("ok", []),
    ]
    check(spark, cases, lambda text: C.clauses(text))


def test_claimed(spark):
    got = value(spark, C.claimed(F.lit("Given a signed-in manager, when a refund is asked for, then the refund is queued; logs stay immutable.")))
    assert got == ["Given a signed-in manager, when a refund is asked for, then the refund is queued", "the refund is queued", "logs stay immutable.", "logs stay immutable"]


def test_quotable(spark):
    text = "Version 2.0 ships. It has limits; none grow!\n- first point\n- second point"
    got = value(spark, C.quotable(F.lit(text)))
    assert got[0] == text and "Version 2.0 ships." in got and "It has limits; none grow!" in got and "Version 2.0 ships. It has limits; none grow!" in got
    assert "first point" in got and "second point" in got and "It has limits" in got and "none grow!" in got and len(got) == len(set(got))
    assert value(spark, C.quotable(F.lit("  "))) == []


def test_denies_others(spark):
    cases = [
        ("Given a non-administrator, the export is denied to export audit logs", "Only administrators may export audit logs.", True), ("An unauthorized user cannot export audit logs", "Only administrators may export audit logs.", True),
        ("A manager is denied to export audit logs", "Only administrators may export audit logs.", False), ("A non-administrator is denied a coffee", "Only administrators may export audit logs.", False),
        ("A non-manager cannot approve refunds", "The portal allows only managers to approve refunds.", True), ("A non-administrator exports audit logs", "Only administrators may export audit logs.", False),
    ]
    check(spark, cases, lambda claim, source: C.denies_others(C.described(claim), C.all_described(F.array(source))))


def test_stops_at_bound(spark):
    cases = [
        ("Checking out more than 3 assets is rejected", "Employees are allowed to check out up to 3 assets.", True), ("Checking out more than 4 assets is rejected", "Employees are allowed to check out up to 3 assets.", False),
        ("The 501 session is rejected under load of 500 sessions", "Pages load under a load of up to 500 sessions.", False), ("Checking out 3 assets proceeds", "Employees are allowed to check out up to 3 assets.", False),
    ]
    check(spark, cases, lambda claim, source: C.stops_at_bound(C.described(claim), C.all_described(F.array(F.lit("Unrelated."), source))))


def test_unsupported_terms(spark):
    cases = [
        ("The system shall encrypt backups", ["The system stores backups."], ["encrypt"]), ("The system shall encrypt backups", ["Backups are encrypted."], []), ("The asset list grows", ["Assets grow."], []),
        ("The asset is listed", ["Assets grow."], ["display"]), ("A non-manager is denied access to approve refunds", ["Only managers may approve refunds."], []),
        ("The request is blocked", ["Staff must not share keys."], []), ("Records are retained", ["Records are soft-deleted."], []), ("Records are retained", ["Records exist."], ["retain"]),
        ("Permission is restricted to managers", ["Only managers may see pay."], ["permission"]), ("", ["x"], []),
    ]
    check(spark, cases, lambda text, facts: C.unsupported_terms(C.described(text), C.all_described(facts)))


def test_terms_for_review(spark):
    cases = [
        ("The system shall notify managers", ["notify"]), ("Filter audit logs", []), ("The system shall log access", ["record"]), ("Entries are recorded", ["record"]), ("A failure is shown", ["failure"]), ("Tests are run", ["test"]),
        ("and alerts the owner", ["notify"]),
    ]
    check(spark, cases, lambda text: C.terms_for_review(C.described(text), sources("Managers see pages.")))


def test_polarity(spark):
    cases = [
        ("Users may delete their own comments", ["Users may delete their own comments."], "ENTAILED"), ("Users cannot delete their own comments", ["Users may delete their own comments."], "CONTRADICTED"),
        ("Invoices are exported as pdf files", ["Users may delete their own comments."], "NOT_COVERED"), ("Users delete their own comments", ["Audit logs never expire. Users may delete their own comments."], "ENTAILED"),
        ("anything", [], "NOT_COVERED"), ("", ["Users may delete comments."], "NOT_COVERED"),
    ]
    check(spark, cases, lambda claim, facts: C.polarity(C.described(claim), C.all_described(facts)))


def test_unlimited_conflicts_with_a_limit(spark):
    assert value(spark, C.conflicts_with(said("Unlimited downloads"), sources("Users may take up to 3 files.")))
    assert not value(spark, C.conflicts_with(said("Unlimited downloads"), sources("Users may take files.")))


def test_approval(spark):
    assert value(spark, C.invents_approval(said("Then the request is approved"), sources("Refunds require manager approval.")))
    assert not value(spark, C.invents_approval(said("Then the request is approved"), sources("The request is approved when the manager approves.")))


def test_numbers(spark):
    assert value(spark, C.unsupported_numbers_of(said("within 5 seconds"), sources("within 2 seconds"))) == ["5 seconds"]
    assert value(spark, C.missing_numbers(said("at most 1,000 in 2.0 s"), said("2 and 999"))) == ["1000"]


def test_coverage_of_clauses(spark):
    texts = F.array(F.lit("Users may delete their own comments; admins must review invoices"))
    assert value(spark, C.clause_coverage(texts, sources("Users may delete their own comments"))) == 0.5
    assert value(spark, C.clause_coverage(F.array().cast("array<string>"), sources("x"))) == 1.0
    assert value(spark, C.alignment(texts, said("Users may delete their own comments"))) == 1.0


def test_completed(spark):
    cases = [
        ("The page loads fast", "The page loads fast, within 2 seconds, for all users.", "The page loads fast, within 2 seconds, for all users."), ("The page loads fast", "Invoices are paid within 2 days.", "The page loads fast"),
        ("The page loads fast", "", "The page loads fast"), ("", "x", ""),
    ]
    check(spark, cases, lambda requirement, evidence: C.completed(requirement, evidence))


def test_labels_points_dispositions(spark):
    labels = lambda text, *names: value(spark, C.settled_labels(F.lit(text), F.array(*map(F.lit, names))))
    assert labels("A fast page", "FR", "NFR", "FR") == ["FR"] and labels("Latency below 200 ms", "FR", "NFR") == ["FR", "NFR"] and labels("Show pages", "FR", "BR") == ["FR"] and labels("Only admins", "FR", "BR") == ["FR", "BR"]
    assert value(spark, C.story_points(F.lit(5), F.array(F.lit("x")))) == 5 and value(spark, C.story_points(F.lit(4), F.array(F.lit("Export reports")))) == 1
    assert [value(spark, C.disposition(F.lit(t).cast("string"))) for t in ("We ruled out faxes", "It must not leak", "Deferred to phase two", "Plain", None)] == ["rejected", "accepted", "deferred", None, None]


def test_quoted(spark):
    cases = [
        ("b c", "a b c d", ("b c", "exact")), ("B, c", "a b  C d", ("b  C", "fuzzy")), ("zz", "abc", ("abc", "fallback")), (None, "abc", ("abc", "fallback")), ("q", None, ("", "fallback"))
    ]
    check(spark, cases, lambda quote, text: C.quoted(quote, text))


def test_other_script(spark):
    assert value(spark, C.other_script(F.lit("abc"), F.lit("\u0645\u0646"))) and not value(spark, C.other_script(F.lit("abc"), F.lit("xyz"), F.lit("en-US"), F.lit("en")))
    assert value(spark, C.other_script(F.lit("abc"), F.lit("xyz"), F.lit("en"), F.lit("fr"))) and not value(spark, C.other_script(F.lit("a"), F.lit(None).cast("string"), F.lit("en"), F.lit(None).cast("string")))


def test_generic_criteria(spark):
    assert [value(spark, C.generic_criterion(F.lit(t).cast("string"))) for t in (None, "short", "The export works as expected", "The export has 3 columns")] == [True, True, True, False]


def test_covers_material_facts(spark):
    assert value(spark, C.covers_material_facts(said("Managers approve refunds"), said("Managers must approve refunds of any size.")))
    assert not value(spark, C.covers_material_facts(said("Managers approve refunds"), said("Managers refuse loans.")))
