"""What statements claim, and whether sources bear it: clauses, entailment, polarity, unsupported facts.

A statement is compared in a described form, a struct of its text and what the rules look
at, so that tokens and numbers are taken once however many rules ask for them.  ``let``
names such a value inside an expression.  Sources are arrays of described statements.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimstone.functions import values as V
from claimstone.functions.facts import fact_tokens, needs_review, numeric_values, stem
from claimstone.functions.facts import named as alias
from claimstone.functions.text import let, meaningful_tokens, numbers, strings

SPACES = " \t\n\r\x0b\x0c"
_NOTHING = "array<string>"


def bare(text: Column) -> Column:
    """Without white space at the ends; null is empty."""
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))


def compact(text: Column) -> Column:
    """``bare``, runs of white space as one blank, lower case."""
    return F.lower(F.regexp_replace(bare(text), r"\s+", " "))


def _some(parts: Column) -> Column:
    return F.filter(F.transform(parts, bare), lambda p: p != "")


def _said(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)) > 0


# --- Clauses ----------------------------------------------------------------------------


def clauses(text: Column) -> Column:
    """The clauses that must be covered: parts of sentences, a list of three or more after ``for`` or ``by`` as one clause each."""
    parts = F.flatten(F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?؟])\s+(?=[^\d\s])"), lambda s: F.split(s, V.CLAUSE_CUTS)))

    def expanded(part: Column) -> Column:
        items = F.filter(F.transform(F.split(F.regexp_extract(part, V.LISTED, 2), r",\s*|,?\s+(?:and|or)\s+"), bare), lambda i: F.size(meaningful_tokens(i)) >= 1)
        each = F.transform(items, lambda i: F.concat(F.regexp_extract(part, V.LISTED, 1), F.lit(" "), i))
        return F.when(part.rlike(V.LISTED), each).when(F.size(meaningful_tokens(part)) >= 2, F.array(part)).otherwise(F.array().cast(_NOTHING))

    return F.flatten(F.transform(F.transform(parts, lambda p: F.btrim(p, F.lit(" ."))), expanded))


def claimed(text: Column) -> Column:
    """The claims of a criterion: its sentences or their clauses, and what follows ``then``."""
    def told(part: Column) -> Column:
        outcome = bare(F.regexp_extract(part, r"(?is)\bthen\b(.*)$", 1))
        return let(clauses(part), lambda c: F.concat(F.when(F.size(c) > 1, c).otherwise(F.array(part)), F.filter(F.array(outcome), lambda o: o != ""), c))

    return F.array_distinct(F.flatten(F.transform(_some(F.split(F.coalesce(text, F.lit("")), r"\s*;\s*|(?<=[.!?])\s+")), told)))


def quotable(text: Column, window: int = 1200) -> Column:
    """The parts of a text that may be quoted, each once: all of it, sentences, bullets, two or three sentences in a row, parts between semicolons."""
    whole = F.coalesce(text, F.lit(""))
    runs = F.filter(F.regexp_extract_all(whole, F.lit(r"(?s)(.+?(?:[.!?]+(?=\s|$)|$))"), F.lit(1)), lambda r: bare(r) != "")
    bullets = F.regexp_extract_all(whole, F.lit(r"(?s)(?:^|\n)\s*[-*•]\s*(.+?)(?=(?:\n\s*[-*•]\s)|(?:\n\s*#{1,6}\s)|\z)"), F.lit(1))

    def found(r: Column) -> Column:
        rows = lambda n: F.transform(r, lambda _, i: F.when(i + n <= F.size(r), bare(F.array_join(F.slice(r, i + 1, n), ""))))
        several = F.filter(F.flatten(F.zip_with(rows(2), rows(3), lambda a, b: F.array(a, b))), lambda w: F.length(w) <= window)
        split = F.flatten(F.transform(r, lambda s: F.split(bare(s), r"\s*;\s*")))
        return F.concat(F.array(whole), r, bullets, several, split)

    return F.array_distinct(_some(let(runs, found)))


# --- Described statements -----------------------------------------------------------------


def described(text: Column) -> Column:
    """A statement with its lower-case form, facts, meaningful tokens, numbers, and whether it denies."""
    return let(F.coalesce(text, F.lit("")), lambda t: F.struct(
        t.alias("text"), compact(t).alias("low"), fact_tokens(t).alias("facts"), meaningful_tokens(t).alias("words"), numbers(t).alias("numbers"), _said(t, V.NEGATION).alias("denies")))


def weighed(text: Column) -> Column:
    """What ``support`` looks at in a statement, and no more."""
    return let(F.coalesce(text, F.lit("")), lambda t: F.struct(fact_tokens(t).alias("facts"), meaningful_tokens(t).alias("words"), numbers(t).alias("numbers")))


def all_described(texts: Column) -> Column:
    return F.transform(F.coalesce(texts, F.array().cast(_NOTHING)), described)


def _of(shared: Column, whole: Column) -> Column:
    return shared / F.greatest(F.size(whole), F.lit(1))


def support(source: Column, other: Column) -> Column:
    """How far ``other`` says what ``source`` does, 0 to 1: recall before precision, by words or by facts; 0 if their numbers differ."""
    apart = (F.size(source["numbers"]) > 0) & (F.size(other["numbers"]) > 0) & ~F.arrays_overlap(source["numbers"], other["numbers"])
    words, facts = F.size(F.array_intersect(source["words"], other["words"])), F.size(F.array_intersect(source["facts"], other["facts"]))
    by_words = F.when((F.size(source["words"]) == 0) | (F.size(other["words"]) == 0), 0.0).otherwise(F.round(0.75 * _of(words, source["words"]) + 0.25 * _of(words, other["words"]), 4))
    by_facts = F.round(0.80 * _of(facts, source["facts"]) + 0.20 * _of(facts, other["facts"]), 4)
    bare_of_facts = (F.size(source["facts"]) == 0) | (F.size(other["facts"]) == 0)
    return F.when(apart, 0.0).when(bare_of_facts, by_words).otherwise(F.greatest(by_words, by_facts))


def _affirmed(s: Column) -> Column:
    return F.array_except(s["facts"], strings(V.NEGATION_TOKENS))


def relation(source: Column, other: Column) -> Column:
    """The larger of ``support`` and the share of the smaller one's facts, negations aside, that both have."""
    a, b = _affirmed(source), _affirmed(other)
    held = F.size(F.array_intersect(a, b)) / F.greatest(F.least(F.size(a), F.size(b)), F.lit(1))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), support(source, other)).otherwise(F.greatest(support(source, other), held))


def coverage(requirement: Column, evidence: Column) -> Column:
    """The share of a requirement's facts, modals aside, in the evidence; 1 if it has none."""
    material = F.array_except(requirement["facts"], strings(V.MODALS))
    held = F.size(F.array_intersect(material, evidence["facts"])) / F.greatest(F.size(material), F.lit(1))
    return F.when(F.size(material) == 0, 1.0).otherwise(held)


# --- Entailment ---------------------------------------------------------------------------


def _any(sources: Column, holds: Callable[[Column], Column]) -> Column:
    return F.exists(sources, lambda s: F.coalesce(holds(s), F.lit(False)))


_ONLY = [rf"(?i)\bonly\s+([a-z][a-z0-9 _-]{{1,60}}?)\s+{V.EXCLUSIVE}\s+([^.;]+)", r"(?i)\b(?:allow|allows|permit|permits)\s+only\s+([a-z][a-z0-9 _-]{1,60}?)\s+to\s+([^.;]+)"]


def denies_others(claim: Column, sources: Column) -> Column:
    """Whether a source lets only some role act and the claim denies that act to others."""
    named = F.concat(*[F.regexp_extract_all(claim["low"], F.lit(p), F.lit(1)) for p in (r"\bnon[-\s]?(\w+)\b", r"\bnot\s+(?:an?\s+|the\s+)?(\w+)\b")])
    excluded = F.concat(named, F.transform(F.filter(named, lambda w: w.endswith("s")), lambda w: F.left(w, F.length(w) - 1)))
    others = _said(claim["low"], r"\b(?:other|unauthorized)\s+(?:user|users|actor|actors|role|roles)\b")

    def grants(source: Column, pattern: str) -> Column:
        said = F.regexp_replace(bare(source["text"]), r"\s+", " ")
        role, act = fact_tokens(F.regexp_extract(said, pattern, 1)), fact_tokens(F.regexp_extract(said, pattern, 2))
        enough = _of(F.size(F.array_intersect(act, claim["facts"])), act) >= 0.40
        return said.rlike(pattern) & (F.size(role) > 0) & (F.size(act) > 0) & (others | F.arrays_overlap(excluded, role)) & enough

    return _said(claim["low"], V.DENIED) & _any(sources, lambda s: grants(s, _ONLY[0]) | grants(s, _ONLY[1]))


def enforceable_bound(source: Column) -> Column:
    """Whether a statement sets a numeric limit that is a rule, not the load under which another holds."""
    patterns = [rf"\b(?:allow(?:ed|s)?|permit(?:ted|s)?)\b[^.;()]{{0,100}}\b{V.UPPER_BOUND}", r"\b(?:limit(?:ed|s)?)\b[^.;()]{0,60}\bto\s+\d+(?:[,.]\d+)?", rf"\b(?:may|can)\b[^.;()]{{0,80}}\b{V.UPPER_BOUND}"]
    return source["low"].rlike("|".join(patterns))


def stops_at_bound(claim: Column, sources: Column) -> Column:
    """Whether the claim stops what exceeds a limit that a source sets."""
    def sets(s: Column) -> Column:
        stated = _said(s["text"], r"(?i)\b(?:up to|at most|no more than|maximum(?:\s+of)?|limit(?:ed)?\s+to)\s+\d+(?:[,.]\d+)?")
        return enforceable_bound(s) & stated & F.arrays_overlap(claim["numbers"], s["numbers"]) & (F.size(F.array_intersect(claim["facts"], s["facts"])) >= 2)

    return _said(claim["low"], V.STOPPED) & _any(sources, sets)


def restates_exclusive(claim: Column, sources: Column) -> Column:
    """Whether the claim limits access to the role to which a source limits it."""
    pattern = r"\b(?:access|retrieval|permission)\b[^.;]{0,60}\b(?:limited|restricted)\s+to\s+([a-z][a-z0-9 _-]{1,40})"
    roles = fact_tokens(F.regexp_extract(claim["low"], pattern, 1))
    only = rf"(?i)\bonly\s+([a-z][a-z0-9 _-]{{1,60}}?)\s+{V.EXCLUSIVE}\s+"
    return claim["low"].rlike(pattern) & _any(sources, lambda s: F.arrays_overlap(fact_tokens(F.regexp_extract(s["text"], only, 1)), roles))


def follows_prohibition(claim: Column, sources: Column) -> Column:
    """Whether the claim prevents something and a source prohibits."""
    return _said(claim["low"], V.PREVENTED) & _any(sources, lambda s: _said(s["text"], V.PROHIBITED))


def retention_follows(claim: Column, sources: Column) -> Column:
    """Whether keeping follows from a source that soft-deletes, archives or forbids deletion."""
    return F.array_contains(claim["facts"], "retain") & _any(sources, lambda s: _said(s["low"], V.KEPT))


def invents_approval(claim: Column, sources: Column) -> Column:
    """Whether the claim says that something is approved where a source only asks for approval."""
    asks = lambda s: _said(s["low"], r"\bapprov(?:al|e|ed)\b") & ~_said(s["low"], V.APPROVED + r"|\bmanager\s+approves\b")
    return _said(claim["low"], V.APPROVED) & _any(sources, asks)


def _all_facts(sources: Column) -> Column:
    return F.flatten(F.transform(sources, lambda s: s["facts"]))


def entailment(claim: Column, sources: Column) -> Column:
    """What follows from sources though none says it, as a struct that the functions below take for ``why``."""
    return F.struct(denies_others(claim, sources).alias("denies"), restates_exclusive(claim, sources).alias("restates"), stops_at_bound(claim, sources).alias("stops"), follows_prohibition(claim, sources).alias("prevents"), retention_follows(claim, sources).alias("retains"))


def unsupported_terms(claim: Column, sources: Column, why: Column | None = None) -> Column:
    """Terms that assert a behaviour which no source has and none entails.  ``why``: ``entailment``, where it is known already."""
    if why is None:
        return let(entailment(claim, sources), lambda w: unsupported_terms(claim, sources, w))
    assertive = F.array_distinct(F.transform(strings(V.ASSERTIVE_TERMS), lambda t: alias(stem(t))))
    found = F.array_intersect(F.array_except(claim["facts"], _all_facts(sources)), assertive)

    def judged(terms: Column) -> Column:
        gone = [
            (~_said(claim["text"], V.SHOWN), ["display"]), (~_said(claim["text"], V.ACCESSED) | why["denies"] | why["restates"], ["access"]),
            (why["denies"], ["deny"]), (why["stops"], ["block", "deny", "proceed", "reject"]), (why["prevents"], ["block", "deny", "reject", "prevent"]), (why["retains"], ["retain"]),
        ]
        excused = F.flatten(F.array(*[F.when(why, strings(names)).otherwise(F.array().cast(_NOTHING)) for why, names in gone]))
        return F.when(F.size(terms) > 0, F.array_except(terms, excused)).otherwise(terms)

    return let(found, judged)


def terms_for_review(claim: Column, sources: Column) -> Column:
    """Terms of lower risk that no source has and that the claim uses as acts."""
    acts = {"notify": V.NOTIFIED, "record": V.RECORDED, "test": [V.TESTED]}
    lowered = F.lower(claim["text"])
    used = F.array(*[F.when(reduce(or_, [_said(lowered, p) for p in acts.get(t, [rf"\b{t}\b"])]), F.lit(t)) for t in V.REVIEW_TERMS])
    return let(F.array_intersect(F.array_except(claim["facts"], _all_facts(sources)), strings(V.REVIEW_TERMS)), lambda new: F.when(F.size(new) > 0, F.array_intersect(new, used)).otherwise(new))


def unsupported_numbers_of(claim: Column, sources: Column) -> Column:
    """Numbers with their units that no source has."""
    return F.array_except(claim["numbers"], F.flatten(F.transform(sources, lambda s: s["numbers"])))


def missing_numbers(source: Column, other: Column) -> Column:
    """Values of a source that the other text leaves out."""
    return F.array_except(numeric_values(source["text"]), numeric_values(other["text"]))


# --- Polarity -----------------------------------------------------------------------------


def _proposition(s: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(s["text"], r"(?U)\W+", " ")))


def restated(claim: Column, sources: Column) -> Column:
    """Whether a source says the same, or contains it or is contained with a support of 0.90, and denies alike."""
    def same(s: Column) -> Column:
        a, b = _proposition(claim), _proposition(s)
        inside = (a.contains(b) | b.contains(a)) & (support(claim, s) >= 0.90)
        return (a != "") & (b != "") & (claim["denies"] == s["denies"]) & ((a == b) | inside)

    return _any(sources, same)


def all_clauses(texts: Column) -> Column:
    """The described clauses of each of some texts: an array of arrays."""
    return F.transform(texts, lambda t: F.transform(clauses(t), described))


def polarity(claim: Column, sources: Column, known: Column | None = None, asked: Column | None = None, why: Column | None = None) -> Column:
    """ENTAILED, CONTRADICTED or NOT_COVERED, by the source clause nearest to each clause of the claim.

    ``known``, ``asked`` (described clauses of the sources, described claims) and ``why`` (``entailment``): where they are known already.
    """
    def nearest(clause: Column, known: Column) -> Column:
        scored = F.transform(known, lambda s, i: F.struct(relation(s, clause).alias("score"), (-i).alias("first"), s.alias("s")))
        return F.array_sort(scored, lambda x, y: F.when(x["score"] != y["score"], F.when(x["score"] > y["score"], -1).otherwise(1)).otherwise(F.when(x["first"] > y["first"], -1).otherwise(1)))[0]

    def verdict(clause: Column, known: Column) -> Column:
        def of(best: Column) -> Column:
            shared, whole = F.size(F.array_intersect(_affirmed(best["s"]), _affirmed(clause))), _affirmed(best["s"])
            unrelated = (best["score"] < V.RELATED) | (shared < 2)
            return F.when(unrelated, "none").when(clause["denies"] == best["s"]["denies"], "yes").when(_of(shared, whole) >= V.SAME_PROPOSITION, "no").otherwise("none")

        return let(nearest(clause, known), of)

    def decided(known: Column, asked: Column) -> Column:
        each = F.when((F.size(known) > 0) & (F.size(asked) > 0), F.transform(asked, lambda c: verdict(c, known))).otherwise(F.array().cast(_NOTHING))
        return let(each, lambda v: F.when(F.array_contains(v, "no"), "CONTRADICTED").when(F.array_contains(v, "yes"), "ENTAILED").otherwise("NOT_COVERED"))

    follows = why["denies"] | why["stops"] | why["prevents"] if why is not None else denies_others(claim, sources) | stops_at_bound(claim, sources) | follows_prohibition(claim, sources)
    entailed = restated(claim, sources) | follows
    known = F.flatten(all_clauses(F.transform(sources, lambda s: s["text"]))) if known is None else known
    asked = F.transform(claimed(claim["text"]), described) if asked is None else asked
    return F.when(entailed, "ENTAILED").otherwise(let(F.struct(known.alias("known"), asked.alias("asked")), lambda x: decided(x["known"], x["asked"])))


def conflicts_with(claim: Column, sources: Column, verdict: Column | None = None) -> Column:
    """Whether the claim adds or drops a negation of what sources say, or is unlimited where one sets a limit.  ``verdict``: its ``polarity``, where that is known already."""
    verdict = polarity(claim, sources) if verdict is None else verdict
    return (_said(claim["low"], V.UNLIMITED) & _any(sources, lambda s: _said(s["text"], V.LIMITED))) | (verdict == "CONTRADICTED")


# --- Composites -----------------------------------------------------------------------------


def substantive(s: Column) -> Column:
    return F.size(s["words"]) >= 3


def generic_criterion(text: Column) -> Column:
    """Whether a criterion is blank, short or boilerplate."""
    low = F.lower(bare(text))
    return (F.length(low) < V.GENERIC_CRITERION_CHARS) | low.rlike("|".join(map(re.escape, V.GENERIC_CRITERIA)))


def covers_material_facts(requirement: Column, evidence: Column) -> Column:
    """Whether evidence may be cited: it stands alone, has the requirement's numbers, doesn't contradict, and has its facts."""
    least = F.when(F.size(requirement["facts"]) <= 6, 1.0).otherwise(0.85)
    sources = F.array(evidence)
    return ~needs_review(evidence["text"]) & (F.size(unsupported_numbers_of(requirement, sources)) == 0) & ~conflicts_with(requirement, sources) & (coverage(requirement, evidence) >= least)


def clause_coverage(texts: Column, criteria: Column) -> Column:
    """The share of the clauses of ``texts`` (array) that a criterion (described) entails; 1 without a clause."""
    def covered(clause: Column) -> Column:
        one = F.array(clause)
        holds = lambda c: (F.size(missing_numbers(clause, c)) == 0) & (denies_others(c, one) | ((support(clause, c) >= V.RELATED) & (polarity(c, one) == "ENTAILED")))
        return _any(criteria, holds)

    known = F.transform(F.flatten(F.transform(texts, clauses)), described)
    return let(known, lambda k: F.when(F.size(k) == 0, 1.0).otherwise(F.size(F.filter(k, covered)) / F.greatest(F.size(k), F.lit(1))))


def alignment(texts: Column, story: Column) -> Column:
    """How far a story says what a clause of its requirements (array) does, at best; 0 without requirements."""
    known = F.transform(F.flatten(F.transform(texts, lambda t: let(clauses(t), lambda c: F.when(F.size(c) > 0, c).otherwise(F.array(t))))), described)
    return F.coalesce(F.array_max(F.transform(known, lambda c: support(c, story))), F.lit(0.0))


def completed(requirement: Column, evidence: Column) -> Column:
    """The evidence in place of a requirement that it extends by numbers, a negation or a condition, if it supports it; else the requirement."""
    own, said = bare(requirement), bare(evidence)

    def chosen(pair: Column) -> Column:
        r, e = pair["r"], pair["e"]
        longer = (F.size(F.array_except(e["numbers"], r["numbers"])) > 0) | (e["denies"] & ~r["denies"]) | ((F.size(F.array_except(e["facts"], r["facts"])) > 0) & _said(e["text"], V.EXTENSION))
        clean = F.regexp_replace(bare(F.regexp_replace(e["text"], r"^\s*[-*•]\s*", "")), r"\s+", " ")
        fits = longer & ~other_script(r["text"], e["text"]) & (support(r, e) >= V.STRICT_SUPPORT) & ~conflicts_with(r, F.array(e)) & (F.length(clean) <= 800)
        return F.when(fits, clean).otherwise(r["text"])

    return F.when((own == "") | (said == ""), own).otherwise(let(F.struct(described(own).alias("r"), described(said).alias("e")), chosen))


def other_script(a: Column, b: Column, lang_a: Column | None = None, lang_b: Column | None = None) -> Column:
    """Whether two texts are of different languages: by primary tags where both have one, or by one having Arabic letters and the other none."""
    arabic = lambda t: F.coalesce(t, F.lit("")).rlike("[\\u0600-\\u06FF]")
    differ = arabic(a) != arabic(b)
    if lang_a is None or lang_b is None:
        return differ
    primary = lambda c: F.lower(F.split(c, "-")[0])
    return F.coalesce((lang_a != "") & (lang_b != "") & (primary(lang_a) != primary(lang_b)), F.lit(False)) | differ


def disposition(text: Column) -> Column:
    """rejected, accepted for a standing prohibition, deferred, or null where the wording decides nothing; in this order."""
    t = F.coalesce(text, F.lit(""))
    return F.when(_said(t, V.REJECTED), "rejected").when(_said(t, V.ACTIVE_PROHIBITION), "accepted").when(_said(t, V.DEFERRED), "deferred")


def settled_labels(text: Column, labels: Column) -> Column:
    """Labels, each once, without a quality or rule label beside a function that the wording doesn't bear out."""
    low = F.lower(F.coalesce(text, F.lit("")))
    quality = low.rlike(V.MEASURED) | low.rlike("|".join(map(re.escape, V.QUALITY_SIGNS)))
    rule = low.rlike("|".join(map(re.escape, V.RULE_SIGNS)))
    once = F.array_distinct(F.filter(F.coalesce(labels, F.array().cast(_NOTHING)), lambda x: F.coalesce(x != "", F.lit(False))))
    drop = lambda xs, name, why: F.when(F.array_contains(xs, "FR") & ~why, F.array_remove(xs, name)).otherwise(xs)
    return let(once, lambda xs: drop(drop(xs, "NFR", quality), "BR", rule))


def story_points(proposed: Column, texts: Column) -> Column:
    """The proposed points if they are a step of the scale; else by the number of facts and clauses of the source texts (array)."""
    facts, parts = F.size(fact_tokens(F.array_join(texts, " "))), F.aggregate(texts, F.lit(0), lambda n, t: n + F.size(clauses(t)))
    steps = F.when((facts <= 6) & (parts <= 1), 1).when((facts <= 12) & (parts <= 1), 2).when((facts <= 24) & (parts <= 2), 3).when((facts <= 45) & (parts <= 4), 5).otherwise(8)
    return F.when(proposed.isin(V.STORY_POINTS), proposed).otherwise(steps)


def quoted(quote: Column, text: Column) -> Column:
    """``quote, kind``: the quote as the text has it - exact; fuzzy, but for case and what stands between words; or fallback, the text's first 200 characters."""
    q, t = F.coalesce(quote, F.lit("")), F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(F.lower(q), F.lit(r"(?U)(\w+)"), F.lit(1))
    near = F.call_function("regexp_extract", t, F.concat(F.lit("(?iu)("), F.array_join(words, r"\s*"), F.lit(")")), F.lit(1))
    fuzzy = F.when(F.size(words) > 0, near).otherwise("")
    return let(fuzzy, lambda f: F.when((q != "") & t.contains(q), F.struct(q.alias("quote"), F.lit("exact").alias("kind")))
               .when((q != "") & (f != ""), F.struct(f.alias("quote"), F.lit("fuzzy").alias("kind"))).otherwise(F.struct(F.left(t, F.lit(200)).alias("quote"), F.lit("fallback").alias("kind"))))
