"""What the rules of ``functions.claims`` say of claims and their sources, each different pair judged once.

However many rows repeat a wording, it is described once, and however many put the same
claim to the same sources, these are compared once.  Rows know both by their marks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimstone.functions import claims as C
from claimstone.functions import values as V
from claimstone.functions.facts import numeric_values
from claimstone.session import stored

PAIR = ["claim_mark", "sources_mark"]
_TEXTS = "array<string>"


def mark(value: Column) -> Column:
    """128 bits for a text or an array."""
    return F.unhex(F.md5(F.to_json(F.struct(value.alias("v")))))


def pair(claim: Column, sources: Column) -> list[Column]:
    """The columns by which ``judged`` knows a claim (null is empty) and its sources (an array of texts)."""
    claim = F.coalesce(claim, F.lit(""))
    return [claim.alias("claim"), sources.alias("sources"), mark(claim).alias(PAIR[0]), mark(sources).alias(PAIR[1])]


def of(verdicts: DataFrame, name: str) -> DataFrame:
    """``verdicts`` as one column ``name``, to join by ``name_claim`` and ``name_sources``."""
    rest = [c for c in verdicts.columns if c not in PAIR]
    return verdicts.select(F.col(PAIR[0]).alias(f"{name}_claim"), F.col(PAIR[1]).alias(f"{name}_sources"), F.struct(*rest).alias(name))


def judged(pairs: DataFrame) -> DataFrame:
    """A row for each different pair (``pair``): its marks and

    ``terms, review, numbers`` (whether the claim has some that no source bears), ``conflicts``,
    ``entailed``, ``denies`` and ``approval`` (it denies others what a source reserves, it invents an
    approval), ``lost`` (it leaves out a number of the sources), ``best`` and ``held`` (the highest
    support of a substantive source, and of any), ``aligned`` (of any clause).
    """
    pairs = stored(pairs.select(*PAIR, "claim", "sources").distinct(), "claims-to-judge")
    claim, sources = F.col("d"), F.col("src")
    asked = F.transform(C.claimed(F.col("claim")), C.described)
    claims = pairs.select(PAIR[0], "claim").distinct().select(PAIR[0], C.described(F.col("claim")).alias("d"), asked.alias("asked"), numeric_values(F.col("claim")).alias("claim_values"))
    values = F.array_distinct(F.flatten(F.transform("sources", numeric_values)))
    told = pairs.select(PAIR[1], "sources").distinct().select(PAIR[1], C.all_described(F.col("sources")).alias("src"), C.all_clauses(F.col("sources")).alias("parts"), values.alias("source_values"))
    rows = pairs.select(*PAIR).join(stored(claims, "described-claims"), PAIR[0]).join(stored(told, "described-sources"), PAIR[1])
    rows = rows.withColumn("why", C.entailment(claim, sources))
    rows = rows.withColumn("verdict", C.polarity(claim, sources, F.flatten("parts"), F.col("asked"), F.col("why")))
    supports = lambda many: F.array_max(F.transform(many, lambda s: C.support(s, claim)))
    nearest = F.flatten(F.zip_with("src", "parts", lambda s, p: F.when(F.size(p) > 0, p).otherwise(F.array(s))))
    return stored(rows.select(
        *PAIR, (F.size(C.unsupported_terms(claim, sources, F.col("why"))) > 0).alias("terms"), (F.size(C.terms_for_review(claim, sources)) > 0).alias("review"), (F.size(C.unsupported_numbers_of(claim, sources)) > 0).alias("numbers"),
        C.conflicts_with(claim, sources, F.col("verdict")).alias("conflicts"), (F.col("verdict") == "ENTAILED").alias("entailed"), F.col("why.denies").alias("denies"), C.invents_approval(claim, sources).alias("approval"),
        (F.size(F.array_except("source_values", "claim_values")) > 0).alias("lost"), supports(F.filter(sources, C.substantive)).alias("best"), supports(sources).alias("held"), F.coalesce(supports(nearest), F.lit(0.0)).alias("aligned"),
    ), "verdicts")


def to_cover(rows: DataFrame) -> DataFrame:
    """Each different pair of requirements' ``texts`` and criteria ``said`` (arrays) of rows with ``texts_mark, said_mark``: with the ``clauses`` to be covered; stored."""
    each = rows.select("texts_mark", "said_mark", "texts", "said").distinct()
    return stored(each.select("texts_mark", "said_mark", "said", F.flatten(F.transform("texts", C.clauses)).alias("clauses")), "clauses-to-cover")


def _met(cover: DataFrame) -> DataFrame:
    clause = cover.select("texts_mark", "said_mark", "said", F.posexplode("clauses").alias("i", "clause"))
    return clause.select("texts_mark", "said_mark", "i", "clause", F.explode("said").alias("c"))


def cover_pairs(cover: DataFrame) -> DataFrame:
    """The pairs that ``covered`` needs: each criterion against each clause."""
    return _met(cover).select("clause", "c").distinct().select(*pair(F.col("c"), F.array("clause")))


def covered(cover: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``texts_mark, said_mark, covered``: the share of the clauses that a criterion entails; 1 without a clause."""
    holds = ~F.col("v.lost") & (F.col("v.denies") | ((F.col("v.held") >= V.RELATED) & F.col("v.entailed")))
    met = _met(cover).select("texts_mark", "said_mark", "i", mark(F.coalesce("c", F.lit(""))).alias("v_claim"), mark(F.array("clause")).alias("v_sources")).join(of(verdicts, "v"), ["v_claim", "v_sources"])
    some = met.groupBy("texts_mark", "said_mark", "i").agg(F.max(F.coalesce(holds, F.lit(False))).alias("holds")).groupBy("texts_mark", "said_mark").agg(F.count_if("holds").alias("n"))
    n = F.size("clauses")
    share = F.when(n == 0, 1.0).otherwise(F.coalesce("n", F.lit(0)) / F.greatest(n, F.lit(1)))
    return cover.join(some, ["texts_mark", "said_mark"], "left").select("texts_mark", "said_mark", share.alias("covered"))
