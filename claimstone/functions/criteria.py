"""Acceptance criteria in the words of the requirements: one for each clause, one more for each limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimstone.functions import claims as C
from claimstone.functions import values as V
from claimstone.functions.text import let
from claimstone.plans import derived


def _small(text: Column) -> Column:
    """With a small first letter."""
    return F.concat(F.lower(F.left(text, F.lit(1))), F.substr(text, F.lit(2)))


def _third_person(verb: Column) -> Column:
    return F.concat(verb, F.when(verb.rlike(r"(?:s|x|z|ch|sh)$"), "es").otherwise("s"))


def outcome(clause: Column) -> Column:
    """What can be seen when a clause holds: ``The system must lock accounts`` as ``the system locks accounts``."""
    def told(t: Column) -> Column:
        part = lambda i: F.regexp_extract(t, V.MODAL_CLAUSE, i)
        subject, negative, predicate = C.bare(part(1)), part(2) != "", C.bare(part(4))
        many = F.lower(subject).rlike(V.PLURAL_SUBJECTS)
        action, rest = F.regexp_extract(predicate, r"^(\S+)", 1), F.regexp_extract(predicate, r"(?s)^\S+\s+(.+)$", 1)
        second = r"(?i)^(and\s+)([a-z]+)"
        joined = F.when(rest.rlike(second), F.concat(F.regexp_extract(rest, second, 1), _third_person(F.regexp_extract(rest, second, 2)), F.regexp_replace(rest, second, ""))).otherwise(rest)
        plain = ~many & ~negative
        acts = F.concat(F.when(plain, _third_person(action)).otherwise(action), F.when(rest == "", "").otherwise(F.concat(F.lit(" "), F.when(plain, joined).otherwise(rest))))
        is_ = F.concat(subject, F.when(many, " are").otherwise(" is"), F.when(negative, " not").otherwise(""), F.lit(" "), predicate)
        does = F.concat(subject, F.lit(" "), F.when(negative & many, "do not ").when(negative, "does not ").otherwise(""), acts)
        return F.when(~t.rlike(V.MODAL_CLAUSE), _small(t)).otherwise(_small(F.when(part(3) != "", is_).otherwise(does)))

    return let(F.rtrim(C.bare(clause), F.lit(".")), told)


def _of_clause(clause: Column, performer: Column, activity: Column) -> Column:
    """The criteria of a clause, as an array."""
    said = F.concat(F.lit("Given the required preconditions are satisfied, when "), performer, F.lit(" attempts to "), activity, F.lit(", then "), outcome(clause), F.lit("."))
    number, held = F.regexp_extract(clause, V.LIMIT_OF, 1), C.bare(F.regexp_extract(clause, V.LIMIT_OF, 2))
    limit = F.concat(F.lit("Given "), performer, F.lit(" already has "), number, F.lit(" "), held, F.lit(", when "), performer, F.lit(" attempts to "), activity, F.lit(" again, then the operation does not proceed because the maximum of "), number, F.lit(" has been reached."))
    stops = clause.rlike(V.LIMIT_OF) & C.stops_at_bound(C.described(limit), F.array(C.described(clause)))
    return F.when(stops, F.array(said, limit)).otherwise(F.array(said))


def criteria_of(text: Column, actor: Column, goal: Column) -> Column:
    """The criteria of a requirement, each once, in the order of its clauses; one that names no clause if it has none."""
    who = C.bare(F.coalesce(F.nullif(actor, F.lit("")), F.lit("system")))
    performer = F.when(F.lower(who) == "system", "the system").otherwise(who)
    aim = F.rtrim(C.bare(F.coalesce(F.nullif(goal, F.lit("")), F.lit("the specified behavior"))), F.lit("."))
    activity = F.regexp_replace(F.when(aim != "", _small(aim)).otherwise("perform the operation"), r"(?i)^to\s+", "")
    none = F.array(F.concat(F.lit("Given the required preconditions are satisfied, when the system attempts to the specified behavior, then the linked source requirement is satisfied.")))

    def each(parts: Column) -> Column:
        return F.when(F.size(parts) > 0, F.flatten(F.transform(parts, lambda c: _of_clause(F.rtrim(c, F.lit(".")), performer, activity)))).otherwise(none)

    keys = lambda all_: F.transform(all_, lambda t: F.btrim(F.regexp_replace(F.lower(t), r"[^a-z0-9؀-ۿ]+", " ")))
    once = lambda all_: let(keys(all_), lambda k: F.filter(F.transform(all_, lambda t, i: F.when((F.get(k, i) != "") & (F.array_position(k, F.get(k, i)) == i + 1), t)), lambda t: t.isNotNull()))
    return F.transform(let(let(C.clauses(F.coalesce(text, F.lit(""))), each), once), lambda t: F.replace(t, F.lit(" ."), F.lit(".")))


# --- Queries --------------------------------------------------------------------------


def criteria_of_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = derived.requirements(spark, sf_dir)
    made = r.select("scope", "id", F.posexplode(criteria_of(F.col("text"), F.col("actor"), F.col("goal"))).alias("i", "text"))
    name = F.concat(F.lit("story_"), F.col("id").cast("string"), F.lit("_ac_"), (F.col("i") + 1).cast("string"))
    return made.select("scope", "id", name.alias("criterion_id"), F.md5("text").alias("text_md5"))


QUERIES = {"criteria_of_requirements": criteria_of_requirements}
SQL: dict[str, str] = {}
