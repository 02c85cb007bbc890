"""The part of a recording that bears a requirement best.

A recogniser sets full stops inside phrases, so runs of up to four sentences are looked at.
A run may not begin with a sentence that leans on the one before, nor end where the next
one goes on.  Of the runs that suffice the shortest is quoted, as it was said.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimstone.functions import claims as C
from claimstone.functions import values as V
from claimstone.functions.text import let
from claimstone.functions.transcripts import comparable, without_heading
from claimstone.session import stored
from claimstone.sources.tables import table

#: So many runs of a recording are weighed together; what several of them may quote is weighed once.
TOGETHER = 32


def _goes_on(before: Column, after: Column) -> Column:
    """Whether a full stop between two sentences split a phrase."""
    last = F.regexp_extract(F.lower(before), r"([a-z0-9]+)[^a-z0-9]*$", 1)
    first = F.regexp_extract(F.lower(after), r"([a-z0-9]+)", 1)
    return after.rlike(V.GOES_ON) | F.concat(last, F.lit(" "), first).isin([" ".join(p) for p in V.SPLIT_PHRASES])


def runs(text: Column) -> Column:
    """The runs of sentences that may be quoted, by their first sentence and then their length; the sentences themselves where none may."""
    whole = without_heading(F.coalesce(text, F.lit("")))
    said = F.filter(F.transform(F.split(whole, r"(?<=[.!?؟])\s+|\n+"), C.bare), lambda s: s != "")

    def found(s: Column) -> Column:
        # Each run is the one before it and one more sentence.
        ends = F.transform(s, lambda x, i: (i < F.size(s) - 1) & _goes_on(x, F.get(s, i + 1)))

        def of(i: Column, ends: Column) -> Column:
            return F.transform(F.sequence(F.lit(1), F.least(F.size(s) - i, F.lit(V.RUN_SENTENCES))), lambda n: F.struct(F.array_join(F.slice(s, i + 1, n), " ").alias("run"), F.get(ends, i + n - 1).alias("open")))

        none = F.array().cast("array<struct<run:string,open:boolean>>")
        every = let(ends, lambda e: F.flatten(F.transform(s, lambda x, i: F.when((i > 0) & x.rlike(V.LEANS), none).otherwise(of(i, e)))))
        kept = F.transform(F.filter(every, lambda r: (F.length(r["run"]) <= V.RUN_CHARS) & ~F.coalesce(r["open"], F.lit(False))), lambda r: r["run"])
        return let(kept, lambda k: F.when(F.size(k) > 0, k).otherwise(s))

    return let(said, lambda s: F.when(F.size(s) > 0, found(s)).otherwise(F.array().cast("array<string>")))


def blocks(of: Column) -> Column:
    """Up to TOGETHER runs in a row, and the place of the first.  Runs of a block share most of what may be quoted from them."""
    return let(of, lambda every: F.when(F.size(every) > 0, F.transform(F.sequence(F.lit(0), F.size(every) - 1, F.lit(TOGETHER)), lambda at: F.struct(at.alias("at"), F.slice(every, at + 1, F.lit(TOGETHER)).alias("runs")))))


def best_runs(pairs: DataFrame) -> DataFrame:
    """``pair, score, quote`` for each row of ``pair, requirement, said`` (``pair`` names it) whose recording has a sentence.

    A run suffices with a support of 0.60 and 0.70 of the requirement's facts; of these the
    shortest wins, then the best supported, then the first.  Where none suffices the best
    supported wins, then the one with most facts, then the shortest, then the first.
    """
    # Described below the explode: once for each row, not for each run.
    asked = pairs.withColumn("r", C.weighed(comparable(F.col("requirement"))))
    told = asked.select("pair", "r", F.explode(blocks(runs(F.col("said")))).alias("block")).repartition("pair", "block.at")
    told = told.withColumn("quotes", F.transform(F.col("block.runs"), lambda run: let(comparable(run), lambda heard: C.quotable(heard))))
    told = told.withColumn("parts", F.array_distinct(F.flatten("quotes")))
    told = told.withColumn("held", F.transform("parts", lambda p: let(C.weighed(p), lambda q: F.struct(C.support(F.col("r"), q).alias("score"), F.size(F.array_intersect(F.col("r.facts"), q["facts"])).alias("facts")))))

    def judged(run: Column, k: Column) -> Column:
        quotes, of = F.get("quotes", k), lambda q: F.get("held", F.array_position(F.col("parts"), q).cast("int") - 1)
        score = F.coalesce(F.array_max(F.transform(quotes, lambda q: of(q)["score"])), F.lit(0.0))
        # The first part of a run is all of it.
        facts = F.when((F.size("r.facts") > 0) & (F.size(quotes) > 0), of(F.get(quotes, F.lit(0)))["facts"] / F.size("r.facts")).otherwise(0.0)
        return F.struct((F.col("block.at") + k).alias("i"), run.alias("run"), score.alias("score"), facts.alias("facts"))

    scored = stored(told.select("pair", F.inline(F.transform(F.col("block.runs"), judged))), "runs")
    enough = (F.col("score") >= V.RUN_SUPPORT) & (F.col("facts") >= V.RUN_FACTS)
    size = F.length("run")
    order = F.when(enough, F.struct(F.lit(0).alias("a"), size.cast("double").alias("b"), (-F.col("score")).alias("c"), F.lit(0.0).alias("d"), "i")).otherwise(F.struct(F.lit(1).alias("a"), (-F.col("score")).alias("b"), (-F.col("facts")).alias("c"), size.cast("double").alias("d"), "i"))
    return scored.groupBy("pair").agg(F.min_by(F.struct("score", "run"), order).alias("best")).select("pair", "best.score", F.col("best.run").alias("quote"))


# --- Queries --------------------------------------------------------------------------


def spoken_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each turn that follows another one of its conversation: what in it bears the turn before best."""
    turns = table(spark, sf_dir, "conversations")
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    pairs = turns.select(F.struct("conv_id", "turn").alias("pair"), before.alias("requirement"), F.col("text").alias("said")).where("requirement is not null")
    return best_runs(pairs).select("pair.conv_id", "pair.turn", F.round("score", 4).alias("score"), F.md5("quote").alias("quote_md5"))


QUERIES = {"spoken_answers": spoken_answers}
SQL: dict[str, str] = {}
