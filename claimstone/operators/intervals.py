"""Interval joins by time bins.

Each interval is listed in all bins that it touches; a pair meets in the bin where the later
of the two starts, and nowhere else, so no distinct is needed after the equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimstone.sources.tables import table


def _binned(df: DataFrame, start: str, end: str, width: float) -> DataFrame:
    bins = F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))
    return df.where(F.col(end) > F.col(start)).withColumn("_bin", F.explode(bins))


def overlap_join(left: DataFrame, right: DataFrame, *, on: list[str], width: float, how: str = "inner", left_span: tuple[str, str] = ("start", "end"), right_span: tuple[str, str] = ("r_start", "r_end")) -> DataFrame:
    """Rows of ``left`` and ``right`` of one key whose half-open spans (seconds) overlap.

    ``how``: inner, or left_anti for left rows that overlap nothing.  Empty and reversed
    spans overlap nothing.  ``width`` should be near the usual length of a span: an
    interval is listed length / width + 1 times.
    """
    a, b = _binned(left, *left_span, width), _binned(right, *right_span, width)
    overlap: Column = (F.col(left_span[0]) < F.col(right_span[1])) & (F.col(left_span[1]) > F.col(right_span[0]))
    first = F.col("_bin") == F.floor(F.greatest(left_span[0], right_span[0]) / width)
    pairs = a.join(b, [*on, "_bin"]).where(overlap & first).drop("_bin")
    if how == "inner":
        return pairs
    # Rows are known by all their columns; nulls are equal here.
    met = pairs.select(*[F.col(c).alias(f"_met_{i}") for i, c in enumerate(left.columns)]).distinct()
    same = [F.col(c).eqNullSafe(F.col(f"_met_{i}")) for i, c in enumerate(left.columns)]
    return left.join(met, same, "left_anti")


# --- Queries: views and clicks as utterances in two languages; a value is a length in seconds ---------


def _utterances(spark: SparkSession, sf_dir: str, kind: str, prefix: str = "") -> DataFrame:
    start = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    events = table(spark, sf_dir, "events").where(F.col("event_type") == kind)
    return events.select("user_id", F.col("event_id").alias(f"{prefix}id"), start.alias(f"{prefix}start"), (start + 60 * F.col("value")).alias(f"{prefix}end"))


def overlapping_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each view what overlaps it: how many clicks, and their mean start after the view's."""
    pairs = overlap_join(_utterances(spark, sf_dir, "view"), _utterances(spark, sf_dir, "click", "r_"), on=["user_id"], width=1200.0)
    return pairs.groupBy("id").agg(F.count("*").alias("overlaps"), F.round(F.avg(F.col("r_start") - F.col("start")), 3).alias("mean_shift"))


def orphaned_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views that no click overlaps."""
    views = _utterances(spark, sf_dir, "view")
    return overlap_join(views, _utterances(spark, sf_dir, "click", "r_"), on=["user_id"], width=1200.0, how="left_anti").select("id", "user_id")


_PAIRS = """u AS (SELECT user_id, event_id AS id, event_type, epoch_us(ts) / 1e6 AS s, epoch_us(ts) / 1e6 + 60 * value AS e FROM events WHERE value > 0),
    p AS (SELECT a.id, b.s - a.s AS shift FROM u a JOIN u b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'click' AND a.s < b.e AND a.e > b.s)"""
SQL = {
    "overlapping_utterances": f"WITH {_PAIRS} SELECT id, count(*) AS overlaps, round(avg(shift), 3) AS mean_shift FROM p GROUP BY id",
    "orphaned_utterances": f"WITH {_PAIRS} SELECT event_id AS id, user_id FROM events WHERE event_type = 'view' AND event_id NOT IN (SELECT id FROM p)",
}
QUERIES = {"overlapping_utterances": overlapping_utterances, "orphaned_utterances": orphaned_utterances}
