"""A corpus pipeline of five operators, each stage's documents written as Parquet and reread by the next."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimstone.llm import contamination, jaccard, mixing, simhash, suffix, toxicity
from claimstone.session import scratch, shared_dir, written
from claimstone.sources.tables import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _alone(stage: Stage) -> Stage:
    """``stage`` with its documents written; what it kept on disk for itself goes then, whoever runs it."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        path = shared_dir(spark, f"pipeline-{stage.__name__}")
        with scratch(spark):
            return written(stage(spark, docs, sf_dir), path)

    return run


@_alone
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go."""
    chain = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(*COLUMNS), chain).where(F.col("toxicity")[len(toxicity.CATEGORIES) - 1] < toxicity.THRESHOLD).select(*COLUMNS)


@_alone
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the document with the smallest id stays.

    Documents are linked if their SimHash values lie within op2's radius or their five-word
    shingles have a similarity of 0.8 or more.  Of rows that repeat its id the one with the
    smallest text does.  Rows without an id are in no component and stay.
    """
    docs = docs.select(*COLUMNS)
    prints = simhash.near_duplicates(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("src"), F.col("component_id").alias("dst"))
    gone = jaccard.components(docs, prints).where("node <> component").select(F.col("node").alias("doc_id"))
    row = F.min(F.struct("text", "lang", "source", "n_chars")).alias("row")
    kept = docs.where("doc_id is not null").join(gone, "doc_id", "left_anti").groupBy("doc_id").agg(row).select("doc_id", "row.*")
    return kept.select(*COLUMNS).unionByName(docs.where("doc_id is null"))


@_alone
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes or more that a document with a smaller id has are cut; every document stays."""
    cut = suffix.remove_repeats(docs.select(*COLUMNS))
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


@_alone
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    pairs, _ = contamination.find_contained(docs, table(spark, sf_dir, "benchmark"))
    return docs.select(*COLUMNS).join(pairs.select("doc_id").distinct(), "doc_id", "left_anti").select(*COLUMNS)


@_alone
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeats),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]
#: Trained models and hashes decide; SQL doesn't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
