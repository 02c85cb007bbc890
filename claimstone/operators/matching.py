"""Greedy matching with a cap on each end's number of pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimstone.operators.ranges import positions
from claimstone.operators.retrieval import cosine_pairs
from claimstone.session import stored
from claimstone.sources.tables import table

#: The cosine from which two vectors may pair, and the places of each.
LEAST = 0.55
PLACES = 5


def capped_matching(pairs: DataFrame, k: int) -> DataFrame:
    """The pairs (``a, b, score``) that one pass from the best down keeps if no end may have more than ``k``.

    Ties go by a and b; a pair appears once.  The pass is done in rounds: a pair that is
    among the best of both its ends, as many as they have places left, is kept by any
    order; pairs of full ends go.  The best pair of all is always kept, so the rounds end.
    """
    better = [F.desc("score"), F.asc("a"), F.asc("b")]
    left = stored(pairs.select("a", "b", "score"), "pairs")
    kept = None
    while not left.isEmpty():
        used = None
        if kept is not None:
            used = stored(kept.select(F.explode(F.array("a", "b")).alias("end")).groupBy("end").agg(F.count("*").alias("used")), "used")
        # An end's pairs are ranked among all of its pairs, whichever side it is on.
        sides = left.select("a", "b", "score", F.explode(F.array("a", "b")).alias("end"))
        sides = sides.withColumn("rank", F.row_number().over(Window.partitionBy("end").orderBy(*better)))
        room = F.lit(k)
        if used is not None:
            sides = sides.join(used, "end", "left")
            room = k - F.coalesce("used", F.lit(0))
        both = sides.groupBy("a", "b", "score").agg(F.min((F.col("rank") <= room).cast("int")).alias("fits"), F.min(room).alias("room"))
        both = stored(both, "ranked")
        new = both.where("fits = 1 and room > 0").select("a", "b", "score")
        kept = new if kept is None else stored(kept.unionByName(new), "kept")
        full = kept.select(F.explode(F.array("a", "b")).alias("end")).groupBy("end").agg(F.count("*").alias("n")).where(F.col("n") >= k).select("end")
        rest = both.where("fits = 0").select("a", "b", "score")
        left = stored(rest.join(full.withColumnRenamed("end", "a"), "a", "left_anti").join(full.withColumnRenamed("end", "b"), "b", "left_anti").select("a", "b", "score"), "left")
    return kept if kept is not None else left


def similar_pairs_capped(vectors: DataFrame, least: float = LEAST, k: int = PLACES) -> DataFrame:
    """The pairs (``a, b, score``) of vectors (``vec_id, embedding``) of cosine ``least`` or more that one pass keeps with ``k`` places for each.

    Equal vectors pair before all others, then the pass goes by cosine to 9 places.  Among
    n equal vectors it makes, in order of ids, full groups of k + 1 that pair with each other
    and with nothing else, so only the at most k vectors left over of each class meet others.
    """
    kept = vectors.where(F.col("vec_id").isNotNull() & F.exists("embedding", lambda x: x != 0))
    kept = stored(kept.select("vec_id", "embedding", F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2")), "vectors")
    classes = stored(kept.groupBy("h1", "h2").agg(F.min("vec_id").alias("class_id"), F.count("*").alias("members")), "classes")
    placed = positions(kept.select("vec_id", "h1", "h2").join(classes, ["h1", "h2"]), "class_id", "vec_id")
    placed = stored(placed.select("vec_id", "class_id", F.expr(f"(pos - 1) div {k + 1}").alias("g"), (F.col("pos") - 1 >= F.col("members") - F.col("members") % (k + 1)).alias("rest")), "placed")
    group = placed.join(classes.where("members > 1").select("class_id"), "class_id", "left_semi")
    same = group.select("class_id", "g", "rest", F.col("vec_id").alias("a")).join(group.select("class_id", "g", F.col("vec_id").alias("b")), ["class_id", "g"]).where("a < b")
    same = stored(same.select("a", "b", F.lit(2.0).alias("score"), "rest"), "same")
    free = placed.where("rest").select("class_id", "vec_id")
    reps = kept.join(free.select(F.col("class_id").alias("vec_id")).distinct(), "vec_id", "left_semi")
    near = cosine_pairs(reps, least)
    met = near.join(free.toDF("a", "x"), "a").join(free.toDF("b", "y"), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "score")
    best = capped_matching(met.unionByName(same.where("rest").drop("rest")), k).unionByName(same.where("not rest").drop("rest"))
    return best.select("a", "b", F.round(F.least("score", F.lit(1.0)), 5).alias("score"))


def similar_vectors_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all pairs of vectors of cosine 0.55 or more, those kept with five places for each vector."""
    return similar_pairs_capped(table(spark, sf_dir, "embeddings"))


SQL: dict[str, str] = {}
QUERIES = {"similar_vectors_capped": similar_vectors_capped}
