"""Places of rows among those of their key, without one task for a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimstone.session import stored


def positions(df: DataFrame, key: str, order: str) -> DataFrame:
    """``df`` with ``pos``: the place of a row among those of its ``key`` by ``order``, from 1.

    Rows are cut in ranges of key and order, so that a key with very many rows spreads.
    """
    cut = stored(df.repartitionByRange(key, order).withColumn("part", F.spark_partition_id()), "ranges")
    counts = cut.groupBy(key, "part").agg(F.count("*").alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = stored(counts.withColumn("before", before).drop("rows"), "starts")
    local = F.row_number().over(Window.partitionBy(key, "part").orderBy(order))
    return cut.withColumn("local", local).join(starts, [key, "part"]).withColumn("pos", F.col("before") + F.col("local")).drop("part", "local", "before")
