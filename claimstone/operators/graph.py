"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimstone.session import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph.

    ``edges``: columns ``src`` and ``dst`` (long); direction, repeats and self-loops don't
    matter, rows with a null are ignored.  Returns ``node, component``: one row for each
    node of an edge between two different nodes; ``component`` is the smallest node id
    that can be reached.  No edges give an empty result.

    A round replaces each edge by edges to smaller nodes: *large-star* links a node's
    larger neighbours to its smallest neighbour, *small-star* links its smaller ones.  The
    number of edges never grows, the rounds are logarithmic in practice, and no node's
    neighbours are gathered: minima are partial aggregates, and each joins as a stored
    table, so a node with very many neighbours is split by adaptive execution.
    """
    e = stored(
        edges.where("src is not null and dst is not null and src <> dst")
        .select(F.greatest("src", "dst").cast("long").alias("u"), F.least("src", "dst").cast("long").alias("v"))
        .distinct(),
        "edges",
    )
    before = None
    while True:  # each round but the last brings nodes nearer to their smallest one, so it ends
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low")
        large = stored(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        low = stored(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        hung = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stored(hung.unionByName(low.withColumnRenamed("m", "v")).distinct(), "small")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.withColumn("component", F.col("node")))
