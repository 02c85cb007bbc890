"""Rows that go because an earlier row that stays repeats them.

Whether a row stays depends on the rows before it that stay: of a chain in which each
repeats the one before, every other one stays.  So components are the wrong answer; the
kept rows are the lexicographically first independent set of the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimstone.session import stored

#: Pairs that are left over to one task once no more than so many are undecided.
LAST_PAIRS = 200_000


def similar_sets(sets: DataFrame, least: float) -> DataFrame:
    """``a, b``: nodes a < b whose sets have a Jaccard of ``least`` or more, both orders once.

    ``sets``: ``node`` long and ``s``, different tokens; equal sets should be one node.
    Sets this similar share one of their first n - ceil(least * n) + 1 tokens from rare to
    frequent, and their sizes are within ``least``; what follows that token must be enough.
    """
    flat = stored(sets.where(F.size("s") > 0).select("node", F.size("s").alias("n"), F.explode("s").alias("t")), "set-tokens")
    often = stored(flat.groupBy("t").agg(F.count("*").alias("df")).where("df > 1"), "token-frequencies")
    # Tokens of one set only come first in its order; they are known by what is missing.
    shared = flat.join(often, "t").withColumn("i", F.row_number().over(Window.partitionBy("node").orderBy("df", "t")))
    shared = shared.withColumn("i", F.col("i") + F.col("n") - F.count("*").over(Window.partitionBy("node")))
    prefix = stored(shared.where(F.col("i") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1).select("t", "node", "n", "i"), "set-prefixes")
    a, b = (prefix.select("t", *[F.col(c).alias(f"{c}_{k}") for c in ("node", "n", "i")]) for k in "ab")
    sized = (F.col("node_a") < F.col("node_b")) & (F.col("n_a") >= F.col("n_b") * least - 1e-9) & (F.col("n_b") >= F.col("n_a") * least - 1e-9)
    rest = F.least(F.col("n_a") - F.col("i_a"), F.col("n_b") - F.col("i_b")) + 1
    met = a.join(b, "t").where(sized & (rest * (1 + least) >= least * (F.col("n_a") + F.col("n_b")) - 1e-9))
    met = stored(met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct(), "sets-met")
    sides = [sets.select(F.col("node").alias(k), F.col("s").alias(f"s{k}")) for k in "ab"]
    both = F.size(F.array_intersect("sa", "sb"))
    return met.join(sides[0], "a").join(sides[1], "b").where(both >= least * (F.size("sa") + F.size("sb") - both) - 1e-9).select("a", "b")


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows that go, of all pairs that are left: a row is judged once all before it are."""
    after: dict[int, list[int]] = {}
    waiting: dict[int, int] = {}
    for batch in batches:
        for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            after.setdefault(a, []).append(b)
            waiting[b] = waiting.get(b, 0) + 1
    gone: set[int] = set()
    ready = [a for a in after if a not in waiting]
    while ready:
        row = ready.pop()
        for later in after.get(row, ()):
            if row not in gone:
                gone.add(later)
            waiting[later] -= 1
            if not waiting[later]:
                ready.append(later)
    yield pa.RecordBatch.from_pandas(pd.DataFrame({"node": sorted(gone)}, dtype="int64"), preserve_index=False)


def repeated(pairs: DataFrame, *, last_pairs: int = LAST_PAIRS) -> DataFrame:
    """``node``: the rows that an earlier kept row repeats.

    ``pairs``: ``a, b`` (long), b repeats a and comes after it.  In each round the rows
    without an undecided earlier one stay, and what they repeat goes; a round settles the
    first row of every component at least.  A long chain takes a round for each two rows,
    so the last pairs, ``last_pairs`` at most, are settled in one pass by one task.
    """
    left = stored(pairs.where("a <> b").select("a", "b").distinct(), "undecided")
    gone = left.select(F.col("b").alias("node")).limit(0)
    while (n := left.count()) > last_pairs:
        kept = stored(left.select("a").distinct().join(left.select(F.col("b").alias("a")).distinct(), "a", "left_anti"), "kept")
        out = stored(left.join(kept, "a", "left_semi").select(F.col("b").alias("node")).distinct(), "gone")
        gone = gone.unionByName(out)
        rest = left.join(kept, "a", "left_anti").join(out.select(F.col("node").alias("a")), "a", "left_anti").join(out.select(F.col("node").alias("b")), "b", "left_anti")
        left = stored(rest.select("a", "b"), "undecided")
    if not n:
        return gone
    return gone.unionByName(left.coalesce(1).mapInArrow(_fold, "node long"))
