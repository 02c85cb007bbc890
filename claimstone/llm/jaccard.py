"""Components of texts whose five-word shingles have a similarity of 0.8 or more, exactly.

Shingles are put in one order: by how many documents of a sample hold them, then by hash.
Sets of n shingles this similar share one of their first n - ceil(0.8 n) + 1, so only these
prefixes meet, and whole sets verify.  The order decides about speed only, whatever it is.

A shingle that many sets have in their prefix would give pairs in the square of their
number.  All of its sets meet two of them first; what that connects is one component, and
after it only sets outside their shingle's largest component meet the others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimstone.operators.graph import connected_components
from claimstone.session import stored

SHINGLE_WORDS = 5
LEAST = 0.8
#: One document in so many tells which shingles are frequent; those that so many of them have are, up to a number.
SAMPLE = 16
FREQUENT = 3
FREQUENT_MOST = 200_000
#: Counts that rule out pairs before their whole sets move.
BUCKETS = 256
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def shingle_set(text: str | None, width: int = SHINGLE_WORDS) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes; of a shorter text all its words, of a blank one none."""
    words = (text or "").lower().encode("utf-8", "surrogatepass").split()
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    width = min(width, len(w))
    if not width:
        return w
    m = len(w) - width + 1
    h = np.full(m, width, np.uint64)
    for i in range(width):
        h = (h ^ (h >> np.uint64(29))) * _ODD + w[i : i + m]
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return np.unique(h ^ (h >> np.uint64(32)))


def _counts(s: np.ndarray) -> np.ndarray:
    """How many shingles fall in each of BUCKETS; the sum of two sets' lesser counts is at least what they share."""
    return np.bincount((s & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS).astype(np.int32)


def _mark(s: np.ndarray) -> int:
    """A set's 64 bits, signed."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64))


#: Texts described at a time; bounds a worker's memory, whatever Arrow's batches are.
AT_ONCE = 256


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, AT_ONCE):
            yield batch.slice(i, AT_ONCE)


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64), kind))


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles of texts, one after the other."""
    for part in _slices(batches):
        sets = [shingle_set(t).view(np.int64) for t in part.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets), pa.int64())], ["t"])


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's mark and whole set."""
    for part in _slices(batches):
        sets = [shingle_set(t) for t in part.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([_mark(s) for s in sets], pa.int64()), _lists([s.view(np.int64) for s in sets], pa.int64())], ["mark", "s"])


def _described(frequent: pd.DataFrame) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (doc_id, text) as (doc_id, mark, n, prefix, counts): each set's size and its prefix with the ``frequent`` shingles last."""
    frequent = frequent.sort_values("t")
    t, n = frequent.t.to_numpy(np.int64), frequent.n.to_numpy(np.int64)

    def prefix(h: np.ndarray) -> np.ndarray:
        p = len(h) - int(np.ceil(len(h) * LEAST - 1e-9)) + 1 if len(h) else 0
        if not len(t):
            return h[np.argsort(h)[:p]]
        at = np.minimum(np.searchsorted(t, h), len(t) - 1)
        return h[np.lexsort((h, np.where(t[at] == h, n[at], 0)))[:p]]

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            sets = [shingle_set(x) for x in part.column(1).to_pylist()]
            columns = [part.column(0), pa.array([_mark(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), _lists([prefix(s.view(np.int64)) for s in sets], pa.int64()), _lists([_counts(s) for s in sets], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "n", "prefix", "counts"])

    return described


def components(docs: DataFrame, links: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``node, component``: what ``links`` (``src, dst``, ids) and texts of a similarity of LEAST or more connect.

    As connected_components gives it: ids that nothing links have no row.  Rows without an
    id link nothing; the texts of rows that repeat an id all count for it.
    """
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sample = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).select("text").mapInArrow(_sampled, "t long")
    frequent = sample.groupBy("t").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "t").limit(FREQUENT_MOST).toPandas()
    kind = texts.schema["doc_id"].dataType.simpleString()
    sets = stored(texts.mapInArrow(_described(frequent), f"doc_id {kind}, mark long, n int, prefix array<long>, counts array<int>"), "sets")
    classes = stored(sets.groupBy("mark").agg(F.min("doc_id").alias("rep")), "classes")
    equal = sets.select("doc_id", "mark").join(classes, "mark").where("doc_id <> rep").select(F.col("doc_id").alias("src"), F.col("rep").alias("dst"))
    flat = sets.join(classes, "mark").where("doc_id = rep").select("mark", "n", F.explode("prefix").alias("t"))
    if not sets.groupBy("doc_id", "mark").count().where("count > 1").isEmpty():
        flat = flat.distinct()
    flat = stored(flat, "prefixes")

    def fits(a: str, b: str):
        return (F.col(a) >= F.col(b) * LEAST - 1e-9) & (F.col(b) >= F.col(a) * LEAST - 1e-9)

    def verified(pairs: DataFrame) -> DataFrame:
        """Of pairs of marks (``a, b``) the similar ones, as links of ids."""
        tallied = pairs.select(F.explode(F.array("a", "b")).alias("mark")).distinct().join(sets.join(classes, "mark").where("doc_id = rep"), "mark").select("mark", "n", "counts")
        tallied = stored(tallied.dropDuplicates(["mark"]), "tallied")
        most = F.aggregate(F.zip_with("ca", "cb", lambda x, y: F.least(x, y)), F.lit(0), lambda x, y: x + y)
        pairs = pairs.join(tallied.toDF("a", "na", "ca"), "a").join(tallied.toDF("b", "nb", "cb"), "b").where(most >= LEAST * (F.col("na") + F.col("nb") - most) - 1e-9)
        pairs = stored(pairs.select("a", "b"), "likely")
        asked = classes.join(pairs.select(F.explode(F.array("a", "b")).alias("mark")).distinct(), "mark")
        asked = stored(asked, "asked")
        read = texts.join(asked.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").select("text").mapInArrow(_marked, "mark long, s array<long>")
        read = stored(read.join(asked, "mark").groupBy("mark", "rep").agg(F.first("s").alias("s")), "read")
        both = pairs.join(read.toDF("a", "src", "sa"), "a").join(read.toDF("b", "dst", "sb"), "b")
        shared = F.size(F.array_intersect("sa", "sb"))
        return stored(both.where(shared >= LEAST * (F.size("sa") + F.size("sb") - shared) - 1e-9).select("src", "dst"), "similar")

    def ordered(a: str, b: str) -> list:
        return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]

    # Marks are hashes, so the least and the greatest are two sets at random, the same ones for all shingles of a group.
    shared = flat.groupBy("t").agg(F.count("*").alias("m"), F.min("mark").alias("l1"), F.min_by("n", "mark").alias("n1"), F.max("mark").alias("l2"), F.max_by("n", "mark").alias("n2"))
    met = stored(flat.join(stored(shared.where("m > 1"), "shared"), "t"), "met")
    ends = F.array(F.struct(F.col("l1").alias("l"), F.col("n1").alias("nl")), F.struct(F.col("l2").alias("l"), F.col("n2").alias("nl")))
    stars = met.select("mark", "n", F.inline(ends)).where((F.col("mark") != F.col("l")) & fits("n", "nl")).select(*ordered("mark", "l")).distinct()
    edges = links.select("src", "dst").unionByName(equal).unionByName(verified(stored(stars, "stars")))
    found = stored(connected_components(edges), "found")

    # Two sets that share a shingle have met; of more, those of different components may still link.
    placed = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("mark", F.coalesce("component", "rep").alias("c"))
    inner = stored(met.where("m > 2").select("t", "mark", "n").join(placed, "mark"), "inner")
    largest = inner.groupBy("t", "c").agg(F.count("*").alias("k")).groupBy("t").agg(F.max_by("c", "k").alias("top"), F.count("*").alias("parts")).where("parts > 1")
    open_ = stored(inner.join(stored(largest.select("t", "top"), "largest"), "t"), "open")
    odd = open_.where("c <> top").select("t", F.col("mark").alias("x"), F.col("n").alias("nx"), F.col("c").alias("cx"))
    pairs = odd.join(open_, "t").where((F.col("c") != F.col("cx")) & ((F.col("c") == F.col("top")) | (F.col("x") < F.col("mark"))) & fits("n", "nx"))
    more = verified(stored(pairs.select(*ordered("x", "mark")).distinct(), "pairs"))
    if more.isEmpty():
        return found
    return connected_components(found.select(F.col("node").alias("src"), F.col("component").alias("dst")).unionByName(more))
