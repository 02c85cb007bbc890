"""Ordered rows in batches of a bounded weight, and trees of them.

What a row adds to a batch can depend on what the open batch holds, so rows are read in
order, one key after the other, and only the open batch is kept.  Rows carry lengths, not
texts.  A key's rows go to one task in one stream; all keys run side by side.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimstone.session import stored
from claimstone.sources.tables import table

#: Characters of a batch of comparisons, and of a part of a text that is summarised at once.
BATCH_CHARS, PART_CHARS = 2500 * 4, 24_000
EXCERPT_CHARS = 180


class _PairBatches:
    """Pairs of texts; a text weighs once in a batch."""

    def __init__(self, limit: int):
        self.limit, self.number, self.size, self.held = limit, 0, 0, set()

    def add(self, row: dict) -> int:
        ends = ((row["a"], row["len_a"]), (row["b"], row["len_b"]))
        own = len(f"Compare REQ-{row['a']} and REQ-{row['b']}\n")
        more = own + sum(n for i, n in ends if i not in self.held)
        if self.held and self.size + more > self.limit:
            # The row that opens a batch weighs what it added to the one before.
            self.number, self.size, self.held = self.number + 1, 0, set()
        self.size += more
        self.held |= {i for i, _ in ends}
        return self.number


class _Sizes:
    """Rows that weigh what they say, with ``between`` more in a batch of several."""

    def __init__(self, limit: int):
        self.limit, self.number, self.size, self.some = limit, 0, 0, False

    def add(self, row: dict) -> int:
        if self.some and self.size + row["weight"] > self.limit:
            self.number, self.size = self.number + 1, 0
        self.size += row["weight"]
        self.some = True
        return self.number


def _pack(batches: Iterator[pa.RecordBatch], kind: type, limit: int) -> Iterator[pa.RecordBatch]:
    key, open_ = None, None
    for batch in batches:
        numbers = []
        for row in batch.to_pylist():
            if open_ is None or row["key"] != key:
                key, open_ = row["key"], kind(limit)
            numbers.append(open_.add(row))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64())], [*batch.schema.names, "batch"])


def _packed(rows: DataFrame, kind: type, limit: int, order: list) -> DataFrame:
    schema = ", ".join(f"`{n}` {t}" for n, t in [*rows.dtypes, ("batch", "long")])
    return rows.repartition("key").sortWithinPartitions("key", *order).mapInArrow(partial(_pack, kind=kind, limit=limit), schema)


def pair_batches(pairs: DataFrame, *, limit: int = BATCH_CHARS) -> DataFrame:
    """``pairs`` with ``batch``, from 0 in each scope: pairs in the order of ``place`` whose different texts fit ``limit`` characters together.

    ``pairs``: ``scope, place, a, b, len_a, len_b``.  A pair larger than the limit is a batch
    of its own.  A null scope is a scope of its own.
    """
    rows = pairs.select(F.to_json(F.struct("scope")).alias("key"), "scope", "place", "a", "b", "len_a", "len_b")
    return _packed(rows, _PairBatches, limit, ["place"]).drop("key")


def split_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", limit: int = PART_CHARS) -> DataFrame:
    """``doc_id, part, text``: whole texts up to ``limit`` characters as one part; longer ones by paragraphs, as many to a part as fit, none lost; no part for an empty text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    small = docs.where(F.length(text) <= limit).select(F.col(id_col).alias("doc_id"), F.lit(0).cast("long").alias("part"), text.alias("text")).where("text <> ''")
    paragraphs = F.filter(F.transform(F.split(text, r"\n\s*\n|\f"), lambda p: F.btrim(p, F.lit(" \t\n\r\x0b\x0c"))), lambda p: p != "")
    pieces = F.flatten(F.transform(paragraphs, lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 1) / limit).cast("int")), lambda i: F.substr(p, i * limit + 1, F.lit(limit)))))
    large = docs.where(F.length(text) > limit).select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("key"), pieces.alias("pieces"))
    cut = stored(large.select("doc_id", "key", F.posexplode("pieces").alias("i", "piece")), "pieces")
    sized = cut.select("key", "i", (F.length("piece") + 2).cast("long").alias("weight"))
    placed = _packed(sized, _Sizes, limit, ["i"]).select("key", "i", "batch")
    parts = cut.join(placed, ["key", "i"]).groupBy("doc_id", "key", "batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "piece"))), lambda x: x["piece"]), "\n\n").alias("text"))
    return small.unionByName(parts.select("doc_id", F.col("batch").alias("part"), "text"))


def excerpt(texts: Column) -> Column:
    """A stand-in for a model's summary of some texts (array): the first characters of each."""
    return F.array_join(F.transform(texts, lambda t: F.left(t, F.lit(EXCERPT_CHARS))), "; ")


def reduced(items: DataFrame, combine=excerpt, *, limit: int = PART_CHARS) -> DataFrame:
    """``key, text, rounds``: the texts of a key made one: packed in order, combined, and packed again until one is left.

    ``items``: ``key, place, text``.  ``combine`` makes a text of an array of texts.  A batch
    that isn't the only one of its key holds at least two texts unless one alone is over
    ``limit``, so a key takes rounds in the logarithm of its size; a key whose round leaves
    as many as before is combined whole.
    """
    now = stored(items.select("key", "place", "text", F.lit(0).alias("rounds")), "reduce-0")
    done = None
    while True:
        sized = now.select("key", "place", F.length("text").cast("long").alias("weight"))
        placed = stored(_packed(sized, _Sizes, limit, ["place"]), "reduce-batches")
        counts = placed.groupBy("key").agg(F.count("*").alias("n"), (F.max("batch") + 1).alias("batches"))
        stuck = counts.where("batches = n or batches = 1").select("key")
        to = now.join(placed.select("key", "place", "batch"), ["key", "place"]).join(stuck.withColumn("last", F.lit(True)), "key", "left").withColumn("batch", F.when(F.col("last"), F.lit(0)).otherwise(F.col("batch")))
        joined = to.groupBy("key", "batch").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]).alias("texts"), (F.max("rounds") + 1).alias("rounds"), F.first("last").alias("last"))
        made = stored(joined.select("key", F.col("batch").alias("place"), combine(F.col("texts")).alias("text"), "rounds", "last"), "reduce")
        out = made.where("last").select("key", "text", "rounds")
        done = out if done is None else done.unionByName(out)
        now = made.where("last is null").select("key", "place", "text", "rounds")
        if now.isEmpty():
            return done


# --- Queries --------------------------------------------------------------------------


def text_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = split_texts(table(spark, sf_dir, "documents"), limit=4000)
    return parts.select("doc_id", "part", F.length("text").alias("chars"), F.md5("text").alias("text_md5"))


def source_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An excerpt of each source's documents, reduced by parts of 2,000 characters."""
    docs = table(spark, sf_dir, "documents").where("text <> ''").select(F.coalesce("source", F.lit("")).alias("key"), F.col("doc_id").alias("place"), F.left("text", F.lit(EXCERPT_CHARS)).alias("text"))
    return reduced(docs, lambda texts: F.left(excerpt(texts), F.lit(400)), limit=2000).select(F.col("key").alias("source"), F.length("text").alias("chars"), "rounds")


def comparison_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of comparisons of each order with the next ones of its customer."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("scope"), F.col("o_orderkey").alias("a"), (F.pmod("o_orderkey", F.lit(900)) + 50).cast("int").alias("len_a"))
    near = o.select("scope", F.col("a").alias("b"), F.col("len_a").alias("len_b"))
    pairs = o.join(near, "scope").where("a < b and b - a <= 400").withColumn("place", F.struct("a", "b"))
    return pair_batches(pairs, limit=2000).groupBy("scope", "batch").agg(F.count("*").alias("pairs"))


QUERIES = {"text_parts": text_parts, "source_excerpts": source_excerpts, "comparison_batches": comparison_batches}
_MORE = "(length('Compare REQ-' || x.a || ' and REQ-' || x.b || chr(10)) + CASE WHEN list_contains(u.h, x.a) THEN 0 ELSE x.la END + CASE WHEN list_contains(u.h, x.b) THEN 0 ELSE x.lb END)"
SQL = {
    "text_parts": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        p AS (SELECT doc_id, list_filter(list_transform(string_split_regex(t, '\n\s*\n|\f'), lambda x: trim(x, E' \t\n\r\x0b\x0c')), lambda x: x <> '') AS p FROM d WHERE length(t) > 4000),
        c AS (SELECT doc_id, flatten(list_transform(p, lambda x: list_transform(range(0, (length(x) - 1) // 4000 + 1), lambda i: substring(x, i * 4000 + 1, 4000)))) AS c FROM p),
        i AS (SELECT doc_id, c, unnest(range(1, len(c) + 1)) AS i FROM c),
        b AS (SELECT doc_id, i, c[i] AS piece, list_reduce(list_transform(c[1:i], lambda x: {'b': 0::BIGINT, 's': length(x) + 2}),
            lambda u, x: {'b': CASE WHEN u.s + x.s > 4000 THEN u.b + 1 ELSE u.b END, 's': CASE WHEN u.s + x.s > 4000 THEN x.s ELSE u.s + x.s END}).b AS part FROM i),
        o AS (SELECT doc_id, 0::BIGINT AS part, t FROM d WHERE length(t) BETWEEN 1 AND 4000 UNION ALL SELECT doc_id, part, string_agg(piece, E'\n\n' ORDER BY i) FROM b GROUP BY doc_id, part)
        SELECT doc_id, part, length(t)::INTEGER AS chars, md5(t) AS text_md5 FROM o""",
    "comparison_batches": f"""
        WITH o AS (SELECT o_custkey AS scope, o_orderkey AS k, (o_orderkey % 900 + 50)::BIGINT AS n FROM orders),
        p AS (SELECT x.scope, list({{'n': 0::BIGINT, 's': length('Compare REQ-' || x.k || ' and REQ-' || y.k || chr(10)) + x.n + y.n, 'h': [x.k, y.k], 'a': x.k, 'b': y.k, 'la': x.n, 'lb': y.n}} ORDER BY x.k, y.k) AS p
            FROM o x JOIN o y ON x.scope = y.scope AND x.k < y.k AND y.k - x.k <= 400 GROUP BY x.scope),
        i AS (SELECT scope, p, unnest(range(1, len(p) + 1)) AS i FROM p),
        b AS (SELECT scope, list_reduce(p[1:i], lambda u, x: {{'n': CASE WHEN u.s + {_MORE} > 2000 THEN u.n + 1 ELSE u.n END, 's': CASE WHEN u.s + {_MORE} > 2000 THEN {_MORE} ELSE u.s + {_MORE} END,
            'h': CASE WHEN u.s + {_MORE} > 2000 THEN [x.a, x.b] ELSE list_concat(u.h, [x.a, x.b]) END, 'a': x.a, 'b': x.b, 'la': x.la, 'lb': x.lb}}).n AS batch FROM i)
        SELECT scope, batch, count(*) AS pairs FROM b GROUP BY scope, batch""",
}
