"""Mixing sources to target weights.

Each source's documents, in id order, are a stream of words packed into blocks of
``block_words``.  Each output shard draws multinomial counts of its slots over the sources,
and what a source was drawn above its total goes to sources below theirs.  A source's slots
are numbered; a slot's number goes through a pseudorandom permutation of its source's block
indexes, one permutation for each pass over the source; blocks join by index.  DataFrame
functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimstone.llm.text import word_count
from claimstone.session import stored
from claimstone.sources.tables import table

#: Documents of a source in a bucket, about, and slots that a task makes, about.
BUCKET_ROWS, TASK_SLOTS = 1 << 14, 1 << 20
#: Parts of the range of draws by which sources are looked up.
CELLS = 4096
#: Applications of the network that bring a number back into range; see _permuted().
WALK = 24
#: The table of sources is broadcast up to this many rows, and joined by shuffles beyond.
BROADCAST_SOURCES = 100_000


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """Targets of sources from their sizes: ``sid, source, source_size, target``.

    Sources in code-point order, null last, weigh ``weights`` in turn and divide ``share``
    of all words; a target stops at ``cap`` times its source's size and the excess goes to
    the others by weight.  With sources in the order of cap over weight this settles in
    one pass: if all before a source are capped, the rest divide what is left at some
    words for each unit of weight, and the largest such level is the final one.
    The table has a row per source; the windows over it see no documents.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("sid") - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("sid", rank.cast("long")).withColumn("w", weight).withColumn("most", cap * F.col("source_size"))
    order = Window.orderBy(F.col("most") / F.col("w"), "sid")
    everything = Window.partitionBy()
    s = s.withColumn("before", F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("open", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("level", F.max((share * F.sum("source_size").over(everything) - F.col("before")) / F.col("open")).over(everything))
    return s.select("sid", "source", "source_size", F.least("most", F.col("w") * F.col("level")).alias("target"))


def _network(x: Column, a: Column, b: Column, keys: tuple[Column, ...], seed: int) -> Column:
    """A keyed Feistel network over pairs of a number below ``a`` and one below ``b``, four half-rounds; ``x`` is a pair as one number."""
    left, right = F.floor(x / b), x % b
    for k in range(2):
        left = F.pmod(left + F.pmod(F.xxhash64(right, *keys, F.lit(seed + 2 * k)), a), a)
        right = F.pmod(right + F.pmod(F.xxhash64(left, *keys, F.lit(seed + 2 * k + 1)), b), b)
    return left * b + right


def _permuted(index: Column, n: Column, sid: Column, turn: Column, seed: int) -> Column:
    """A pseudorandom permutation of 0 to n-1 for each source and turn.

    The network permutes 0 to a*b-1, where a*b exceeds n by less than the root of n.  A
    number from n on goes through it again until it is below n: for n up to WALK^2 within
    WALK times for certain, beyond but for a chance of WALK^-WALK.
    """
    a = F.greatest(F.lit(1), F.ceil(F.sqrt(n.cast("double")))).cast("long")
    b = F.ceil(n / a).cast("long")
    once = lambda x: _network(x, a, b, (sid, turn), seed)
    return F.aggregate(F.sequence(F.lit(2), F.lit(WALK)), once(index), lambda x, _: F.when(x < n, x).otherwise(once(x)))


def streams(docs: DataFrame, *, id_col: str, text_col: str, source_col: str, buckets: int | None = None) -> DataFrame:
    """``doc_id, source, size, start``: the words of a document begin at ``start`` of its source's stream.

    A source's stream is ordered by bucket (a hash of the id) and id.  Sums by source and
    bucket are small and give each bucket's base; running sums then stay inside buckets, so
    that a source with a third of all rows is spread over ``buckets`` groups, by default one
    for every BUCKET_ROWS documents.
    """
    sized = stored(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size")), "sizes")
    buckets = buckets or max(64, sized.count() // BUCKET_ROWS)
    sized = sized.withColumn("bucket", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(buckets)))
    before = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(*keys[-1])
    sums = sized.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    base = sums.withColumn("base", F.sum("n").over(before("source", ["bucket"])) - F.col("n")).select(F.col("source").alias("s"), F.col("bucket").alias("b"), "base")
    inside = sized.withColumn("start", F.sum("size").over(before("source", "bucket", ["doc_id", "size"]).rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    return inside.join(base, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).select("doc_id", "source", "size", (F.col("start") + F.col("base")).alias("start"))


def _drawn(sources: DataFrame, shard_slots: int, seed: int) -> DataFrame:
    """``shard, sid, first, k``: of a source's slots a shard has the ``k`` from number ``first`` on.

    A slot draws its source with the chance that the source's total has in all; so a shard's
    counts are multinomial.  A source's slots are numbered by shard.  Those numbered beyond
    its total, about the root of all slots, go one by one, in order, to the sources drawn
    too seldom: both are ranges of numbers, and overlapping ranges join.
    """
    spark = sources.sparkSession
    total = sources.agg(F.sum("m")).first()[0] or 0
    running = F.sum("m").over(Window.orderBy("sid"))
    ranges = sources.where("m > 0").select("sid", "m", (running - F.col("m")).alias("from"), running.alias("to"))
    width = F.lit(-(-total // CELLS) or 1)
    cells = ranges.select("*", F.explode(F.sequence(F.floor(F.col("from") / width), F.floor((F.col("to") - 1) / width))).alias("cell"))
    if sources.count() <= BROADCAST_SOURCES:  # and at most CELLS rows more
        cells = F.broadcast(cells)
    slots = spark.range(0, total, 1, max(1, total // TASK_SLOTS)).select(F.floor(F.col("id") / shard_slots).alias("shard"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(total, 1))).alias("u"))
    drawn = slots.withColumn("cell", F.floor(F.col("u") / width)).join(cells, "cell").where((F.col("u") >= F.col("from")) & (F.col("u") < F.col("to")))
    counts = stored(drawn.groupBy("shard", "sid", "m").agg(F.count("*").alias("k")), "draws")
    counts = counts.withColumn("first", F.sum("k").over(Window.partitionBy("sid").orderBy("shard")) - F.col("k"))
    own = F.greatest(F.lit(0), F.least(F.col("k"), F.col("m") - F.col("first")))
    kept = counts.withColumn("own", own)
    over = kept.where("own < k").select("shard", "sid", (F.col("k") - F.col("own")).alias("x"))
    over = over.withColumn("b", F.sum("x").over(Window.orderBy("sid", "shard"))).select("shard", (F.col("b") - F.col("x")).alias("a"), "b")
    had = counts.groupBy("sid").agg(F.sum("k").alias("had"))
    short = sources.where("m > 0").join(had, "sid", "left").withColumn("had", F.coalesce("had", F.lit(0))).where("had < m").select("sid", "had", (F.col("m") - F.col("had")).alias("y"))
    short = short.withColumn("d", F.sum("y").over(Window.orderBy("sid"))).select("sid", "had", (F.col("d") - F.col("y")).alias("c"), "d")
    low, high = F.greatest("a", "c"), F.least("b", "d")
    moved = over.join(short, (F.col("a") < F.col("d")) & (F.col("c") < F.col("b"))).select("shard", "sid", (F.col("had") + low - F.col("c")).alias("first"), (high - low).alias("k"))
    return kept.where("own > 0").select("shard", "sid", "first", F.col("own").alias("k")).unionByName(moved)


def plan(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5,
    cap: float = 2.0, block_words: int = 128, shard_slots: int = 8192, buckets: int | None = None, seed: int = 42,
) -> tuple[DataFrame, DataFrame]:
    """The mix: documents with their places, and the slots of all shards.

    Documents: ``doc_id, sid, source_size, target, size, start``.  Slots: ``shard, sid,
    slot, block``: the block of a source that one of the shard's slots takes.  A source with
    n blocks fills ``round(target * n / source_size)`` slots, at most ``cap`` * n, so a block
    is taken at most ``cap`` (a whole number of) times.
    """
    placed = streams(docs, id_col=id_col, text_col=text_col, source_col=source_col, buckets=buckets)
    placed = stored(placed, "placed")
    sources = targets(placed.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    blocks = F.ceil(F.col("source_size") / block_words)
    slots = F.least(F.floor(cap * F.col("n")), F.round(F.col("target") * F.col("n") / F.col("source_size"))).cast("long")
    sources = stored(sources.withColumn("n", blocks).withColumn("m", F.coalesce(F.when(F.col("source_size") > 0, slots), F.lit(0))), "sources")
    few = F.broadcast(sources) if sources.count() <= BROADCAST_SOURCES else sources
    named = few.select(F.col("source").alias("named"), "sid", "source_size", "target")
    placed = placed.join(named, F.col("source").eqNullSafe(F.col("named"))).drop("source", "named")
    pieces = stored(_drawn(sources, shard_slots, seed), "pieces")
    # A piece is at most a shard's slots.  The number of partitions is given, since few rows become many.
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), (pieces.agg(F.sum("k")).first()[0] or 0) // TASK_SLOTS)
    spread = pieces.repartition(tasks, "shard", "sid", "first").join(few.select("sid", "n"), "sid")
    filled = spread.select("shard", "sid", "n", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("k") - 1)).alias("slot"))
    block = _permuted(F.col("slot") % F.col("n"), F.col("n"), F.col("sid"), F.floor(F.col("slot") / F.col("n")), seed)
    return placed, filled.select("shard", "sid", "slot", block.alias("block"))


def mix(docs: DataFrame, *, block_words: int = 128, **options) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every row of ``docs``.

    ``taken`` is the words of the document in the mix, repeats counted.  Documents of no
    word (null or blank text) take 0; a null source is a source of its own; null ids order
    first; rows that repeat an id are placed one after the other; other columns are
    ignored.  The same rows give the same mix, however they are partitioned.
    """
    placed, slots = plan(docs, block_words=block_words, **options)
    times = slots.groupBy("sid", "block").agg(F.count("*").alias("times"))
    span = F.sequence(F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words))
    held = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words) - F.greatest("start", F.col("block") * block_words)
    parts = placed.where("size > 0").select("*", F.explode(span).alias("block")).withColumn("held", held)
    # Spark's estimate of ``times`` is that of the counts before their explode, far too small; a merge join keeps it from being broadcast.
    whole = parts.join(times.hint("merge"), ["sid", "block"], "left").groupBy("doc_id", "sid", "start", "size", "source_size", "target").agg(F.sum(F.col("held") * F.coalesce("times", F.lit(0))).alias("taken"))
    empty = placed.where("size = 0").withColumn("taken", F.lit(0))
    columns = ["doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken")]
    return whole.select(*columns).unionByName(empty.select(*columns))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents."""
    return mix(table(spark, sf_dir, "documents"))


QUERIES = {"op8_source_mixing": op8_source_mixing}
SQL: dict[str, str] = {}
