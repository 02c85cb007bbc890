import random

import pytest

from claimstone.llm import mixing


def reshared(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    """The excess of capped sources given to the others by weight, until none is above."""
    names = sorted(sizes, key=lambda n: (n is None, n or ""))
    w = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    capped: set = set()
    while True:
        left = share * sum(sizes.values()) - sum(cap * sizes[n] for n in capped)
        rest = [n for n in names if n not in capped]
        target = {n: cap * sizes[n] for n in capped} | {n: left * w[n] / sum(w[m] for m in rest) for n in rest}
        above = [n for n in rest if target[n] > cap * sizes[n] + 1e-9]
        if not above:
            return target
        capped |= set(above)


@pytest.mark.parametrize("seed", range(6))
def test_targets(spark, seed):
    r = random.Random(seed)
    sizes = {n: r.choice([0, 1, 10, 100, 1000, 7000]) for n in ["b", "a", "\U00010000", "￿", "ab", "", None][: r.randint(1, 7)]}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df, (3, 1, 2), 1.5, 2.0).collect()}
    assert got == pytest.approx(reshared(sizes) if sum(sizes.values()) else dict.fromkeys(sizes, 0.0))


def test_every_block_as_often_as_planned(spark):
    r = random.Random(1)
    rows = [(i, " ".join(["w"] * r.choice([0, 1, 5, 128, 500])), r.choice(["x", "y", "z", None]), 7) for i in range(150)] + [(150, None, "x", 7), (None, "a b", "x", 7), (3, "a b c", "x", 7), (3, "a b c", "x", 7), (151, "w " * 30_000, "y", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    _, slots = mixing.plan(docs, block_words=16, shard_slots=64, buckets=4)
    slots = slots.collect()
    used: dict = {}
    for s in slots:
        used.setdefault(s.sid, []).append(s.block)
    for blocks in used.values():
        n = max(blocks) + 1
        assert all(blocks.count(b) <= 2 for b in set(blocks))
        assert min(blocks) == 0 and (len(blocks) < n or set(blocks) == set(range(n)))
    assert len({s.shard for s in slots}) > 3
    mixed = mixing.mix(docs, block_words=16, shard_slots=64, buckets=4).collect()
    times: dict = {}
    for s in slots:
        times[s.sid, s.block] = times.get((s.sid, s.block), 0) + 1
    placed, _ = mixing.plan(docs, block_words=16, shard_slots=64, buckets=4)
    want = sorted((str(d.doc_id), d.size, sum(times.get((d.sid, w // 16), 0) for w in range(d.start, d.start + d.size))) for d in placed.collect())
    assert sorted((str(m.doc_id), m.size, m.taken) for m in mixed) == want
    assert len(mixed) == len(rows) and all(0 <= m.taken <= 2 * m.size for m in mixed)
    again = mixing.mix(docs.repartition(7), block_words=16, shard_slots=64, buckets=4).collect()
    assert sorted(map(str, mixed)) == sorted(map(str, again))


def test_all_documents(spark):
    rows = mixing.op8_source_mixing(spark, "/root/testdata/sf0.01").collect()
    source = {r.doc_id: r.source for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source").collect()}
    sizes, taken, target = {}, {}, {}
    for r in rows:
        s = source[r.doc_id]
        sizes[s] = sizes.get(s, 0) + r.size
        taken[s] = taken.get(s, 0) + r.taken
        target[s] = r.target
        assert r.taken <= 2 * r.size
    assert target == pytest.approx(reshared(sizes))
    assert all(abs(taken[s] - target[s]) <= 128 + 0.01 * target[s] for s in sizes)
    assert all(r.source_size == sizes[source[r.doc_id]] for r in rows)


def test_permutations(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 7, 1000):
        df = spark.range(n).select(mixing._permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3).cast("long"), F.lit(1).cast("long"), 42).alias("p"))
        assert sorted(r.p for r in df.collect()) == list(range(n))


@pytest.mark.parametrize("n", [1024, 65536, 15015])
def test_neighbours_do_not_stay_neighbours(spark, n):
    from pyspark.sql import functions as F

    df = spark.range(n).select("id", mixing._permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3).cast("long"), F.lit(1).cast("long"), 42).alias("p"))
    p = [r.p for r in df.orderBy("id").collect()]
    assert sorted(p) == list(range(n))
    strides = {}
    for a, b in zip(p, p[1:], strict=False):
        strides[(b - a) % n] = strides.get((b - a) % n, 0) + 1
    assert max(strides.values()) < 20 + n / 100 and len(strides) > n / 3


def test_shards_are_multinomial_and_totals_exact(spark):
    sources = spark.createDataFrame([(1, 5000), (2, 20_000), (3, 1), (4, 0), (5, 15_000)], "sid long, m long")
    rows = mixing._drawn(sources, 512, 42).collect()
    held, shards = {}, {}
    for r in rows:
        held.setdefault(r.sid, []).extend(range(r.first, r.first + r.k))
        shards.setdefault(r.shard, {}).setdefault(r.sid, 0)
        shards[r.shard][r.sid] += r.k
    assert {s: sorted(v) for s, v in held.items()} == {1: list(range(5000)), 2: list(range(20_000)), 3: [0], 5: list(range(15_000))}
    sizes = [sum(v.values()) for _, v in sorted(shards.items())]
    assert sizes[:-1] == [512] * (len(sizes) - 1) and sum(sizes) == 40_001
    share = [v.get(2, 0) / 512 for _, v in sorted(shards.items())[:-1]]
    spread = sum((x - 0.5) ** 2 for x in share) / len(share)
    assert 0.3 < spread / (0.25 / 512) < 3  # the variance of draws, not of fixed shares


def test_empty(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
