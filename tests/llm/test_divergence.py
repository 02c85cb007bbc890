import random
import re
import tracemalloc
from collections import Counter

import duckdb

from claimstone.llm import divergence
from tests.compare import duck_rows, spark_rows


def naive(rows, min_documents=10, top=10):
    """rows: (text, lang, source)."""
    lower = str.maketrans(divergence.UPPER, divergence.LOWER)
    docs = [(re.findall(divergence.TERM, (t or "").translate(lower)), lang or "", s or "") for t, lang, s in rows]
    out = []
    for lang in {d[1] for d in docs}:
        own = [(w, s) for w, x, s in docs if x == lang]
        df = Counter(t for w, _ in own for t in set(w))
        kept = {t for t, n in df.items() if n >= min_documents}
        counts = {s: Counter() for _, s in own}
        for w, s in own:
            counts[s].update(t for t in w if t in kept)

        def shares(c, kept=kept):
            return {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in counts.items()}, shares(sum(counts.values(), Counter()))
        for s in counts:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // (p[s][t] + p[o][t]) for t in kept), o.encode()) for o in counts if o != s]
            terms = [(-((p[s][t] - q[t]) ** 2 // (p[s][t] + q[t])), t.encode()) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item.decode(), -value, i + 1) for i, (value, item) in enumerate(found)]
    return sorted(out)


def made(n, seed):
    r = random.Random(seed)
    words = ["The", "the,", "don't", "x1y2", "42", "Été", "été.", "naïve—yes", " nb", "日本", "𝒳z", "a-b-a", "ÉCOLE", "&", "end\x0b\x0cnext"] + [f"w{'abcdefgh'[i]}" for i in range(8)]
    rows = [("".join(r.choice(words) + r.choice([" ", "\n", "\t"]) for _ in range(r.randint(0, 30))), r.choice(["en", "de", None, ""]), r.choice(["s1", "s2", None, "é", "𝒳", "￿"])) for _ in range(n)]
    return rows + [(None, "en", "s1"), ("", "fr", "only"), (None, "fr", "other"), ("few terms", "xx", "a")] + rows[:5]


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def test_against_brute_force(spark):
    rows = made(300, 1)
    assert got(divergence.audit(spark.createDataFrame(rows, "text string, lang string, source string"))) == naive(rows)


def test_small_blocks_tiles_and_parts(spark):
    rows = made(120, 2)
    df = spark.createDataFrame(rows, "text string, lang string, source string").withColumn("chunk", divergence.F.lit(1)).withColumn("no", divergence.F.lit("x"))
    assert got(divergence.audit(df, min_documents=3, top_terms=4, tile=2, part_rows=7, block_documents=5)) == naive(rows, 3, 4)


def test_documents_are_distinct(spark):
    rows = [("The the THE the, other", "en", "a"), ("the", "en", "a"), ("the", "en", "b")]
    documents, counts = divergence.term_counts(spark.createDataFrame(rows, "text string, lang string, source string"))
    assert {r.term: r.documents for r in documents.collect()} == {"the": 3, "other": 1}
    assert {(r.source, r.term): r.n for r in counts.collect()} == {("a", "the"): 5, ("b", "the"): 1, ("a", "other"): 1}


def test_rows_of_a_block():
    block = divergence._Block(3)
    for text in ("a b a", "b c", ""):
        block.add("en", 7, text.upper().encode())
    rows = {r["chunk"]: (r["docs"], r["sources"], r["counts"]) for r in block.rows().to_pylist()}
    assert rows == {b"a": ([0], [7], [2]), b"b": ([0, 1], [7], [2]), b"c": ([1], [7], [1])}
    assert divergence._Block(1).rows().num_rows == 0


def test_very_long_text(spark):
    rows = [("lorem ipsum " * 200_000, "en", "a")] + [("lorem", "en", "b")] * 10
    assert got(divergence.audit(spark.createDataFrame(rows, "text string, lang string, source string"))) == naive(rows)


def test_large_counts_stay_exact(spark):
    big = 10**17 + 7
    row = spark.range(1).select(divergence.share(divergence.F.lit(big), divergence.F.lit(3 * big), divergence.F.lit(5)).alias("p")).first()
    assert row.p == 1 + 10**9 * (big + 2) // (3 * big + 10)


def test_empty(spark):
    assert divergence.audit(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_sql_on_odd_rows(spark, tmp_path):
    spark.createDataFrame(made(200, 3), "text string, lang string, source string").coalesce(1).write.parquet(str(tmp_path / "d"))
    connection = duckdb.connect()
    connection.execute(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    want = duck_rows(connection, divergence.SQL["op11_source_divergence"])[1]
    assert spark_rows(divergence.audit(spark.read.parquet(str(tmp_path / "d")))) == want


def test_query(spark, sf_dir, duck):
    assert spark_rows(divergence.op11_source_divergence(spark, sf_dir)) == duck_rows(duck, divergence.SQL["op11_source_divergence"])[1]


def test_a_blocks_rows_take_little_beside_its_keys():
    r = random.Random(5)
    words = [f"w{i}" for i in range(20_000)]
    block = divergence._Block(0)
    for _ in range(400):
        block.add("en", r.randrange(5), " ".join(r.choices(words, k=1000)).encode())
    keys = 8 * 400_000
    tracemalloc.start()
    block.rows()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 7.5 * keys and not block.keys
