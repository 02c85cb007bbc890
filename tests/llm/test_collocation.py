import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from claimstone.llm import collocation
from tests.compare import duck_rows, spark_rows


def pieces_of(text):
    text = (text or "").translate(str.maketrans(collocation.UPPER, collocation.LOWER))
    for c in ".,;:!?\n\x0b\x0c\r":
        text = text.replace(c, "\n")
    return [[w for w in p.replace("\t", " ").split(" ") if w] for p in text.split("\n")]


def naive(rows, min_count=100, top=2000, percent=100):
    """rows: (text, lang)."""
    out = []
    for lang in {x or "und" if x is None else x for _, x in rows}:
        f = Counter()
        for text, x in rows:
            if ("und" if x is None else x) == lang:
                for p in pieces_of(text):
                    f.update(" ".join(p[i : i + k]) for k in range(1, 6) for i in range(len(p) - k + 1))
        n = sum(c for p, c in f.items() if " " not in p)
        found = {p: c for p, c in f.items() if " " in p and c >= min_count}
        scored = []
        for p, a in found.items():
            w = p.split(" ")
            score, _, left, right = min((1000 * a * n // (f[" ".join(w[:k])] * f[" ".join(w[k:])]), k, f[" ".join(w[:k])], f[" ".join(w[k:])]) for k in range(1, len(w)))
            if not any(len(q.split(" ")) > len(w) and f" {p} " in f" {q} " and 100 * c >= percent * a for q, c in found.items()):
                scored.append((-score, -a, p.encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -score) for i, (score, a, p, left, right) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def made(n, seed):
    r = random.Random(seed)
    words = ["The", "of", "house", "a", "été", "É", "日本", "x\x1fy", "don't", "\x85"]
    fixed = ["in the house of", "a b a b a b a b", "The End", "one two three four five six"]
    rows = []
    for _ in range(n):
        parts = [r.choice(fixed) if r.random() < 0.3 else r.choice(words) for _ in range(r.randint(0, 25))]
        rows.append(("".join(p + r.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\r\n", "\x0b"]) for p in parts), r.choice(["en", "en", "de", None, "und"])))
    return rows + [(None, "en"), ("", None), ("only", "fr"), *rows[:3]]


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize(("block", "shard", "ranked", "percent", "top"), [(1 << 18, 200_000, 50_000, 100, 2000), (3, 7, 2, 60, 5), (40, 50, 9, 100, 30)])
def test_against_brute_force(spark, block, shard, ranked, percent, top):
    rows = made(200, block)
    df = spark.createDataFrame(rows, "text string, lang string").withColumn("words", collocation.F.lit(1)).withColumn("a", collocation.F.lit("x"))
    result = collocation.collocations(df, min_count=10, inside_percent=percent, top=top, block_tokens=block, shard=shard, ranked_rows=ranked)
    want = naive(rows, 10, top, percent)
    assert want and got(result) == want


def test_double_array():
    r = random.Random(4)
    words = [f"w{i}".encode() for i in range(60)]
    phrases = sorted({(r.choice(["en", "de"]), b" ".join(r.choice(words[:8] if r.random() < 0.7 else words) for _ in range(r.randint(1, 5)))) for _ in range(1500)})
    trie = collocation.DoubleArray(phrases)
    numbers = {p: i for i, p in enumerate(phrases)}
    block = [r.randrange(0, 80) for _ in range(4000)]
    names = [f"w{i}".encode() for i in range(80)]
    want = Counter()
    for i in range(3000):
        for k in range(1, 6):
            part = block[i : i + k]
            if len(part) == k and 0 not in part:
                p = ("de", b" ".join(names[t - 1] for t in part))
                want[numbers.get(p, -1)] += 1
    counts = np.zeros(len(phrases), np.int64)
    trie.count("de", names, np.array(block, np.int32), 3000, counts)
    trie.count("xx", names, np.array(block, np.int32), 3000, counts)
    want.pop(-1)
    assert {i: n for i, n in enumerate(counts.tolist()) if n} == want
    assert len(trie.base) < 4 * 5 * trie.digits * len(phrases)


def test_many_words_fill_the_arrays():
    r = random.Random(6)
    phrases = sorted({("en", b" ".join(b"w%d" % min(int(r.paretovariate(0.5)), 30_000) for _ in range(r.randint(2, 5)))) for _ in range(60_000)})
    trie = collocation.DoubleArray(phrases)
    states = int((trie.check >= 0).sum()) + 1
    assert trie.digits == 2 and len(trie.base) < 2 * states + 2000
    names = [w for w in trie.words]
    text = [names.index(w) + 1 for _, p in phrases[::5000] for w in p.split(b" ")]
    counts = np.zeros(len(phrases), np.int64)
    trie.count("en", names, np.array(text, np.int32), len(text), counts)
    assert (counts[::5000] > 0).all()


def test_one_wide_node():
    phrases = sorted(("en", f"a w{i:05}".encode()) for i in range(20_000))
    trie = collocation.DoubleArray(phrases)
    counts = np.zeros(len(phrases), np.int64)
    trie.count("en", [b"a", b"w00007", b"w19999"], np.array([1, 2, 1, 3, 1, 0, 2], np.int32), 7, counts)
    assert counts[7] == counts[19_999] == 1 and counts.sum() == 2


def test_colliding_hashes_add_nothing(spark, monkeypatch):
    rows = made(120, 9)
    monkeypatch.setattr(collocation, "_bits", lambda hashes: np.full(1 << collocation.FILTER_BITS - 6, (1 << 64) - 1, np.uint64))
    assert got(collocation.collocations(spark.createDataFrame(rows, "text string, lang string"), min_count=15)) == naive(rows, 15)


def test_a_text_without_ends_is_cut_in_blocks(spark):
    rows = [("a b c " * 60_000, "en"), ("a b c d", "en")]
    assert got(collocation.collocations(spark.createDataFrame(rows, "text string, lang string"), block_tokens=5000)) == naive(rows)


def test_empty(spark):
    assert collocation.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0
    assert collocation.collocations(spark.createDataFrame([(None, None), ("a b", "en")], "text string, lang string")).count() == 0


def test_sql_on_odd_rows(spark, tmp_path):
    spark.createDataFrame(made(1500, 3), "text string, lang string").coalesce(1).write.parquet(str(tmp_path / "d"))
    connection = duckdb.connect()
    connection.execute(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    want = duck_rows(connection, collocation.SQL["op13_phrase_collocations"])[1]
    assert want and spark_rows(collocation.collocations(spark.read.parquet(str(tmp_path / "d")))) == want


def test_query(spark, sf_dir, duck):
    want = duck_rows(duck, collocation.SQL["op13_phrase_collocations"])[1]
    assert want and spark_rows(collocation.op13_phrase_collocations(spark, sf_dir)) == want


def test_hashes_tell_words_apart():
    words = [f"{a}{b}ing{c}".encode() for a in "abcdefghij" for b in ("", "x", "long-middle-") for c in range(200)] + ["é".encode(), b"e"]
    h = collocation._word_hashes("en", pa.array(words, pa.binary()))
    assert len(set(h.tolist())) == len(words)
    assert not set(h.tolist()) & set(collocation._word_hashes("de", pa.array(words, pa.binary())).tolist())
    assert (collocation._word_hashes("en", pa.array(words, pa.binary()).slice(5, 40)) == h[5:45]).all()


def test_few_blocks_are_in_memory_together(spark, monkeypatch):
    """A task used to hold a row group of 128 MB of blocks when it wrote one and when it read one."""
    asked, kept = {}, collocation.stored

    def stored(df, label, **bounds):
        asked[label] = bounds, kept(df, label, **bounds)
        return asked[label][1]

    monkeypatch.setattr(collocation, "stored", stored)
    rows = made(200, 3)
    df = spark.createDataFrame(rows, "text string, lang string").coalesce(1)
    assert got(collocation.collocations(df, min_count=10, block_tokens=3)) == naive(rows, 10)
    groups = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in asked["blocks"][1].inputFiles()]
    assert sum(g.num_rows for g in groups) > 10 * collocation.TOGETHER
    assert all(g.row_group(i).num_rows <= collocation.TOGETHER for g in groups for i in range(g.num_row_groups))
    assert {label for label, (bounds, _) in asked.items() if bounds.get("batch") == collocation.TOGETHER} == {"words", "frequent-hashes", "candidates", "trie-counts"}
