import random

import pytest
import xxhash

from claimstone.llm import simhash
from claimstone.operators.graph import connected_components
from tests.test_operators import components_of


def naive(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r " else c for c in text).split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "one TWO", "a b c", "a b c d a b c", "É x y\x1cz ÀB c d", "w " * 3000, " lead\x0b\x0cand\rtail "])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == naive(text)


@pytest.mark.parametrize("bucket", [64, 3])
def test_links_connect_what_is_near(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET_PAIRS", bucket)
    r = random.Random(bucket)
    prints = {0, 1 << 63, (1 << 64) - 1}
    for _ in range(60):
        x = r.getrandbits(64)
        for _ in range(6):
            prints.add(x)
            for _ in range(r.randint(1, 4)):
                x ^= 1 << r.choice([r.randrange(64), 31, 32, 63])
    prints = sorted(prints)
    near = [(i, j) for i, x in enumerate(prints) for j, y in enumerate(prints[:i]) if (x ^ y).bit_count() <= 2]
    nodes = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x, i) for i, x in enumerate(prints)], "fp long, rep long")
    got = {r.node: r.component for r in connected_components(simhash.links(nodes)).collect()}
    assert got == components_of(near)


def test_all_documents_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    prints = {r.doc_id: naive(r.text) for r in rows}
    ids = sorted(prints)
    labels = components_of([(a, b) for i, a in enumerate(ids) for b in ids[:i] if (prints[a] ^ prints[b]).bit_count() <= 2])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op2_simhash_near_dup(spark, sf_dir).collect()}
    assert got == {i: (f"{prints[i]:016x}", labels.get(i, i)) for i in ids}


def test_odd_rows(spark):
    rows = [(1, None, 0), (2, "", 0), (None, "", 0), (4, "a b c d", 0), (3, "a b c d", 0), (3, "a b c d", 0), (None, "q r s t", 0)]
    got = [(r.doc_id, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp int")).collect()]
    assert sorted(got, key=str) == sorted([(1, 1), (2, 1), (None, None), (4, 3), (3, 3), (3, 3), (None, None)], key=str)


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
