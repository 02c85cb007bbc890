import hashlib
import random

import numpy as np
import pytest

from claimstone.llm import suffix

L = suffix.LENGTH


def brute(rows):
    first: dict[bytes, int] = {}
    known = [(suffix.NO_ID if i is None else i, (t or "").encode()) for i, t in rows]
    for i, b in known:
        for k in range(len(b) - L + 1):
            first[b[k : k + L]] = min(first.get(b[k : k + L], i), i)
    out = []
    for (i, _), (j, b) in zip(rows, known, strict=True):
        mask = bytearray(len(b))
        for k in range(len(b) - L + 1):
            if first[b[k : k + L]] < j:
                mask[k : k + L] = b"\1" * L
        kept = bytes(x for x, m in zip(b, mask, strict=True) if not m)
        spans = sum(1 for k in range(len(mask)) if mask[k] and (k == 0 or not mask[k - 1]))
        out.append((i, len(b), sum(mask), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def spans_of(spark, rows):
    df = suffix.removals(spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, id int, copy int"))
    return found(df.select("row.doc_id", "removal.*"))


def odd_rows():
    r = random.Random(5)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 7))) for _ in range(60)]
    base = [" ".join(r.choice(words) for _ in range(r.randint(1, 150))) for _ in range(12)]
    rows = []
    for i in range(100):
        t, own = r.choice(base), " ".join(r.choice(words) for _ in range(r.randint(0, 40)))
        a = r.randint(0, len(t))
        rows.append((r.randint(0, 100) if i % 9 else None, own + t[a : r.randint(a, len(t))] + r.choice(["", "a" * r.randint(40, 3000), own, "ab" * 60]) + r.choice(base)[: r.randint(0, 200)]))
    return rows + [(200, None), (201, ""), (202, "x" * 49), (203, "x" * 50), (204, "x" * 51), rows[3], rows[3]]


@pytest.mark.parametrize(("crowd", "piece", "run"), [(20_000, 1 << 16, 1024), (2, 1 << 16, 1024), (2, 100, 7), (20_000, 64, 5)])
def test_brute_force(spark, monkeypatch, crowd, piece, run):
    for name, value in (("CROWD", crowd), ("PIECE", piece), ("RUN", run), ("TEXT", 2000), ("PACK", 5000)):
        monkeypatch.setattr(suffix, name, value)
    rows = odd_rows()
    assert spans_of(spark, rows) == brute(rows)


def test_all_documents(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert found(suffix.op10_suffix_array_dedup(spark, sf_dir)) == brute(rows)


def test_interval_groups():
    r = random.Random(1)
    for trial in range(40):
        n = r.randint(1, 400)
        text = np.array([r.choice([97, 98, 256] if trial % 2 else [97, 98, 99, 100]) for _ in range(n)])
        length = r.choice([1, 3, 8, 50])
        order, group = suffix.shared_prefix_groups(text, length)
        prefix = [tuple(text[i : i + length]) for i in range(n)]
        by: dict[int, set] = {}
        for i, g in zip(order.tolist(), group.tolist(), strict=True):
            by.setdefault(g, set()).add(prefix[i])
        assert sorted(order.tolist()) == list(range(n))
        assert all(len(v) == 1 for v in by.values()) and len(by) == len(set(prefix))


def test_segments_say_the_same_of_equal_strings():
    r = random.Random(2)
    texts = [bytes(r.choice(b"abc") for _ in range(r.randint(0, 300))) for _ in range(30)]
    texts += [t[5:] + texts[0] for t in texts[:10]]
    anchors: dict[bytes, int] = {}
    strings = 0
    for i, a, n, key in zip(*(x.tolist() for x in suffix.segments(texts)), strict=True):
        for k in range(a, a + n):
            strings += 1
            assert anchors.setdefault(texts[i][k : k + L], key) == key
    assert strings == sum(max(0, len(t) - L + 1) for t in texts)


def test_text_stays_text(spark):
    rows = [(1, "é" * 60, 5, "r"), (2, "x" + "é" * 60 + "y", 6, "s"), (3, None, 7, "t"), (4, "é" * 60, 8, "u"), (5, "short", 9, "v")]
    got = suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, found int, row string")).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(1, "é" * 60, 5, "r"), (2, "xy", 6, "s"), (3, None, 7, "t"), (4, "", 8, "u"), (5, "short", 9, "v")]


def test_ids_must_be_numbers(spark):
    with pytest.raises(TypeError):
        suffix.removals(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_empty(spark):
    assert suffix.removals(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert suffix.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
