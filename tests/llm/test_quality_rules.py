import base64
import random

import numpy as np
import pytest
import zstandard

from claimstone.llm import quality_rules as qr
from claimstone.llm import ragged


def words_of(text):
    return [w for w in "".join(" " if c in "\t\n\x0b\x0c\r " else c for c in text).split(" ") if w]


def naive(text):
    text = text or ""
    w = words_of(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    covered = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(3)} if len(w) < 3000 else None
    lines = [x for x in text.split("\n") if words_of(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), None if covered is None else len(covered)


def band_rejects(text):
    raw = (text or "").encode()

    def odd(x):
        ratio = len(zstandard.ZstdCompressor(level=3).compress(x)) / len(x)
        limits = [b for b in qr.BANDS if b[0] <= len(x)]
        return bool(limits) and not limits[-1][1] <= ratio <= limits[-1][2]

    chunks = [raw[i : i + 4096] for i in range(0, len(raw), 4096)]
    return bool(raw) and (odd(raw) or sum(len(c) for c in chunks if odd(c)) > 0.2 * len(raw))


TEXTS = [None, "", " \n\t", "a", "a b", "a b c a b c", "a a a a", "x\nx\n x\nx\n\n\n \n", "é ü # <b>|& 50%$*", "a b c d\x1ce\x85f", "one two three " * 40, "# " * 100]


@pytest.mark.parametrize("text", TEXTS)
def test_measures(text):
    got = qr.describe((text or "").encode(), zstandard.ZstdCompressor(level=3))
    assert got[1:6] == naive(text)


def test_all_documents_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for r in rows:
        n, chars, symbols, lines, _ = naive(r.text)
        w = words_of(r.text or "")
        count, covered = {}, set()
        for i in range(n - 2):
            count.setdefault(tuple(w[i : i + 3]), []).append(i)
        for places in count.values():
            if len(places) > 1:
                covered |= {p + k for p in places for k in range(3)}
        failed = n < 50 or 100 * len(covered) > 50 * n
        want[r.doc_id] = (n, chars, symbols, lines, len(covered), failed, not failed and not band_rejects(r.text))
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in qr.op12_quality_rules(spark, sf_dir).collect()}
    assert got == want


def test_good_labels_are_kept(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    kept = qr.op12_quality_rules(spark, sf_dir).join(labels, "doc_id")
    assert kept.where("not base_failed and not kept").count() == 0


def test_bands():
    r = random.Random(5)
    vocabulary = ["".join(r.choices("etaoinshrdlu", k=r.randint(2, 9))) for _ in range(3000)]
    prose = " ".join(r.choices(vocabulary, k=6000))
    noise = base64.b64encode(r.randbytes(30_000)).decode()
    line = "all work and no play makes a dull day of it "
    z = zstandard.ZstdCompressor(level=3)

    def odd(text):
        got = qr.describe(text.encode(), z)
        return got[-1] > qr.CHUNK_SHARE * got[0]

    assert not odd(prose) and not odd(prose[:3000]) and not odd(prose[:300]) and not odd(prose[:60])
    assert odd(noise) and odd(noise[:1500]) and odd(line * 500) and odd(line * 20)
    assert odd(prose + line * 300), "a repetitive part of a long text, hidden in the ratio of the whole"
    assert not odd(prose + line * 30)


def test_slices_keep_words(monkeypatch):
    text = ("ab " * 50 + "x" * 500 + "\n" + "y é ").encode() * 3
    whole = qr.describe(text, zstandard.ZstdCompressor())
    monkeypatch.setattr(ragged, "SLICE", 16)
    assert qr.describe(text, zstandard.ZstdCompressor()) == whole
    assert b"".join(ragged.slices(text)) == text


def test_very_long_text():
    got = qr.describe(b"lorem ipsum " * 1_000_000, zstandard.ZstdCompressor(level=3))
    assert got[1] == got[5] == 2_000_000 and got[-1] == got[0]


def test_repeated_words_by_windows():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 50, 200):
        a = r.integers(0, 4, n).astype(np.int32)
        windows = [tuple(a[i : i + 3]) for i in range(max(0, n - 2))]
        want = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(3)}
        assert qr.repeated_words(a) == len(want)


def test_odd_rows(spark):
    rows = [(1, None, 3), (None, "a b", 3), (2, "w " * 60, 3), (2, "w " * 60, 3)]
    got = [(r.doc_id, r.n_words, r.base_failed, r.kept) for r in qr.assess(spark.createDataFrame(rows, "doc_id long, text string, n_words int")).collect()]
    assert sorted(got, key=str) == sorted([(1, 0, True, False), (None, 2, True, False), (2, 60, True, False), (2, 60, True, False)], key=str)
    assert qr.assess(spark.createDataFrame([], "doc_id long, text string")).count() == 0
