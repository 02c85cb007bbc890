"""Learned operators: held-out accuracy, and rows that aren't like the others."""

import zlib

import numpy as np
import pytest

from claimstone.llm import language, learning, quality, toxicity

SF = "/root/testdata/sf0.01"
ODD = [(1, None, 5), (2, "", 5), (3, "1234 !!", 5), (None, "some text", 5), (4, "word " * 40_000, 5), (4, "word " * 40_000, 5)]
SCHEMA = "doc_id long, text string, label int"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def auc(score, label):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    n1 = label.sum()
    return (rank[label].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(label) - n1))


@pytest.fixture(scope="module")
def labels(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}


def test_quality_held_out(spark, labels):
    rows = quality.op4_quality_convnet(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert auc(np.array([r.score for r in held]), np.array([labels[r.doc_id].quality == 1 for r in held])) > 0.9


def test_toxicity_held_out(spark, labels):
    held = [r for r in toxicity.op7_toxicity_chain(spark, SF).collect() if r.held_out and r.doc_id in labels]
    assert auc(np.array([r.p_toxic for r in held]), np.array([labels[r.doc_id].toxic == 1 for r in held])) > 0.8
    clean = [r for r in held if labels[r.doc_id].toxic == 0]
    assert np.mean([r.predicted for r in clean]) < 0.05


def test_language_held_out(spark):
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [r for r in language.op9_language_id(spark, SF).collect() if r.held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in held)
    assert np.mean([docs[r.doc_id] == r.lang_pred for r in held]) > 0.97


def test_language_of_odd_texts():
    p = language.Profiles([("x", int(g), i) for i, g in enumerate(language.profile("the then them the"))])
    assert p.predict("") == ("und", 0.0) and p.predict("12 \U0001f600!") == ("und", 0.0)
    assert p.predict("the then them the") == ("x", 1.0)
    assert p.predict("\U00010400\U00010401")[0] == "x"  # letters beyond the basic plane
    assert language.Profiles([]).predict("the") == ("und", 0.0)


def test_profile_order():
    """Counts fall, ties go by value; an n-gram never has a blank inside."""
    values = language.profile("ab ab b")
    names = []
    for v in values.tolist():
        kind, v = (3, v ^ 1 << 61) if v >> 61 else (2, v ^ 1 << 60) if v >> 60 else (1, v)
        names.append("".join(chr(v >> 16 * k & 0xFFFF) for k in reversed(range(kind))).replace("\0", "_"))
    assert names[:3] == ["b", "b_", "a"] and set(names) == {"b", "b_", "a", "_a", "ab", "_b", "_ab", "ab_", "_b_"}


def test_odd_rows_are_scored(spark):
    docs = frame(spark, ODD, SCHEMA)
    network, chain = quality.Network(), toxicity.Chain([], toxicity.View(*(np.zeros(0, np.int64) for _ in range(3))), [np.array([*[0] * i, -1.0]) for i in (0, 1, 2, 6)])
    assert all(0 <= r.score <= 1 for r in quality.score(docs, network).collect()) and quality.score(docs, network).count() == len(ODD)
    assert toxicity.score(docs, chain).count() == len(ODD)
    assert [r.guess.lang_pred for r in language.identify(docs.where("doc_id < 3"), language.Profiles([("x", 97, 0)])).collect()] == ["und", "und"]


def test_nothing_to_learn_from(spark):
    docs, none = frame(spark, [(1, "a text")], "doc_id long, text string"), frame(spark, [(None, None, None)], "doc_id long, quality int, toxic int")
    assert 0 < quality.score(docs, quality.train(docs, none)).first().score < 1
    assert toxicity.score(docs, toxicity.train(docs, none)).first().toxicity[-1] < 0.01
    assert language.train(docs.withColumn("lang", docs.text.substr(9, 1))).langs in ([""], [])


def test_gradients_are_right():
    net = quality.Network(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    docs = [quality.chunks_of("abc! " * 120), quality.chunks_of("Word and word. " * 9)]
    chunks, starts, y = np.concatenate(docs), np.array([0, len(docs[0])]), np.array([1.0, 0.0])

    def loss():
        s = learning.sigmoid(net.combined(net.pooled(chunks), starts) @ net.p["out"] + net.p["bias"])
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    found = net.gradients(chunks, starts, y)
    for name in net.p:
        flat, grad = net.p[name].reshape(-1), found[name].reshape(-1)
        for i in np.argsort(-np.abs(grad))[:5]:
            keep, step = flat[i], 1e-5
            flat[i] = keep + step
            up = loss()
            flat[i] = keep - step
            down = loss()
            flat[i] = keep
            assert abs((up - down) / (2 * step) - grad[i]) < 1e-4 + 0.02 * abs(grad[i]), name


def test_chunks_cover_all_bytes():
    for n in (0, 1, 255, 256, 257, 480, 481, 5000):
        text = "".join(chr(33 + i % 90) for i in range(n))
        chunks = quality.chunks_of(text)
        step = quality.CHUNK - quality.OVERLAP
        whole = bytearray(step * (len(chunks) - 1) + quality.CHUNK)
        for k, c in enumerate(chunks):
            whole[k * step : k * step + quality.CHUNK] = c.tobytes()
        assert bytes(whole)[:n] == text.encode() and not any(whole[n:]) and len(whole) - n < max(quality.CHUNK, step) + 1


def test_linear_model():
    r = np.random.default_rng(0)
    x = r.normal(size=(400, 3))
    y = (x @ [2, -1, 0] + 0.5 + r.logistic(size=400) > 0).astype(float)
    w = learning.fit_linear(x, y)
    assert np.mean((x @ w[:-1] + w[-1] > 0) == y) > 0.75 and abs(w[2]) < 0.4
    assert learning.sigmoid(learning.fit_linear(x, np.zeros(400))[-1]) < 0.01


def brute_score(p, text):
    """The network of one text, window by window."""
    data = text.encode()
    step = quality.CHUNK - quality.OVERLAP
    n = max(1, -(-(len(data) - quality.OVERLAP) // step))
    values = []
    for k in range(n):
        chunk = data[k * step : k * step + quality.CHUNK].ljust(quality.CHUNK, b"\0")
        rows = [np.concatenate([p["embed"][b] for b in chunk[i : i + quality.WIDTH]]) @ p["filters"] for i in range(quality.CHUNK - quality.WIDTH + 1)]
        values.append(np.tanh(np.max(rows, axis=0) + p["shift"]))
    d = np.concatenate([np.mean(values, axis=0), np.max(values, axis=0), np.min(values, axis=0)])
    return 1 / (1 + np.exp(-(d @ p["out"] + p["bias"][0])))


def test_scores_against_every_window():
    net = quality.Network(5)
    texts = ["", "a", "word " * 300, "é" * 1000, "x" * 256, "y z" * 90]
    assert net.score(texts) == pytest.approx([brute_score(net.p, t) for t in texts], abs=1e-5)


def test_one_row_for_each_labelled_id(spark):
    docs = frame(spark, [(1, "b"), (1, "a"), (1, "a"), (2, "c"), (3, None), (None, "d")], "doc_id long, text string")
    labels = frame(spark, [(1, 0), (1, 1), (2, None), (3, 0), (4, 1), (None, 1)], "doc_id long, quality int")
    got = learning.labelled_sample(docs, labels, label="quality", rows=10, folds=1, held=1).collect()
    assert sorted((r.doc_id, r.label) for r in got) == [(1, 1), (3, 0)] and len(got) == 2
    assert learning.labelled_sample(docs, labels, label="quality", rows=1, folds=1, held=1).count() == 1


def test_empty_tables(spark):
    docs = frame(spark, [], "doc_id long, text string, lang string")
    assert quality.score(docs, quality.Network()).count() == 0
    assert language.identify(docs, language.train(docs)).count() == 0
    none = frame(spark, [], "doc_id long, quality int, toxic int")
    assert toxicity.score(docs, toxicity.train(docs, none)).count() == 0


def test_languages_learn_from_the_smallest_hashes(spark, monkeypatch):
    rows = [(i, f"{lang} text {i}", lang) for lang, n in (("x", 400), ("y", 30), ("z", 3)) for i in range(1000 * n, 1000 * n + n)] + [(1, "again", "x")] * 50
    df = frame(spark, rows, "doc_id long, text string, lang string")
    seen = []
    monkeypatch.setattr(language, "stored", lambda d, label: (seen.append(d.collect()) if label == "ids" else None) or d)
    language.train(df, rows=20)
    got = {lang: sum(r.lang == lang for r in seen[0]) for lang in "xyz"}
    assert got["x"] == 20 and got["y"] == 20 and 1 <= got["z"] <= 3 and len(set(seen[0])) == len(seen[0])


def brute_language(profiles, text):
    """Out-of-place distances from lists of n-grams as strings."""
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    counts: dict[str, int] = {}
    for i, w in enumerate(words):
        padded = f" {w} "
        for n in (1, 2, 3):
            for k in range(len(padded) - n + 1):
                g = padded[k : k + n]
                if " " in g.strip(" ") or g.strip(" ") == "" or (n == 3 and g[1] == " "):
                    continue
                if n < 3 or g.strip():
                    counts[g] = counts.get(g, 0) + 1
    return counts


def test_profiles_count_every_gram():
    for text in ("the then them", "a bb a", "Ünï code é", "x"):
        codes = language.letters(text)
        values, counts = language.grams(codes)
        got = {}
        for v, n in zip(values.tolist(), counts.tolist(), strict=True):
            kind, v = (3, v ^ 1 << 61) if v >> 61 else (2, v ^ 1 << 60) if v >> 60 else (1, v)
            got["".join(chr(v >> 16 * k & 0xFFFF) for k in reversed(range(kind))).replace("\0", " ")] = n
        assert got == brute_language(None, text)


def test_terms_are_counted_as_by_hand():
    chain = toxicity.Chain(["bad", "bad*", "worse*", "é"], toxicity.View(np.array([0, 3]), np.array([0]), np.array([1, 2])), [])
    assert chain.counts("Bad badly, BADLY worsened é; a worse bad1x").tolist() == [2, 2, 1, 1, 9]
    views = [chain.view.of(link, np.array([[2, 2, 1, 1.0], [0, 0, 0, 0]]), np.array([10, 0.0])) for link in range(4)]
    assert views[0].tolist() == [[1, 1], [0, 0]] and views[2].tolist() == [[10, 10], [0, 0]] and views[3][0].tolist() == [1, 1, 1, 2 / 3, 10]


def test_evidence_by_hand():
    got = toxicity.evidence(np.array([0.0, 5, 50]), np.array([10.0, 5, 0]), 100, 10)
    assert got[0] == pytest.approx(2 * (10 * np.log(11) + 100 * np.log(11 / 10)), rel=1e-9) and got[1] < got[0] and got[2] > 0


def test_folds_choose_their_terms_without_themselves(spark):
    """A word that only one fold's toxic documents hold is no term of that fold's models."""
    rows = [(i, f"calm text {i}" + (" vile" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(600)]
    docs = frame(spark, [r[:2] for r in rows], "doc_id long, text string")
    labels = frame(spark, [(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    chain = toxicity.train(docs, labels)
    assert [chain.terms[i] for i in chain.view.marking] == ["vile"]
    got = {r.doc_id: r.toxicity for r in toxicity.score(docs, chain).collect()}
    assert all((got[i][3] > 0.5) == bool(t) and (got[i][0] > 0.5) == bool(t) for i, _, t in rows)
