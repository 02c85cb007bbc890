"""Operators on small tables: ties, nulls, empty inputs, hot keys."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from claimstone.operators import graph, intervals, jobs, retrieval, similarity


def components_of(edges):
    parent: dict[int, int] = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(200)] + [(7, 7), (None, 3), (3, None)]
    got = {x.node: x.component for x in graph.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == components_of(edges)


def test_no_edges(spark):
    assert graph.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_bm25_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "some words")], "item_id long, text string")
    assert retrieval.bm25(docs, items, doc_id="doc_id", query_id="item_id").count() == 0


def test_bm25_repeats_and_ties(spark):
    docs = spark.createDataFrame([(3, "alpha beta"), (1, "alpha beta"), (2, "gamma"), (4, "the of"), (5, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha"), (2, "alpha alpha")], "item_id long, text string")
    top = retrieval.top_k(retrieval.bm25(docs, items, doc_id="doc_id", query_id="item_id"), 2).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.doc_id) for r in top] == [(1, 1), (1, 3), (2, 1), (2, 3)]
    assert abs(top[2].score - 2 * top[0].score) < 1e-8


def test_merge_hits(spark):
    schema = "query_id long, doc_id long, score double, rank int"
    lexical = spark.createDataFrame([(1, 10, 4.0, 1), (1, 11, 2.0, 2)], schema)
    vector = spark.createDataFrame([(1, 11, 0.8, 1), (1, 12, 0.4, 2), (2, 9, 0.0, 1)], schema)
    got = [(r.query_id, r.doc_id, r.score) for r in retrieval.merge_hits(lexical, vector, 5).orderBy("query_id", "rank").collect()]
    assert got == [(1, 11, 0.85), (1, 10, 0.5), (1, 12, 0.25), (2, 9, 0.0)]


def test_cosine_scope_and_odd_vectors(spark):
    rows = [(1, [1.0, 0.0], "a"), (2, [1.0, 0.0], "a"), (3, [0.0, 0.0], "a"), (4, None, "a"), (5, [1.0, 0.0], "b"), (6, [1.0, 1.0], "a")]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    got = retrieval.cosine_top_k(v, v.where("vec_id = 1"), 3, scope_cols=("label",)).orderBy("rank").collect()
    assert [r.doc_id for r in got] == [2, 6, 3]
    assert all(r.doc_id != 5 for r in got)


def test_near_pairs_brute_force(spark):
    r = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    base = [r.sample(words, r.randint(3, 15)) for _ in range(25)]
    rows = [(i, " ".join(w for w in r.choice(base) if r.random() > 0.07)) for i in range(200)] + [(500, None), (501, ""), (None, "w1 w2 w3 w4")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets: dict[frozenset, int] = {}
    for i, t in sorted((x for x in rows if x[0] is not None), key=lambda x: x[0]):
        sets.setdefault(frozenset((t or "").split()), i)
    items = [(i, s) for s, i in sets.items() if len(s) >= 4]
    want = {(i, j) for i, a in items for j, b in items if i < j and len(a & b) >= 0.8 * len(a | b) - 1e-9}
    assert {(x.a, x.b) for x in similarity.near_pairs(docs, similarity.token_classes(docs)).collect()} == want


def test_overlaps_brute_force(spark):
    r = random.Random(5)
    left = [(i, r.randrange(3), s := r.uniform(0, 100), s + r.uniform(-1, 30)) for i in range(80)]
    right = [(i, r.randrange(3), s := r.uniform(0, 100), s + r.uniform(-1, 30)) for i in range(80)]
    a = spark.createDataFrame(left, "id long, k long, start double, end double")
    b = spark.createDataFrame(right, "r_id long, k long, r_start double, r_end double")
    want = {(x[0], y[0]) for x in left for y in right if x[1] == y[1] and x[3] > x[2] and y[3] > y[2] and x[2] < y[3] and x[3] > y[2]}
    got = [(x.id, x.r_id) for x in intervals.overlap_join(a, b, on=["k"], width=7.0).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    free = {x.id for x in intervals.overlap_join(a, b, on=["k"], width=7.0, how="left_anti").collect()}
    assert free == {x[0] for x in left} - {i for i, _ in want}


def test_upsert_keeps_known_values(spark):
    df = spark.createDataFrame([(1, 1, "a", None), (1, 2, None, 5), (1, 3, None, None), (2, 1, None, None)], "job long, at long, error string, n long")
    assert sorted(tuple(r) for r in jobs.upserted(df, ["job"], ["at"]).collect()) == [(1, "a", 5), (2, None, None)]


def test_fingerprint_of_json(spark):
    import hashlib
    import json

    row = {"b": 'say "hi"\n\\ é', "a": None}
    df = spark.createDataFrame([(row["b"],)], "b string").select(jobs.request_fingerprint(b=F.col("b"), a=F.lit(None)).alias("f"))
    assert df.first().f == hashlib.sha256(json.dumps(row, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def test_capped_matching_is_the_sequential_pass(spark):
    from claimstone.operators.matching import capped_matching

    r = random.Random(6)
    pairs = sorted({(a, b) for a, b in ((r.randrange(25), r.randrange(25)) for _ in range(200)) if a < b})
    rows = [(a, b, r.choice([0.5, 0.6, 0.7, 0.8])) for a, b in pairs]
    for k in (1, 3):
        used: dict[int, int] = {}
        want = []
        for a, b, s in sorted(rows, key=lambda x: (-x[2], x[0], x[1])):
            if used.get(a, 0) < k and used.get(b, 0) < k:
                used[a], used[b] = used.get(a, 0) + 1, used.get(b, 0) + 1
                want.append((a, b, s))
        got = [tuple(x) for x in capped_matching(spark.createDataFrame(rows, "a long, b long, score double"), k).collect()]
        assert sorted(got) == sorted(want)
    assert capped_matching(spark.createDataFrame([], "a long, b long, score double"), 2).count() == 0


def test_creation_outcomes(spark):
    cases = [
        (False, True, False, None, False, 202, "created"), (True, False, False, "QUEUED", True, 409, "conflict of scope"), (True, True, True, "RUNNING", True, 409, "not retryable"),
        (True, True, True, "FAILED", False, 409, "another request"), (True, True, True, "CANCELLED", True, 202, "retried"), (True, True, False, "COMPLETED", False, 409, "another request"),
        (True, True, False, "RUNNING", True, 202, "already running"), (True, True, False, "COMPLETED", True, 200, "reported"), (True, True, False, "FAILED", True, 200, "reported"),
    ]
    df = spark.createDataFrame([c[:5] for c in cases], "e boolean, s boolean, r boolean, status string, f boolean")
    rows = df.select(jobs.creation_outcome(exists=F.col("e"), same_scope=F.col("s"), reprocess=F.col("r"), status=F.col("status"), same_request=F.col("f")).alias("x")).collect()
    assert [(r.x.code, r.x.outcome) for r in rows] == [c[5:] for c in cases]


def test_coverage_order(spark):
    reqs = spark.createDataFrame([(1, "rejected", "FR"), (2, "accepted", "Assumption"), (3, "proposed", "FR"), (4, "accepted", "FR"), (5, "accepted", "FR"), (6, "accepted", "FR")], "item_id long, disposition string, label string")
    tales = spark.createDataFrame([("s2", 2, [4]), ("s1", 1, [4, 5, 3])], "story_id string, ord int, item_ids array<long>")
    got = [tuple(r) for r in jobs.coverage(reqs, tales).orderBy("item_id").collect()]
    assert got == [(1, "non_story", None), (2, "non_story", None), (3, "needs_review", None), (4, "merged_into_story", "s1"), (5, "merged_into_story", "s1"), (6, "needs_review", None)]


def test_prior_duplicates_brute_force(spark):
    r = random.Random(9)
    words = [f"w{i}" for i in range(30)]
    base = [r.sample(words, r.randint(1, 14)) for _ in range(15)]
    rows = [(i, " ".join(w for w in r.choice(base) + (r.sample(words, 2) if r.random() < 0.3 else []) if r.random() > 0.05)) for i in range(150)] + [(900, None), (901, "the of")]
    sets = {i: set((t or "").split()) - {"the", "of"} for i, t in rows}

    def same(a, b):
        m, least = len(a & b), min(len(a), len(b))
        return m >= 0.9 * len(a | b) - 1e-9 or least >= 4 and m >= 0.82 * least - 1e-9

    want = {}
    for i, a in sets.items():
        prior = [j for j, b in sets.items() if j < i and a and b and same(a, b)]
        if prior:
            want[i] = (len(prior), min(prior))
    got = {x.id: (x.n_prior, x.first_prior) for x in similarity.prior_duplicates(spark.createDataFrame(rows, "item_id long, text string")).collect()}
    assert got == want and len(want) > 50


def test_issues_gather_distinct_details_only(spark):
    rows = [("job", 1, "error", s, i, d) for i, (s, d) in enumerate([("low", "b"), ("high", None), ("medium", "a"), ("low", "b")] * 50)] + [("job", 2, "error", "low", 1, None)]
    df = jobs.grouped_issues(spark.createDataFrame(rows, "item_type string, item_id long, cause string, severity string, ord long, details string"))
    got = {r.item_id: (r.severity, r.issues, r.details) for r in df.collect()}
    assert got == {1: ("high", 200, "b; a"), 2: ("low", 1, "")}
    # Rows are aggregated by their details before anything is gathered.
    plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert [("collect_list" in x) for x in plan if "Aggregate" in x] == [True, False]


def test_all_similar_vectors_are_matched(spark):
    from claimstone.operators.matching import similar_pairs_capped

    r = random.Random(8)
    centres = [[r.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    rows = [(3 * i + 1, [x + r.gauss(0, 0.4) for x in r.choice(centres)]) for i in range(60)]
    rows += [(1000 + i, centres[0]) for i in range(15)] + [(2000 + i, centres[1]) for i in range(12)] + [(3000, [0.0] * 6), (3001, None), (3002, [1.0])]

    def cosine(a, b):
        return round(sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5, 9)

    full = [x for x in rows if x[1] and len(x[1]) == 6 and any(x[1])]
    pairs = [(2.0 if u == v else cosine(u, v), min(a, b), max(a, b)) for i, (a, u) in enumerate(full) for b, v in full[:i]]
    used, want = {}, []
    for s, a, b in sorted((p for p in pairs if p[0] >= 0.55), key=lambda p: (-p[0], p[1], p[2])):
        if used.get(a, 0) < 5 and used.get(b, 0) < 5:
            used[a], used[b] = used.get(a, 0) + 1, used.get(b, 0) + 1
            want.append((a, b))
    got = [(x.a, x.b) for x in similar_pairs_capped(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()]
    assert sorted(got) == sorted(want) and len(want) > 150


def test_conflicts_brute_force(spark):
    r = random.Random(12)
    texts = {i: " ".join(r.sample([f"w{x}" for x in range(12)], r.randint(0, 7))) for i in range(60)} | {100: "alpha beta", 101: "alpha gamma"}
    classes: dict[frozenset, int] = {}
    for i in sorted(texts):
        classes.setdefault(frozenset(texts[i].split()), i)
    want = {tuple(sorted((i, j))) for a, i in classes.items() for b, j in classes.items() if i != j and a and b and 0.3 <= len(a & b) / len(a | b) < 0.8}
    got = [(x.a, x.b) for x in similarity.conflicts(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()]
    assert len(got) == len(set(got)) and set(got) == want and (100, 101) in want


def test_all_turns_count_for_repeats(spark, tmp_path):
    said = "export weekly figures quickly whenever managers ask"
    rows = [(2, 0, "system", "some opening words nobody repeats"), (2, 1, "user", said), (1, 0, "user", "hello"), (2, 2, "assistant", said + " again"), (3, 4, "user", said.upper()), (3, 5, "user", None)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert similarity.repeated_statements(spark, str(tmp_path)).count() == 0
    got = [tuple(r) for r in similarity.repeated_turns(spark, str(tmp_path)).orderBy("conv_id", "turn").collect()]
    assert got == [(2, 2, 1, 2, 1), (3, 4, 2, 2, 1)]


def test_copies_are_not_paired_with_each_other(spark):
    rows = [(i, "needs seven quite different meaningful words") for i in range(3000)]
    got = {r.id: (r.n_prior, r.first_prior) for r in similarity.prior_duplicates(spark.createDataFrame(rows, "item_id long, text string")).collect()}
    assert got == {i: (i, 0) for i in range(1, 3000)}


def test_sets_of_near_copies_move_once(spark):
    """Each near copy pairs with each other one, but its set isn't read again for each pair; no pair is lost."""
    from itertools import combinations

    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[:40] + [f"own{i}"]) for i in range(60)] + [" ".join(words[k : k + 30]) for k in range(40, 300, 3)] + [" ".join(words[:300]), " ".join(words[:260])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [set(t.split()) for t in texts]
    for least in (0.8, 0.3):
        want = {(a, b) for a, b in combinations(range(len(sets)), 2) if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]) - 1e-9}
        found = similarity.near_pairs(docs, similarity.token_classes(docs), least=least)
        assert {(r.a, r.b) for r in found.collect()} == want
    ordered = spark.createDataFrame([(i, [0]) for i in range(60)], "class_id long, set array<long>")
    dealt, held = similarity._dealt(spark.createDataFrame(list(combinations(range(60), 2)), "a long, b long"), ordered)
    assert (dealt.count(), held.count()) == (60 * 59 // 2, 60)


def test_best_matches_without_a_row_for_each_pair(spark, monkeypatch):
    words = ["order", "clerk", "seal", "ledger", "audit", "nightly", "refund"]
    texts = [" ".join(words[(i * k) % 7] for k in range(1 + i % 9)) for i in range(300)] + [None, " ", "none of them", "order " * 40]
    docs = spark.createDataFrame([(3 * i % 1000, t) for i, t in enumerate(texts)], "doc_id long, text string")
    items = spark.createDataFrame([(0, "order clerk order"), (1, "audit ledger"), (2, None), (3, "unheard"), (None, "refund"), (5, "seal the audit nightly")], "item_id long, text string")
    rows = lambda df: sorted(map(str, df.select("query_id", "doc_id", "score", "rank").collect()))
    of = {"doc_id": "doc_id", "query_id": "item_id"}
    want = rows(retrieval.top_k(retrieval.bm25(docs, items, **of), 4))
    got = retrieval.bm25_top_k(docs, items, 4, **of)
    assert rows(got) == want and len(want) == 16
    assert "Aggregate" not in got._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(retrieval, "CELLS", 16)
    assert rows(retrieval.bm25_top_k(docs, items, 4, **of)) == want
    for odd in (docs.unionByName(docs.limit(9)), docs.withColumn("doc_id", F.col("doc_id").cast("string")), docs.unionByName(spark.createDataFrame([(None, "order")], docs.schema))):
        assert rows(retrieval.bm25_top_k(odd, items, 4, **of)) == rows(retrieval.top_k(retrieval.bm25(odd, items, **of), 4))
    assert rows(retrieval.bm25_top_k(docs, items.limit(0), 4, **of)) == rows(retrieval.bm25_top_k(docs.limit(0), items, 4, **of)) == []


def _written(monkeypatch) -> dict[str, int]:
    """The rows of each table that a query of ``similarity`` writes, by label, once it ran."""
    rows, stored = {}, similarity.stored

    def counted(df, label):
        rows[label] = rows.get(label, 0) + (out := stored(df, label)).count()
        return out

    monkeypatch.setattr(similarity, "stored", counted)
    return rows


def test_statements_that_only_share_rare_words_are_not_written_as_pairs(spark, monkeypatch):
    r, words = random.Random(4), [f"word{i}" for i in range(40)]
    rows = [(i, " ".join(r.sample(words, 9))) for i in range(300)] + [(1000 + i, " ".join(r.sample(words, 3))) for i in range(50)]
    rows += [(2000 + i, rows[i][1].rsplit(" ", 1)[0] + " another") for i in range(30)]
    sets = {i: set(t.split()) for i, t in rows}
    written = _written(monkeypatch)
    got = {x.id: (x.n_prior, x.first_prior) for x in similarity.prior_duplicates(spark.createDataFrame(rows, "item_id long, text string")).collect()}
    prior = {i: [j for j, b in sets.items() if j < i and (len(a & b) >= 0.9 * len(a | b) - 1e-9 or min(len(a), len(b)) >= 4 and len(a & b) >= 0.82 * min(len(a), len(b)) - 1e-9)] for i, a in sets.items()}
    assert got == {i: (len(p), min(p)) for i, p in prior.items() if p} and len(got) >= 30
    assert len(got) <= written["met"] < 2000  # of some 30,000 that share one


def test_sets_too_different_for_a_conflict_are_not_written_as_pairs(spark, monkeypatch):
    r, words = random.Random(5), [f"word{i}" for i in range(60)]
    texts = [" ".join(r.sample(words, 9)) for _ in range(300)]
    sets = {i: set(t.split()) for i, t in enumerate(texts)}
    want = {(a, b) for a in sets for b in sets if a < b and 0.3 <= len(sets[a] & sets[b]) / len(sets[a] | sets[b]) < 0.8}
    written = _written(monkeypatch)
    found = similarity.conflicts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {(x.a, x.b) for x in found.collect()} == want and len(want) == 100
    assert written["candidates"] < 2000  # of some 30,000 that share one
    assert len(want) <= written["candidates"] and "dealt" not in written


def test_blocks_of_vectors_meet_two_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "AT_ONCE", 3)
    r = random.Random(21)
    rows = [(i, [r.gauss(0, 1) for _ in range(4)], i % 2) for i in range(60)] + [(60, None, 0), (61, [0.0] * 4, 1), (62, [1.0], 0), (63, [], 1)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")

    def cosine(a, b):
        size = (sum(x * x for x in a or []) * sum(x * x for x in b or [])) ** 0.5
        return round(sum(x * y for x, y in zip(a, b, strict=True)) / size, 9) if size and len(a) == len(b) else 0.0

    full = {i: e for i, e, _ in rows if e and len(e) == 4 and any(e)}
    for block in (5, 4096):
        found = retrieval.cosine_pairs(v.where("vec_id < 62"), 0.5, block=block)
        assert {(x.a, x.b) for x in found.collect()} == {(a, b) for a in full for b in full if a < b and cosine(full[a], full[b]) >= 0.5}
        # A row of a plan with whole blocks in it would come to Python by thousands.
        assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().executedPlan().toString()
        near = retrieval.cosine_top_k(v.where("vec_id < 62"), v.where("vec_id % 20 = 0 and vec_id < 60"), 3, scope_cols=("label",), block=block)
        got = {}
        for x in sorted(near.collect(), key=lambda x: x["rank"]):
            got.setdefault(x.query_id, []).append(x.doc_id)
        held = {i: e for i, e, label in rows if label == 0 and i < 62}
        assert got == {q: sorted((d for d in held if d != q), key=lambda d: (-cosine(held[q], held[d]), d))[:3] for q in (0, 20, 40)}
