from pathlib import Path

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

COLUMNS = corpus_pipeline.COLUMNS
SF = "/root/testdata/sf0.01"


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "repeated_passages", "decontamination", "mixing"]


def test_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    rows = out.collect()
    ids = [r.doc_id for r in rows]
    assert len(ids) == len(set(ids)) and set(ids) <= {r.doc_id for r in docs.select("doc_id").collect()}
    assert 0.6 * docs.count() < len(ids) < docs.count()


def test_near_duplicates_keep_one(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(5, text, "en", "a", 1), (3, text, "en", "b", 1), (3, text, "en", "b", 1), (9, "quite another text than the other one here", None, None, None), (None, text, "en", "a", 1), (7, None, None, None, None), (8, "", None, None, None)]
    got = corpus_pipeline.drop_near_duplicates(spark, frame(spark, rows), SF)
    assert got.columns == COLUMNS and sorted((r.doc_id for r in got.collect()), key=str) == [3, 7, 9, None]


def test_contaminated_go(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    rows = [(1, f"before {item} after", "en", "a", 1), (2, item[: len(item) // 2], "en", "a", 1), (3, None, None, None, None), (None, "x", None, None, None)]
    got = corpus_pipeline.drop_contaminated(spark, frame(spark, rows), SF)
    assert got.columns == COLUMNS and sorted((r.doc_id for r in got.collect()), key=str) == [2, 3, None]


def test_passages_are_cut(spark):
    passage = "this passage is repeated word for word in two documents of the corpus. "
    rows = [(1, "first. " + passage, "en", "a", 1), (2, "second. " + passage + "end", "en", "a", 1)]
    got = {r.doc_id: r for r in corpus_pipeline.cut_repeats(spark, frame(spark, rows), SF).collect()}
    assert got[1].text == rows[0][1] and got[2].text == "secondend" and got[2].n_chars == 9


def test_toxic_go(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, SF).select("doc_id").collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    assert sum(r.doc_id in kept for r in labels if r.toxic == 0) > 0.97 * sum(r.toxic == 0 for r in labels)
    assert sum(r.doc_id in kept for r in labels if r.toxic == 1) < 0.5 * sum(r.toxic == 1 for r in labels)


def test_near_duplicates_reach_a_similarity_of_0_8(spark):
    import random

    def shingles(text):
        w = text.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}

    rng = random.Random(4)
    line = "a line that very many of the documents have in common word for word".split()
    texts = []
    for _ in range(12):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(40, 160))]
        texts.append(base)
        for changes in (1, 1, 2, 4, 8):
            copy = list(base)
            for _ in range(changes):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(3000)}"
            texts.append(copy)
    texts += [line + [f"y{rng.randrange(3000)}" for _ in range(rng.randrange(1, 40))] for _ in range(60)]
    base = [f"g{i}" for i in range(60)]
    texts += [base[:i] + ["changed"] + base[i + 1 :] for i in range(60)]
    rng.shuffle(texts)
    texts = [" ".join(t) for t in texts]
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    linked = 0
    for b in range(len(texts)):
        for a in range(b):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                linked += 1
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    assert linked > 30
    got = corpus_pipeline.drop_near_duplicates(spark, frame(spark, [(i, t, "en", "a", 1) for i, t in enumerate(texts)]), SF)
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(root))


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, name):
    """Null texts, sources and ids, empty and repeated rows and columns of other names; and no row at all."""
    stage = dict(corpus_pipeline.STAGES)[name]
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "some words of a plain document", "en", None, 30), (3, "some words of a plain document", "en", None, 30), (4, "quite another plain text", None, "b", 24)]
    docs = frame(spark, rows).selectExpr("*", "1 AS w", "'x' AS component", "2 AS size_")
    got = stage(spark, docs, SF)
    ids = {r.doc_id for r in got.select("doc_id").collect()}
    # Null and empty texts have the same fingerprint.
    assert ids == ({1, 3, 4} if name == "near_duplicates" else {1, 2, 3, 4}) and (name == "mixing" or got.columns == COLUMNS)
    assert stage(spark, frame(spark, []), SF).count() == 0


def test_a_stage_by_itself_leaves_only_its_documents(spark):
    """A stage's own tables went with ``run`` only, so that stages run one by one piled them up."""
    passage = "this passage is repeated word for word in two documents of the corpus. "
    docs = frame(spark, [(1, "first. " + passage, "en", "a", 1), (2, "second. " + passage + "end", "en", "a", 1), (3, passage, "en", "a", 1)])
    from claimstone import session

    session.shared_dir(spark, "probe")  # may set the folder
    root = Path(session.shared_dir(spark, "probe").removeprefix("file:")).parent
    for stage in (corpus_pipeline.drop_near_duplicates, corpus_pipeline.cut_repeats):
        before = set(root.iterdir())
        out = stage(spark, docs, SF)
        made = set(root.iterdir()) - before
        assert [p.name.rpartition("-")[0] for p in made] == [f"pipeline-{stage.__name__}"] and out.count() >= 1
