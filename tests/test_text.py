"""Text rules that the tables don't exercise."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from claimstone.functions import text as T
from claimstone.operators import chunking


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "text string").select(column(F.col("text")).alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "masked", "pii"),
    [
        ("pay 4111 1111 1111 1111 now", "pay [REDACTED_CREDIT_CARD] now", {"CREDIT_CARD": 1}),
        ("pay 4111 1111 1111 1112 now", "pay [PHONE] now", {"PHONE": 1}),
        ("api_key = 'abcdefghijklmnop1234' end", "api_key=[REDACTED_SECRET]' end", {"API_SECRET": 1}),
        ("mail a.b@c.org", "mail [EMAIL]", {"EMAIL": 1}),
        ("AKIA" + "A1" * 8, "[REDACTED_AWS_KEY]", {"AWS_KEY": 1}),
        ("hf_" + "a" * 34, "[REDACTED_HF_TOKEN]", {"HF_TOKEN": 1}),
        ("sk-" + "a" * 32, "[REDACTED_OPENAI_KEY]", {"OPENAI_KEY": 1}),
        ("ghp_" + "b" * 36, "[REDACTED_GITHUB_TOKEN]", {"GITHUB_TOKEN": 1}),
        ("AIzaSy" + "c" * 33, "[REDACTED_GOOGLE_API_KEY]", {"GOOGLE_API_KEY": 1}),
        ("call +49 (30) 123-4567 today", "call [PHONE] today", {"PHONE": 1}),
        ("nothing", "nothing", {}),
        (None, "", {}),
    ],
)
def test_mask_pii(spark, text, masked, pii):
    row = T.mask_pii(spark.createDataFrame([(text,)], "text string")).first()
    assert (row.masked, row.pii) == (masked, pii)


@pytest.mark.parametrize(
    ("text", "decision"),
    [
        ("", "irrelevant"), (None, "irrelevant"), ("short text of 24 letters", "uncertain"),
        ("The system shall notify the manager when the limit of ten users is exceeded.", "relevant"),
        ("Mix two cups of flour and sugar, add a teaspoon of baking powder, preheat the oven.", "irrelevant"),
        ("Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor.", "irrelevant"),
        ("A long walk along the river where nothing at all happened for a good while.", "uncertain"),
    ],
)
def test_relevance(spark, text, decision):
    assert one(spark, lambda c: T.relevance(c)["decision"], text) == decision


def test_small_functions(spark):
    assert one(spark, T.tokenize, "The user-ID is x 42 42") == ["user", "id", "42", "42"]
    assert one(spark, T.meaningful_tokens, "The system shall lock lock accounts") == ["lock", "accounts"]
    assert one(spark, T.numbers, "within 5  Seconds or 2.5 % of 10") == ["5 seconds", "2.5", "10"]
    assert one(spark, T.normalize_text, " a \t b\r\n\r\n\n\r c ") == "a b\n\nc"
    assert one(spark, T.slug, "  Hello, World! ") == "hello-world"
    assert one(spark, T.match_key, None) == ""
    assert one(spark, T.priority, "This is urgent") == "High"
    assert one(spark, T.priority, None) == "Medium"
    assert one(spark, T.category, "Uptime of the API") == "Performance & Reliability"
    assert one(spark, lambda c: T.luhn_valid(c), "4111111111111111") is True
    assert one(spark, lambda c: T.luhn_valid(c), "4111111111111112") is False


@pytest.mark.parametrize(("n", "spans"), [(0, []), (1, [(0, 1)]), (3000, [(0, 3000)]), (3001, [(0, 3000), (2500, 3001)]), (5500, [(0, 3000), (2500, 5500)])])
def test_windows_without_blanks(spark, n, spans):
    df = spark.createDataFrame([(1, "x" * n)], "doc_id long, text string")
    assert [(r.start_char, r.end_char) for r in chunking.sliding_windows(df).orderBy("chunk_index").collect()] == spans


def test_pages(spark):
    df = spark.createDataFrame([(1, "ab\f \fcd"), (2, None), (3, "")], "doc_id long, text string")
    assert [(r.doc_id, r.page, r.start_char, r.end_char, r.chunk) for r in chunking.pages(df).orderBy("page").collect()] == [(1, 1, 0, 2, "ab"), (1, 3, 5, 7, "cd")]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a.b@c.org +49 (30) 123-4567", ("[EMAIL] [PHONE]", 1, 1, 0, 0)),
        ("card 4111-1111-1111-1111x", ("card [PHONE]-1111x", 0, 1, 0, 0)),
        ("card 4111 1111 1111 1111", ("card [CREDIT_CARD]", 0, 0, 1, 0)),
        ("api_key = 'abcdefghijklmnop1234' and AKIA" + "A1" * 8, ("api_key = '[API_KEY]' and [API_KEY]", 0, 0, 0, 2)),
        ("", ("", 0, 0, 0, 0)),
    ],
)
def test_legacy_masks(spark, text, want):
    assert tuple(one(spark, T.mask_pii_legacy, text)) == want


def test_files(spark):
    import io
    import zipfile

    from claimstone.sources import files

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", "x")
        z.writestr("word/document.xml", "x")
    rows = [
        ("a.pdf", b"%PDF-1.4 x", "pdf", None), ("a.txt", b"%PDF-1.4 x", "pdf", "content is not what the name says"), ("b.docx", out.getvalue(), "docx", None), ("c.docx", b"PK\x03\x04junk", None, "unknown content"),
        ("d.wav", b"RIFF\0\0\0\0WAVEfmt ", "wav", None), ("e.mp3", b"ID3\x03", "mp3", None), ("f.ogg", b"OggS\0", "ogg", None), ("g.m4a", b"\0\0\0\x18ftypM4A ", "m4a", None), ("h.webm", b"\x1aE\xdf\xa3..", "webm", None),
        ("i.txt", "plain é\n".encode(), "text", None), ("j.txt", b"nul\0inside", None, "unknown content"), ("k.txt", b"\xff\xfe\xfd", None, "unknown content"), ("l.html", b"<p>", "text", "blocked extension"), ("m.txt", b"", None, "unknown content"), ("n", None, None, "unknown content"),
    ]
    df = files.inspected(spark.createDataFrame([r[:2] for r in rows], "name string, content binary"), name_col="name")
    assert [(r.name, r.kind, r.rejected) for r in df.orderBy("name").collect()] == [(n, k, w) for n, _, k, w in rows]


def test_sample_marks_its_parts(spark):
    from claimstone.functions import text as T

    texts = ["  short\ftext \n", "a" * 999 + " " + "b" * 4000 + " " + "c" * 999, None]
    got = [r.x for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(T.sample(F.col("t")).alias("x")).collect()]
    assert got == ["short text", "a" * 999 + "\n\n[... middle section ...]\n\n" + "b" * 1000 + "\n\n[... ending section ...]\n\n" + "c" * 999, ""]


def test_let_computes_once(spark):
    from claimstone.functions.text import let

    df = spark.range(3).select(let(F.rand(1), lambda x: F.struct(x.alias("a"), x.alias("b"))).alias("r"))
    assert all(r.r.a == r.r.b for r in df.collect())


@pytest.mark.parametrize("name", ["numeric_claims", "relevance_decisions", "relevance_against_labels", "priorities", "pii_emails", "pii_cards"])
def test_words_beside_accents(spark, tmp_path, name):
    """Edges of words are those of the SQL where accented letters, vertical tabs or other cases stand beside them."""
    import duckdb

    from tests.compare import duck_rows, spark_rows

    texts = ["27 4116106959541135\nÉréviè ç", "é5 seconds, 7 secondsé, 8\x0bdays, 9 day\u017f", "éuser must log in énotify the manager, la la laé, lorem ipsumé dolor sit amet or so", "élorem ipsum élorem ipsum dolor sit amet and more than fifty letters", "éurgenté businesscritical \u017furgent",
             "éjohn@example.com john@example.comé", "é4111111111111111 4111111111111111é", None, "", "priority:\x0bhigh", "PRIORITY: LOW, N\u0131ce to have, bu\u017fine\u017fs critical"]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(len(texts))], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    connection = duckdb.connect()
    for table in ("documents", "labels"):
        connection.execute(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
    assert spark_rows(T.QUERIES[name](spark, str(tmp_path))) == duck_rows(connection, T.SQL[name])[1]


def test_legacy_masks_hand_on_a_few_texts_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(T, "AT_ONCE", 3)
    texts = ["write to a.b@example.org or 555-123-4567", None, "", "card 4111 1111 1111 1111", "api_key = 'abcdef1234567890abcd'"] * 4
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "a.b@example.org", "x")], "doc_id int, text string, lang string").coalesce(1)
    found = T.legacy_masked(docs)
    want = docs.select("doc_id", T.mask_pii_legacy(F.coalesce("text", F.lit(""))).alias("m")).select("doc_id", "m.*")
    assert found.dtypes == want.dtypes and sorted(map(str, found.collect())) == sorted(map(str, want.collect()))
    assert "ArrowEvalPython" not in found._jdf.queryExecution().executedPlan().toString()
