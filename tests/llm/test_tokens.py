import random
import time

import public_tokenizers
from tokenizers import Tokenizer

from claimstone.llm import tokens

ODD = [
    "", " ", "\n", "a<|endoftext|>b  <|endoftext|>", "<|endoftext|><|endoftext|>", "<|endoftext", "aaaaaaaaaaaaaaaaaaaaa", "   x  \n\n y 　z", "日本語 \U0001f600\U0001f600 �", "x" * 20_000,
    "I'll we're 123 4567 \t\t don't", "\x00\x01\x7f\x80\xa0\xad", "́é",
]


def want(texts):
    return [len(e.ids) for e in Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode_batch(texts, add_special_tokens=False)]


def test_odd_texts():
    assert tokens.vocabulary().counts(ODD) == want(ODD)


def test_random_texts():
    r = random.Random(2)
    texts = ["".join(r.choice("aabcdeE  '12.,-é\nß") for _ in range(r.randint(0, 300))) for _ in range(400)]
    assert tokens.vocabulary().counts(texts) == want(texts)


def test_memory_starts_over(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 10)
    texts = [f"word{i} other{i * 7}" for i in range(100)]
    v = tokens.vocabulary()
    got = [n for i in range(0, 100, 10) for n in v.counts(texts[i : i + 10])]
    assert got == want(texts) and len(v.known) < 200


def test_all_documents(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    counted = dict(zip(texts, want(list(texts.values())), strict=True))
    for r in tokens.op6_token_counts(spark, sf_dir).collect():
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), counted[r.doc_id], counted[r.doc_id] > 512)


def test_null_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, None, 1), (1, "two words", 1), (1, "two words", 1), (2, "", 1)], "doc_id long, text string, n_tokens int")
    assert sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.count_tokens(df, limit=1).collect()) == [(0, 0, False), (0, 0, False), (9, 2, True), (9, 2, True)]
    assert tokens.count_tokens(df.limit(0)).count() == 0


def test_long_pre_tokens():
    r = random.Random(4)
    texts = ["".join(r.choice(letters) for _ in range(n)) for letters, n in (("abcdefghijklmnopqrstuvwxyz", 30_000), ("ACGT", 40_000), ("a", 5000), ("ab", 5001), ("é日", 3000), ("-=", 9001))]
    assert tokens.vocabulary().counts(texts) == want(texts)
    for t in texts:
        assert tokens.vocabulary().merged([t[:2000].encode()])[0] == tokens.vocabulary().merged_long(t[:2000].encode())


def test_a_megabyte_without_a_blank_takes_seconds():
    r = random.Random(5)
    text = "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000))
    began = time.process_time()
    assert tokens.vocabulary().counts([text]) == want([text])
    assert time.process_time() - began < 20
