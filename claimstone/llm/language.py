"""Language identification by rank-order profiles.

A profile is the ``TOP`` most frequent letter n-grams (1 to 3, words padded by a blank) in
order of frequency.  A document's profile is compared to each language's by the
out-of-place distance: for each n-gram how far its two ranks are apart, TOP if it is missing.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from claimstone.llm.learning import fold_of
from claimstone.session import stored
from claimstone.sources.tables import table

TOP = 300
#: At most so many documents of each language are learned from.
SAMPLE_ROWS = 1000
#: Up to this many languages, and sampled documents by their ids, are broadcast.
BROADCAST_ROWS = 200_000
NO_LETTER = "und"
OTHER = 0xFFFF  # all letters beyond the basic plane


def _letter_table() -> np.ndarray:
    """The code of each character of the basic plane: itself if it is a letter, else 0."""
    codes = np.arange(1 << 16, dtype=np.int64)
    return np.where([unicodedata.category(chr(c))[0] == "L" for c in range(1 << 16)], codes, 0)


_LETTERS: np.ndarray | None = None


def letters(text: str) -> np.ndarray:
    """Lower-case letters as codes, each run of other characters as one 0, and a 0 at both ends; empty without a letter."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = _letter_table()
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = _LETTERS[np.minimum(points, 0xFFFF)]
    beyond = np.flatnonzero(points > 0xFFFF)
    if len(beyond):
        codes[beyond] = [OTHER if unicodedata.category(chr(p))[0] == "L" else 0 for p in points[beyond].tolist()]
    if not codes.any():
        return codes[:0]
    codes = np.concatenate(([0], codes, [0]))
    return codes[np.concatenate(([True], (codes[1:] != 0) | (codes[:-1] != 0)))]


def grams(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of 1 to 3 letters, packed in 16 bits a letter, and their counts; in order of the packed value.

    The blank alone isn't one, nor is an n-gram with a blank inside it.
    """
    two = codes[:-1] << 16 | codes[1:]
    inner = codes[1:-1] != 0
    three = (two[:-1] << 16 | codes[2:])[inner]
    every = np.sort(np.concatenate([codes[codes != 0], two | 1 << 60, three | 1 << 61]))
    at = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
    return every[at], np.diff(np.append(at, len(every)))


def profile(text: str) -> np.ndarray:
    """The packed n-grams of a text by falling count, ties by value."""
    codes = letters(text)
    if not len(codes):
        return codes
    values, counts = grams(codes)
    return values[np.argsort(-counts, kind="stable")[:TOP]]


class Profiles:
    """The profiles of all languages."""

    def __init__(self, rows: list[tuple[str, int, int]]):
        self.langs = sorted({lang for lang, _, _ in rows})
        self.tables = []
        for lang in self.langs:
            ranked = sorted((gram, rank) for name, gram, rank in rows if name == lang)
            self.tables.append((np.array([g for g, _ in ranked], np.int64), np.array([r for _, r in ranked], np.int64)))

    def predict(self, text: str) -> tuple[str, float]:
        """The nearest language, and how near it is: 1 for its very profile, 0 for none of its n-grams."""
        own = profile(text)
        if not len(own) or not self.langs:
            return NO_LETTER, 0.0
        rank = np.arange(len(own))
        far = []
        for values, ranks in self.tables:
            at = np.minimum(np.searchsorted(values, own), len(values) - 1)
            far.append(int(np.where(values[at] == own, np.minimum(np.abs(ranks[at] - rank), TOP), TOP).sum()))
        best = int(np.argmin(far))
        return self.langs[best], 1 - far[best] / (TOP * len(own))


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for lang, part in batch.groupby("lang"):
            found = [grams(c) for c in map(letters, part.text) if len(c)]
            if found:
                values, counts = (np.concatenate(x) for x in zip(*found, strict=True))
                own, place = np.unique(values, return_inverse=True)
                yield pd.DataFrame({"lang": lang, "gram": own, "n": np.bincount(place, counts).astype("int64")})


def train(docs: DataFrame, *, rows: int = SAMPLE_ROWS, folds: int = 4, held: int = 2) -> Profiles:
    """Profiles from at most ``rows`` documents a language, outside fold ``held``; null languages, texts and ids don't count.

    Documents are taken by the smallest hashes of their ids.  A language's count says below
    which hash about twice as many lie as are wanted; only these are ranked, so that no task
    gets more of a language, however many documents have it.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold_of(F.col("doc_id"), folds) != held))
    share = F.least(F.lit(1.0), F.lit(2.0 * rows + 100) / F.col("n"))
    below = stored(known.groupBy("lang").agg(F.count("*").alias("n")).select("lang", (share * (1 << 40)).cast("long").alias("below")), "below")
    if below.count() <= BROADCAST_ROWS:  # else documents would be dealt by language
        below = F.broadcast(below)
    place = F.xxhash64("doc_id")
    near = known.select("doc_id", "lang", place.alias("place")).join(below, "lang").where(F.pmod("place", F.lit(1 << 40)) < F.col("below")).select("doc_id", "lang", "place").distinct()
    order = Window.partitionBy("lang").orderBy(F.pmod("place", F.lit(1 << 40)), "place", "doc_id")
    ids = stored(near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= rows).select("doc_id", "lang"), "ids")
    if ids.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    sample = known.select("doc_id", "lang", "text").join(ids, ["doc_id", "lang"])
    counts = sample.select("lang", "text").mapInPandas(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= TOP)
    return Profiles([(r.lang, r.gram, r.rank - 1) for r in ranked.collect()])


PREDICTION = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType())])


def identify(docs: DataFrame, profiles: Profiles, *, text_col: str = "text") -> DataFrame:
    """``docs`` with ``guess`` (``lang_pred, score``; replaced if it is there) for every row; ``und`` and 0 where the text is null or has no letter."""

    @F.pandas_udf(PREDICTION)
    def predicted(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([profiles.predict(t) for t in texts], columns=["lang_pred", "score"])

    return docs.withColumn("guess", predicted(F.coalesce(F.col(text_col), F.lit(""))))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents; ids whose crc32 modulo 4 is 2 are held out of learning."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(fold_of(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out")
    return identify(docs.select("doc_id", "text"), train(docs)).select("doc_id", held, "guess.lang_pred", "guess.score")


QUERIES = {"op9_language_id": op9_language_id}
SQL: dict[str, str] = {}
