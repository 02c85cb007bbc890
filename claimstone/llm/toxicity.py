"""Toxicity by a classifier chain.

Categories are predicted one after the other by linear models; each also gets the
probabilities of the categories before it, in training those of models that were fitted
without the document's fold (out of fold), so that they are as uncertain as they will be
for new documents.  What a fold's models look for is chosen without the fold too.

The label table has one judgement, ``toxic``, which ends the chain.  The earlier categories
are read off the labelled documents with it: ``abusive`` (labelled toxic and holding a word
that marks the toxic ones), ``repeated`` (three such words or more) and ``dense`` (one in
100 words or more).  Each link has its own view of a text, so that what it hands on is news
to the next: which words are there, how often, their rates, and for ``toxic`` the stems,
the first 3 to 7 letters of words, which catch inflected and compounded forms.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType

from claimstone.llm.learning import fit_linear, fold_of, labelled_sample, sigmoid
from claimstone.session import stored
from claimstone.sources.tables import table

CATEGORIES = ("abusive", "repeated", "dense", "toxic")
WORD = re.compile(r"[^\W\d_]+")
STEMS = range(3, 8)
#: Bound of the labelled sample, and folds of the chain.
SAMPLE_ROWS, FOLDS = 6000, 5
#: From which log-likelihood ratio on a term tells toxic documents from others (chance gives it to one term in 100,000), and how much likelier a toxic one is to hold a marking word.
EVIDENCE, MARKING = 20.0, 20.0
THRESHOLD = 0.5
#: Texts scored at a time.
AT_ONCE = 256


def terms_of(word: str) -> list[str]:
    """The word and, marked by a star, its stems."""
    return [word, *(f"{word[:k]}*" for k in STEMS if k < len(word))]


def evidence(clean: np.ndarray, toxic: np.ndarray, n_clean: int, n_toxic: int) -> np.ndarray:
    """The log-likelihood ratio of terms that so many clean and toxic documents hold."""
    def part(k: np.ndarray, n: int, rate: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            held = np.where(k > 0, k * np.log(k / np.maximum(n * rate, 1e-300)), 0)
            not_held = np.where(n - k > 0, (n - k) * np.log((n - k) / np.maximum(n * (1 - rate), 1e-300)), 0)
        return held + not_held

    rate = (clean + toxic) / max(n_clean + n_toxic, 1)
    return 2 * (part(clean, n_clean, rate) + part(toxic, n_toxic, rate))


@dataclass
class View:
    """What models look for: columns of the words, of the marking ones among them, and of the stems."""

    words: np.ndarray
    marking: np.ndarray
    stems: np.ndarray

    def of(self, link: int, counts: np.ndarray, size: np.ndarray) -> np.ndarray:
        """What a link sees, from counts of all terms and the number of words."""
        if link < 3:
            words = counts[:, self.words]
            return words > 0 if link == 0 else np.log1p(words) if link == 1 else np.minimum(100 * words / np.maximum(size, 1)[:, None], 10)
        hits, rate = self.hits(counts, size)
        return np.column_stack([counts[:, self.stems] > 0, hits > 0, np.minimum(hits, 10) / 3, np.minimum(rate, 10)])

    def hits(self, counts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many marking words texts have, and how many in 100."""
        hits = counts[:, self.marking].sum(axis=1)
        return hits, 100 * hits / np.maximum(size, 1)


@dataclass
class Chain:
    """Terms, a view of them and, for each category, weights over its view and earlier probabilities."""

    terms: list[str]
    view: View
    weights: list[np.ndarray]

    def __post_init__(self) -> None:
        self.number = {t: i for i, t in enumerate(self.terms)}
        self.heads = {t.rstrip("*")[:3] for t in self.terms}

    def counts(self, text: str) -> np.ndarray:
        """How often the whole text has each term, and last its number of words."""
        out = np.zeros(len(self.terms) + 1)
        for word, n in Counter(WORD.findall(text.lower())).items():
            out[-1] += n
            if word[:3] in self.heads:
                for t in terms_of(word):
                    if t in self.number:
                        out[self.number[t]] += n
        return out

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """The probabilities of all categories for rows of counts."""
        known = np.zeros((len(counts), 0))
        for link, w in enumerate(self.weights):
            x = np.column_stack([self.view.of(link, counts[:, :-1], counts[:, -1]), known])
            known = np.column_stack([known, sigmoid(x @ w[:-1] + w[-1])])
        return known


def _term_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        held: dict[tuple[str, int], list[int]] = {}
        for text, fold, label in zip(batch.text, batch.fold, batch.label, strict=True):
            for t in {t for w in set(WORD.findall(text.lower())) for t in terms_of(w)}:
                held.setdefault((t, fold), [0, 0])[label] += 1
        yield pd.DataFrame([(w, f, a, b) for (w, f), (a, b) in held.items()], columns=["term", "fold", "clean", "toxic"])


def _view(terms: list[str], clean: np.ndarray, toxic: np.ndarray, n_clean: int, n_toxic: int) -> View:
    """The terms that tell, by their counts in documents; of stems that say the same one stays."""
    tells = evidence(clean, toxic, n_clean, n_toxic) >= EVIDENCE
    rate = (toxic + 0.5) / (n_toxic + 1) / ((clean + 0.5) / (n_clean + 1))
    words, marking, stems, seen = [], [], [], set()
    for i, t in enumerate(terms):
        if not tells[i]:
            continue
        if not t.endswith("*"):
            words.append(i)
            if rate[i] >= MARKING:
                marking.append(i)
        elif (key := (t[:3], clean[i], toxic[i])) not in seen:
            seen.add(key)
            stems.append(i)
    return View(*(np.array(x, np.int64) for x in (words, marking, stems)))


def train(docs: DataFrame, labels: DataFrame, *, rows: int = SAMPLE_ROWS, held: int = 0) -> Chain:
    """Fit a chain on at most ``rows`` labelled documents outside fold ``held``.

    Terms are counted on the executors; the driver gets those that tell toxic documents from
    others in the sample, however many, and a row of their counts for each sampled document.
    Documents of equal texts and labels count once, so that copies make no evidence.
    """
    fold = (F.floor(fold_of(F.col("doc_id"), 2**31) / FOLDS) % FOLDS).cast("int")
    sample = labelled_sample(docs, labels, label="toxic", rows=rows, folds=FOLDS, held=held).select("doc_id", "text", (F.col("label") > 0).cast("int").alias("label"), fold.alias("fold"))
    sample = stored(sample.groupBy("text", "label").agg(F.min(F.struct("doc_id", "fold")).alias("d")).select("d.*", "text", "label"), "texts")
    size = np.zeros((FOLDS, 2))
    for r in sample.groupBy("fold", "label").agg(F.count("*").alias("n")).collect():
        size[r.fold, r.label] = r.n
    counted = sample.select("text", "fold", "label").mapInPandas(_term_counts, "term string, fold int, clean long, toxic long")
    in_fold = lambda c, k: F.sum(F.when(F.col("fold") == k, F.col(c)).otherwise(0)).alias(f"{c}{k}")
    table_of = counted.groupBy("term").agg(*[in_fold(c, k) for c in ("clean", "toxic") for k in range(FOLDS)])
    got = table_of.where(_may_tell(size)).toPandas().sort_values("term")
    clean, toxic = (got[[f"{c}{k}" for k in range(FOLDS)]].to_numpy(float) for c in ("clean", "toxic"))
    terms = got.term.tolist()

    def view(without: int | None) -> View:
        use = [k for k in range(FOLDS) if k != without]
        return _view(terms, clean[:, use].sum(axis=1), toxic[:, use].sum(axis=1), size[use, 0].sum(), size[use, 1].sum())

    chain = Chain(terms, view(None), [])

    @F.pandas_udf(BinaryType())
    def counts(texts: pd.Series) -> pd.Series:
        """The terms that a text has, with how often, as pairs of 32 bits: far fewer bytes for the driver than all counts."""
        pairs = []
        for t in texts:
            own = chain.counts(t)
            at = np.flatnonzero(own)
            pairs.append(np.stack([at, own[at]]).astype(np.int32).tobytes())
        return pd.Series(pairs, dtype=object)

    rows_ = sample.select("doc_id", "label", "fold", counts("text").alias("x")).toPandas().sort_values("doc_id")
    x = np.zeros((len(rows_), len(terms) + 1), np.float32)
    for own, pairs in zip(x, rows_.x, strict=True):
        at, n = np.frombuffer(pairs, np.int32).reshape(2, -1)
        own[at] = n
    x, n_words = x[:, :-1], x[:, -1]
    label, fold_no = rows_.label.to_numpy() > 0, rows_.fold.to_numpy()

    def target(v: View, link: int) -> np.ndarray:
        hits, rate = v.hits(x, n_words)
        return (label & [hits > 0, hits >= 3, rate >= 1, label][link]).astype(float)

    def fitted(v: View, link: int, rows: np.ndarray) -> np.ndarray:
        return fit_linear(np.column_stack([v.of(link, x[rows], n_words[rows]), known[rows]]), target(v, link)[rows])

    views = [view(k) for k in range(FOLDS)]
    known, every = np.zeros((len(x), 0)), np.ones(len(x), bool)
    for link in range(len(CATEGORIES)):
        chain.weights.append(fitted(chain.view, link, every))
        out = np.zeros(len(x))
        for k in range(FOLDS):
            test = fold_no == k
            if test.any() and link + 1 < len(CATEGORIES):
                w = fitted(views[k], link, ~test)
                out[test] = sigmoid(np.column_stack([views[k].of(link, x[test], n_words[test]), known[test]]) @ w[:-1] + w[-1])
        known = np.column_stack([known, out])
    return chain


def _may_tell(size: np.ndarray) -> Column:
    """Whether a term's evidence reaches EVIDENCE over all folds, or without one of them."""
    def term(k: Column, n: float, rate: Column) -> Column:
        n = F.lit(float(n))
        held = F.when(k > 0, k * F.log(k / (n * rate))).otherwise(0.0)
        return held + F.when(n - k > 0, (n - k) * F.log((n - k) / (n * (1 - rate)))).otherwise(0.0)

    def ratio(use: list[int]) -> Column:
        n_clean, n_toxic = size[use, 0].sum(), size[use, 1].sum()
        clean, toxic = (sum((F.col(f"{c}{k}") for k in use[1:]), F.col(f"{c}{use[0]}")).cast("double") for c in ("clean", "toxic"))
        rate = (clean + toxic) / F.lit(float(max(n_clean + n_toxic, 1)))
        return F.coalesce(2 * (term(clean, n_clean, rate) + term(toxic, n_toxic, rate)), F.lit(0.0)) >= EVIDENCE - 1e-6

    folds = list(range(FOLDS))
    out = ratio(folds)
    for k in folds:
        out = out | ratio([j for j in folds if j != k])
    return out


def score(docs: DataFrame, chain: Chain, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``toxicity`` (the probabilities of CATEGORIES; replaced if it is there) for every row; a null text is empty."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def scored(texts: pd.Series) -> pd.Series:
        out: list[np.ndarray] = []
        for i in range(0, len(texts), AT_ONCE):
            out += list(chain.scores(np.array([chain.counts(t) for t in texts.iloc[i : i + AT_ONCE]])))
        return pd.Series(out, dtype=object)

    return docs.withColumn("toxicity", scored(F.coalesce(F.col(text_col), F.lit(""))))


def op7_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of all categories for all documents, and whether each is toxic.

    Labels are learned only from ids whose crc32 modulo 5 isn't 0 (``held_out`` is false).
    """
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    named = [F.col("toxicity")[i].alias(f"p_{c}") for i, c in enumerate(CATEGORIES)]
    return scored.select("doc_id", F.coalesce(fold_of(F.col("doc_id"), FOLDS) == 0, F.lit(False)).alias("held_out"), *named).withColumn("predicted", (F.col("p_toxic") >= THRESHOLD).cast("int"))


QUERIES = {"op7_toxicity_chain": op7_toxicity_chain}
SQL: dict[str, str] = {}
