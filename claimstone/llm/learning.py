"""Bounded samples of labelled documents, and a linear model."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimstone.session import stored


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, *, label: str, rows: int, folds: int, held: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """At most ``rows`` labelled documents outside fold ``held``: ``doc_id, text, label``.

    The ids with the smallest hashes that are in ``docs`` are taken, the same ones on every
    run.  An id that several rows have counts once, with the text of the smallest hash; one
    that has several labels with the largest.  Null labels and ids don't count.  The chosen
    ids are at most ``rows``, so they may be broadcast.
    """
    judged = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & (fold_of(F.col(id_col), folds) != held))
    judged = judged.groupBy(F.col(id_col).alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    held_ids = docs.select(F.col(id_col).alias("doc_id"), F.struct(F.xxhash64(text), F.md5(text)).alias("mark"))
    chosen = held_ids.join(judged, "doc_id").groupBy("doc_id", "label").agg(F.min("mark").alias("mark")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.struct(F.xxhash64(text), F.md5(text)).alias("mark"))
    found = texts.join(F.broadcast(chosen), ["doc_id", "mark"]).groupBy("doc_id", "label").agg(F.first("text").alias("text"))
    return stored(found.select("doc_id", "text", "label"), "sample")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_linear(x: np.ndarray, y: np.ndarray, l2: float = 0.3, steps: int = 25) -> np.ndarray:
    """Weights, the bias last, of an L2-regularised logistic model by Newton's method.

    The bias is free; with labels of one kind only, it alone carries their rate.  Without
    any row nothing has the label: the bias alone is set, to -20.
    """
    if not len(x):
        return np.append(np.zeros(x.shape[1]), -20.0)
    x = np.column_stack([x, np.ones(len(x))])
    ridge = np.full(x.shape[1], l2)
    ridge[-1] = 1e-2
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = sigmoid(x @ w)
        gradient = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), gradient)
        w -= step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w
