"""Quality classifier: a byte-level convolutional network in numpy.

A document's bytes are cut into overlapping chunks that cover all of it.  Learned byte
embeddings feed learned filters over every window of a chunk; the maximum of each filter is
the chunk's value, and the mean, the maximum and the minimum over all chunks combine into
one probability.  Every parameter, the embeddings included, is trained by gradient descent.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from claimstone.llm.learning import fold_of, labelled_sample, sigmoid
from claimstone.sources.tables import table

CHUNK, OVERLAP = 256, 32
WIDTH, DIMENSIONS, FILTERS = 6, 6, 32
#: Bound of training: labelled documents, each with its whole text.
SAMPLE_ROWS = 2500
EPOCHS, BATCH, RATE, DECAY, SEED = 14, 48, 0.01, 1e-4, 7
FOLDS, THRESHOLD = 5, 0.3
#: Chunks whose windows are held at a time.
AT_ONCE = 128


def chunks_of(text: str) -> np.ndarray:
    """The chunks of a whole text, (n, CHUNK) bytes, the last ones filled with zeros."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = max(1, -(-(len(data) - OVERLAP) // (CHUNK - OVERLAP)))
    padded = np.zeros((n - 1) * (CHUNK - OVERLAP) + CHUNK, np.uint8)
    padded[: len(data)] = data
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[:: CHUNK - OVERLAP]


class Network:
    """Parameters, scores and gradients."""

    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        self.p = {
            "embed": r.normal(0, 0.5, (256, DIMENSIONS)), "filters": r.normal(0, (WIDTH * DIMENSIONS) ** -0.5, (WIDTH * DIMENSIONS, FILTERS)),
            "shift": np.zeros(FILTERS), "out": r.normal(0, 0.1, 3 * FILTERS), "bias": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def windows(self, chunks: np.ndarray) -> np.ndarray:
        """The embedded windows: (chunks, places, WIDTH * DIMENSIONS)."""
        e = self.p["embed"][chunks].reshape(len(chunks), -1)
        return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(e, WIDTH * DIMENSIONS, axis=1)[:, ::DIMENSIONS])

    def responses(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The windows and what each filter says of them."""
        x = self.windows(chunks)
        return x, (x.reshape(-1, WIDTH * DIMENSIONS) @ self.p["filters"]).reshape(len(chunks), -1, FILTERS)

    def pooled(self, chunks: np.ndarray) -> np.ndarray:
        """The value of each filter in each chunk."""
        most = [self.responses(chunks[k : k + AT_ONCE])[1].max(axis=1) for k in range(0, len(chunks), AT_ONCE)]
        return np.tanh(np.concatenate(most) + self.p["shift"])

    @staticmethod
    def combined(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Mean, maximum and minimum over the chunks of each document."""
        sizes = np.diff(np.append(starts, len(h)))[:, None]
        return np.hstack([np.add.reduceat(h, starts) / sizes, np.maximum.reduceat(h, starts), np.minimum.reduceat(h, starts)])

    def score(self, texts: list[str]) -> np.ndarray:
        """The probability of label 1 of each whole text."""
        if not texts:
            return np.empty(0)
        values, sizes, held = [], [], []
        for text in texts:  # documents share passes over some AT_ONCE chunks
            held.append(chunks_of(text))
            sizes.append(len(held[-1]))
            if sum(map(len, held)) >= AT_ONCE:
                values.append(self.pooled(np.concatenate(held)))
                held = []
        if held:
            values.append(self.pooled(np.concatenate(held)))
        starts = np.cumsum([0, *sizes[:-1]])
        return sigmoid((self.combined(np.concatenate(values), starts) @ self.p["out"] + self.p["bias"]).astype(np.float64))

    def gradients(self, chunks: np.ndarray, starts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss of some documents."""
        p = self.p
        parts = []
        for k in range(0, len(chunks), AT_ONCE):  # of all windows only each filter's best are kept
            x, z = self.responses(chunks[k : k + AT_ONCE])
            at = z.argmax(axis=1)
            parts.append((at, np.take_along_axis(z, at[:, None], 1)[:, 0], x[np.arange(len(x))[:, None], at]))
        best, most, picked = (np.concatenate(c) for c in zip(*parts, strict=True))  # picked: (chunks, filters, window)
        h = np.tanh(most + p["shift"])
        d = self.combined(h, starts)
        wrong = ((sigmoid(d @ p["out"] + p["bias"]) - y) / len(y)).astype(np.float32)
        sizes = np.diff(np.append(starts, len(h)))
        doc = np.repeat(np.arange(len(starts)), sizes)
        back = (wrong[:, None] * p["out"])[doc]
        mean, largest, least = (back[:, k * FILTERS : (k + 1) * FILTERS] for k in range(3))
        dh = mean / sizes[doc][:, None]
        for part, k in ((largest, 1), (least, 2)):  # chunks that share an extreme share its gradient
            holds = h == d[doc, k * FILTERS : (k + 1) * FILTERS]
            dh = dh + part * holds / np.add.reduceat(holds.astype(np.float32), starts)[doc]
        dz = dh * (1 - h * h)
        rows = np.arange(len(chunks))[:, None]
        dx = dz[:, :, None] * p["filters"].T[None]
        at = chunks[rows[:, :, None], best[:, :, None] + np.arange(WIDTH)].ravel()
        flat = dx.reshape(-1, DIMENSIONS)
        return {
            "embed": np.column_stack([np.bincount(at, flat[:, k], 256) for k in range(DIMENSIONS)]), "filters": np.einsum("cfw,cf->wf", picked, dz),
            "shift": dz.sum(axis=0), "out": d.T @ wrong, "bias": wrong.sum(keepdims=True),
        }

    def fit(self, documents: list[np.ndarray], y: np.ndarray) -> Network:
        """Adam over shuffled batches of documents, the rate falling to zero; a fixed seed, so reruns agree."""
        r = np.random.default_rng(SEED)
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        steps = max(1, EPOCHS * -(-len(y) // BATCH))
        done = 0
        for _ in range(EPOCHS):
            order = r.permutation(len(y))
            for i in range(0, len(order), BATCH):
                ids = order[i : i + BATCH]
                starts = np.cumsum([0, *(len(documents[k]) for k in ids[:-1])])
                found = self.gradients(np.concatenate([documents[k] for k in ids]), starts, y[ids])
                done += 1
                for k, g in found.items():
                    g = (g + DECAY * self.p[k]).astype(np.float32)
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    self.p[k] -= RATE * (1 - done / steps) * (first[k] / (1 - 0.9**done)) / (np.sqrt(second[k] / (1 - 0.99**done)) + 1e-7)
        return self


def train(docs: DataFrame, labels: DataFrame, *, rows: int = SAMPLE_ROWS, held: int = 0) -> Network:
    """Fit on at most ``rows`` labelled documents outside fold ``held``, on all chunks of each.

    The driver gets the texts of these documents.  Without labels the network is as
    initialised, and scores are near one half.
    """
    sample = labelled_sample(docs, labels, label="quality", rows=rows, folds=FOLDS, held=held)
    got = sample.orderBy("doc_id", "text").toPandas()
    documents = [chunks_of(t) for t in got.text]
    return Network().fit(documents, (got.label.to_numpy() > 0).astype(np.float32))


def score(docs: DataFrame, network: Network, *, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (replaced if it is there), the probability of label 1 of every whole text; a null text is empty, which scores like any."""

    @F.pandas_udf(DoubleType())
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(network.score(texts.tolist()), dtype="float64")

    return docs.withColumn("score", scored(F.coalesce(F.col(text_col), F.lit(""))))


def op4_quality_convnet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of all documents; ids whose crc32 modulo 5 is 0 are held out of learning."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    held = F.coalesce(fold_of(F.col("doc_id"), FOLDS) == 0, F.lit(False)).alias("held_out")
    return score(docs, train(docs, labels)).select("doc_id", held, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op4_quality_convnet": op4_quality_convnet}
SQL: dict[str, str] = {}
