"""Quality rules: counts of words, symbols and repeats, and bands of compression ratios.

A text's ratio is its zstandard size over its UTF-8 size.  Text that repeats itself has a
low ratio, random letters a high one; short text can't be compressed much, so each length
has its own band.  The whole text and each of its chunks of ``CHUNK`` bytes are held
against the band of their own length: a text is rejected if the whole is outside, or if
chunks outside hold more than ``CHUNK_SHARE`` of its bytes.  The chunks find what the whole
hides: a long text whose fifth part is one line over and over has an ordinary ratio.

Each text is read by itself, so the work is one pass without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from claimstone.llm.ragged import BLANK, Numbers, numbered, slices
from claimstone.sources.tables import table

LEVEL = 3
CHUNK = 4096
#: A text is rejected if chunks outside their bands hold over this share of its bytes.
CHUNK_SHARE = 0.2
#: From so many bytes on: the least and the largest ratio.  Below the first length any ratio will do.
BANDS = ((64, 0.40, 2.0), (128, 0.35, 1.0), (256, 0.30, 0.90), (512, 0.28, 0.82), (1024, 0.25, 0.78), (2048, 0.22, 0.76), (4096, 0.20, 0.76))
MIN_WORDS, MAX_REPEATED_PERCENT, WINDOW = 50, 50, 3

_FROM, _LOW, _HIGH = (np.array(x) for x in zip((0, 0.0, np.inf), *BANDS, strict=True))
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def outside(n_bytes: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """Whether ratios lie outside the bands of texts of so many bytes."""
    band = np.searchsorted(_FROM, n_bytes, side="right") - 1
    return (ratio < _LOW[band]) | (ratio > _HIGH[band])


def repeated_words(numbers: np.ndarray, window: int = WINDOW) -> int:
    """How many words lie in windows that occur twice or more, the first included."""
    n = len(numbers) - window + 1
    if n < 2:
        return 0
    key = numbers[:n].astype(np.int64)
    for k in range(1, window):
        key = np.unique(key << 32 | numbers[k : k + n], return_inverse=True)[1].astype(np.int64)
    twice = np.bincount(key)[key] > 1
    covered = np.zeros(len(numbers), bool)
    for k in range(window):
        covered[k : k + n] |= twice
    return int(covered.sum())


def duplicate_lines(text: bytes) -> int:
    r"""How many lines, cut at \n, have a word and equal an earlier line."""
    seen, n, at = set(), 0, 0
    while at <= len(text):
        end = text.find(b"\n", at)
        end = len(text) if end < 0 else end
        line = text[at:end]
        if line and not line.isspace():
            n += line in seen
            seen.add(line)
        at = end + 1
    return n


def describe(text: bytes, compressor: zstandard.ZstdCompressor) -> tuple:
    """The measures of one text, in the order of MEASURES."""
    numbers = Numbers()
    words, chars, symbols = [np.zeros(0, np.int32)], 0, 0
    for piece in slices(text):
        words.append(numbered(piece.split(), numbers))
        raw = np.frombuffer(piece, np.uint8)
        chars += int(((raw & 0xC0) != 0x80).sum() - BLANK[raw].sum())
        symbols += int(_SYMBOL[raw].sum())
    words = np.concatenate(words)
    size = np.array([len(text)])
    if not text:
        return 0, 0, 0, 0, 0, 0, None, 0
    ratio = np.array([len(compressor.compress(text))]) / size
    starts = range(0, len(text), CHUNK)
    lengths = np.minimum(CHUNK, len(text) - np.array(starts))
    packed = np.array([len(compressor.compress(text[a : a + CHUNK])) for a in starts])
    odd = int(lengths[outside(lengths, packed / lengths)].sum())
    if outside(size, ratio)[0]:
        odd = len(text)
    return len(text), len(words), chars, symbols, duplicate_lines(text), repeated_words(words), float(ratio[0]), odd


MEASURES = StructType(
    [StructField(n, LongType()) for n in ("n_bytes", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [StructField("ratio", DoubleType()), StructField("odd_bytes", LongType())]
)


@F.pandas_udf(MEASURES)
def _measures(texts: pd.Series) -> pd.DataFrame:
    compressor = zstandard.ZstdCompressor(level=LEVEL)
    return pd.DataFrame([describe(t, compressor) for t in texts], columns=MEASURES.names)


def assess(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measures and verdicts of every row; columns besides the two named are ignored.

    ``n_bytes``, ``n_words``, ``word_chars`` (code points in words), ``n_symbols``,
    ``n_dup_lines``, ``n_repeat_words``; ``ratio`` of the whole; ``odd_bytes``, all bytes if
    the whole is outside its band and else those of the chunks outside; ``base_failed`` for
    under 50 words or over half of the words in repeated windows; ``kept`` for texts that
    neither the counts nor the bands reject.  A null text is an empty one: no word, no
    ratio (null), rejected.  Rows that repeat, and null ids, are each returned.
    """
    m = docs.select(F.col(id_col).alias("doc_id"), _measures(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("m")).select("doc_id", "m.*")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    fits = F.col("odd_bytes") <= CHUNK_SHARE * F.col("n_bytes")
    return m.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & fits)


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and compression bands over all documents."""
    return assess(table(spark, sf_dir, "documents"))


QUERIES = {"op12_quality_rules": op12_quality_rules}
SQL: dict[str, str] = {}
