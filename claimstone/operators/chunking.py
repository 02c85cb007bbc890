"""Chunks: overlapping windows, pages, and windows of turns.

A window's start depends on where the one before it ended, which no set operation says;
each document's windows are found in one pass over its own text, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from claimstone.functions import values as V
from claimstone.session import stored
from claimstone.sources.tables import table

SPAN = StructType([StructField("start", IntegerType()), StructField("end", IntegerType())])


def _spans(text: str, size: int, overlap: int, keep: float) -> list[tuple[int, int]]:
    out, start = [], 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            blank = text.rfind(" ", start, end)
            if blank > start + int(size * keep):
                end = blank
        out.append((start, end))
        if end == len(text):
            break
        start = max(end - overlap, start + 1)
    return out


def sliding_windows(docs: DataFrame, *, text_col: str = "text", size: int = V.CHUNK_CHARS, overlap: int = V.CHUNK_OVERLAP) -> DataFrame:
    """``docs`` without the text, a row for each window: ``chunk_index, start_char, end_char, chunk``.

    Windows of ``size`` characters; one that doesn't end the text ends at its last blank if
    that is past 80 % of it.  The next starts ``overlap`` characters before its end.  Null
    and empty texts have no window; windows of blanks only are dropped but keep their index.
    """

    @F.pandas_udf(ArrayType(SPAN))
    def spans(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"start": a, "end": b} for a, b in _spans(t, size, overlap, V.CHUNK_KEEP)] for t in texts], dtype=object)

    rest = [c for c in docs.columns if c != text_col]
    rows = docs.where(F.col(text_col).isNotNull()).select(*rest, text_col, F.posexplode(spans(text_col)).alias("chunk_index", "s"))
    piece = F.substr(F.col(text_col), F.col("s.start") + 1, F.col("s.end") - F.col("s.start"))
    return rows.select(*rest, "chunk_index", F.col("s.start").alias("start_char"), F.col("s.end").alias("end_char"), piece.alias("chunk")).where(F.trim("chunk") != "")


def pages(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, a row for each page that isn't blank: ``page`` from 1, ``start_char, end_char, chunk``; pages end at form feeds."""
    rest = [c for c in docs.columns if c != text_col]
    parts = F.split(F.coalesce(F.col(text_col), F.lit("")), "\f")
    rows = stored(docs.select(*rest, F.monotonically_increasing_id().alias("_row"), parts.alias("_parts")).select(*rest, "_row", F.posexplode("_parts").alias("i", "_p")), "pages")
    # A page starts behind all pages before it and a form feed for each.
    before = Window.partitionBy("_row").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("z", F.struct(F.col("_p").alias("p"), F.coalesce(F.sum(F.length("_p") + 1).over(before), F.lit(0)).cast("int").alias("o")))
    return rows.select(*rest, (F.col("i") + 1).alias("page"), F.col("z.o").alias("start_char"), (F.col("z.o") + F.length("z.p")).alias("end_char"), F.col("z.p").alias("chunk")).where(F.trim("chunk") != "")


def turn_windows(turns: DataFrame, *, group: str = "conv_id", order: str = "turn", text_col: str = "text", speaker: str = "role", size: int = V.WINDOW_CHARS) -> DataFrame:
    """Turns of a conversation packed in order: ``group, window, first, last, turns, n_chars, speaker``.

    A window closes before the turn that would take it past ``size`` characters, one blank
    between turns.  Blank turns are skipped.  ``speaker`` is the window's only one, or null.
    Rows reach Python sorted, and a conversation's open window is all that is held of it.
    """
    rows = turns.where(F.trim(text_col) != "").select(group, order, F.col(speaker).alias("speaker"), F.length(text_col).cast("long").alias("n")).repartition(group).sortWithinPartitions(group, order, "n", "speaker")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict | None = None
        columns = [group, "window", "first", "last", "turns", "n_chars", "speaker"]

        def closed(w: dict) -> tuple:
            return (w["g"], w["window"], w["first"], w["last"], w["turns"], w["n"], w["speaker"])

        for batch in batches:
            out = []
            for g, o, who, n in batch.itertuples(index=False):
                if state and state["g"] == g and state["n"] + 1 + n <= size:
                    state |= {"last": o, "turns": state["turns"] + 1, "n": state["n"] + 1 + n, "speaker": who if state["speaker"] == who else None}
                else:
                    if state:
                        out.append(closed(state))
                    state = {"g": g, "window": state["window"] + 1 if state and state["g"] == g else 0, "first": o, "last": o, "turns": 1, "n": n, "speaker": who}
            yield pd.DataFrame(out, columns=columns)
        if state:
            yield pd.DataFrame([closed(state)], columns=columns)

    return rows.mapInPandas(pack, f"{group} long, window long, first long, last long, turns long, n_chars long, speaker string")


# --- Queries --------------------------------------------------------------------------


def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sliding_windows(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "chunk_index", "start_char", "end_char", F.md5("chunk").alias("chunk_md5"))


def chunk_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = sliding_windows(table(spark, sf_dir, "documents").select("source", "lang", "text"))
    return chunks.groupBy("source", "lang").agg(F.count("*").alias("chunks"), F.sum(F.col("end_char") - F.col("start_char")).alias("chars"), F.max("chunk_index").alias("last_index"))


def conversation_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_windows(table(spark, sf_dir, "conversations"))


_WINDOWS = """
    w(doc_id, i, s, e, text) AS (
      SELECT doc_id, 0, 0, CASE WHEN length(text) <= 3000 THEN length(text)
             WHEN 3000 - instr(reverse(substring(text, 1, 3000)), ' ') > 2400 AND instr(reverse(substring(text, 1, 3000)), ' ') > 0 THEN 3000 - instr(reverse(substring(text, 1, 3000)), ' ') ELSE 3000 END, text
      FROM documents WHERE length(text) > 0
      UNION ALL
      SELECT doc_id, i + 1, n, CASE WHEN length(text) <= n + 3000 THEN length(text)
             WHEN 3000 - instr(reverse(substring(text, n + 1, 3000)), ' ') > 2400 AND instr(reverse(substring(text, n + 1, 3000)), ' ') > 0 THEN n + 3000 - instr(reverse(substring(text, n + 1, 3000)), ' ') ELSE n + 3000 END, text
      FROM (SELECT *, greatest(e - 500, s + 1) AS n FROM w WHERE e < length(text)))"""
SQL = {
    "chunk_windows": f"WITH RECURSIVE {_WINDOWS} SELECT doc_id, i AS chunk_index, s::INT AS start_char, e::INT AS end_char, md5(substring(text, s + 1, e - s)) AS chunk_md5 FROM w WHERE trim(substring(text, s + 1, e - s), ' ') <> ''",
    "chunk_totals": f"""WITH RECURSIVE {_WINDOWS} SELECT source, lang, count(*) AS chunks, sum(e - s)::BIGINT AS chars, max(i) AS last_index FROM w JOIN (SELECT doc_id, source, lang FROM documents) USING (doc_id)
        WHERE trim(substring(text, s + 1, e - s), ' ') <> '' GROUP BY ALL""",
}
QUERIES = {"chunk_windows": chunk_windows, "chunk_totals": chunk_totals, "conversation_windows": conversation_windows}
