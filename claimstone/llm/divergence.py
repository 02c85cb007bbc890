"""Source divergence audit by chunk factorization.

Terms lie inside chunks, the runs of characters without a blank, and far fewer chunks are
distinct than occur.  So documents are only cut into chunks and these are counted per
document; each chunk that is distinct over all documents is tokenized once, its terms join
back, and documents and occurrences of each term are aggregated.

Documents are counted in blocks.  A block has one row for each chunk of a language in it:
the numbers of the documents that hold the chunk, and its occurrences for each source.  A
document is known by its number in its block, so the numbers of a term's chunks unite
inside a block, where they are bounded, and distinct documents add up over blocks.  A
chunk that every document has is one row for each block, not one for each document.

The divergence of two distributions is the triangular one, sum of (p-q)^2 / (p+q), in
whole billionths, each term rounded down.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimstone.llm.ragged import Numbers, numbered, slices
from claimstone.session import stored
from claimstone.sources.tables import table

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_DOCUMENTS, TOP_TERMS = 10, 10
SCALE = 1_000_000_000
#: A block ends at so many documents or bytes of text.
BLOCK_DOCUMENTS, BLOCK_BYTES = (1 << 15) - 1, 32 << 20
#: Pairs of sources are summed in tiles of so many sources, and in parts of about so many counts.
TILE, PART_ROWS = 512, 200_000

_DOC_BITS = 15
_POSTINGS = "block long, lang string, chunk binary, plain boolean, docs array<short>, sources array<long>, counts array<int>"
#: Chunks that are a term and nothing else.
_PLAIN = re.compile(rb"[A-Za-z\x80-\xff]+")


def _lists(values: pa.Array, starts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)), pa.int32()), values)


def _firsts(values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    new = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    return np.flatnonzero(new)


class _Block:
    """The chunks of some documents."""

    def __init__(self, number: int):
        self.number, self.bytes = number, 0
        self.chunks, self.langs, self.sources = Numbers(), Numbers(), Numbers()
        self.keys: list[np.ndarray] = []
        self.source_of: list[int] = []

    def add(self, lang: str, source: int, text: bytes) -> None:
        doc = self.langs[lang] << 46 | len(self.source_of)
        self.source_of.append(self.sources[source])
        for piece in slices(text):
            self.keys.append(numbered(piece.lower().split(), self.chunks).astype(np.int64) << _DOC_BITS | doc)
        self.bytes += len(text) + 1

    def rows(self) -> pa.RecordBatch:
        """One row for each language and chunk; the block's keys go with it, since copies of them are most of a task's memory."""
        held = np.concatenate([np.zeros(0, np.int64), *self.keys])
        self.keys.clear()
        held.sort()
        at = _firsts(held)
        n, held = np.diff(np.append(at, len(held))).astype(np.int32), held[at]
        docs, chunk = (held & (1 << _DOC_BITS) - 1).astype(np.int16), held >> _DOC_BITS
        del held, at
        first = _firsts(chunk)
        by_source = np.repeat(np.arange(len(first)) << 32, np.diff(np.append(first, len(chunk))))
        by_source |= np.array(self.source_of, np.int64)[docs]
        order = np.argsort(by_source, kind="stable")
        by_source = by_source[order]
        place = _firsts(by_source)
        counts = np.add.reduceat(n[order], place, dtype=np.int32) if len(n) else n
        by_source = by_source[place]
        del order, place, n
        chunks = list(self.chunks)
        plain = np.fromiter((_PLAIN.fullmatch(c) is not None for c in chunks), bool, len(chunks))
        names = pa.array(np.array(list(self.sources), np.int64)[by_source & 0xFFFFFFFF])
        at = chunk[first]
        del chunk
        return pa.record_batch(
            [
                pa.array(np.full(len(first), self.number)),
                pa.array(list(self.langs), pa.string()).take(pa.array(at >> 46 - _DOC_BITS)),
                pa.array(chunks, pa.binary()).take(pa.array(at & 0x7FFFFFFF)),
                pa.array(plain[at & 0x7FFFFFFF]),
                _lists(pa.array(docs), first),
                *(_lists(x, np.flatnonzero(np.diff(by_source >> 32, prepend=-1))) for x in (names, pa.array(counts))),
            ],
            names=["block", "lang", "chunk", "plain", "docs", "sources", "counts"],
        )


def _count(batches: Iterator[pa.RecordBatch], block_documents: int) -> Iterator[pa.RecordBatch]:
    part, n = TaskContext.get().partitionId(), 0
    block = _Block(part << 32)
    for batch in batches:
        for lang, source, text in zip(*batch.columns, strict=True):
            block.add(lang.as_py(), source.as_py(), text.as_py())
            if len(block.source_of) >= block_documents or block.bytes >= BLOCK_BYTES:
                yield from _cut(block.rows())
                n += 1
                block = _Block(part << 32 | n)
    yield from _cut(block.rows())


def _cut(rows: pa.RecordBatch, size: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    for at in range(0, rows.num_rows, size):
        yield rows.slice(at, size)


def _named(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))], text)


def _numbered_sources(named: DataFrame) -> tuple[DataFrame, Column]:
    """``lang, source, number`` of all groups, and the number as an expression: a hash under which no two sources meet."""
    groups = stored(named.select("lang", "source").distinct(), "groups")
    for salt in range(1 << 16):
        number = F.xxhash64(F.concat(F.lit(str(salt) if salt else ""), "source"))
        sources, numbers = groups.agg(F.count_distinct("source"), F.count_distinct(number)).first()
        if sources == numbers:
            return groups.withColumn("number", number), number
    raise RuntimeError("sources can't be numbered")


def term_counts(
    docs: DataFrame, *, min_documents: int = 1, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", block_documents: int = BLOCK_DOCUMENTS,
) -> tuple[DataFrame, DataFrame]:
    """``lang, term, documents`` and ``lang, source, term, n`` of the terms in at least ``min_documents`` documents of a language, exact over all rows.

    Each row is a document, also where ids repeat.  Null texts, languages and sources are
    empty ones; texts without a term give no row; columns besides the three are ignored.

    A chunk that is a term and nothing else is its own term; the others are tokenized once
    each and their terms join back.
    """
    named = _named(docs, text_col, lang_col, source_col)
    groups, number = _numbered_sources(named)
    postings = stored(named.select("lang", number.alias("source"), "text").mapInArrow(partial(_count, block_documents=block_documents), _POSTINGS), "postings").withColumn("chunk", F.col("chunk").cast("string"))
    compound = postings.where(~F.col("plain"))
    tokens = compound.select("chunk").distinct().select("chunk", F.explode(F.regexp_extract_all("chunk", F.lit(TERM), F.lit(0))).alias("term"))
    terms = stored(tokens.groupBy("chunk", "term").agg(F.count("*").alias("times")), "chunk-terms")
    columns = ["block", "lang", "term", "times", "docs", "sources", "counts"]
    joined = stored(compound.join(terms, "chunk").select(*columns), "joined-terms")
    held = postings.where("plain").select("block", "lang", F.col("chunk").alias("term"), F.lit(1).cast("long").alias("times"), "docs", "sources", "counts").unionByName(joined)
    united = F.size(F.array_distinct(F.flatten(F.collect_list("docs"))))
    documents = held.groupBy("block", "lang", "term").agg(united.alias("n")).groupBy("lang", "term").agg(F.sum("n").alias("documents"))
    documents = stored(documents.where(F.col("documents") >= min_documents), "term-documents")
    kept = held.join(documents.select("lang", "term"), ["lang", "term"]).select("lang", "term", "times", F.inline(F.arrays_zip("sources", "counts")))
    counts = kept.groupBy("lang", F.col("sources").alias("number"), "term").agg(F.sum(F.col("counts") * F.col("times")).alias("n"))
    return documents, counts.join(groups, ["lang", "number"]).select("lang", "source", "term", "n")


def share(n: Column, total: Column, kept: Column) -> Column:
    """A term's share of ``total``, smoothed by two occurrences for each kept term, in billionths; exact for counts up to 19 digits."""
    top = F.lit(SCALE).cast("decimal(10,0)") * (n + 2).cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", top, (total + 2 * kept).cast("decimal(20,0)"))


def _apart(p: Column, q: Column) -> Column:
    """(p-q)^2 / (p+q), rounded down."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _pair_sums(key: tuple, held: pd.DataFrame, sources: pd.DataFrame) -> pd.DataFrame:
    """Sums over the terms of a part for the pairs of sources of two tiles."""
    lang, _, low, high = key
    sources = sources.sort_values("no")
    no, rest = sources.no.to_numpy(), sources.rest.to_numpy()
    term, column = np.unique(held.term.to_numpy(str) if len(held) else np.zeros(0, str), return_inverse=True)
    row = np.searchsorted(no, held.no.to_numpy())
    p = held.p.to_numpy()
    sums = np.zeros((len(no), len(no)), np.int64)
    order = np.argsort(column, kind="stable")
    row, column, p = row[order], column[order], p[order]
    for at in range(0, len(term), 64):
        a, b = np.searchsorted(column, (at, at + 64))
        table = np.repeat(rest[:, None], min(64, len(term) - at), axis=1)
        table[row[a:b], column[a:b] - at] = p[a:b]
        for i in range(len(no) - 1):
            far = table[i] - table[i + 1 :]
            sums[i, i + 1 :] += (far * far // (table[i] + table[i + 1 :])).sum(axis=1)
    # Kept terms of the part that none of these sources has.
    far = rest[:, None] - rest
    absent = int(sources.terms.iloc[0]) - len(term)
    sums += absent * (far * far // np.maximum(rest[:, None] + rest, 1))
    i, j = np.triu_indices(len(no), 1)
    tiles = sources.tile.to_numpy()
    ours = (tiles[i] == low) & (tiles[j] == high)
    i, j = i[ours], j[ours]
    return pd.DataFrame({"lang": lang, "low": no[i], "high": no[j], "value": sums[i, j]})


def _tiled(rows: DataFrame) -> DataFrame:
    """Each row once for each tile of its language that its source's tile meets."""
    met = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return met.withColumn("t_low", F.least("tile", "with")).withColumn("t_high", F.greatest("tile", "with"))


def audit(
    docs: DataFrame, *, min_documents: int = MIN_DOCUMENTS, top_terms: int = TOP_TERMS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
    block_documents: int = BLOCK_DOCUMENTS, tile: int = TILE, part_rows: int = PART_ROWS,
) -> DataFrame:
    """``lang, source, part, item, value, rank``.

    Each language keeps the terms in at least ``min_documents`` of its documents.  Part
    ``pair`` has each other source of the language with the divergence of both over all kept
    terms (0 where none is kept); part ``term`` the ``top_terms`` kept terms that are more
    frequent in the source than in its language, by their summand.  Ranks run by falling
    value and then by the item's bytes.  Rows are documents, also where ids repeat; nulls
    are empty strings; an empty table gives no row.
    """
    _, counts = term_counts(docs, min_documents=min_documents, text_col=text_col, lang_col=lang_col, source_col=source_col, block_documents=block_documents)
    held = stored(counts, "kept-counts")
    whole = stored(held.groupBy("lang", "term").agg(F.sum("n").alias("lang_n")), "lang-counts")
    langs = whole.groupBy("lang").agg(F.sum("lang_n").alias("lang_total"), F.count("*").alias("kept"))
    sums = held.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("rows"))
    groups = _named(docs, text_col, lang_col, source_col).select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    of_lang = Window.partitionBy("lang")
    groups = groups.fillna(0, ["total", "rows", "lang_total", "kept"]).withColumn("no", F.row_number().over(of_lang.orderBy("source")) - 1)
    groups = groups.withColumn("tile", F.floor(F.col("no") / tile).cast("int")).withColumn("tiles", F.ceil(F.count("*").over(of_lang) / tile).cast("int"))
    groups = groups.withColumn("parts", F.ceil((F.sum("rows").over(of_lang) + 1) / part_rows))
    rest = F.when(F.col("kept") > 0, share(F.lit(0), F.col("total"), F.col("kept"))).otherwise(0)
    groups = stored(groups.withColumn("rest", rest), "source-groups")
    p = stored(held.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("kept"))), "shares")

    q = share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
    above = p.join(whole, ["lang", "term"]).withColumn("q", q).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _apart(F.col("p"), F.col("q")).alias("value"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    top = above.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top_terms)

    at = ["lang", "part", "t_low", "t_high"]
    part = F.pmod(F.xxhash64("term"), "parts")
    left = _tiled(p.withColumn("part", part)).select(*at, "term", "no", "p").groupBy(*at)
    terms = whole.join(groups.where("no = 0").select("lang", "parts"), "lang").groupBy("lang", part.alias("part")).agg(F.count("*").alias("terms"))
    every = groups.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).join(terms, ["lang", "part"], "left").fillna(0, ["terms"])
    right = _tiled(every).select(*at, "no", "tile", "rest", "terms").groupBy(*at)
    sums = left.cogroup(right).applyInPandas(_pair_sums, "lang string, low int, high int, value long").groupBy("lang", "low", "high").agg(F.sum("value").alias("value"))
    both = F.array(F.struct(F.col("low").alias("no"), F.col("high").alias("other")), F.struct(F.col("high").alias("no"), F.col("low").alias("other")))
    names = groups.select("lang", "no", "source")
    pairs = sums.select("lang", "value", F.inline(both)).join(names, ["lang", "no"]).join(names.select("lang", F.col("no").alias("other"), F.col("source").alias("item")), ["lang", "other"])
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(by_value))
    return pairs.unionByName(top)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language lie apart, over all documents, and by which terms."""
    return audit(table(spark, sf_dir, "documents"))


QUERIES = {"op11_source_divergence": op11_source_divergence}
SQL = {
    "op11_source_divergence": rf"""
        WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
        o AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '{TERM}')) AS term FROM d),
        kept AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= {MIN_DOCUMENTS}),
        v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
        c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN kept USING (lang, term) GROUP BY ALL),
        g AS (SELECT d.lang, d.source, coalesce(any_value(s.n), 0) AS total FROM d LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL) s USING (lang, source) GROUP BY ALL),
        p AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, (1 + {SCALE}::HUGEINT * (coalesce(c.n, 0) + 2) // (g.total + 2 * v.v))::HUGEINT AS p
            FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
        q AS (SELECT lang, term, (1 + {SCALE}::HUGEINT * (n + 2) // (sum(n) OVER (PARTITION BY lang) + 2 * v))::HUGEINT AS q
            FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL) JOIN v USING (lang)),
        pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value
                FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
        terms AS (SELECT p.lang, p.source, p.term AS item, (p.p - q.q) * (p.p - q.q) // (p.p + q.q) AS value FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q),
        ranked AS (SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
            FROM (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms))
        SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= {TOP_TERMS}""",
}
