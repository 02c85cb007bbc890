"""Ranking: BM25, cosine search in blocks, and their merge."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegralType

from claimstone.functions import values as V
from claimstone.functions.text import meaningful_tokens, numbers, tokenize, tokens_sql
from claimstone.session import stored
from claimstone.sources.tables import table

#: Tables of query terms are broadcast up to this many rows, and joined by a shuffle beyond.
BROADCAST_ROWS = 400_000


def _small(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def bm25(docs: DataFrame, queries: DataFrame, *, doc_id: str, query_id: str, text_col: str = "text", k1: float = V.BM25_K1, b: float = V.BM25_B) -> DataFrame:
    """``query_id, doc_id, score`` of all pairs that share a term.

    A query term counts as often as the query repeats it.  Documents count towards the
    corpus if their text isn't blank, even without a token.  Only terms of the queries
    leave the scan of the documents, so postings grow with matches, not with text.
    """
    asked = queries.select(F.col(query_id).alias("query_id"), F.explode(tokenize(F.col(text_col))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    asked = stored(asked, "query-terms")
    held = docs.where(F.trim(text_col) != "").select(F.col(doc_id).alias("doc_id"), tokenize(F.col(text_col)).alias("tokens"))
    stats = held.agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("avgdl"))
    terms = _small(asked.select("term").distinct())
    found = held.select("doc_id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term")).join(terms, "term")
    postings = stored(found.groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf")), "postings")
    # The corpus statistics are one row; df has a row for each term of the queries.
    one = stats.first()
    df = postings.groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", F.log(1 + (F.lit(one.n) - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    weighted = asked.join(df, "term")
    part = F.col("idf") * F.col("qtf") * (F.col("tf") * (k1 + 1)) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(one.avgdl or 1.0)))
    return postings.join(_small(weighted), "term").groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"))


def top_k(scores: DataFrame, k: int, *, least: float = 0.0) -> DataFrame:
    """The ``k`` best of each query with their ``rank``; scores are rounded to 9 places before ranking, ties by id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    ranked = scores.withColumn("score", F.round("score", 9)).where(F.col("score") > least).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k)

#: Cells of documents and queries, and weights of terms in them, that a task holds at once.
CELLS = 1 << 20


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``score`` (documents by queries) of all that may be among a query's ``k`` best once rounded to 9 places: of equal scores the ``k`` smallest ids."""
    n = score.shape[0]
    kth = np.partition(score, n - k, axis=0)[n - k] if n > k else np.zeros(score.shape[1])
    d, q = np.nonzero((score > 0) & (score >= kth - 2e-9))
    order = np.lexsort((ids[d], -score[d, q], q))
    d, q = d[order], q[order]
    at = np.arange(len(d))
    first = np.ones(len(d), bool)
    first[1:] = (q[1:] != q[:-1]) | (score[d[1:], q[1:]] != score[d[:-1], q[:-1]])
    kept = at - np.maximum.accumulate(np.where(first, at, 0)) < k
    return d[kept], q[kept]


def bm25_top_k(docs: DataFrame, queries: DataFrame, k: int, *, doc_id: str, query_id: str, text_col: str = "text", k1: float = V.BM25_K1, b: float = V.BM25_B) -> DataFrame:
    """``top_k`` of ``bm25``, with no row for each pair.

    A document's terms are in one row, so a batch of documents has its scores whole, and only
    what may be among the best of it leaves a task.  If ids repeat or aren't integers, or the queries
    have over BROADCAST_ROWS terms, the pairs are joined.
    """
    asked = queries.select(F.col(query_id).alias("query_id"), F.explode(tokenize(F.col(text_col))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    asked = stored(asked, "query-terms")
    repeated = docs.groupBy(doc_id).agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.col(doc_id).isNull())
    if not isinstance(docs.schema[doc_id].dataType, IntegralType) or asked.count() > BROADCAST_ROWS or not repeated.isEmpty():
        return top_k(bm25(docs, queries, doc_id=doc_id, query_id=query_id, text_col=text_col, k1=k1, b=b), k)
    terms = pa.array([r.term for r in asked.select("term").distinct().orderBy("term").collect()], pa.string())
    held = docs.where(F.trim(text_col) != "").select(F.col(doc_id).alias("doc_id"), tokenize(F.col(text_col)).alias("tokens"))
    kind = docs.schema[doc_id].dataType.simpleString()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch["tokens"]
            sizes = tokens.value_lengths().to_numpy()
            row = np.repeat(np.arange(len(sizes), dtype="int64"), sizes)
            code = pc.index_in(tokens.flatten(), value_set=terms)
            known = code.is_valid().to_numpy(zero_copy_only=False)
            cell, tf = np.unique(row[known] * max(len(terms), 1) + code.drop_null().to_numpy(), return_counts=True)
            ends = np.searchsorted(cell, np.arange(len(sizes) + 1, dtype="int64") * max(len(terms), 1)).astype("int32")
            of = lambda x: pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype("int32")))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(sizes.astype("int32")), of(cell % max(len(terms), 1)), of(tf)], ["doc_id", "dl", "codes", "tfs"])

    postings = stored(held.mapInArrow(counted, f"doc_id {kind}, dl int, codes array<int>, tfs array<int>"), "postings")
    one = postings.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
    df = np.zeros(len(terms))
    for r in postings.select(F.explode("codes").alias("c")).groupBy("c").agg(F.count("*").alias("df")).collect():
        df[r.c] = r.df
    idf, mean = np.log(1 + (one.n - df + 0.5) / (df + 0.5)), one.avgdl or 1.0
    # The queries of each term, one after another.
    rows = asked.collect()
    ids = sorted({r.query_id for r in rows if r.query_id is not None}) + [None] * any(r.query_id is None for r in rows)
    place = {q: i for i, q in enumerate(ids)}
    code = pc.index_in(pa.array([r.term for r in rows], pa.string()), value_set=terms).to_numpy(zero_copy_only=False).astype("int64")
    by = np.argsort(code, kind="stable")
    who, often = np.array([place[r.query_id] for r in rows], "int64")[by], np.array([r.qtf for r in rows], float)[by]
    weight, start = idf[code[by]] * often if len(rows) else often, np.searchsorted(code[by], np.arange(len(terms) + 1))

    def scores(rows: pa.RecordBatch) -> np.ndarray:
        sizes = rows["codes"].value_lengths().to_numpy()
        doc, t, tf = np.repeat(np.arange(len(sizes)), sizes), rows["codes"].flatten().to_numpy(), rows["tfs"].flatten().to_numpy().astype(float)
        part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * rows["dl"].to_numpy()[doc] / mean))
        n = start[t + 1] - start[t]
        before = np.concatenate([[0], np.cumsum(n)])
        score, i = np.zeros(len(sizes) * len(ids)), 0
        while i < len(t):
            # A term's queries may be many: postings as far as about CELLS of them go.
            j = max(i + 1, int(np.searchsorted(before, before[i] + CELLS, "right")) - 1)
            m = n[i:j]
            at = np.repeat(start[t[i:j]] - before[i:j], m) + np.arange(before[i], before[j])
            score += np.bincount(np.repeat(doc[i:j], m) * len(ids) + who[at], weight[at] * np.repeat(part[i:j], m), len(score))
            i = j
        return score.reshape(len(sizes), len(ids))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, CELLS // max(len(ids), 1))
        for batch in batches if ids else ():
            for i in range(0, len(batch), step):
                rows = batch.slice(i, step)
                score = scores(rows)
                d, q = _best(score, rows["doc_id"].to_numpy(), k)
                names = pa.array([ids[x] for x in q.tolist()], asked_type)
                yield pa.RecordBatch.from_arrays([names, rows["doc_id"].take(pa.array(d)), pa.array(score[d, q])], ["query_id", "doc_id", "score"])

    asked_type = to_arrow_type(asked.schema["query_id"].dataType)
    return top_k(postings.mapInArrow(best, f"query_id {asked.schema['query_id'].dataType.simpleString()}, doc_id {kind}, score double"), k)



#: Vectors of a block, which goes to a task whole, and of them those that meet the other block at once.
BLOCK, AT_ONCE = 4096, 256


def _matrix(rows: pa.Table, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of norm 1 of a block's rows (``id, v``); those of no or another length than ``size`` have norm 0."""
    v = rows["v"].combine_chunks()
    fit = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(v), size), False).to_numpy(zero_copy_only=False))
    m = np.zeros((rows.num_rows, size))
    m[fit] = pc.list_flatten(v.take(pa.array(fit))).to_numpy(zero_copy_only=False).astype(float).reshape(len(fit), size)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return rows["id"].to_numpy(), np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _longest(rows: pa.Table) -> int:
    return pc.max(pc.list_value_length(rows["v"].combine_chunks())).as_py() or 1


def _dealt(df: DataFrame, scope: Column, block: int, *, id_col: str, vector_col: str) -> DataFrame:
    """``scope, b, id, v``: the rows, dealt to blocks of about ``block`` rows of one scope."""
    rows = df.select(scope.alias("scope"), F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    sizes = rows.groupBy("scope").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    return rows.join(_small(sizes), "scope").withColumn("b", F.pmod(F.pmod(F.xxhash64("id"), F.lit(1 << 20)), F.col("blocks")).cast("int"))


def _meeting(left: DataFrame, right: DataFrame, meet: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """What ``meet`` makes of the rows of ``left`` and of ``right`` that have the same ``scope, x, y``: two blocks, and no more in a task at a time."""
    keys = ["scope", "x", "y"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, schema)


def cosine_top_k(vectors: DataFrame, queries: DataFrame, k: int, *, id_col: str = "vec_id", vector_col: str = "embedding", scope_cols: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """``query_id, doc_id, score, rank``: the exact ``k`` nearest of ``vectors`` by cosine for each row of ``queries``.

    Rows are dealt to blocks of about ``block`` of one scope; a query block meets each
    vector block of its scope once and keeps k for each query, as one matrix product.  A
    vector that is null, of norm 0 or of another length scores 0 with everything.
    A query's own row isn't among its results.
    """
    scope = F.to_json(F.struct(*scope_cols)) if scope_cols else F.lit("")
    left, right = (stored(_dealt(df, scope, block, id_col=id_col, vector_col=vector_col), f"{side}-blocks") for df, side in ((queries, "query"), (vectors, "vector")))
    # The blocks of each side that the other side's rows of a scope meet.
    of = lambda df, n: df.select("scope", F.col("blocks").alias(n)).distinct()
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = left.join(of(right, "n"), "scope").select("scope", F.col("b").alias("x"), every("n").alias("y"), "id", "v")
    held = right.join(of(left, "n"), "scope").select("scope", every("n").alias("x"), F.col("b").alias("y"), "id", "v")

    def nearest(q: pa.Table, c: pa.Table) -> pa.Table:
        if not q.num_rows or not c.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "doc_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        (qi, qm), (ci, cm) = (_matrix(rows, _longest(rows)) for rows in (q, c))
        out = []
        for at in range(0, len(qi), AT_ONCE):
            own, m = qi[at : at + AT_ONCE], qm[at : at + AT_ONCE]
            s = np.round(m @ cm.T if m.shape[1] == cm.shape[1] else np.zeros((len(own), len(ci))), 9)
            s[own[:, None] == ci[None]] = -2
            order = np.lexsort((np.broadcast_to(ci, s.shape), -s), axis=1)[:, :k]
            got = np.take_along_axis(s, order, 1).ravel()
            some = got > -2
            out.append(pa.table({"query_id": np.repeat(own, order.shape[1])[some], "doc_id": ci[order].ravel()[some], "score": got[some]}))
        return pa.concat_tables(out)

    scores = _meeting(asked, held, nearest, "query_id long, doc_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def cosine_pairs(vectors: DataFrame, least: float, *, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """``a, b, score``: all pairs a < b of vectors of one length with a cosine of ``least`` (above 0) or more, rounded to 9 places.

    Every two blocks meet once, as one matrix product.
    """
    rows = vectors.where(F.col(vector_col).isNotNull())
    dealt = stored(_dealt(rows, F.size(vector_col), block, id_col=id_col, vector_col=vector_col), "blocks")
    first = dealt.select("scope", F.col("b").alias("x"), F.explode(F.sequence(F.col("b"), F.col("blocks") - 1)).alias("y"), "id", "v")
    second = dealt.select("scope", F.explode(F.sequence(F.lit(0), F.col("b"))).alias("x"), F.col("b").alias("y"), "id", "v")

    def near(q: pa.Table, c: pa.Table) -> pa.Table:
        if not q.num_rows or not c.num_rows:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        size = _longest(q)
        (qi, qm), (ci, cm) = _matrix(q, size), _matrix(c, size)
        out, same = [], q["x"][0] == q["y"][0]
        for at in range(0, len(qi), AT_ONCE):
            own = qi[at : at + AT_ONCE]
            s = np.round(qm[at : at + AT_ONCE] @ cm.T, 9)
            i, j = np.nonzero((s >= least) & (own[:, None] < ci[None] if same else True))
            out.append(pa.table({"a": np.minimum(own[i], ci[j]), "b": np.maximum(own[i], ci[j]), "score": s[i, j]}))
        return pa.concat_tables(out)

    return _meeting(first, second, near, "a long, b long, score double")


def merge_hits(lexical: DataFrame, vector: DataFrame, k: int, *, both: float = 0.1) -> DataFrame:
    """Two result lists (``query_id, doc_id, score, rank``) as one.

    Each side's scores are divided by its query's largest (no positive one: 0) and count
    half; hits of both sides get ``both`` more.  Ties keep lexical order, then vector order.
    """
    best = Window.partitionBy("query_id")

    def side(df: DataFrame, name: str) -> DataFrame:
        top = F.max("score").over(best)
        return df.select("query_id", "doc_id", F.when(top > 0, F.col("score") / top).otherwise(0.0).alias(name), F.col("rank").alias(f"{name}_rank"))

    joined = side(lexical, "lexical").join(side(vector, "vector"), ["query_id", "doc_id"], "full_outer")
    score = 0.5 * F.coalesce("lexical", F.lit(0.0)) + 0.5 * F.coalesce("vector", F.lit(0.0)) + F.when(F.col("lexical").isNotNull() & F.col("vector").isNotNull(), both).otherwise(0.0)
    order = best.orderBy(F.desc("score"), F.col("lexical_rank").asc_nulls_last(), "vector_rank")
    ranked = joined.withColumn("score", F.round(score, 6)).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("query_id", "doc_id", "score", "rank")


def lexical_support(claims: DataFrame, claim: str, evidence: str) -> DataFrame:
    """``claims`` with ``support`` of one text column by another: 0.75 recall + 0.25 precision of tokens, 0 if their numbers are disjoint."""
    a, b = meaningful_tokens(F.col(claim)), meaningful_tokens(F.col(evidence))
    df = claims.withColumns({"_a": a, "_b": b, "_na": numbers(F.col(claim)), "_nb": numbers(F.col(evidence))})
    shared = F.size(F.array_intersect("_a", "_b"))
    disjoint = (F.size("_na") > 0) & (F.size("_nb") > 0) & ~F.arrays_overlap("_na", "_nb")
    score = F.when((F.size("_a") == 0) | (F.size("_b") == 0) | disjoint, 0.0).otherwise(0.75 * shared / F.greatest(F.size("_a"), F.lit(1)) + 0.25 * shared / F.greatest(F.size("_b"), F.lit(1)))
    return df.withColumn("support", F.round(score, 4)).drop("_a", "_b", "_na", "_nb")


# --- Queries --------------------------------------------------------------------------


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each benchmark item the three documents that match it best."""
    best = bm25_top_k(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 3, doc_id="doc_id", query_id="item_id")
    return best.select(F.col("query_id").alias("item_id"), "doc_id", F.round("score", 6).alias("score"), "rank")


def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of the index over all documents: documents, vocabulary, mean length."""
    held = table(spark, sf_dir, "documents").where("trim(text) <> ''").select("doc_id", tokenize(F.col("text")).alias("t"))
    sizes = held.agg(F.count("*").alias("documents"), F.round(F.avg(F.size("t")), 6).alias("mean_tokens"))
    words = held.select(F.explode("t").alias("term")).distinct().agg(F.count("*").alias("vocabulary"))
    parts = sizes.unionByName(words, allowMissingColumns=True)  # one row each
    return parts.agg(*[F.max(c).alias(c) for c in ("documents", "mean_tokens", "vocabulary")])


def frequent_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred terms in the most documents."""
    terms = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(tokenize(F.col("text")))).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("df")).orderBy(F.desc("df"), "term").limit(100)


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every twentieth."""
    v = table(spark, sf_dir, "embeddings")
    return cosine_top_k(v, v.where("vec_id % 20 = 0"), 5).select("query_id", "doc_id", F.round("score", 5).alias("score"), "rank")


def vector_topk_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same among vectors of the query's label only."""
    v = table(spark, sf_dir, "embeddings")
    return cosine_top_k(v, v.where("vec_id % 20 = 0"), 5, scope_cols=("label",)).select("query_id", "doc_id", F.round("score", 5).alias("score"), "rank")


def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 and vector hits of benchmark items merged; an item's vector is the one with its id, a document's likewise."""
    items = table(spark, sf_dir, "benchmark")
    lexical = bm25_top_k(table(spark, sf_dir, "documents"), items, 5, doc_id="doc_id", query_id="item_id")
    v = table(spark, sf_dir, "embeddings")
    near = cosine_top_k(v, v.join(items.select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi"), 5)
    return merge_hits(lexical, near, 5).select(F.col("query_id").alias("item_id"), "doc_id", "score", "rank")


def evidence_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the three best documents of an item support it."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    hits = bm25_top_k(docs, items, 3, doc_id="doc_id", query_id="item_id").select(F.col("query_id").alias("item_id"), "doc_id")
    both = docs.select("doc_id", F.col("text").alias("evidence")).join(hits, "doc_id").join(items.select("item_id", F.col("text").alias("claim")), "item_id")
    return lexical_support(both, "claim", "evidence").select("item_id", "doc_id", "support")


BM25_SQL = f"""
    h AS (SELECT doc_id, {tokens_sql('text')} AS t FROM documents WHERE trim(text, ' ') <> ''),
    st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM h),
    tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM h) GROUP BY ALL),
    q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({tokens_sql('text')}) AS term FROM benchmark) GROUP BY ALL),
    df AS (SELECT term, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, st GROUP BY term),
    sc AS (SELECT query_id, doc_id, round(sum(idf * qtf * (tf * {V.BM25_K1 + 1}) / (tf + {V.BM25_K1} * (1 - {V.BM25_B} + {V.BM25_B} * dl / avgdl))), 9) AS score
           FROM q JOIN tf USING (term) JOIN df USING (term), st GROUP BY query_id, doc_id),
    bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0)"""


def _cosine_sql(queries: str, scope: str = "") -> str:
    return f"""
    vs AS (SELECT q.vec_id AS query_id, c.vec_id AS doc_id, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9) AS score
           FROM embeddings q, embeddings c WHERE {queries} AND q.vec_id <> c.vec_id {scope}),
    vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM vs)"""


def numbers_sql(column: str) -> str:
    return rf"list_distinct(list_transform(regexp_extract_all(coalesce({column}, ''), '{V.NUMBER}'), lambda x: regexp_replace(trim(lower(x)), '\s+', ' ', 'g')))"


_MEANING = ", ".join(f"'{w}'" for w in V.GENERIC_TERMS)
SQL = {
    "bm25_topk": f"WITH {BM25_SQL} SELECT query_id AS item_id, doc_id, round(score, 6) AS score, rank::INT AS rank FROM bm WHERE rank <= 3",
    "index_stats": f"""WITH h AS (SELECT {tokens_sql('text')} AS t FROM documents WHERE trim(text, ' ') <> '')
        SELECT count(*) AS documents, round(avg(len(t)), 6) AS mean_tokens, (SELECT count(DISTINCT term) FROM (SELECT unnest(t) AS term FROM h)) AS vocabulary FROM h""",
    "frequent_terms": f"SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({tokens_sql('text')})) AS term FROM documents) GROUP BY term ORDER BY df DESC, term LIMIT 100",
    "vector_topk": f"WITH {_cosine_sql('q.vec_id % 20 = 0')} SELECT query_id, doc_id, round(score, 5) AS score, rank::INT AS rank FROM vr WHERE rank <= 5",
    "vector_topk_scoped": f"WITH {_cosine_sql('q.vec_id % 20 = 0', 'AND q.label = c.label')} SELECT query_id, doc_id, round(score, 5) AS score, rank::INT AS rank FROM vr WHERE rank <= 5",
    "hybrid_topk": f"""WITH {BM25_SQL}, {_cosine_sql('q.vec_id IN (SELECT item_id FROM benchmark)')},
        l AS (SELECT *, score / max(score) OVER (PARTITION BY query_id) AS s FROM bm WHERE rank <= 5),
        v AS (SELECT *, CASE WHEN max(score) OVER (PARTITION BY query_id) > 0 THEN score / max(score) OVER (PARTITION BY query_id) ELSE 0 END AS s FROM vr WHERE rank <= 5),
        m AS (SELECT query_id, doc_id, round(0.5 * coalesce(l.s, 0) + 0.5 * coalesce(v.s, 0) + CASE WHEN l.s IS NOT NULL AND v.s IS NOT NULL THEN 0.1 ELSE 0 END, 6) AS score, l.rank AS lr, v.rank AS vr
              FROM l FULL JOIN v USING (query_id, doc_id)),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, lr NULLS LAST, vr) AS rank FROM m)
        SELECT query_id AS item_id, doc_id, score, rank::INT AS rank FROM r WHERE rank <= 5""",
    "evidence_support": f"""WITH {BM25_SQL},
        p AS (SELECT b.item_id, d.doc_id, list_filter(list_distinct({tokens_sql('b.text')}), lambda x: NOT list_contains([{_MEANING}], x)) AS a,
              list_filter(list_distinct({tokens_sql('d.text')}), lambda x: NOT list_contains([{_MEANING}], x)) AS e, {numbers_sql('b.text')} AS na, {numbers_sql('d.text')} AS ne
              FROM bm JOIN benchmark b ON b.item_id = bm.query_id JOIN documents d ON d.doc_id = bm.doc_id WHERE bm.rank <= 3)
        SELECT item_id, doc_id, round(CASE WHEN len(a) = 0 OR len(e) = 0 OR (len(na) > 0 AND len(ne) > 0 AND NOT list_has_any(na, ne)) THEN 0
               ELSE 0.75 * len(list_intersect(a, e)) / len(a) + 0.25 * len(list_intersect(a, e)) / len(e) END, 4)::DOUBLE AS support FROM p""",
}
QUERIES = {
    "bm25_topk": bm25_topk, "index_stats": index_stats, "frequent_terms": frequent_terms, "vector_topk": vector_topk, "vector_topk_scoped": vector_topk_scoped,
    "hybrid_topk": hybrid_topk, "evidence_support": evidence_support,
}
