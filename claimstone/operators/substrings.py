"""Texts that contain a name, without comparing every text with every name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimstone.session import stored
from claimstone.sources.tables import table

#: Names meet texts by one of their pieces of LONG characters; names under that by one of SHORT.
LONG, SHORT = 8, 3


def _pieces(text: Column, q: int) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - q + 1, F.lit(1))), lambda i: F.substr(text, i, F.lit(q))))


def containing(texts: DataFrame, names: DataFrame) -> DataFrame:
    """``text_id, name_id``: the first name, by ``place``, that a text of its scope contains.

    ``texts``: ``scope, text_id, text``; ``names``: ``scope, name_id, name, place``, of SHORT
    characters or more (shorter ones, null and empty ones match nothing).  A name is looked
    up by the piece of it that fewest texts of the scope have; ``contains`` verifies.
    Texts without a name have no row; a null scope is one of its own.
    """
    key = F.to_json(F.struct("scope")).alias("s")
    t = stored(texts.where("text is not null and text_id is not null").select(key, "text_id", "text"), "texts")
    n = stored(names.where(F.length("name") >= SHORT).select(key, "name_id", "name", "place"), "names")
    met = None
    for q, own in ((LONG, n.where(F.length("name") >= LONG)), (SHORT, n.where(F.length("name") < LONG))):
        asked = own.select("s", "name_id", F.explode(_pieces(F.col("name"), q)).alias("piece"))
        wanted = stored(asked.select("s", "piece").distinct(), "pieces-wanted")
        have = t.where(F.length("text") >= q).select("s", "text_id", F.explode(_pieces(F.col("text"), q)).alias("piece"))
        have = stored(have.join(wanted, ["s", "piece"]), "pieces-held")
        often = have.groupBy("s", "piece").agg(F.count("*").alias("df"))
        # A piece that no text has rules its name out.
        rarest = asked.join(often, ["s", "piece"], "left").groupBy("s", "name_id").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "piece")).alias("r")).where("r.df > 0").select("s", "name_id", F.col("r.piece").alias("piece"))
        pairs = have.join(rarest, ["s", "piece"]).select("s", "text_id", "name_id")
        met = pairs if met is None else met.unionByName(pairs)
    held = met.join(t, ["s", "text_id"]).join(n, ["s", "name_id"]).where(F.col("text").contains(F.col("name")))
    return held.groupBy("s", "text_id").agg(F.min(F.struct("place", "name_id")).alias("first")).select("text_id", F.col("first.name_id").alias("name_id"))


# --- Queries --------------------------------------------------------------------------


def documents_by_chunk_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document that each chunk's id names, in scopes by language; every seventh chunk names none."""
    docs = table(spark, sf_dir, "documents").where("doc_id is not null")
    name = F.concat(F.lit("_"), F.col("source"), F.lit("-"), F.col("doc_id").cast("string"), F.lit("_"))
    chunk = F.when(F.pmod("doc_id", F.lit(7)) == 0, F.concat(F.lit("chunk"), F.col("doc_id").cast("string"))).otherwise(F.concat(F.lit("job9"), name, F.lit("p1")))
    return containing(docs.select(F.col("lang").alias("scope"), F.col("doc_id").alias("text_id"), chunk.alias("text")), docs.select(F.col("lang").alias("scope"), F.col("doc_id").alias("name_id"), name.alias("name"), F.col("doc_id").alias("place")))


QUERIES = {"documents_by_chunk_id": documents_by_chunk_id}
SQL = {
    "documents_by_chunk_id": """
        WITH d AS (SELECT lang, doc_id, '_' || source || '-' || doc_id || '_' AS name FROM documents WHERE doc_id IS NOT NULL),
        c AS (SELECT lang, doc_id, CASE WHEN doc_id % 7 = 0 THEN 'chunk' || doc_id ELSE 'job9' || name || 'p1' END AS text FROM d)
        SELECT c.doc_id AS text_id, min(d.doc_id) AS name_id FROM c JOIN d ON c.lang = d.lang AND contains(c.text, d.name) GROUP BY c.doc_id""",
}
