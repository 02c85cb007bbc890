"""SimHash near-duplicates by multi-index hashing.

A text's fingerprint has a bit set where over half of its shingle hashes have it.  Two
fingerprints link at ``RADIUS`` = 2 or fewer differing bits.  Cut in two segments of 32 bits,
linked fingerprints differ by at most one bit in one of them, so each looks up the Hamming
ball of radius 1 around each of its segments, and complete distances verify the matches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from claimstone.operators.graph import connected_components
from claimstone.session import stored
from claimstone.sources.tables import table

SHINGLE_WORDS = 3
SEED = 42
RADIUS = 2
#: A segment value that more fingerprints share isn't paired up; see links().
BUCKET_PAIRS = 64


def fingerprint(text: str | None, width: int = SHINGLE_WORDS) -> int:
    """The unsigned 64-bit fingerprint of a whole text; 0 if it has no word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words) - width + 1
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if n <= 1:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[width - 1 :].tolist(), strict=True)), ">u8", n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


@F.pandas_udf(LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="uint64").astype("int64")


def _flips(value: Column, bits: int) -> Column:
    """``value`` and ``value`` with each of its low ``bits`` bits flipped."""
    return F.concat(F.array(value), *[F.array(value.bitwiseXOR(F.lit(1 << b if b < 63 else -(1 << 63)))) for b in range(bits)])


def _cleared(value: Column) -> Column:
    """``value`` and ``value`` with each one of its set bits cleared, of 32."""
    masks = F.array(*[F.lit(1 << b) for b in range(32)])
    return F.concat(F.array(value), F.transform(F.filter(masks, lambda m: value.bitwiseAND(m) != 0), lambda m: value.bitwiseXOR(m)))


def links(nodes: DataFrame) -> DataFrame:
    """Links between distinct fingerprints (``fp`` long, ``rep`` the id to link), as ``src, dst``.

    Every two fingerprints within RADIUS are connected through the links, if not directly.

    Two segments that differ by one bit are found from the side that has the bit set, so a
    ball is the segment and its single-bit clearings.  A segment value that more than
    BUCKET_PAIRS fingerprints share would give pairs in the square of their number.  All
    fingerprints that hold or look up such a value meet exactly and without pairs instead:
    two of them are within 2 bits if, and only if, some value lies within 1 bit of both;
    each emits the 65 values within 1 bit, and the at most 65 that meet in a value are
    within 2 bits of each other.
    """
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("fp", 32)
    sides = F.array(*[F.struct(F.lit(i).alias("seg"), v.alias("val")) for i, v in enumerate((low, high))])
    index = nodes.select("fp", "rep", F.inline(sides))
    probes = index.select("seg", F.col("fp").alias("fp_a"), F.col("rep").alias("rep_a"), F.posexplode(_cleared(F.col("val"))).alias("pos", "val"))
    hot = stored(index.groupBy("seg", "val").count().where(F.col("count") > BUCKET_PAIRS).select("seg", "val"), "hot")
    close = F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp"))) <= RADIUS
    once = (F.col("pos") > 0) | (F.col("fp_a") < F.col("fp"))
    pairs = (
        probes.join(index.join(hot, ["seg", "val"], "left_anti"), ["seg", "val"]).where((F.col("fp_a") != F.col("fp")) & once & close)
        .select(F.col("rep_a").alias("src"), F.col("rep").alias("dst"))
    )
    if hot.isEmpty():
        return pairs
    crowd = probes.join(hot, ["seg", "val"], "left_semi").select(F.col("fp_a").alias("fp"), F.col("rep_a").alias("rep")).distinct()
    crowd = crowd.unionByName(index.join(hot, ["seg", "val"], "left_semi").select("fp", "rep")).distinct()
    met = crowd.select("rep", F.explode(_flips(F.col("fp"), 64)).alias("mid")).groupBy("mid").agg(F.min("rep").alias("src"), F.collect_set("rep").alias("reps"))
    stars = met.where(F.size("reps") > 1).select("src", F.explode("reps").alias("dst")).where("src <> dst").distinct()
    return pairs.unionByName(stars)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row.

    ``component_id`` is the smallest id that links reach.  Equal texts have equal
    fingerprints; texts of null or no word have 0 and link like any other.  A row without
    an id gets its fingerprint and a null component and links nothing.  Rows that repeat an
    id are each returned.  Columns besides the two named are ignored.
    """
    prints = stored(docs.select(F.col(id_col).alias("doc_id"), _fingerprints(F.coalesce(F.col(text_col), F.lit(""))).alias("fp")), "prints")
    nodes = stored(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    found = connected_components(links(nodes)).withColumnRenamed("node", "rep")
    joined = stored(nodes.join(found, "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id")), "joined")
    return prints.join(joined, "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )


def op2_simhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op2_simhash_near_dup": op2_simhash_near_dup}
SQL: dict[str, str] = {}
