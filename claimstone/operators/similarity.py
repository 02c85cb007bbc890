"""Duplicate statements: equal keys, similar token sets, their components and survivors."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from claimstone.functions.text import match_key, meaning_sql, meaningful_tokens, tokenize, tokens_sql
from claimstone.operators.graph import connected_components
from claimstone.operators.ranges import positions
from claimstone.session import stored
from claimstone.sources.tables import table

NEAR = 0.8
#: Sets of fewer tokens are never near duplicates, only equal ones.  Conflicts have no least size.
LEAST_TOKENS = 4
#: Bits of a set's parities, and of them folded; how many sets of one leader meet in one group.
BITS, FOLDED, TOGETHER = 2048, 512, 128
#: Bits of a set that go with each of its tokens, so that most pairs go where they meet.
NARROW = 256
#: Two sets of at most so many tokens move whole with their pair.
SHORT = 64


def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``key_md5, members, first_id``: statements that are equal but for case and punctuation, two or more."""
    keyed = docs.select(F.col(id_col).alias("id"), F.md5(match_key(F.col(text_col))).alias("key_md5"))
    return keyed.groupBy("key_md5").agg(F.count("*").alias("members"), F.min("id").alias("first_id")).where("members > 1")


def token_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, class_id``: rows with equal token sets share the smallest id among them; stored.

    Sets are known by 128 bits of hash, so that texts don't move.
    """
    tokens = F.array_sort(F.array_distinct(tokenize(F.col(text_col))))
    marked = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.md5(F.array_join(tokens, " ")).alias("mark"))
    marked = stored(marked, "marks")
    first = stored(marked.groupBy("mark").agg(F.min("id").alias("class_id")), "classes")
    return stored(marked.join(first, "mark").select("id", "class_id"), "members")


@F.pandas_udf(ArrayType(LongType()))
def _parities(sets: pd.Series) -> pd.Series:
    """For each of BITS remainders whether an odd number of the set's tokens has it."""
    odd = lambda s: np.packbits((np.bincount(np.asarray(s, "int64") & (BITS - 1), minlength=BITS) & 1).astype("uint8"), bitorder="little").view("int64")
    return pd.Series([odd(s) for s in sets])


@F.pandas_udf(ArrayType(LongType()))
def _presence(sets: pd.Series) -> pd.Series:
    """For each of NARROW remainders whether a token of the set has it."""
    any_ = lambda s: np.packbits(np.bincount(np.asarray(s, "int64") & (NARROW - 1), minlength=NARROW) > 0, bitorder="little").view("int64")
    return pd.Series([any_(s) for s in sets])


def _words(bits: Column, name: str) -> list[Column]:
    return [bits[i].alias(f"{name}{i}") for i in range(NARROW // 64)]


def _folded(bits: Column, size: int) -> list[Column]:
    """The words of a set's parities for ``size`` remainders."""
    n, out = size // 64, []
    for i in range(n):
        word = bits[i]
        for k in range(i + n, BITS // 64, n):
            word = word.bitwiseXOR(bits[k])
        out.append(word)
    return out


def _sifted(pairs: DataFrame, ordered: DataFrame, least: float, folded: bool) -> DataFrame:
    """The pairs that may have a Jaccard of ``least``: sets differ in no fewer tokens than their parities in bits."""
    side = lambda k: ordered.select(F.col("class_id").alias(k), F.col("n").alias(f"n{k}"), (F.array(*_folded(F.col("bits"), FOLDED)) if folded else F.col("bits")).alias(f"w{k}"))
    apart = sum((F.bit_count(F.col("wa")[i].bitwiseXOR(F.col("wb")[i])) for i in range((FOLDED if folded else BITS) // 64)), F.lit(0))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(_near(apart, F.col("na") + F.col("nb"), least)).select("a", "b")


def _near(apart: Column, n: Column, least: float) -> Column:
    """Whether sets of ``n`` tokens in all whose parities differ in ``apart`` bits may have a Jaccard of ``least``."""
    return apart <= n - 2 * least / (1 + least) * n + 1e-6


def _whole(pairs: DataFrame, ordered: DataFrame) -> DataFrame:
    """``a, b, na, nb, shared`` of pairs of short sets."""
    side = lambda k: ordered.where(F.col("n") <= SHORT).select(F.col("class_id").alias(k), F.col("n").alias(f"n{k}"), F.col("set").alias(f"s{k}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.select("a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).alias("shared"))


GROUP = ["la", "pa", "lb", "pb"]


def _dealt(pairs: DataFrame, ordered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pairs by group, and each set once for each group that it is in.

    A class's leader is the smallest class that it pairs with, or itself: near copies of one
    text mostly have one.  A group is the pairs between two leaders' classes, of which each
    leader's are parted by their hash so that about TOGETHER meet.
    """
    ends = pairs.select(F.col("b").alias("id"), F.col("a").alias("to")).unionByName(pairs.select(F.col("a").alias("id"), F.col("a").alias("to")))
    leaders = stored(ends.groupBy("id").agg(F.min("to").alias("leader")), "leaders")
    parts = stored(leaders.groupBy("leader").agg(F.ceil(F.count("*") / TOGETHER).alias("parts")), "leader-parts")
    placed = stored(leaders.join(parts, "leader").select("id", "leader", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part")), "places")
    side = lambda k: placed.select(F.col("id").alias(k), F.col("leader").alias(f"l{k}"), F.col("part").alias(f"p{k}"))
    dealt = stored(pairs.join(side("a"), "a").join(side("b"), "b"), "dealt")
    own = [F.col(g).alias(f"of_{g}") for g in GROUP]
    held = dealt.select(*own, F.col("a").alias("class_id")).unionByName(dealt.select(*own, F.col("b").alias("class_id"))).distinct()
    return dealt, held.join(ordered.select("class_id", "set"), "class_id")


def _shared(dealt: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b, na, nb, shared`` of the pairs of each group."""

    def count(pairs: pa.Table, held: pa.Table) -> pa.Table:
        of = {i: np.sort(np.asarray(s, "int64")) for i, s in zip(held["class_id"].to_pylist(), (s.values for s in held["set"]))}
        a, b = pairs["a"].to_pylist(), pairs["b"].to_pylist()

        def both(x: np.ndarray, y: np.ndarray) -> int:
            merged = np.concatenate([x, y])
            merged.sort(kind="stable")
            return int(np.count_nonzero(merged[1:] == merged[:-1]))

        sizes = [pa.array([len(of[i]) for i in k], pa.int32()) for k in (a, b)]
        return pa.table({"a": pairs["a"], "b": pairs["b"], "na": sizes[0], "nb": sizes[1], "shared": pa.array([both(of[i], of[j]) for i, j in zip(a, b)], pa.int32())})

    schema = f"a {dealt.schema['a'].dataType.simpleString()}, b {dealt.schema['b'].dataType.simpleString()}, na int, nb int, shared int"
    return dealt.groupBy(*GROUP).cogroup(sets.groupBy(*[f"of_{g}" for g in GROUP])).applyInArrow(count, schema)


def near_pairs(docs: DataFrame, members: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = NEAR, least_tokens: int = LEAST_TOKENS) -> DataFrame:
    """``a, b, jaccard``: classes a < b of different sets of ``least_tokens`` or more with a Jaccard of ``least`` or more.

    Tokens are ordered from rare to frequent.  Sets this similar share one of their first
    n - ceil(least * n) + 1 tokens, their sizes are within ``least`` of each other, and what
    follows that token is long enough.  So ids, sizes, places and NARROW parities of prefix
    tokens meet, and pairs whose parities differ in more bits than similar sets may go there, unwritten.
    Short sets then move with their pair.  Of the other pairs more go by more parities; their
    sets, hashes of 8 bytes a token, move once for each group, not for each pair.
    """
    heads = members.where("id = class_id").select("class_id")
    sets = docs.join(heads, docs[id_col] == heads["class_id"]).groupBy("class_id").agg(F.first(F.array_distinct(tokenize(F.col(text_col)))).alias("tokens")).where(F.size("tokens") >= least_tokens)
    flat = stored(sets.select("class_id", F.explode(F.transform("tokens", lambda t: F.xxhash64(t))).alias("t")), "tokens")
    ranks = stored(flat.groupBy("t").agg(F.count("*").alias("df")), "frequencies")
    # Tokens of one set only can't be shared; they count in sizes and verification through n.
    ordered = flat.join(ranks, "t").groupBy("class_id").agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("s"))
    n = F.size("s")
    ordered = stored(ordered.select("class_id", n.alias("n"), F.transform("s", lambda x: x["t"]).alias("set"), (n - F.ceil(n * least - 1e-9) + 1).cast("int").alias("p")).withColumn("bits", _parities("set")), "sets")
    prefix = stored(ordered.select("class_id", "n", *[w.alias(f"w{i}") for i, w in enumerate(_folded(F.col("bits"), NARROW))], F.posexplode(F.slice("set", F.lit(1), F.col("p"))).alias("i", "t")), "prefixes")
    a, b = (prefix.select(*[F.col(c).alias(c if c == "t" else f"{c}_{side}") for c in prefix.columns]) for side in "ab")
    sized = (F.col("class_id_a") < F.col("class_id_b")) & (F.col("n_a") >= F.col("n_b") * least - 1e-9) & (F.col("n_b") >= F.col("n_a") * least - 1e-9)
    # At the first token that both hold, all that both hold comes from there on.
    rest = F.least(F.col("n_a") - F.col("i_a"), F.col("n_b") - F.col("i_b"))
    apart = sum((F.bit_count(F.col(f"w{i}_a").bitwiseXOR(F.col(f"w{i}_b"))) for i in range(NARROW // 64)), F.lit(0))
    met = a.join(b, "t").where(sized & (rest * (1 + least) >= least * (F.col("n_a") + F.col("n_b")) - 1e-9) & _near(apart, F.col("n_a") + F.col("n_b"), least))
    met = stored(met.select(F.col("class_id_a").alias("a"), F.col("class_id_b").alias("b"), (F.greatest("n_a", "n_b") <= SHORT).alias("short")).distinct(), "candidates")
    scored, pairs = _whole(met.where("short").select("a", "b"), ordered), met.where("not short").select("a", "b")
    if not pairs.isEmpty():
        for folded in (True, False):
            pairs = stored(_sifted(pairs, ordered, least, folded), "alike")
        scored = scored.unionByName(_shared(*_dealt(pairs, ordered)))
    return scored.where(F.col("shared") >= least * (F.col("na") + F.col("nb") - F.col("shared")) - 1e-9).select("a", "b", F.round(F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")), 6).alias("jaccard"))


def conflicts(statements: DataFrame) -> DataFrame:
    """``a, b, jaccard``: classes of statements (``doc_id, text``) with a Jaccard of 0.3 up to NEAR, whatever their size."""
    return near_pairs(statements, token_classes(statements), least=0.3, least_tokens=1).where(F.col("jaccard") < NEAR)


def components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, component_id``: the smallest id that equal or near token sets lead to, for every row with an id."""
    members = token_classes(docs, id_col=id_col, text_col=text_col)
    linked = connected_components(near_pairs(docs, members, id_col=id_col, text_col=text_col).select(F.col("a").alias("src"), F.col("b").alias("dst")))
    linked = stored(linked.withColumnRenamed("node", "class_id"), "linked")
    return members.join(linked, "class_id", "left").select("id", F.coalesce("component", "class_id").alias("component_id"))


def prior_duplicates(items: DataFrame, *, id_col: str = "item_id", text_col: str = "text", alike: float = 0.90, held: float = 0.82, scope_col: str | None = None) -> DataFrame:
    """``id, n_prior, first_prior``: statements that an earlier one (smaller id) repeats.

    With ``scope_col`` ids are those of a scope, statements of different scopes don't meet,
    and the result has ``scope`` too; a null scope is one of its own.

    Two do if their meaningful tokens have a Jaccard of ``alike``, or the smaller set has
    LEAST_TOKENS or more and the other holds ``held`` of it.  Either way one of the smaller
    set's n - ceil(held * n) + 1 rarest tokens is in the larger one, so those are looked up.

    What the larger set lacks shows in NARROW bits of both, so most pairs go where they
    meet, unwritten.  Tokens are looked up by hashes; whole sets decide.

    Equal sets are one class, which pairs once; a statement's prior ones are those before it
    among its class and the classes that pair with it.
    """
    if scope_col is not None:
        own = items.where(F.col(id_col).isNotNull()).select(F.struct(F.col(scope_col).alias("scope"), F.col(id_col).alias("id")).alias("id"), F.col(text_col).alias("text"))
        name = F.concat(F.to_json(F.struct("id.scope")), F.lit("|"))
    else:
        own = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        name = F.lit("")
    marked = own.groupBy("id").agg(F.first(F.array_sort(meaningful_tokens(F.col("text")))).alias("s")).where(F.size("s") > 0)
    marked = marked.withColumn("s", F.transform("s", lambda t: F.concat(name, t)))  # tokens of a scope
    marked = stored(marked.withColumn("mark", F.md5(F.array_join("s", " "))), "statements")
    classes = stored(marked.groupBy("mark").agg(F.min("id").alias("class_id"), F.count("*").alias("members")), "classes")
    members = stored(marked.select("id", "mark").join(classes, "mark").select("id", "class_id", "members"), "members")
    sets = marked.join(classes.select("mark", F.col("class_id").alias("id")), ["mark", "id"], "left_semi").select("id", "s", F.size("s").alias("n"), F.transform("s", lambda t: F.xxhash64(t)).alias("h"))
    sets = stored(sets.withColumn("bits", _presence("h")), "sets")
    # Of a smaller set at least so many are in the larger one; one without room for a miss has no other set beside it.
    low = min(alike, held)
    shares = F.ceil(F.col("n") * low - 1e-9)
    asked = sets.where((F.col("n") >= LEAST_TOKENS) | (F.col("n") >= alike * (F.col("n") + 1) - 1e-9))
    flat = sets.select("id", F.explode("h").alias("t"))
    rare = flat.join(stored(flat.groupBy("t").agg(F.count("*").alias("df")), "frequencies"), "t")
    rare = rare.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("r")).join(asked.select("id", "n", "bits"), "id")
    first = stored(rare.select(F.col("id").alias("a"), F.col("n").alias("na"), (F.col("n") - shares).alias("misses"), *_words(F.col("bits"), "p"), F.explode(F.slice("r", F.lit(1), (F.col("n") - shares + 1).cast("int"))).alias("r")).withColumn("t", F.col("r.t")).drop("r"), "rarest")
    other = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), *_words(F.col("bits"), "q"), F.explode("h").alias("t"))
    lacks = sum((F.bit_count(F.col(f"p{i}").bitwiseAND(F.bitwise_not(f"q{i}"))) for i in range(NARROW // 64)), F.lit(0))
    met = stored(first.join(other, "t").where((F.col("a") != F.col("b")) & (F.col("nb") >= F.col("na")) & (lacks <= F.col("misses"))).select("a", "b").distinct(), "met")
    both = met.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    shared, least = F.size(F.array_intersect("sa", "sb")), F.least(F.size("sa"), F.size("sb"))
    same = (shared >= alike * (F.size("sa") + F.size("sb") - shared) - 1e-9) | ((least >= LEAST_TOKENS) & (shared >= held * least - 1e-9))
    pairs = stored(both.where(same).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "alike")
    # For each class its own members and those of its pairs, in one order.
    sides = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    own = members.where("members > 1").select("class_id").unionByName(sides.select(F.col("a").alias("class_id"))).distinct()
    meet = stored(sides.select(F.col("a").alias("own"), F.col("b").alias("class_id")).unionByName(own.select(F.col("class_id").alias("own"), "class_id")), "meet")
    row = positions(meet.join(members.select("id", "class_id"), "class_id").select("own", "id", (F.col("own") == F.col("class_id")).alias("asked")), "own", "id")
    least_ids = meet.groupBy("own").agg(F.min("class_id").alias("first_prior"))
    found = stored(row.where("asked and pos > 1").join(least_ids, "own").select("id", (F.col("pos") - 1).cast("long").alias("n_prior"), "first_prior"), "prior")
    if scope_col is None:
        return found
    return found.select("id.scope", "id.id", "n_prior", F.col("first_prior.id").alias("first_prior"))


# --- Queries --------------------------------------------------------------------------


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def exact_dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_docs(spark, sf_dir))


def near_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return near_pairs(docs, token_classes(docs))


def dup_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(_docs(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def dedup_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each component its representative: most tokens, then longest, then first; with the size of the component."""
    docs = _docs(spark, sf_dir)
    sized = docs.select("doc_id", F.size(tokenize(F.col("text"))).alias("n_tokens"), F.length("text").alias("n"))
    joined = components(docs).withColumnRenamed("id", "doc_id").join(sized, "doc_id")
    best = F.max(F.struct("n_tokens", "n", (-F.col("doc_id")).alias("first")))
    return joined.groupBy("component_id").agg(F.count("*").alias("members"), best.alias("best")).select("component_id", "members", (-F.col("best.first")).alias("kept_id"))


def duplicate_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each source: turns of text into sentences, how many repeat an earlier document's, by key."""
    parts = _docs(spark, sf_dir).select("doc_id", "source", F.explode(F.split(F.coalesce("text", F.lit("")), r"[.!?]\s+|\n")).alias("s"))
    keyed = parts.select("doc_id", "source", F.md5(match_key(F.col("s"))).alias("key")).where(F.length(match_key(F.col("s"))) >= 12)
    first = stored(keyed.groupBy("key").agg(F.min("doc_id").alias("first_id")), "sentence-keys")
    return keyed.join(first, "key").groupBy("source").agg(F.count("*").alias("sentences"), F.count_if(F.col("doc_id") > F.col("first_id")).alias("repeated"))


def conflict_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark statements alike enough to conflict and too different to be duplicates."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return conflicts(items)


def conflict_band_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same among the first sentences of all documents, one for each class of equal token sets."""
    first = F.split(F.btrim(F.coalesce("text", F.lit("")), F.lit(" \t\r\n")), r"[.!?]\s+|\n", 2)[0]
    return conflicts(_docs(spark, sf_dir).select("doc_id", first.alias("text")))


def repeated_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First turns of conversations that an earlier conversation's repeats."""
    turns = table(spark, sf_dir, "conversations").where("turn = 0 and role = 'user'").select(F.col("conv_id").alias("item_id"), "text")
    return prior_duplicates(turns)


def repeated_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns of all conversations that earlier ones, by conversation and turn, repeat."""
    turns = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("item_id"), "text")
    repeated = prior_duplicates(turns)
    return repeated.select("id.conv_id", "id.turn", "n_prior", F.col("first_prior.conv_id").alias("first_conv_id"), F.col("first_prior.turn").alias("first_turn"))


_SETS = f"""
    k AS (SELECT doc_id, list_sort(list_distinct({tokens_sql('text')})) AS s FROM documents),
    c AS (SELECT s, min(doc_id) AS class_id FROM k GROUP BY s),
    t AS (SELECT class_id, len(s) AS n, unnest(s) AS term FROM c WHERE len(s) >= 4),
    sh AS (SELECT a.class_id AS a, b.class_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS m FROM t a JOIN t b ON a.term = b.term AND a.class_id < b.class_id
           AND a.n >= 0.8 * b.n AND b.n >= 0.8 * a.n GROUP BY ALL),
    pr AS (SELECT a, b, round(m / (na + nb - m), 6) AS jaccard FROM sh WHERE 10 * m >= 8 * (na + nb - m))"""
_COMPONENTS = f"""
    {_SETS},
    e AS (SELECT a AS x, b AS y FROM pr UNION SELECT b, a FROM pr),
    r(node, reach) AS (SELECT class_id, class_id FROM c UNION SELECT e.y, r.reach FROM r JOIN e ON e.x = r.node AND r.reach < e.y),
    l AS (SELECT node, min(reach) AS component_id FROM r GROUP BY node),
    m AS (SELECT k.doc_id, l.component_id FROM k JOIN c USING (s) JOIN l ON l.node = c.class_id)"""
SQL = {
    "exact_dup_groups": "SELECT md5(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g'))) AS key_md5, count(*) AS members, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "near_dup_pairs": f"WITH {_SETS} SELECT * FROM pr",
    "dup_components": f"WITH RECURSIVE {_COMPONENTS} SELECT doc_id, component_id FROM m",
    "dedup_survivors": f"""WITH RECURSIVE {_COMPONENTS},
        z AS (SELECT m.component_id, d.doc_id, len({tokens_sql('d.text')}) AS n_tokens, length(d.text) AS n FROM m JOIN documents d USING (doc_id)),
        o AS (SELECT *, row_number() OVER (PARTITION BY component_id ORDER BY n_tokens DESC, n DESC, doc_id) AS rk, count(*) OVER (PARTITION BY component_id) AS members FROM z)
        SELECT component_id, members, doc_id AS kept_id FROM o WHERE rk = 1""",
    "duplicate_statements": r"""WITH p AS (SELECT doc_id, source, trim(regexp_replace(lower(unnest(regexp_split_to_array(coalesce(text, ''), '[.!?]\s+|\n'))), '[^a-z0-9]+', ' ', 'g')) AS key FROM documents),
        f AS (SELECT key, min(doc_id) AS first_id FROM p WHERE length(key) >= 12 GROUP BY key)
        SELECT source, count(*) AS sentences, count(*) FILTER (WHERE doc_id > first_id) AS repeated FROM p JOIN f USING (key) GROUP BY source""",
}
SQL["repeated_statements"] = f"""
    WITH k AS (SELECT conv_id AS id, {meaning_sql('text')} AS s FROM conversations WHERE turn = 0 AND role = 'user'),
    p AS (SELECT b.id, a.id AS prior, len(a.s) AS na, len(b.s) AS nb, len(list_intersect(a.s, b.s)) AS m FROM k a JOIN k b ON a.id < b.id AND len(a.s) > 0 AND len(b.s) > 0)
    SELECT id, count(*) AS n_prior, min(prior) AS first_prior FROM p WHERE 10 * m >= 9 * (na + nb - m) OR (least(na, nb) >= 4 AND 100 * m >= 82 * least(na, nb)) GROUP BY id"""
SQL["repeated_turns"] = f"""
    WITH k AS (SELECT conv_id, turn, (conv_id, turn) AS id, {meaning_sql('text')} AS s FROM conversations),
    p AS (SELECT b.conv_id, b.turn, a.id AS prior, len(a.s) AS na, len(b.s) AS nb, len(list_intersect(a.s, b.s)) AS m FROM k a JOIN k b ON a.id < b.id AND len(a.s) > 0 AND len(b.s) > 0),
    f AS (SELECT * FROM p WHERE 10 * m >= 9 * (na + nb - m) OR (least(na, nb) >= 4 AND 100 * m >= 82 * least(na, nb)))
    SELECT conv_id, turn, count(*) AS n_prior, min(prior)[1] AS first_conv_id, min(prior)[2] AS first_turn FROM f GROUP BY conv_id, turn"""
SQL["conflict_pairs"] = f"""
    WITH k AS (SELECT item_id, list_sort(list_distinct({tokens_sql('text')})) AS s FROM benchmark),
    c AS (SELECT s, min(item_id) AS i FROM k WHERE len(s) >= 1 GROUP BY s),
    p AS (SELECT a.i AS a, b.i AS b, round(len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))), 6) AS jaccard FROM c a JOIN c b ON a.i < b.i)
    SELECT * FROM p WHERE jaccard >= 0.3 AND jaccard < 0.8"""
QUERIES = {
    "exact_dup_groups": exact_dup_groups, "near_dup_pairs": near_dup_pairs, "dup_components": dup_components, "dedup_survivors": dedup_survivors, "duplicate_statements": duplicate_statements,
    "conflict_pairs": conflict_pairs, "conflict_band_pairs": conflict_band_pairs, "repeated_statements": repeated_statements, "repeated_turns": repeated_turns,
}
