"""Canonical requirements: of those that say the same in a scope one stays, with what the others know.

Two requirements of a scope are one if their texts are equal but for case and marks, if the
facts of one are mostly in a composite other, or if their facts are nearly equal and their
actors don't differ; across documents their goals must agree too.  An accepted and a
rejected one never are.  What is close but not one is marked for review.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimstone.functions import values as V
from claimstone.functions.facts import fact_tokens
from claimstone.functions.text import match_key, meaningful_tokens, strings
from claimstone.operators.graph import connected_components
from claimstone.plans import derived
from claimstone.session import stored

NEAR, LEAST, CONTAINED, SAME_GOAL = 0.8, 4, 0.60, 0.75
PRIORITIES = ["Low", "Medium", "High", "Critical"]
#: Different texts, and characters of all of them, up to which what is known of each is broadcast.
KNOWN, KNOWN_CHARS = 10_000, 1 << 21


def actor_key(actor: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.coalesce(actor, F.lit("")))), r"\s+", " ")


def actors_differ(a: Column, b: Column) -> Column:
    """Whether both are named and differ by more than a plural or the name of a technical part."""
    technical = lambda c: c.rlike("|".join(V.TECHNICAL))
    singular = lambda c: F.rtrim(c, F.lit("s"))
    return (a != "") & (b != "") & (a != b) & (singular(a) != singular(b)) & ~(technical(a) & technical(b))


def _jaccard(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return shared / F.greatest(F.size(a) + F.size(b) - shared, F.lit(1))


def numeric_context(text: Column) -> Column:
    """The facts within CONTEXT_TOKENS tokens of a number, those of no meaning aside."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([$€£]?\d[\d,]*(?:\.\d+)?|[a-z]+)"), F.lit(1))
    near = F.filter(F.transform(tokens, lambda t, i: F.when(t.rlike(r"^[$€£]?\d"), F.array_join(F.slice(tokens, F.greatest(i - V.CONTEXT_TOKENS, F.lit(0)) + 1, F.least(i, F.lit(V.CONTEXT_TOKENS)) + V.CONTEXT_TOKENS + 1), " "))), lambda w: w.isNotNull())
    return F.array_except(F.array_distinct(F.flatten(F.transform(near, fact_tokens))), strings(V.NO_CONTEXT))


def orthogonal(a: Column, b: Column) -> Column:
    """Whether two numeric rules limit different things: their contexts share less than two facts."""
    x, y = numeric_context(a), numeric_context(b)
    return (F.size(x) > 0) & (F.size(y) > 0) & (F.size(F.array_intersect(x, y)) < 2)


def composable(a: Column, b: Column) -> Column:
    """Whether a conditional approval and a limit of quantity, neither with an exception, can hold together."""
    low = [F.lower(F.coalesce(c, F.lit(""))) for c in (a, b)]
    gate = F.when(low[0].rlike(V.APPROVAL), low[0]).when(low[1].rlike(V.APPROVAL), low[1])
    return ~low[0].rlike(V.EXEMPT) & ~low[1].rlike(V.EXEMPT) & F.coalesce(gate.rlike(V.CONDITIONAL), F.lit(False)) & (low[0].rlike(V.QUANTITY) | low[1].rlike(V.QUANTITY))


ROW = ["scope", "id", "text", "actor", "goal", "disposition", "labels", "priority", "confidence", "needs_review", "evidence"]


def _rows(requirements: DataFrame) -> DataFrame:
    """The rows with ``node``, a number of their own, and ``s``, their scope as a key that is never null; stored.

    Ids are those of a scope: the same id in two scopes means two requirements.
    """
    return stored(requirements.select(*ROW, F.to_json(F.struct("scope")).alias("s"), F.monotonically_increasing_id().alias("node")), "requirements")


def _once(rows: DataFrame, column: str, **of: Column) -> DataFrame:
    """Stored ``rows`` with ``of``, expressions over the text ``column`` (no nulls): taken once for each different text where these are few."""
    texts = stored(rows.select(column).distinct(), "different-texts")
    n, chars = texts.agg(F.count("*"), F.coalesce(F.sum(F.length(column)), F.lit(0))).first()
    if n > KNOWN or chars > KNOWN_CHARS:
        return rows.withColumns(of)
    return rows.join(F.broadcast(stored(texts.withColumns(of), "known-texts")), column)


def close_pairs(requirements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes of equal requirements, and the pairs of classes of a scope that are close.

    Classes: ``scope, s, id, node, class``, one for each row; rows of one class have text,
    actor, goal, disposition and documents in common, and are named by the node of the first.
    Pairs: ``scope, s, a, b`` (classes), ``first_a, first_b`` (``id, node`` of their first
    rows) and ``verdict``: merged, actor (theirs differ) or source (other documents, other
    intent).  Classes of one key are linked to the first of them, not to each other.

    Other pairs meet by the rarer of their facts, once for all that share key and facts:
    two that share LEAST share one of all but the LEAST - 1 most frequent facts of each.
    """
    rows = requirements if {"s", "node"} <= set(requirements.columns) else _rows(requirements)
    docs = F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce("evidence", F.array().cast(requirements.schema["evidence"].dataType)), lambda e: e["document_id"]), lambda d: d.isNotNull())))
    key, facts = match_key(F.col("text")), F.array_sort(fact_tokens(F.col("text")))
    told = rows.select("scope", "s", "id", "node", F.coalesce("text", F.lit("")).alias("text"), actor_key(F.col("actor")).alias("actor"), F.coalesce("goal", F.lit("")).alias("aim"), "disposition", docs.alias("docs"))
    told = _once(told, "text", key=key, facts=facts, facts_of=F.md5(F.to_json(F.struct(key.alias("key"), facts.alias("facts")))))
    told = _once(told, "aim", goal=F.array_sort(fact_tokens(F.col("aim")))).drop("aim")
    told = stored(told.withColumn("mark", F.md5(F.to_json(F.struct("text", "actor", "goal", "disposition", "docs")))), "described")
    firsts = stored(told.groupBy("s", "mark").agg(F.min(F.struct("id", "node")).alias("first")), "classes")
    classes = stored(told.join(firsts, ["s", "mark"]).select("scope", "s", "id", "node", F.col("first.node").alias("class")), "members")
    heads = stored(told.join(firsts.select("s", "mark", F.col("first.node").alias("node")), ["s", "mark", "node"], "left_semi").withColumn("first", F.struct("id", "node")), "heads")

    same = stored(heads.groupBy("s", "facts_of").agg(F.min("node").alias("group"), F.first("facts").alias("facts")), "fact-groups")
    flat = same.select("s", "group", F.explode("facts").alias("t"))
    often = stored(flat.groupBy("s", "t").agg(F.count("*").alias("df")).where("df > 1"), "fact-frequencies")
    own = Window.partitionBy("s", "group")
    rare = flat.join(often, ["s", "t"]).withColumn("i", F.row_number().over(own.orderBy("df", "t"))).withColumn("n", F.count("*").over(own)).where(F.col("i") <= F.col("n") - (LEAST - 1))
    rare = stored(rare.select("s", "t", "group"), "rare-facts")
    met = stored(rare.join(rare.withColumnRenamed("group", "other"), ["s", "t"]).where("group < other").select("group", "other").distinct(), "groups-met")
    of = stored(heads.join(same.select("s", "facts_of", "group"), ["s", "facts_of"]), "grouped-heads")
    side = lambda g, k: of.select("s", "scope", F.col("group").alias(g), F.col("first").alias(f"first_{k}"), F.struct("text", "key", "facts", "actor", "goal", "disposition", "docs").alias(f"r{k}"))
    p = met.join(side("group", "a"), "group").join(side("other", "b").drop("s", "scope"), "other").where("ra.key <> rb.key or ra.key = ''")
    a, b = F.col("ra"), F.col("rb")
    least, shared = F.least(F.size(a["facts"]), F.size(b["facts"])), F.size(F.array_intersect(a["facts"], b["facts"]))
    # Of as many facts the later one counts as the larger.
    larger = F.when((F.size(a["facts"]) < F.size(b["facts"])), b["text"]).otherwise(a["text"])
    near = (least >= LEAST) & (_jaccard(a["facts"], b["facts"]) >= NEAR - 1e-9)
    contained = (least >= LEAST) & (F.size(a["facts"]) != F.size(b["facts"])) & larger.rlike(r"(?i)[;,]|\b(?:and|or)\b") & (shared >= LEAST) & (shared >= CONTAINED * least - 1e-9)
    differ = actors_differ(a["actor"], b["actor"])
    goals = (F.size(a["goal"]) > 0) & (F.size(b["goal"]) > 0) & (_jaccard(a["goal"], b["goal"]) >= SAME_GOAL - 1e-9)
    intent = (F.size(a["docs"]) == 0) | (F.size(b["docs"]) == 0) | F.arrays_overlap(a["docs"], b["docs"]) | (~differ & goals)
    opposed = F.array_sort(F.array(a["disposition"], b["disposition"])) == F.array(F.lit("accepted"), F.lit("rejected"))
    verdict = F.when(opposed, None).when(contained & intent, "merged").when(near & intent, F.when(differ, "actor").otherwise("merged")).when(contained | near, "source")
    columns = ["scope", "s", F.least("first_a", "first_b").alias("first_a"), F.greatest("first_a", "first_b").alias("first_b"), "verdict"]
    judged = p.withColumn("verdict", verdict).where("verdict is not null").select(*columns)

    settled = F.coalesce(F.col("disposition").isin("accepted", "rejected"), F.lit(False))
    hubs = heads.where("key <> ''").groupBy("s", "key").agg(F.min(F.when(~settled, F.col("first"))).alias("any"), *[F.min(F.when(F.col("disposition") == d, F.col("first"))).alias(d) for d in ("accepted", "rejected")])
    to = F.coalesce("any", F.when(F.col("disposition") == "accepted", F.col("accepted")).otherwise(F.col("rejected")))
    equal = heads.join(stored(hubs, "hubs"), ["s", "key"]).select("scope", "s", F.col("first").alias("first_a"), to.alias("first_b"), F.lit("merged").alias("verdict")).where("first_a.node <> first_b.node")
    pairs = judged.unionByName(equal.select(*columns))
    return classes, stored(pairs.select("scope", "s", F.col("first_a.node").alias("a"), F.col("first_b.node").alias("b"), "first_a", "first_b", "verdict"), "close")


def canonical(requirements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row for each group, and what became of each id.

    Groups: ``scope, id`` (its representative's), ``number`` in its scope, ``members``, and
    what they know together.  Ids: ``scope, old_id, id, number``.

    The representative has the most meaningful words, then the longest text, the highest
    confidence, the smallest id.  Highest priority, confidence and disposition; labels and
    evidence of all, each once, the representative's first; the first actor and goal;
    ``needs_review`` if one needs it, is close to another, or a scope both accepts and rejects.
    A null scope is a scope of its own; rows that repeat an id of a scope are requirements each.
    """
    rows = _rows(requirements)
    classes, close = close_pairs(rows)
    groups = connected_components(close.where("verdict = 'merged'").select(F.col("a").alias("src"), F.col("b").alias("dst"))).select(F.col("node").alias("class"), "component")
    sides = [close.where("verdict <> 'merged'").select(F.col(x).alias("class"), F.col(f"first_{y}").alias("other")) for x, y in ("ab", "ba")]
    others = stored(sides[0].unionByName(sides[1]).groupBy("class").agg(F.min("other").alias("other")), "others")
    both = rows.groupBy("s").agg((F.max(F.col("disposition") == "accepted") & F.max(F.col("disposition") == "rejected")).alias("split"))
    flagged = classes.join(groups, "class", "left").join(others, "class", "left").select("node", F.coalesce("component", "class").alias("component"), F.coalesce(F.struct("id", "node") > F.col("other"), F.lit(False)).alias("close"))
    review = F.col("needs_review") | F.col("close") | (F.col("split") & F.col("disposition").isin("accepted", "rejected"))
    best = F.struct("words", F.length("text").alias("size"), "confidence", (-F.col("id")).alias("first"), (-F.col("node")).alias("node"))
    worded = _once(rows.withColumn("said", F.coalesce("text", F.lit(""))), "said", words=F.size(meaningful_tokens(F.col("said")))).drop("said")
    r = worded.join(flagged, "node").join(both, "s")
    r = stored(r.withColumn("review", F.coalesce(review, F.lit(False))).withColumn("best", best).withColumn("at", F.struct(F.col("id").cast("long").alias("id"), "node")), "grouped")
    tops = stored(r.groupBy("component").agg(F.max("best").alias("top")), "representatives")
    front = F.struct(F.lit(-(1 << 63)).cast("long").alias("id"), F.lit(0).cast("long").alias("node"))
    r = r.join(tops, "component").withColumn("place", F.when(F.col("best") == F.col("top"), front).otherwise(F.col("at")))
    rank = lambda names, c: F.max(F.array_position(F.array(*map(F.lit, names)), F.coalesce(F.col(c), F.lit(names[0])))).cast("int")
    first = lambda c: F.min_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("place")))
    whole = r.groupBy("scope", "component").agg(
        (-F.max("top.first")).alias("id"), F.count("*").alias("members"), F.min_by("text", "place").alias("text"), first("actor").alias("actor"), first("goal").alias("goal"), F.max("confidence").alias("confidence"),
        F.element_at(F.array(*map(F.lit, PRIORITIES)), F.greatest(rank(PRIORITIES, "priority"), F.lit(1))).alias("priority"), F.element_at(F.array(*map(F.lit, V.DISPOSITIONS)), F.greatest(rank(V.DISPOSITIONS, "disposition"), F.lit(1))).alias("disposition"), F.max("review").alias("needs_review"))
    # Labels and evidence are made different before they are gathered.
    label = r.select("component", "place", F.posexplode("labels").alias("i", "label")).groupBy("component", "label").agg(F.min(F.struct("place", "i")).alias("at"))
    quote = r.select("component", "place", F.posexplode("evidence").alias("i", "e")).groupBy("component", "e.chunk_id", "e.quote").agg(F.min(F.struct("place", "i")).alias("at"))
    names = label.groupBy("component").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "label"))), lambda x: x["label"]).alias("labels"))
    proofs = quote.groupBy("component").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "chunk_id", "quote"))), lambda x: F.struct(x["chunk_id"].alias("chunk_id"), x["quote"].alias("quote"))).alias("evidence"))
    joined = whole.join(names, "component", "left").join(proofs, "component", "left")
    numbered = stored(joined.withColumn("number", F.row_number().over(Window.partitionBy("scope").orderBy("id", "component"))), "canonical")
    ids = r.select("scope", F.col("id").alias("old_id"), "component").join(numbered.select("component", "id", "number"), "component")
    return numbered.drop("component"), stored(ids.drop("component"), "canonical-ids")


def composed(maps: list[DataFrame]) -> DataFrame:
    """``scope, old_id, new_id``: what several passes of ``scope, old_id, new_id`` make of an id together.

    Neighbouring passes are put together, then neighbouring results, so that n passes take
    joins of depth log2 n.  An id that a later pass doesn't name stays.  An id that only
    later passes name is in the result too.
    """
    if len(maps) == 1:
        return maps[0].select("scope", "old_id", "new_id")
    half = len(maps) // 2
    a, b = composed(maps[:half]), composed(maps[half:])
    a, b = a.select("scope", "old_id", F.col("new_id").alias("via")), b.select(F.col("scope").alias("scope_b"), F.col("old_id").alias("via_b"), F.col("new_id").alias("to"))
    return stored(a.join(b, F.col("scope").eqNullSafe(F.col("scope_b")) & (F.col("via") == F.col("via_b")), "left").select("scope", "old_id", F.coalesce("to", "via").alias("new_id")), "composed")


def remapped_issues(issues: DataFrame, ids: DataFrame, requirements: DataFrame) -> DataFrame:
    """``scope, item_type, item_id, rule, details, seq`` after requirements became others by ``ids`` (``scope, old_id, new_id``).

    Issues about duplicates are settled and go; those about evidence go where the new
    requirement has some; issues of requirements and coverages move to the new id; of equal
    ones the first (smallest ``seq``) stays.  Each scope by itself; ids without a new one stay.
    """
    to = ids.groupBy(F.col("scope").alias("to_scope"), "old_id").agg(F.max("new_id").alias("new_id"))
    proved = requirements.where(F.size("evidence") > 0).select(F.col("scope").alias("p_scope"), F.col("id").alias("p_id")).distinct().withColumn("proved", F.lit(True))
    moved = issues.where(~F.coalesce(F.col("rule").isin("duplicate_requirement", "semantic_conflict_duplicate"), F.lit(False)))
    moved = moved.join(to, F.col("scope").eqNullSafe(F.col("to_scope")) & (F.col("item_id") == F.col("old_id")), "left").withColumn("at", F.coalesce("new_id", "item_id"))
    moved = moved.join(proved, F.col("scope").eqNullSafe(F.col("p_scope")) & (F.col("at") == F.col("p_id")), "left")
    about = F.coalesce(F.col("rule").isin("missing_evidence", "missing_verified_evidence", "evidence_semantic_mismatch"), F.lit(False))
    moved = moved.where(~about | F.col("proved").isNull()).withColumn("item_id", F.when(F.col("item_type").isin("requirement", "coverage"), F.col("at")).otherwise(F.col("item_id")))
    return moved.groupBy("scope", "item_type", "item_id", "rule", "details").agg(F.min("seq").alias("seq"))


# --- Queries --------------------------------------------------------------------------


def canonical_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = canonical(derived.requirements(spark, sf_dir))
    return rows.select("scope", "number", "id", "members", "priority", "disposition", "needs_review", "confidence", F.array_join("labels", ",").alias("labels"), F.coalesce(F.size("evidence"), F.lit(0)).alias("quotes"), "actor", F.md5("text").alias("text_md5"))


def canonical_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each requirement's id became after a pass over all and another over what it left."""
    rows, first = canonical(derived.requirements(spark, sf_dir))
    again = rows.withColumn("evidence", F.transform("evidence", lambda e: F.struct(e["chunk_id"].alias("chunk_id"), F.lit(None).cast("string").alias("document_id"), e["quote"].alias("quote")))).withColumn("id", F.col("number").cast("long"))
    _, second = canonical(again)
    return composed([m.select("scope", "old_id", F.col("number").cast("long").alias("new_id")) for m in (first, second)])


def close_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of classes of a scope by what the rules make of them, and how many limit different things or can hold together."""
    rows = _rows(derived.requirements(spark, sf_dir))
    text = [rows.select(F.col("node").alias(s), F.col("text").alias(f"t{s}")) for s in "ab"]
    pairs = close_pairs(rows)[1].join(text[0], "a").join(text[1], "b")
    return stored(pairs.groupBy("verdict").agg(F.count("*").alias("pairs"), F.count_if(orthogonal(F.col("ta"), F.col("tb"))).alias("orthogonal"), F.count_if(composable(F.col("ta"), F.col("tb"))).alias("composable")), "verdicts")


SQL: dict[str, str] = {}
QUERIES = {"canonical_requirements": canonical_requirements, "canonical_ids": canonical_ids, "close_requirements": close_requirements}
