"""Rows of requirements from JSON of any of the shapes in which they come, by schema on read.

A payload is parsed once into a VARIANT and taken apart by typed reads; what it holds
decides how it is read.  A list, an object with a list or objects under a known name, one
object, objects under numbers, or texts under labels all give the same rows.  A payload
that is no JSON, or repeats a name in an object, gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimstone.functions import claims as C
from claimstone.functions import values as V
from claimstone.functions.facts import needs_review
from claimstone.functions.text import let, priority
from claimstone.functions.transcripts import spoken_needs_review, spoken_requirement, without_heading
from claimstone.sources.tables import table

# --- Fixed values: names under which payloads hold items and fields, and what labels and dispositions are called
CONTAINERS = ["requirements", "items", "data", "results", "extracted_requirements", "output", "payload"]
TEXT_NAMES = ["text", "requirement", "description", "statement", "summary", "name", "title"]
ITEM_TEXT_NAMES = ["text", "requirement", "description", "statement", "summary", "title"]
LABELS = ["FR", "NFR", "BR", "Constraint", "Assumption", "Open Question", "Out-of-Scope"]
LABEL_NAMES = {
    "Functional Requirement": "FR", "Functional": "FR", "Non-Functional Requirement": "NFR", "Non Functional": "NFR", "Non-Functional": "NFR", "Business Rule": "BR", "business_rule": "BR",
    "OpenQuestion": "Open Question", "open_question": "Open Question", "Out of Scope": "Out-of-Scope", "out_of_scope": "Out-of-Scope", "Out-of-scope": "Out-of-Scope",
}
DISPOSITION_NAMES = {
    "accepted": "accepted", "active": "accepted", "approved": "accepted", "confirmed": "accepted", "rejected": "rejected", "dropped": "rejected", "cancelled": "rejected", "canceled": "rejected", "declined": "rejected",
    "deferred": "deferred", "postponed": "deferred", "delayed": "deferred", "future": "deferred", "proposed": "proposed", "tentative": "proposed", "suggestion": "proposed", "uncertain": "uncertain", "ambiguous": "uncertain",
}
CONFIDENCE, QUOTE_CHARS = 0.85, 500

EVIDENCE = "struct<chunk_id:string,quote:string,page_number:int,speaker:string,timestamp:string,document_id:string>"
_VARIANTS, _FIELDS = "array<variant>", "map<string,variant>"


def _kind(v: Column) -> Column:
    """STRING, BOOLEAN, BIGINT, ..., or ARRAY and OBJECT without what they hold; null for JSON's null."""
    return F.nullif(F.regexp_extract(F.schema_of_variant(v), r"^(\w+)", 1), F.lit("VOID"))


def _at(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def _text(v: Column) -> Column:
    """A string's value; null for all else."""
    return F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _map(names: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in names.items() for x in pair])


def _true(v: Column) -> Column:
    """Whether a value says something: no null, false, 0, empty text, list or object."""
    kind = _kind(v)
    size = F.when(kind == "ARRAY", F.size(F.try_variant_get(v, "$", _VARIANTS))).when(kind == "OBJECT", F.size(F.try_variant_get(v, "$", _FIELDS)))
    other = F.when(kind == "STRING", F.try_variant_get(v, "$", "string") != "").when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean")).otherwise(F.try_variant_get(v, "$", "double") != 0)
    return F.coalesce(F.when(kind.isin("ARRAY", "OBJECT"), size > 0).otherwise(other), F.lit(False))


def _first(v: Column, names: list[str]) -> Column:
    """The value of the first of some names that says something, as text."""
    return F.coalesce(*[F.when(_true(_at(v, n)), F.try_variant_get(v, f"$.{n}", "string")) for n in names])


def label_of(name: Column) -> Column:
    """The label that a name means; FR for one that means none."""
    up = F.lower(F.trim(name))
    told = (
        F.when(up.startswith("func"), "FR").when(up.contains("non") | up.contains("nfr"), "NFR").when(up.contains("business") | (up == "br"), "BR").when(up.contains("out") & up.contains("scope"), "Out-of-Scope")
        .when(up.contains("open") & up.contains("question"), "Open Question").when(up.contains("constraint"), "Constraint").when(up.contains("assumption"), "Assumption").otherwise("FR")
    )
    return F.when(F.coalesce(name, F.lit("")) == "", "FR").when(name.isin(LABELS), name).otherwise(F.coalesce(F.try_element_at(_map(LABEL_NAMES), name), told))


def _names_label(name: Column) -> Column:
    low = F.lower(F.trim(name))
    told = low.startswith("func") | low.contains("non") | low.contains("nfr") | low.contains("business") | (low == "br") | (low.contains("out") & low.contains("scope")) | (low.contains("open") & low.contains("question")) | low.contains("constraint") | low.contains("assumption")
    return (name != "") & (name.isin([*LABELS, *LABEL_NAMES]) | told)


def _entry(v: Column, label: Column | None = None) -> Column:
    return F.struct(v.alias("v"), (F.lit(None).cast("string") if label is None else label).alias("label"))


def _entries(values: Column) -> Column:
    return F.transform(F.coalesce(values, F.array().cast(_VARIANTS)), lambda v: _entry(v))


def _values(v: Column, names: Column) -> Column:
    """The values of an object in the order in which its names are written."""
    return let(F.try_variant_get(v, "$", _FIELDS), lambda m: F.transform(names, lambda k: F.try_element_at(m, k)))


def items(payload: Column) -> Column:
    """``v, label``: what a payload holds, as an array; ``label`` where a label's name holds it."""
    v = F.try_parse_json(payload)
    names = F.coalesce(F.json_object_keys(payload), F.array().cast("array<string>"))
    none = F.array().cast("array<struct<v:variant,label:string>>")

    def contained() -> Column:
        out = F.lit(None).cast(_VARIANTS)
        for name in reversed(CONTAINERS):
            inner, kind = _at(v, name), _kind(_at(v, name))
            of_object = _values(inner, F.coalesce(F.json_object_keys(F.get_json_object(payload, f"$.{name}")), F.array().cast("array<string>")))
            out = F.when(kind == "ARRAY", F.try_variant_get(v, f"$.{name}", _VARIANTS)).when(kind == "OBJECT", of_object).otherwise(out)
        return out

    def labelled(name: Column, value: Column) -> Column:
        kind, label = _kind(value), label_of(name)
        inner = F.filter(F.try_variant_get(value, "$", _VARIANTS), lambda x: _kind(x).isin("STRING", "OBJECT"))
        return F.when(~_names_label(name), none).when(kind == "ARRAY", F.transform(inner, lambda x: _entry(x, label))).when(kind.isin("STRING", "OBJECT"), F.array(_entry(value, label))).otherwise(none)

    has = lambda *n: F.arrays_overlap(names, F.array(*map(F.lit, n)))
    told = F.exists(F.array(*[_text(_at(v, n)) for n in TEXT_NAMES]), lambda t: C.bare(t) != "")
    one = told | (has("id") & has("candidate_labels", "disposition"))
    numbered = (F.size(names) > 0) & F.forall(names, lambda k: F.trim(k).rlike(r"^\p{Nd}+$"))
    by_label = let(F.try_variant_get(v, "$", _FIELDS), lambda m: F.flatten(F.transform(names, lambda k: labelled(k, F.try_element_at(m, k)))))
    of_object = let(F.coalesce(contained(), F.array().cast(_VARIANTS)), lambda c: F.when(F.size(c) > 0, _entries(c)).when(F.coalesce(one, F.lit(False)), F.array(_entry(v))).when(numbered, _entries(_values(v, names)))
                    .otherwise(let(by_label, lambda b: F.when(F.size(b) > 0, b).when(has("id", "evidence", "confidence"), F.array(_entry(v))).otherwise(none))))
    return F.when(_kind(v) == "ARRAY", _entries(F.try_variant_get(v, "$", _VARIANTS))).when(_kind(v) == "OBJECT", of_object).otherwise(none)


def payload_rows(payloads: DataFrame) -> DataFrame:
    """A row for each requirement of each payload.

    ``payloads``: ``payload`` and its chunk, ``chunk_id, document_id, page_number, speaker,
    start_sec, spoken``.  Result: ``chunk_id, number`` (its place in the payload, from 1),
    ``id, text, actor, goal, disposition, labels, confidence, priority, extraction_type,
    needs_review, review_reason, evidence``.

    Items without a text, and those that are neither object nor text, give no row.  Evidence
    takes from the chunk what it lacks; without any the text is its own.  What the wording
    of text and quotes says about a rejection or deferral counts before the given disposition.
    """
    each = payloads.select("chunk_id", "document_id", "page_number", "speaker", "start_sec", "spoken", F.posexplode(items(F.col("payload"))).alias("i", "item"))
    each = each.withColumn("v", F.col("item.v")).withColumn("kind", _kind(F.col("item.v")))
    v = F.col("v")
    fields = F.when(F.col("kind") == "OBJECT", F.try_variant_get(v, "$", _FIELDS))
    name = F.map_keys(fields)[0]
    short = (F.size(fields) == 1) & F.col("item.label").isNull() & (name.isin([*LABELS, *LABEL_NAMES]) | label_of(name).isin(LABELS)) & (_kind(F.map_values(fields)[0]) == "STRING")
    own_label = F.coalesce(F.when(F.col("kind") == "OBJECT", _first(v, ["label"])), F.col("item.label"))
    text = F.coalesce(*[F.nullif(_text(_at(v, n)), F.lit("")) for n in ITEM_TEXT_NAMES])
    text = F.when(F.col("kind") == "STRING", F.when(F.col("item.label").isNull(), C.bare(_text(v))).otherwise(_text(v))).when(short, _text(F.map_values(fields)[0])).when(F.col("kind") == "OBJECT", text)

    def texts(x: Column) -> Column:
        """A list's texts, or one text as a list."""
        kind = _kind(x)
        return F.when(~_true(x), None).when(kind == "ARRAY", F.transform(F.try_variant_get(x, "$", _VARIANTS), lambda e: F.coalesce(F.try_variant_get(e, "$", "string"), F.lit("")))).when(kind == "STRING", F.array(_text(x)))

    raw = F.when(short, F.array(name)).when(F.col("kind") == "OBJECT", F.coalesce(texts(_at(v, "candidate_labels")), texts(_at(v, "labels"))))
    raw = F.coalesce(raw, F.when(own_label.isNotNull(), F.array(own_label)), F.array(F.lit("FR")))
    each = each.withColumns({"text": text, "labels": F.array_distinct(F.transform(raw, label_of)), "object": (F.col("kind") == "OBJECT") & ~F.coalesce(short, F.lit(False))}).where(C.bare(F.col("text")) != "")

    got = _at(v, "evidence")
    proofs = F.when(F.col("object") & _true(got), F.when(_kind(got) == "OBJECT", F.array(got)).otherwise(F.filter(F.try_variant_get(got, "$", _VARIANTS), lambda e: _kind(e) == "OBJECT")))
    at = F.col("start_sec").cast("string")

    def proof(e: Column) -> Column:
        given = lambda n, kind="string": F.try_variant_get(e, f"$.{n}", kind)
        return F.struct(F.coalesce(F.nullif(given("chunk_id"), F.lit("")), F.col("chunk_id")).alias("chunk_id"), F.coalesce(given("quote"), F.lit("")).alias("quote"), F.coalesce(given("page_number", "int"), F.col("page_number").cast("int")).alias("page_number"),
                        F.coalesce(given("speaker"), F.col("speaker")).alias("speaker"), F.coalesce(given("timestamp"), at).alias("timestamp"), F.coalesce(given("document_id"), F.col("document_id").cast("string")).alias("document_id"))

    own = F.struct(F.col("chunk_id").alias("chunk_id"), F.left("text", F.lit(QUOTE_CHARS)).alias("quote"), F.col("page_number").cast("int").alias("page_number"), F.col("speaker").alias("speaker"), at.alias("timestamp"), F.col("document_id").cast("string").alias("document_id"))
    each = each.withColumn("evidence", F.when(F.size(F.coalesce(proofs, F.array().cast(_VARIANTS))) > 0, F.transform(proofs, proof)).otherwise(F.array(own)).cast(f"array<{EVIDENCE}>"))

    told = C.disposition(F.concat_ws(" ", "text", F.array_join(F.transform("evidence", lambda e: F.coalesce(e["quote"], F.lit(""))), " ")))
    given = F.coalesce(F.try_element_at(_map(DISPOSITION_NAMES), F.lower(C.bare(F.when(F.col("object"), F.try_variant_get(v, "$.disposition", "string"))))), F.lit("accepted"))
    out = F.coalesce(told.isin("rejected", "deferred"), F.lit(False)) & ~F.array_contains("labels", "Out-of-Scope")
    each = each.withColumns({"disposition": F.coalesce(told, given), "labels": F.when(out, F.array_append("labels", F.lit("Out-of-Scope"))).otherwise(F.col("labels"))})

    spoken = F.coalesce(F.col("spoken"), F.lit(False))
    worded = each.withColumn("worded", F.when(spoken, spoken_requirement(F.col("text"))).otherwise(F.regexp_replace(C.bare(F.col("text")), r"\s+", " ")))
    worded = worded.withColumn("final", without_heading(F.col("worded")))
    marks = [(needs_review(F.col("final")), "[INCOMPLETE_REQUIREMENT_CLAUSE]"), (F.col("final") != F.col("worded"), "[UNATTACHED_LEADING_FRAGMENT_DROPPED]"), (spoken & spoken_needs_review(F.col("final")), "[ASR_INCOMPLETE_FRAGMENT]")]
    field = lambda *n: F.when(F.col("object"), _first(v, list(n)))
    reason = F.nullif(F.concat_ws(" ", field("review_reason"), *[F.when(why, F.lit(mark)) for why, mark in marks]), F.lit(""))
    confidence = F.when(F.col("object"), F.try_variant_get(v, "$.confidence", "double"))
    kind = F.when(F.col("object"), _text(_at(v, "extraction_type")))
    return worded.select(
        "chunk_id", (F.col("i") + 1).alias("number"), F.coalesce(field("id"), (F.col("i") + 1).cast("string")).alias("id"), F.col("final").alias("text"), field("actor", "user", "role").alias("actor"), field("goal", "action", "objective").alias("goal"),
        "disposition", "labels", F.when(F.coalesce(confidence, F.lit(0.0)) != 0, confidence).otherwise(CONFIDENCE).alias("confidence"), priority(F.col("final")).alias("priority"), F.when(kind.isin("explicit", "implied"), kind).alias("extraction_type"),
        (F.when(F.col("object"), _true(_at(v, "needs_review"))).otherwise(False) | marks[0][0] | marks[2][0]).alias("needs_review"), reason.alias("review_reason"), "evidence")


# --- Queries --------------------------------------------------------------------------

_CLEAN, _FORMS = r"[^A-Za-z0-9 ,]", 12


def payloads_of(docs: DataFrame) -> DataFrame:
    """A payload for each document, of its first words, in one of twelve shapes by its id."""
    s = F.left(F.btrim(F.regexp_replace(F.left(F.coalesce("text", F.lit("")), F.lit(400)), _CLEAN, " ")), F.lit(160))
    q = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    forms = [
        q('{"requirements":[{"id":7,"text":"', s, '","candidate_labels":["Functional","NFR","Functional"],"confidence":0.5,"actor":"clerk"},{"statement":"', s, ' must not fail","disposition":"postponed"}]}'), q('["', s, '",{"description":"', s, '","labels":"Business Rule"},5,null,""]'), q('{"text":"', s, '","label":"open_question","disposition":" Cancelled ","needs_review":true}'),
        q('{"items":{"2":{"text":"', s, '"},"1":{"title":"second ', s, '","id":"R-9"}}}'), q('{"2":{"text":"', s, '"},"10":{"summary":"', s, '","evidence":{"quote":"we decided against it","page_number":4}}}'), q('{"NFR":["', s, '",{"text":"inner ', s, '","label":"BR"},7],"Constraint":"', s, '","other":"x"}'),
        q('{"requirements":[{"text":"', s), q('{"id":3,"evidence":[{"quote":"', s, '","chunk_id":""},"loose"],"statement":"', s, '"}'), q('"', s, '"'), q('{"data":[],"confidence":0.9,"name":"', s, '"}'), q('[{"FR":"', s, '"},{"note":"x"},["', s, '"]]'), q('{"output":[{"text":"', s, '","goal":"g","objective":"o","extraction_type":"implied","review_reason":"why","confidence":0}]}'),
    ]
    at = F.pmod("doc_id", F.lit(_FORMS))
    payload = F.coalesce(*[F.when(at == i, f) for i, f in enumerate(forms)])
    return docs.select(F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("chunk_id"), F.col("doc_id").alias("document_id"), F.lit(1).alias("page_number"), F.lit(None).cast("string").alias("speaker"), F.lit(None).cast("double").alias("start_sec"), F.lit(False).alias("spoken"), payload.alias("payload"))


def payload_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = payload_rows(payloads_of(table(spark, sf_dir, "documents")))
    return rows.select("chunk_id", "number", "id", F.md5("text").alias("text_md5"), "actor", "goal", "disposition", F.array_join("labels", ",").alias("labels"), "confidence", "extraction_type", F.size("evidence").alias("proofs"), F.md5(F.col("evidence")[0]["quote"]).alias("quote_md5"), F.col("evidence")[0]["page_number"].alias("page_number"), F.col("evidence")[0]["chunk_id"].alias("evidence_chunk"))


QUERIES = {"payload_requirements": payload_requirements}
_ROW = lambda at, number, text, *, id=None, actor="NULL", goal="NULL", disposition="accepted", labels="FR", confidence=CONFIDENCE, kind="NULL", quote=None, page=1: (
    f"SELECT doc_id, {number} AS number, {id or f"'{number}'"} AS id, {text} AS text, {actor}::VARCHAR AS actor, {goal}::VARCHAR AS goal, '{disposition}' AS disposition, '{labels}' AS labels, {confidence}::DOUBLE AS confidence, {kind}::VARCHAR AS extraction_type, {quote or text} AS quote, {page} AS page_number FROM d WHERE doc_id % {_FORMS} = {at}"
)
#: What each shape gives; shapes 6 (cut off), 8 (a text alone) and 9 (a name and an empty list) give nothing.
_GIVEN = [
    _ROW(0, 1, "s", id="'7'", actor="'clerk'", labels="FR,NFR", confidence=0.5), _ROW(0, 2, "s || ' must not fail'"), _ROW(1, 1, "trim(s, ' ')"), _ROW(1, 2, "s", labels="BR"), _ROW(2, 1, "s", disposition="rejected", labels="Open Question"),
    _ROW(3, 1, "s"), _ROW(3, 2, "'second ' || s", id="'R-9'"), _ROW(4, 1, "s"), _ROW(4, 2, "s", disposition="rejected", labels="FR,Out-of-Scope", quote="'we decided against it'", page=4), _ROW(5, 1, "s", labels="NFR"), _ROW(5, 2, "'inner ' || s", labels="BR"),
    _ROW(5, 3, "s", labels="Constraint"), _ROW(7, 1, "s", id="'3'"), _ROW(10, 1, "s"), _ROW(10, 2, "'x'"), _ROW(11, 1, "s", goal="'g'", kind="'implied'"),
]
SQL = {
    "payload_requirements": rf"""
        WITH d AS (SELECT doc_id, left(trim(regexp_replace(left(coalesce(text, ''), 400), '{_CLEAN}', ' ', 'g'), ' '), 160) AS s FROM documents),
        r AS ({' UNION ALL '.join(_GIVEN)})
        SELECT 'c' || doc_id AS chunk_id, number, id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'), ' ')) AS text_md5, actor, goal, disposition, labels, confidence, extraction_type, 1 AS proofs, md5(left(quote, {QUOTE_CHARS})) AS quote_md5, page_number, 'c' || doc_id AS evidence_chunk
        FROM r WHERE trim(text, ' ') <> ''""",
}
