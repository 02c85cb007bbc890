"""Job records: lifecycle, attempts, retention, fingerprints and issues.

The job log of the queries is the events table: a user is a job, an event an entry of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimstone.sources.tables import table

# --- Fixed values: states, severities, public states -------------------------------------
SEVERITIES = ["low", "medium", "high"]
RETRYABLE = ["FAILED", "CANCELLED"]
RUNNING = ["QUEUED", "RUNNING"]
PUBLIC_STATUS = {"PARTIAL": "COMPLETED", "REJECTED": "COMPLETED"}
PROGRESS = {
    "detect_file_type": 5, "prepare_sources": 20, "build_source_index": 35, "extract": 45, "dedupe_requirements": 55, "retrieve_evidence": 62, "classify": 70, "evidence_grounding": 76,
    "generate": 85, "quality_gate": 90, "repair_stories": 92, "summarize": 95, "format": 100,
}
BLOCKED_EXTENSIONS = [".html", ".htm", ".js", ".exe", ".sh", ".bat", ".php"]


def latest(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key by ``order``, as one aggregate."""
    rest = [c for c in log.columns if c != key and c not in order]
    return log.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("last")).select(key, *[F.col(f"last.{c}") for c in [*order, *rest]])


def first_writer(existing: DataFrame, new: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``existing`` with the rows of ``new`` whose key it lacks; of several with one key the first by ``order``."""
    rest = [c for c in new.columns if c != key and c not in order]
    first = new.groupBy(key).agg(F.min(F.struct(*order, *rest)).alias("f")).select(key, *[F.col(f"f.{c}") for c in [*order, *rest]])
    return existing.unionByName(first.join(existing.select(key), key, "left_anti").select(*existing.columns))


def upserted(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: of each other column the last value that isn't null."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    last = [F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c) for c in rest]
    return rows.groupBy(*keys).agg(*last)


def retained(rows: DataFrame, time_col: str, now: Column, days: int) -> DataFrame:
    """Rows not older than ``days`` before ``now``; rows without a time stay."""
    return rows.where(F.col(time_col).isNull() | (F.col(time_col) >= now - F.expr(f"interval {days} days")))


def requeued(jobs: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """``jobs`` (``job_id, status, fingerprint, attempt, progress, queued_at, started_at, ended_at, error``) after retries were asked for (``job_id, fingerprint``).

    A failed or cancelled job whose fingerprint is asked for is queued again as its next
    attempt, its progress, times and error gone; all others stay as they are.
    """
    asked = requests.select("job_id", "fingerprint").distinct().withColumn("_asked", F.lit(True))
    joined = jobs.join(asked, ["job_id", "fingerprint"], "left")
    again = F.coalesce(F.col("_asked"), F.lit(False)) & F.col("status").isin(RETRYABLE)
    new = {"status": F.lit("QUEUED"), "attempt": F.col("attempt") + 1, "progress": F.lit(0), "queued_at": now, "started_at": F.lit(None), "ended_at": F.lit(None), "error": F.lit(None)}
    return joined.select(*[F.when(again, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in jobs.columns])


def progress_of(step: Column) -> Column:
    """How far a job is, in percent, once it has reached a step; null for an unknown one."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in PROGRESS.items() for x in pair]), step)


def valid_job_id(job_id: Column) -> Column:
    return F.coalesce(job_id.rlike(r"\A[A-Za-z0-9._-]{1,128}\z"), F.lit(False))


def request_fingerprint(**fields: Column) -> Column:
    """SHA-256 of the fields as JSON with sorted names, no blanks, nulls written, text unescaped beyond JSON's needs."""
    def quoted(c: Column) -> Column:
        s = F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), '"', r'\\"')
        for raw, code in (("\n", r"\\n"), ("\r", r"\\r"), ("\t", r"\\t"), ("\f", r"\\f"), ("\b", r"\\b")):
            s = F.regexp_replace(s, raw if raw != "\b" else "\\x08", code)
        return F.coalesce(F.concat(F.lit('"'), s, F.lit('"')), F.lit("null"))

    parts = [F.concat(F.lit(f'"{name}":'), quoted(fields[name].cast("string"))) for name in sorted(fields)]
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")), 256)


def creation_outcome(*, exists: Column, same_scope: Column, reprocess: Column, status: Column, same_request: Column) -> Column:
    """What a request to create a job gets: ``code`` (202 made or queued again, 200 reported, 409 refused), ``outcome`` and whether it is ``dispatched``."""
    def out(code: int, outcome: str, dispatched: bool = False) -> Column:
        return F.struct(F.lit(code).alias("code"), F.lit(outcome).alias("outcome"), F.lit(dispatched).alias("dispatched"))

    retryable = status.isin(RETRYABLE)
    return (
        F.when(~exists, out(202, "created", True)).when(~same_scope, out(409, "conflict of scope")).when(reprocess & ~retryable, out(409, "not retryable"))
        .when(reprocess & ~same_request, out(409, "another request")).when(reprocess, out(202, "retried", True)).when(~same_request, out(409, "another request"))
        .when(status.isin(RUNNING), out(202, "already running")).otherwise(out(200, "reported"))
    )


def coverage(requirements: DataFrame, stories: DataFrame) -> DataFrame:
    """``item_id, coverage, story_id``: how each requirement (``item_id, disposition, label``) ended up.

    ``stories``: ``story_id, ord, item_ids``.  In order: rejected and deferred ones, and
    questions, assumptions and what is out of scope, have no story; proposed and uncertain
    ones are to be reviewed; then the first story by ``ord`` that names the requirement
    covers it, alone or with others; without one it is to be reviewed.
    """
    named = stories.select("story_id", "ord", F.size("item_ids").alias("n"), F.explode(F.array_distinct("item_ids")).alias("item_id"))
    first = named.groupBy("item_id").agg(F.min(F.struct("ord", "story_id", "n")).alias("s"))
    d, story = F.col("disposition"), F.col("s.story_id")
    none = d.isin("rejected", "deferred") | F.col("label").isin("Open Question", "Out-of-Scope", "Assumption")
    kind = F.when(none, "non_story").when(d.isin("proposed", "uncertain"), "needs_review").when(story.isNull(), "needs_review").when(F.col("s.n") > 1, "merged_into_story").otherwise("covered_by_story")
    return requirements.join(first, "item_id", "left").select("item_id", kind.alias("coverage"), F.when(kind.isin("merged_into_story", "covered_by_story"), story).alias("story_id"))


def grouped_issues(issues: DataFrame) -> DataFrame:
    """Issues of one item and cause as one: the highest severity, and the distinct details in order."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    item = ["item_type", "item_id", "cause"]
    # Rows meet in partial aggregates by details; only distinct details are gathered.
    once = issues.groupBy(*item, "details").agg(F.min("ord").alias("ord"), F.count("*").alias("issues"), F.max_by("severity", rank).alias("severity"))
    named = F.collect_list(F.when(F.col("details").isNotNull(), F.struct("ord", "details")))
    details = F.array_join(F.transform(F.array_sort(named), lambda d: d["details"]), "; ")
    return once.groupBy(*item).agg(F.max_by("severity", rank).alias("severity"), F.sum("issues").alias("issues"), details.alias("details"))


# --- Queries --------------------------------------------------------------------------


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def _status() -> Column:
    """An event type as a job state."""
    t = F.col("event_type")
    return F.when(t == "error", "FAILED").when(t == "purchase", "COMPLETED").when(t == "view", "PARTIAL").otherwise("RUNNING")


def job_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state that each job's last event shows, as published."""
    return public_states(latest(_events(spark, sf_dir).select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"]))


def public_states(last: DataFrame) -> DataFrame:
    """The last events of jobs as states, and as the states that are shown."""
    public = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in PUBLIC_STATUS.items() for x in kv]), F.col("status")), F.col("status"))
    return last.withColumn("status", _status()).select("user_id", F.col("event_id").alias("last_event"), "status", public.alias("public_status"))


def attempt_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts by job and day: the last known value of each column."""
    rows = _events(spark, sf_dir).select(
        "user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "ts", "event_id", F.when(F.col("event_type") == "error", F.col("props")).alias("error"), F.when(F.col("event_type") != "error", F.col("value")).alias("value"))
    return upserted(rows, ["user_id", "day"], ["ts", "event_id"])


def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of each event type 14 days before the last event, and what goes."""
    events = _events(spark, sf_dir)
    now = F.lit(events.agg(F.max("ts")).first()[0])
    kept = retained(events, "ts", now, 14).groupBy("event_type").agg(F.count("*").alias("kept"))
    return events.groupBy("event_type").agg(F.count("*").alias("events")).join(kept, "event_type", "left").select("event_type", F.coalesce("kept", F.lit(0)).alias("kept"), (F.col("events") - F.coalesce("kept", F.lit(0))).alias("removed"))


def outcome_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each day: events by outcome, and the mean value of those that aren't errors."""
    t = F.col("event_type")
    return _events(spark, sf_dir).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(
        F.count("*").alias("events"), F.count_if(t == "error").alias("errors"), F.count_if(t == "click").alias("clicks"), F.count_if(t == "view").alias("views"),
        F.round(F.avg(F.when(t != "error", F.col("value"))), 4).alias("mean_value"))


def create_or_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs of the first events, and then of the others that are new: the first writer of a key wins."""
    rows = _events(spark, sf_dir).select("user_id", "ts", "event_id", "event_type")
    start = F.lit(rows.agg(F.min("ts")).first()[0]) + F.expr("interval 1 day")
    old = latest(rows.where(F.col("ts") < start), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")
    return first_writer(old, rows.where(F.col("ts") >= start), "user_id", ["ts", "event_id"])


def document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The identity of each document as a request, and the id that its content gives it."""
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select(
        "doc_id", request_fingerprint(content=F.sha2(text, 256), language=F.col("lang"), source=F.col("source")).alias("fingerprint"), F.concat(F.lit("doc_"), F.left(F.sha2(text, 256), F.lit(16))).alias("content_id"))


def page_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What kind each page is by its first bytes, and whether its content or its address bars it."""
    html = F.lower(F.substring(F.ltrim(F.coalesce("html", F.lit(""))), 1, 200))
    kind = F.when(html == "", "empty").when(html.startswith("%pdf-"), "pdf").when(html.startswith("<!doctype html") | html.startswith("<html"), "html").otherwise("text")
    path = F.lower(F.split(F.coalesce("url", F.lit("")), "[?#]")[0])
    blocked = path.rlike("(" + "|".join(e.replace(".", r"\.") for e in BLOCKED_EXTENSIONS) + ")$")
    control = F.regexp_count(F.coalesce("html", F.lit("")), F.lit(r"[\x00-\x08\x0E-\x1F]"))
    return table(spark, sf_dir, "pages").select("page_id", kind.alias("kind"), (blocked | (kind == "html")).alias("rejected"), (control <= 0.05 * F.length(F.coalesce("html", F.lit("")))).alias("is_text"))


def issue_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as issues of jobs, grouped by cause."""
    value = F.col("value")
    issues = _events(spark, sf_dir).select(
        F.lit("job").alias("item_type"), F.col("user_id").alias("item_id"), F.col("event_type").alias("cause"), F.when(value > 50, "high").when(value > 10, "medium").otherwise("low").alias("severity"),
        F.col("event_id").alias("ord"), F.get_json_object("props", "$.k").alias("details"))
    grouped = grouped_issues(issues)
    return grouped.select("item_type", "item_id", "cause", "severity", "issues", F.md5("details").alias("details_md5"))


def merged_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their labels: the union of several, and FR at 0.5 where there is none."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") > 0, "Out-of-Scope").when(F.col("quality") > 0, "FR").otherwise("Open Question").alias("label"))
    merged = labels.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.lit(0.9).alias("confidence"))
    return table(spark, sf_dir, "documents").select("doc_id").join(merged, "doc_id", "left").select("doc_id", F.coalesce("labels", F.lit("FR")).alias("labels"), F.coalesce("confidence", F.lit(0.5)).alias("confidence"))


def creation_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a request to create its user's job, answered by the state that the event before left."""
    before = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = _events(spark, sf_dir).withColumn("status", _status()).withColumn("kind", F.get_json_object("props", "$.k").cast("int") % 3)
    e = e.withColumn("old", F.lag("status").over(before)).withColumn("old_kind", F.lag("kind").over(before))
    # Of the request only what is compared: a kind for its content, the value's parity for the wish to repeat.
    result = creation_outcome(exists=F.col("old").isNotNull(), same_scope=F.lit(True), reprocess=F.col("value").cast("int") % 2 == 1, status=F.col("old"), same_request=F.col("kind").eqNullSafe(F.col("old_kind")))
    return e.select(result.alias("r")).groupBy("r.code", "r.outcome").agg(F.count("*").alias("requests"))


def coverages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as requirements, and conversations as stories that name them by number."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    reqs = table(spark, sf_dir, "documents").select("doc_id").distinct().join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("item_id"), F.when(F.col("toxic") > 0, "rejected").when(F.col("quality") == 0, "proposed").otherwise("accepted").alias("disposition"), F.lit("FR").alias("label"))
    tales = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n")).select(
        F.col("conv_id").alias("story_id"), F.col("conv_id").alias("ord"), F.sequence(F.col("conv_id"), F.col("conv_id") + F.col("n") % 3).alias("item_ids"))
    return coverage(reqs, tales)


_STATUS = "CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'purchase' THEN 'COMPLETED' WHEN 'view' THEN 'PARTIAL' ELSE 'RUNNING' END"
_CTRL = "len(regexp_extract_all(coalesce(html, ''), '[\\x00-\\x08\\x0E-\\x1F]'))"
SQL = {
    "job_status": f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rk FROM events)
        SELECT user_id, event_id AS last_event, {_STATUS} AS status, CASE WHEN {_STATUS} = 'PARTIAL' THEN 'COMPLETED' ELSE {_STATUS} END AS public_status FROM r WHERE rk = 1""",
    "attempt_upsert": """SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, arg_max(props, (ts, event_id)) FILTER (WHERE event_type = 'error') AS error,
        arg_max(value, (ts, event_id)) FILTER (WHERE event_type <> 'error') AS value FROM events GROUP BY 1, 2""",
    "retention": """WITH m AS (SELECT max(ts) AS now FROM events)
        SELECT event_type, count(*) FILTER (WHERE ts >= now - INTERVAL 14 DAY) AS kept, count(*) FILTER (WHERE ts < now - INTERVAL 14 DAY) AS removed FROM events, m GROUP BY event_type""",
    "outcome_counts": """SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS events, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE event_type = 'click') AS clicks,
        count(*) FILTER (WHERE event_type = 'view') AS views, round(avg(value) FILTER (WHERE event_type <> 'error'), 4) AS mean_value FROM events GROUP BY 1""",
    "create_or_get": """WITH m AS (SELECT min(ts) + INTERVAL 1 DAY AS start FROM events),
        o AS (SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events, m WHERE ts < start GROUP BY user_id),
        n AS (SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id, arg_min(event_type, (ts, event_id)) AS event_type FROM events, m WHERE ts >= start GROUP BY user_id)
        SELECT * FROM o UNION ALL SELECT * FROM n WHERE user_id NOT IN (SELECT user_id FROM o)""",
    "document_fingerprints": """SELECT doc_id, sha256('{"content":"' || sha256(coalesce(text, '')) || '","language":' || coalesce('"' || lang || '"', 'null') || ',"source":' || coalesce('"' || source || '"', 'null') || '}') AS fingerprint,
        'doc_' || left(sha256(coalesce(text, '')), 16) AS content_id FROM documents""",
    "page_types": f"""WITH p AS (SELECT page_id, lower(substring(ltrim(coalesce(html, ''), ' '), 1, 200)) AS h, regexp_matches(lower(regexp_split_to_array(coalesce(url, ''), '[?#]')[1]), '(\\.html|\\.htm|\\.js|\\.exe|\\.sh|\\.bat|\\.php)$') AS blocked,
        {_CTRL} <= 0.05 * length(coalesce(html, '')) AS is_text FROM pages),
        k AS (SELECT *, CASE WHEN h = '' THEN 'empty' WHEN starts_with(h, '%pdf-') THEN 'pdf' WHEN starts_with(h, '<!doctype html') OR starts_with(h, '<html') THEN 'html' ELSE 'text' END AS kind FROM p)
        SELECT page_id, kind, blocked OR kind = 'html' AS rejected, is_text FROM k""",
    "issue_groups": """WITH i AS (SELECT user_id, event_type, CASE WHEN value > 50 THEN 3 WHEN value > 10 THEN 2 ELSE 1 END AS s, event_id, json_extract_string(props, '$.k') AS d FROM events),
        f AS (SELECT user_id, event_type, d, min(event_id) AS o FROM i WHERE d IS NOT NULL GROUP BY ALL)
        SELECT 'job' AS item_type, g.user_id AS item_id, g.event_type AS cause, CASE g.s WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity, g.issues, md5(coalesce(t.d, '')) AS details_md5
        FROM (SELECT user_id, event_type, max(s) AS s, count(*) AS issues FROM i GROUP BY ALL) g LEFT JOIN (SELECT user_id, event_type, string_agg(d, '; ' ORDER BY o) AS d FROM f GROUP BY ALL) t USING (user_id, event_type)""",
    "creation_outcomes": """WITH e AS (SELECT *, CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'purchase' THEN 'COMPLETED' WHEN 'view' THEN 'PARTIAL' ELSE 'RUNNING' END AS status,
        json_extract_string(props, '$.k')::INT % 3 AS kind FROM events),
        o AS (SELECT *, lag(status) OVER w AS old, lag(kind) OVER w AS old_kind, trunc(value)::INT % 2 = 1 AS again FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        x AS (SELECT *, kind IS NOT DISTINCT FROM old_kind AS same FROM o),
        r AS (SELECT CASE WHEN old IS NULL THEN 'created' WHEN again AND old NOT IN ('FAILED', 'CANCELLED') THEN 'not retryable' WHEN again AND NOT same THEN 'another request' WHEN again THEN 'retried'
              WHEN NOT same THEN 'another request' WHEN old IN ('QUEUED', 'RUNNING') THEN 'already running' ELSE 'reported' END AS outcome FROM x)
        SELECT CASE WHEN outcome IN ('created', 'retried', 'already running') THEN 202 WHEN outcome = 'reported' THEN 200 ELSE 409 END AS code, outcome, count(*) AS requests FROM r GROUP BY outcome""",
    "coverages": """WITH l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
        s AS (SELECT conv_id, count(*) % 3 + 1 AS n FROM conversations GROUP BY conv_id),
        n AS (SELECT conv_id, n, conv_id + unnest(range(0, n)) AS item_id FROM s),
        f AS (SELECT item_id, arg_min(n, conv_id) AS n, min(conv_id) AS conv_id FROM n GROUP BY item_id),
        c AS (SELECT d.doc_id AS item_id, f.conv_id, CASE WHEN toxic > 0 THEN 'non_story' WHEN quality = 0 THEN 'needs_review' WHEN f.conv_id IS NULL THEN 'needs_review' WHEN f.n > 1 THEN 'merged_into_story' ELSE 'covered_by_story' END AS coverage
              FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN l USING (doc_id) LEFT JOIN f ON f.item_id = d.doc_id)
        SELECT item_id, coverage, CASE WHEN coverage IN ('merged_into_story', 'covered_by_story') THEN conv_id END AS story_id FROM c""",
    "merged_labels": """WITH l AS (SELECT DISTINCT doc_id, CASE WHEN toxic > 0 THEN 'Out-of-Scope' WHEN quality > 0 THEN 'FR' ELSE 'Open Question' END AS label FROM labels),
        m AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM l GROUP BY doc_id)
        SELECT doc_id, coalesce(labels, 'FR') AS labels, CASE WHEN labels IS NULL THEN 0.5 ELSE 0.9 END::DOUBLE AS confidence FROM documents LEFT JOIN m USING (doc_id)""",
}
QUERIES = {
    "job_status": job_status, "attempt_upsert": attempt_upsert, "retention": retention, "outcome_counts": outcome_counts, "create_or_get": create_or_get,
    "document_fingerprints": document_fingerprints, "page_types": page_types, "issue_groups": issue_groups, "merged_labels": merged_labels, "creation_outcomes": creation_outcomes, "coverages": coverages,
}
