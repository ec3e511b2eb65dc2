"""Normalisation, duplicates, sizes and counters."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomlog.functions.jsonbody import LEVEL_KEYS, SERVICE_KEYS, TRACE_KEYS, with_defaults
from loomlog.operators import shapes
from loomlog.operators.counters import count_deltas, log_counts
from loomlog.operators.dedup import drop_recent_duplicates
from loomlog.operators.normalize import normalize
from loomlog.operators.tenancy import too_large, with_plan
from loomlog.sinks.metrics import prometheus_lines
from loomlog.sinks.store import classify, measured, outcome_counts
from loomlog.sources.events import explode_records, split_events, split_oversized
from suite import check
from suite.views import LOGS_SQL, events, logs, table

WITH = f"WITH {LOGS_SQL}"
STAMP = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ')"
KEY = "json_extract_string(props, '$.k')"


def nth(keys: tuple[str, ...]):
    """The alias an event uses, each in turn."""
    names = F.array(*[F.lit(key) for key in keys])
    return F.get(names, (F.col("event_id") % len(keys)).cast("int"))


def payloads(spark, d):
    """Events as producers would send them: every alias, and decoys of other types."""
    decoys = F.when(F.col("event_id") % 3 == 0, '"service":7,"level":30,"trace_id":"",').otherwise("")
    user = F.col("user_id").cast("string")
    payload = F.concat(
        F.lit("{ "), decoys, F.lit('"'), nth(SERVICE_KEYS), F.lit('": "s'), user, F.lit('","'),
        nth(LEVEL_KEYS), F.lit('":"'), F.col("event_type"), F.lit('", "'),
        nth(TRACE_KEYS), F.lit('":"t'), user, F.lit('","k":'),
        F.get_json_object("props", "$.k"), F.lit("}"),
    )
    return events(spark, d).select(
        F.col("event_id").alias("_arrival"), F.col("ts").alias("received_at"), payload.alias("payload")
    )


@check(
    "alias_extract",
    """SELECT event_id, 's' || user_id AS service, event_type AS level, 't' || user_id AS trace_id
       FROM events""",
)
def alias_extract(spark, d):
    return normalize(payloads(spark, d)).select(
        F.col("_arrival").alias("event_id"), "service", "level", "trace_id"
    )


STAMPED = f"""'{{"k":' || {KEY} || ',"received_at":"' || {STAMP} || '"}}'"""


@check(
    "stamped_body",
    f"""SELECT event_id, {STAMPED} AS body, sha256({STAMPED}) AS body_hash,
          CAST(strlen({STAMPED}) AS BIGINT) AS bytes FROM events""",
)
def stamped_body(spark, d):
    raw = events(spark, d).select(
        "event_id", F.col("ts").alias("received_at"), F.col("props").alias("payload")
    )
    return normalize(raw).select("event_id", "body", "body_hash", "bytes")


@check(
    "restamped_body",
    f"""SELECT event_id, '{{"k":' || {KEY} || ',"received_at":"' || {STAMP} || '"}}' AS body FROM events""",
)
def restamped_body(spark, d):
    raw = events(spark, d).select(
        "event_id",
        F.col("ts").alias("received_at"),
        F.concat(
            F.lit('{"received_at":"before","k":'), F.get_json_object("props", "$.k"), F.lit("}")
        ).alias("payload"),
    )
    return normalize(raw).select("event_id", "body")


@check(
    "default_fields",
    f"""SELECT event_id, '{{' || CASE WHEN event_id % 2 = 0 THEN '"service":"api",' ELSE '' END
          || '"env":"prod",' || CASE WHEN event_id % 2 = 0 THEN '' ELSE '"service":"own",' END
          || '"k":' || {KEY} || '}}' AS body FROM events""",
)
def default_fields(spark, d):
    own = F.when(F.col("event_id") % 2 == 0, "").otherwise('"service":"own",')
    payload = F.concat(F.lit("{"), own, F.lit('"k":'), F.get_json_object("props", "$.k"), F.lit("}"))
    return events(spark, d).select(
        "event_id", with_defaults(payload, {"service": "api", "env": "prod"}).alias("body")
    )


@check(
    "dedup_anti",
    f"""{WITH} SELECT b.id, b.trace_id, b.body FROM logs b WHERE b.level = 'warn' AND NOT EXISTS
        (SELECT 1 FROM logs s WHERE s.level = 'error' AND s.trace_id = b.trace_id AND s.body = b.body
           AND s.received_at >= b.received_at - INTERVAL 30 MINUTE)""",
)
def dedup_anti(spark, d):
    rows = logs(spark, d)
    fresh = drop_recent_duplicates(
        rows.filter(F.col("level") == "warn"),
        rows.filter(F.col("level") == "error"),
        seconds=1800,
        keys=("trace_id", "body"),
    )
    return fresh.select("id", "trace_id", "body")


@check(
    "dedup_hot_keys",
    f"""{WITH} SELECT b.id, b.level FROM logs b WHERE b.service = 'svc1' AND NOT EXISTS
        (SELECT 1 FROM logs s WHERE s.service = 'svc2' AND s.level IS NOT DISTINCT FROM b.level
           AND s.level IS NOT NULL AND s.received_at >= b.received_at - INTERVAL 10 MINUTE)""",
)
def dedup_hot_keys(spark, d):
    rows = logs(spark, d)
    fresh = drop_recent_duplicates(
        rows.filter(F.col("service") == "svc1"),
        rows.filter(F.col("service") == "svc2"),
        seconds=600,
        keys=("level",),
    )
    return fresh.select("id", "level")


@check(
    "dedup_within_batch",
    f"""{WITH}, fresh AS (SELECT * FROM logs b WHERE level = 'info' AND trace_id IS NOT NULL AND NOT EXISTS
          (SELECT 1 FROM logs s WHERE s.level = 'warn' AND s.trace_id = b.trace_id
             AND s.received_at >= b.received_at - INTERVAL 3 DAY))
        SELECT min(id) AS id, trace_id FROM fresh GROUP BY trace_id""",
)
def dedup_within_batch(spark, d):
    """Copies in the batch and in the store at once: traces of the batch that the store has not seen lately."""
    rows = logs(spark, d).filter(F.col("trace_id").isNotNull())
    fresh = drop_recent_duplicates(
        rows.filter(F.col("level") == "info"),
        rows.filter(F.col("level") == "warn"),
        seconds=3 * 86400,
        keys=("trace_id",),
        within_batch=True,
    )
    return fresh.select("id", "trace_id")


@check(
    "ingest_outcome",
    """WITH e AS (SELECT *, event_type = 'error' AND event_id % 2 = 0 AS twice,
          event_type = 'view' AS broken FROM events)
       SELECT count(*) FILTER (NOT broken AND NOT twice AND event_type <> 'click') AS written,
         count(*) FILTER (twice) AS deduplicated,
         count(*) FILTER (event_type = 'click') AS oversized,
         count(*) FILTER (broken) AS malformed FROM e""",
)
def ingest_outcome(spark, d):
    kind = F.col("event_type")
    payload = (
        F.when(kind == "view", "{broken")
        .when(kind == "click", F.concat(F.lit('{"pad":"'), F.repeat(F.lit("x"), 200), F.lit('"}')))
        .otherwise(F.concat(F.lit('{"n":'), F.col("event_id").cast("string"), F.lit("}")))
    )
    raw = events(spark, d).select(
        F.col("event_id").alias("_arrival"), kind, F.col("ts").alias("received_at"), payload.alias("payload")
    )
    twice = raw.filter((kind == "error") & (F.col("_arrival") % 2 == 0))
    stored = normalize(twice.drop("event_type")).select("body", "body_hash", "received_at")
    return outcome_counts(classify(measured(raw.drop("event_type"), 100), stored))


@check(
    "oversized_split",
    """SELECT doc_id AS index, CAST(strlen(text) AS BIGINT) AS bytes FROM documents WHERE strlen(text) > 4096""",
)
def oversized_split(spark, d):
    return split_oversized(table(spark, d, "documents"), "text", 4096, "doc_id")[1]


@check(
    "plan_row_limit",
    """SELECT doc_id, quality, coalesce(strlen(text) > quality * 1000 AND quality > 0, false) AS too_large
       FROM documents LEFT JOIN labels USING (doc_id)""",
)
def plan_row_limit(spark, d):
    plans = table(spark, d, "labels").select(
        "doc_id", "quality", (F.col("quality") * 1000).alias("max_row_bytes")
    )
    rows = table(spark, d, "documents").select("doc_id", F.octet_length("text").alias("bytes"))
    return (
        with_plan(rows, plans, key="doc_id", spread="doc_id")
        .select("doc_id", "quality", F.coalesce(too_large(), F.lit(False)).alias("too_large"))
    )


@check(
    "log_counts",
    f"""{WITH} SELECT coalesce(service, '') AS service, coalesce(level, '') AS level, count(*) AS count
        FROM logs GROUP BY 1, 2""",
)
def counters(spark, d):
    rows = logs(spark, d)
    early = rows.filter(F.col("received_at") < "2024-01-10")
    late = rows.filter(F.col("received_at") >= "2024-01-10")
    return log_counts(count_deltas(early).unionByName(count_deltas(late)))


@check(
    "prometheus",
    f"""{WITH} SELECT 'logs_total{{service="' || coalesce(service, 'unknown') || '",level="'
          || coalesce(level, 'unknown') || '"}} ' || count(*) AS value FROM logs GROUP BY service, level""",
)
def exposition(spark, d):
    return prometheus_lines(log_counts(count_deltas(logs(spark, d))))


@check(
    "exploded_records",
    f"""SELECT event_id, '{{"a":' || {KEY} || '}}' AS payload FROM events WHERE event_id % 3 <> 2
        UNION ALL SELECT event_id, '{{"b":"x"}}' FROM events WHERE event_id % 3 = 1""",
)
def exploded_records(spark, d):
    k = F.get_json_object("props", "$.k")
    which = F.col("event_id") % 3
    payload = (
        F.when(which == 0, F.concat(F.lit('{"a":'), k, F.lit("}")))
        .when(which == 1, F.concat(F.lit('[{"a":'), k, F.lit('}, {"b": "x"}]')))
        .otherwise("[]")
    )
    raw = events(spark, d).select("event_id", payload.alias("payload"))
    return split_events(explode_records(raw))[0].select("event_id", "payload")


@check(
    "refused_records",
    """SELECT CASE event_id % 4 WHEN 0 THEN 'malformed json' WHEN 1 THEN 'empty batch'
         WHEN 2 THEN 'too many rows' ELSE 'not an object' END AS reason, count(*) AS records
       FROM events GROUP BY 1""",
)
def refused_records(spark, d):
    which = F.col("event_id") % 4
    payload = (
        F.when(which == 0, "{oops").when(which == 1, "[ ]").when(which == 2, '[{"a":1},{"b":2},{}]').otherwise("[7]")
    )
    raw = events(spark, d).select(payload.alias("payload"))
    refused = split_events(explode_records(raw, max_rows=2))[1]
    return refused.groupBy("reason").agg(F.count(F.lit(1)).alias("records"))


@check(
    "console_records",
    f"""SELECT event_id, CASE event_type WHEN 'error' THEN
           '{{"level":"error","message":"failed","args":[' || {KEY} || ']}}'
         WHEN 'view' THEN '{{"level":"info","message":"seen"}}'
         ELSE '{{"level":"warn","args":[{{"service":"shop"}},' || {KEY} || ']}}' END AS payload FROM events""",
)
def console_records(spark, d):
    k = F.get_json_object("props", "$.k")
    kind = F.col("event_type")
    args = (
        F.when(kind == "error", F.concat(F.lit('["failed",'), k, F.lit("]")))
        .when(kind == "view", '["seen"]')
        .otherwise(F.concat(F.lit('[{"service":"shop"},'), k, F.lit("]")))
    )
    method = F.when(kind == "error", "error").when(kind == "view", "log").otherwise("warn")
    return events(spark, d).select(
        "event_id",
        shapes.console_record(method, F.from_json(args, "array<variant>")).alias("payload"),
    )


@check(
    "leveled_records",
    f"""SELECT event_id, '{{"k":' || {KEY} || ',"level":"warn","message":"' || event_type || '"}}' AS payload
        FROM events""",
)
def leveled_records(spark, d):
    k = F.get_json_object("props", "$.k")
    plain_meta = F.concat(F.lit('{"k":'), k, F.lit("}"))
    clashing = F.concat(F.lit('{"level":"x","k":'), k, F.lit("}"))
    meta = F.when(F.col("event_id") % 2 == 0, plain_meta).otherwise(clashing)
    return events(spark, d).select(
        "event_id",
        shapes.leveled_record(F.lit("warn"), F.col("event_type"), meta).alias("payload"),
    )


@check(
    "access_records",
    """SELECT page_id, '{"level":"' || CASE WHEN page_id % 5 = 0 THEN 'error' ELSE 'info' END
         || '","service":"next","method":"GET","path":"' || regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1)
         || CASE WHEN page_id % 5 = 0 THEN '","error":"boom"' ELSE '","status":200' END
         || ',"duration_ms":' || (page_id * 7) || '}' AS payload FROM pages""",
)
def access_records(spark, d):
    page = F.col("page_id")
    started = F.timestamp_millis(page)
    return table(spark, d, "pages").select(
        "page_id",
        shapes.access_record(
            F.lit("GET"),
            F.col("url"),
            started,
            F.timestamp_millis(page * 8),
            F.lit(200),
            F.when(page % 5 == 0, "boom"),
        ).alias("payload"),
    )


@check(
    "browser_errors",
    """SELECT page_id, '{"level":"error","type":"' || CASE WHEN page_id % 4 = 3 THEN 'unhandled_rejection'
           ELSE 'uncaught_error' END || '","message":"m' || page_id
         || CASE WHEN page_id % 4 IN (1, 2) THEN '","_source":"' || url || ':' || (page_id % 4) ELSE '' END
         || '"}' AS payload FROM pages""",
)
def browser_errors(spark, d):
    page = F.col("page_id")
    return table(spark, d, "pages").select(
        "page_id",
        shapes.browser_error(
            F.concat(F.lit("m"), page.cast("string")),
            F.col("url"),
            page % 4,
            F.lit(None).cast("string"),
            page % 4 == 3,
        ).alias("payload"),
    )


@check(
    "python_records",
    """SELECT conv_id, turn, json_object('level', lower(upper(role)), 'message', text, 'logger', 'app',
         'module', 'm', 'funcName', 'f', 'lineno', turn) AS payload FROM conversations""",
)
def python_records(spark, d):
    return table(spark, d, "conversations").select(
        "conv_id",
        "turn",
        shapes.python_record(
            F.upper("role"), F.col("text"), F.lit("app"), F.lit("m"), F.lit("f"), F.col("turn"),
            F.lit(None).cast("string"),
        ).alias("payload"),
    )


@check(
    "channel_records",
    """SELECT event_id, '{"level":"' || event_type || '","message":"m","channel":"web","datetime":"'
         || strftime(ts, '%Y-%m-%dT%H:%M:%S.%g+00:00') || '"'
         || CASE WHEN event_id % 2 = 0 THEN ',"context":{"user":"' || user_id || '"}' ELSE '' END
         || '}' AS payload FROM events""",
)
def channel_records(spark, d):
    user = F.create_map(F.lit("user"), F.col("user_id").cast("string"))
    empty = F.map_filter(user, lambda _key, _value: F.lit(False))
    return events(spark, d).select(
        "event_id",
        shapes.channel_record(
            F.upper("event_type"),
            F.lit("m"),
            F.lit("web"),
            F.col("ts"),
            F.when(F.col("event_id") % 2 == 0, user).otherwise(empty),
            empty,
        ).alias("payload"),
    )
