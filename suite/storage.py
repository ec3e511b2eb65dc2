"""Retention, the stored table, and streams over it."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loomlog.operators.aggregates import latency_by_service, slow_requests
from loomlog.operators.counters import log_counts
from loomlog.operators.pages import field_rows
from loomlog.operators.rollups import anomaly_stored, histogram_stored, summarize_stored
from loomlog.operators.tokens import count_search_stored, search_page_stored, search_stored
from loomlog.operators.retention import deleted_rows, kept_rows, newest_rows
from loomlog.operators.tenancy import retained
from loomlog.session import shared_dir
from loomlog.sinks.projects import ingest_projects, read_projects, read_usage, retention_all, sweep_projects
from loomlog.sinks.postings import index_store
from loomlog.sinks.rollups import keep_rollup
from loomlog.sinks.store import compact, delete_where, ingest_batch, keep_fields, purge_before, purge_excess
from loomlog.sources.store import read_counts, read_fields, read_logs
from loomlog.streaming.aggregates import alerts, running_counts, windowed_counts
from loomlog.streaming.copies import drop_recent_copies
from loomlog.streaming.tail import stored_stream, tail_stream, watch
from suite import check
from suite.aggregates import CLASSED, RATES
from suite.views import LOGS_SQL, events, logs, table

WITH = f"WITH {LOGS_SQL}"


@check("purge_before", f"{WITH} SELECT id, service FROM logs WHERE received_at >= TIMESTAMP '2024-01-12 06:00:00'")
def purge(spark, d):
    return kept_rows(logs(spark, d), before="2024-01-12T06:00:00Z").select("id", "service")


@check(
    "delete_service",
    f"""{WITH} SELECT id, service FROM logs WHERE NOT coalesce(service = 'svc3', false)""",
)
def delete_service(spark, d):
    return kept_rows(logs(spark, d), service="svc3").select("id", "service")


@check(
    "delete_count",
    f"""{WITH} SELECT count(*) AS deleted FROM logs WHERE service = 'svc3'
        AND received_at < TIMESTAMP '2024-01-12'""",
)
def delete_count(spark, d):
    gone = deleted_rows(logs(spark, d), before="2024-01-12", service="svc3")
    return gone.agg(F.count(F.lit(1)).alias("deleted"))


@check("purge_excess", f"{WITH} SELECT id, service FROM logs ORDER BY id DESC LIMIT 700")
def excess(spark, d):
    return newest_rows(logs(spark, d), 700).select("id", "service")


@check(
    "project_retention",
    f"""{WITH}, plans AS (SELECT 'svc' || n_nationkey AS project_id, n_nationkey * 3 AS days FROM nation)
        SELECT id, service AS project_id FROM logs LEFT JOIN plans ON service = project_id
        WHERE days IS NULL OR days <= 0 OR received_at >= TIMESTAMP '2024-01-31' - to_days(days)""",
)
def project_retention(spark, d):
    plans = table(spark, d, "nation").select(
        F.concat(F.lit("svc"), F.col("n_nationkey").cast("string")).alias("project_id"),
        (F.col("n_nationkey") * 3).alias("retention_days"),
    )
    rows = logs(spark, d).withColumnRenamed("service", "project_id")
    return retained(rows, plans, "2024-01-31").select("id", "project_id")


def raw_events(spark, d):
    user = F.col("user_id").cast("string")
    payload = F.concat(
        F.lit('{"svc":"s'), (F.col("user_id") % 5).cast("string"), F.lit('","level":"'),
        F.col("event_type"), F.lit('","traceId":"t'), user, F.lit('","n":'),
        F.col("event_id").cast("string"), F.lit("}"),
    )
    return events(spark, d).select(F.col("ts").alias("received_at"), payload.alias("payload"))


def stored(spark, d, indexed: bool = False) -> str:
    """Ingest all events in two batches, the second partly repeating the first."""
    root = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    if indexed:
        index_store(spark, root)
    rows = raw_events(spark, d)
    border, again = "2024-01-16", "2024-01-14"
    ingest_batch(rows.filter(F.col("received_at") < border), root, 0)
    ingest_batch(rows.filter(F.col("received_at") >= again), root, 1)
    return root


STORED_SQL = """WITH stored AS (SELECT event_id AS n, ts AS received_at, 's' || (user_id % 5) AS service,
    event_type AS level, 't' || user_id AS trace_id FROM events)"""


@check("store_roundtrip", f"{STORED_SQL} SELECT * FROM stored")
def store_roundtrip(spark, d):
    return read_logs(spark, stored(spark, d)).select(
        F.get_json_object("body", "$.n").cast("bigint").alias("n"),
        "received_at",
        "service",
        "level",
        "trace_id",
    )


@check("store_counts", f"{STORED_SQL} SELECT service, level, count(*) AS count FROM stored GROUP BY 1, 2")
def store_counts(spark, d):
    return log_counts(read_counts(spark, stored(spark, d)))


@check(
    "store_upkeep",
    f"""{STORED_SQL}, kept AS (SELECT * FROM stored WHERE service <> 's2'
          AND received_at >= TIMESTAMP '2024-01-05 12:00:00')
        SELECT n, service, level FROM kept ORDER BY n DESC LIMIT 600""",
)
def store_upkeep(spark, d):
    root = stored(spark, d)
    purge_before(spark, root, "2024-01-05T12:00:00Z")
    delete_where(spark, root, service="s2")
    purge_excess(spark, root, 600)
    return read_logs(spark, root).select(
        F.get_json_object("body", "$.n").cast("bigint").alias("n"), "service", "level"
    )


@check(
    "stream_tail",
    f"{STORED_SQL} SELECT n, trace_id FROM stored WHERE service = 's1' AND level = 'error'",
)
def stream_tail(spark, d):
    root = stored(spark, d)
    tail = tail_stream(
        spark, root, f"{root}/tail", f"{root}/tail-state", service="s1", level="error", available_now=True
    )
    tail.awaitTermination()
    lines = spark.read.schema("trace_id STRING, body STRING").json(f"{root}/tail/*")
    return lines.select(F.get_json_object("body", "$.n").cast("bigint").alias("n"), "trace_id")


@check(
    "stream_histogram",
    f"""{STORED_SQL}, b AS (SELECT time_bucket(INTERVAL '6 hours', received_at, TIMESTAMP '1970-01-01') AS start,
          count(*) AS count FROM stored GROUP BY 1)
        SELECT strftime(start, '%Y-%m-%dT%H:%M:%SZ') AS bucket, count FROM b
        WHERE start + INTERVAL 6 HOURS <= (SELECT max(received_at) FROM stored)""",
)
def stream_histogram(spark, d):
    root = stored(spark, d)
    counts = windowed_counts(stored_stream(spark, root), "6h")
    query = (
        counts.writeStream.format("parquet")
        .outputMode("append")
        .option("path", f"{root}/hist")
        .option("checkpointLocation", f"{root}/hist-state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema("bucket STRING, count BIGINT").parquet(f"{root}/hist")


@check(
    "stream_tail_after_upkeep",
    f"""{STORED_SQL} SELECT n, trace_id FROM stored
        WHERE received_at < TIMESTAMP '2024-01-16' OR service <> 's2'""",
)
def stream_tail_after_upkeep(spark, d):
    """Every row comes once although batches are replayed, rows deleted and a day compacted."""
    root = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    rows = raw_events(spark, d)
    early, late = rows.filter(F.col("received_at") < "2024-01-16"), rows.filter(F.col("received_at") >= "2024-01-16")

    def tail():
        tail_stream(spark, root, f"{root}/tail", f"{root}/tail-state", available_now=True).awaitTermination()

    ingest_batch(early, root, 0)
    tail()
    ingest_batch(late, root, 1)
    delete_where(spark, root, service="s2")
    ingest_batch(late, root, 1)
    compact(spark, root, "2024-01-15")
    tail()
    lines = spark.read.schema("trace_id STRING, body STRING").json(f"{root}/tail/*")
    return lines.select(F.get_json_object("body", "$.n").cast("bigint").alias("n"), "trace_id")


@check(
    "watch_stored",
    f"""{STORED_SQL} SELECT n, service FROM stored WHERE service = 's1' AND level = 'error'
        ORDER BY received_at, n LIMIT 50""",
)
def watch_stored(spark, d):
    seen = watch(spark, stored(spark, d), None, timeout_seconds=5, service="s1", level="error")
    found = spark.createDataFrame([(r["service"], r["body"]) for r in seen.rows], "service STRING, body STRING")
    return found.select(F.get_json_object("body", "$.n").cast("bigint").alias("n"), "service")


@check("stream_counts", f"{STORED_SQL} SELECT service, level, count(*) AS count FROM stored GROUP BY 1, 2")
def stream_counts(spark, d):
    name = f"counts_{uuid.uuid4().hex}"
    counts = running_counts(stored_stream(spark, stored(spark, d)))
    query = counts.writeStream.format("memory").queryName(name).outputMode("complete")
    query.trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).select("service", "level", "count")


@check(
    "stream_alerts",
    f"""{STORED_SQL}, w AS (SELECT date_trunc('hour', received_at) AS since, service, count(*) AS count
          FROM stored WHERE level = 'error' GROUP BY 1, 2 HAVING count(*) >= 2)
        SELECT since, service, count FROM w
        WHERE since + INTERVAL 1 HOUR <= (SELECT max(received_at) FROM stored WHERE level = 'error')""",
)
def stream_alerts(spark, d):
    root = stored(spark, d)
    found = alerts(stored_stream(spark, root), 60, 2)
    query = found.writeStream.format("parquet").outputMode("append").option("path", f"{root}/alerts")
    query = query.option("checkpointLocation", f"{root}/alert-state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema("since TIMESTAMP, service STRING, count BIGINT").parquet(f"{root}/alerts")


def number():
    return F.get_json_object("body", "$.n").cast("bigint").alias("n")


@check(
    "search_stored",
    f"""{STORED_SQL} SELECT n, service FROM stored
        WHERE (service = 's1' AND level = 'error' OR trace_id LIKE 't7%') AND NOT trace_id LIKE 't1%'""",
)
def search_of_a_store(spark, d):
    """A phrase, a prefix and an exclusion, found through the index."""
    root = stored(spark, d, indexed=True)
    return search_stored(spark, root, '("svc s1" AND error OR t7*) NOT t1*').select(number(), "service")


@check(
    "search_page_stored",
    f"""{STORED_SQL} SELECT n, trace_id FROM stored WHERE service = 's3' AND level = 'click'
        AND received_at >= TIMESTAMP '2024-01-09 07:30:00' ORDER BY received_at DESC, n DESC LIMIT 40""",
)
def search_page_of_a_store(spark, d):
    root = stored(spark, d, indexed=True)
    page = search_page_stored(spark, root, "click", service="s3", since="2024-01-09T07:30:00Z", limit=40)
    return page.select(number(), "trace_id")


@check(
    "search_count_stored",
    f"""{STORED_SQL} SELECT 1 AS k, count(*) AS count FROM stored WHERE level = 'error' AND service <> 's2'
        UNION ALL SELECT 2, count(*) FROM stored WHERE trace_id LIKE 't1%' AND received_at < TIMESTAMP '2024-01-20 12:00:00.001'
        UNION ALL SELECT 3, count(*) FROM stored WHERE service = 's1' AND level IN ('error', 'click')""",
)
def search_counts_of_a_store(spark, d):
    """Counts from the postings alone, with a bound within a day, and with a service from the rows."""
    root = stored(spark, d, indexed=True)
    counts = [
        count_search_stored(spark, root, "error NOT s2"),
        count_search_stored(spark, root, "t1*", until="2024-01-20T12:00:00Z"),
        count_search_stored(spark, root, "error OR click", service="s1"),
    ]
    numbered = [c.select(F.lit(k).alias("k"), "count") for k, c in enumerate(counts, 1)]
    return numbered[0].union(numbered[1]).union(numbered[2])


@check(
    "search_after_delete",
    f"""{STORED_SQL}, kept AS (SELECT n FROM stored WHERE level = 'error' AND service <> 's2'
          AND received_at >= TIMESTAMP '2024-01-05 12:00:00')
        SELECT 'row' AS what, n FROM kept UNION ALL SELECT 'count', count(*) FROM kept""",
)
def search_after_delete(spark, d):
    """The index follows deletions and compaction."""
    root = stored(spark, d, indexed=True)
    purge_before(spark, root, "2024-01-05T12:00:00Z")
    delete_where(spark, root, service="s2")
    compact(spark, root, "2024-01-15")
    found = search_stored(spark, root, "error").select(F.lit("row").alias("what"), number())
    counted = count_search_stored(spark, root, "error").select(F.lit("count").alias("what"), F.col("count").alias("n"))
    return found.union(counted)


def stored_fields(spark, d) -> str:
    """A store whose first batch was written before it kept fields, with a deletion after."""
    root = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    rows = raw_events(spark, d)
    border = "2024-01-16"
    ingest_batch(rows.filter(F.col("received_at") < border), root, 0)
    keep_fields(spark, root)
    ingest_batch(rows.filter(F.col("received_at") >= border), root, 1)
    delete_where(spark, root, service="s2")
    return root


KEPT_SQL = STORED_SQL.replace("FROM events)", "FROM events WHERE user_id % 5 <> 2)")


@check(
    "field_stored",
    f"""{KEPT_SQL} SELECT 1 AS k, n FROM stored WHERE n <= 3000
        UNION ALL SELECT 2, n FROM stored WHERE trace_id >= 't9' AND level = 'error'""",
)
def field_stored(spark, d):
    """Comparisons of a number and of a text, from the members of the shredded bodies."""
    rows = read_fields(spark, stored_fields(spark, d))
    numbers = field_rows(rows, "n", "<=", 3000)
    texts = field_rows(field_rows(rows, "traceId", ">=", "t9"), "level", "=", "error")
    found = [df.select(F.lit(k).alias("k"), F.expr("variant_get(fields, '$.n', 'bigint')").alias("n")) for k, df in ((1, numbers), (2, texts))]
    return found[0].union(found[1])


@check(
    "latency_stored",
    f"""{KEPT_SQL} SELECT service, count(*) AS requests, max(n)::DOUBLE AS max_ms FROM stored GROUP BY service""",
)
def latency_stored(spark, d):
    """Counts and greatest values per service from one member of the shredded bodies."""
    return latency_by_service(read_fields(spark, stored_fields(spark, d)), "n").select("service", "requests", "max_ms")


@check(
    "slow_stored",
    f"""{KEPT_SQL} SELECT service, n::DOUBLE AS ms FROM stored WHERE n > 9000""",
)
def slow_stored(spark, d):
    return slow_requests(read_fields(spark, stored_fields(spark, d)), 9000, "n").select("service", "ms")


@check(
    "stream_copies",
    f"""{STORED_SQL.replace("WITH stored", "WITH RECURSIVE stored")}, r AS (
          SELECT n, service || level AS k, received_at,
                 row_number() OVER (PARTITION BY service, level ORDER BY received_at, n) AS place FROM stored),
        c AS (SELECT k, place, n, received_at AS last, true AS kept FROM r WHERE place = 1
          UNION ALL
          SELECT r.k, r.place, r.n, CASE WHEN r.received_at > c.last + INTERVAL 3 HOURS THEN r.received_at ELSE c.last END,
                 r.received_at > c.last + INTERVAL 3 HOURS
          FROM c JOIN r ON r.k = c.k AND r.place = c.place + 1)
        SELECT n, k FROM c WHERE kept""",
)
def stream_copies(spark, d):
    """Of the rows of a service and level, those that none let through in the three hours before covers."""
    root = stored(spark, d)
    rows = stored_stream(spark, root).select("id", "received_at", F.concat("service", "level").alias("k"), number())
    query = drop_recent_copies(rows, "k", seconds=3 * 3600).writeStream.format("parquet").outputMode("append")
    query = query.option("path", f"{root}/once").option("checkpointLocation", f"{root}/once-state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema("n BIGINT, k STRING").parquet(f"{root}/once")


def project_events(spark, d):
    return raw_events(spark, d).withColumn("project_id", F.concat(F.lit("p"), F.get_json_object("payload", "$.n").cast("bigint") % 7))


def projects_stored(spark, d) -> str:
    """The events of seven projects in two batches, the second partly repeating the first and then replayed."""
    root = f"{shared_dir(spark)}/projects-{uuid.uuid4().hex}"
    rows = project_events(spark, d)
    late = rows.filter(F.col("received_at") >= "2024-01-14")
    ingest_projects(rows.filter(F.col("received_at") < "2024-01-16"), root, 0)
    for _ in range(2):
        ingest_projects(late, root, 1)
    return root


PROJECTS_SQL = """WITH stored AS (SELECT event_id AS n, 'p' || event_id % 7 AS project_id, ts AS received_at, event_type AS level,
    strlen('{"svc":"s' || user_id % 5 || '","level":"' || event_type || '","traceId":"t' || user_id || '","n":' || event_id || '}') AS size
  FROM events)"""


@check("ingest_projects", f"{PROJECTS_SQL} SELECT project_id, n, level FROM stored")
def many_projects(spark, d):
    return read_projects(spark, projects_stored(spark, d)).select("project_id", number(), "level")


@check(
    "usage_at_write",
    f"""{PROJECTS_SQL}, sent AS (SELECT * FROM stored UNION ALL
          SELECT * FROM stored WHERE received_at >= TIMESTAMP '2024-01-14' AND received_at < TIMESTAMP '2024-01-16')
        SELECT project_id, strftime(received_at, '%Y-%m') AS month, sum(size)::BIGINT AS bytes, count(DISTINCT n) AS lines
        FROM sent GROUP BY 1, 2""",
)
def usage_at_write(spark, d):
    """Bytes sent, copies included, and rows written, as the batches left them."""
    return read_usage(spark, projects_stored(spark, d))


@check(
    "retention_all",
    f"""{PROJECTS_SQL} SELECT project_id, count(*) AS rows, min(n) AS least, max(n) AS most FROM stored
        WHERE project_id = 'p0' OR received_at >= TIMESTAMP '2024-01-30 08:30:00' - to_days((n % 7 * 4)::INT)
        GROUP BY project_id""",
)
def retention_of_all(spark, d):
    """Seven retentions applied at once, and once more after the sweep."""
    root = projects_stored(spark, d)
    plans = spark.range(7).select(F.concat(F.lit("p"), F.col("id")).alias("project_id"), (F.col("id") * 4).cast("int").alias("retention_days"))
    for _ in range(2):
        retention_all(spark, root, plans, "2024-01-30T08:30:00Z")
        sweep_projects(spark, root)
    rows = read_projects(spark, root).select("project_id", number())
    return rows.groupBy("project_id").agg(F.count(F.lit(1)).alias("rows"), F.min("n").alias("least"), F.max("n").alias("most"))


def rolled_up(spark, d) -> str:
    """A store whose first batch was written before it kept hourly counts, with a deletion and a compaction after."""
    root = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    rows = raw_events(spark, d)
    border = "2024-01-16"
    ingest_batch(rows.filter(F.col("received_at") < border), root, 0)
    keep_rollup(spark, root)
    ingest_batch(rows.filter(F.col("received_at") >= border), root, 1)
    purge_before(spark, root, "2024-01-05T12:30:00Z")
    delete_where(spark, root, before="2024-01-18T07:20:00Z", service="s2")
    compact(spark, root, "2024-01-19")
    return root


ROLLED_SQL = f"""{STORED_SQL}, kept AS (SELECT * FROM stored WHERE received_at >= TIMESTAMP '2024-01-05 12:30:00'
    AND NOT (service = 's2' AND received_at < TIMESTAMP '2024-01-18 07:20:00'))"""


@check(
    "hist_rollup",
    f"""{ROLLED_SQL} SELECT strftime(time_bucket(INTERVAL '6 hours', received_at, TIMESTAMP '1970-01-01'),
          '%Y-%m-%dT%H:%M:%SZ') AS bucket, service, count(*) AS count FROM kept
        WHERE received_at >= TIMESTAMP '2024-01-03 08:15:30' AND received_at <= TIMESTAMP '2024-01-27 19:40:00'
        GROUP BY 1, 2""",
)
def hist_rollup(spark, d):
    """Buckets over a window that cuts hours, from hourly counts that follow deletions and compaction."""
    bounds = {"since": "2024-01-03T08:15:30Z", "until": "2024-01-27T19:40:00Z"}
    return histogram_stored(spark, rolled_up(spark, d), "6h", by=("service",), **bounds)


@check("summary_rollup", f"{ROLLED_SQL} SELECT service, level, count(*) AS count FROM kept GROUP BY 1, 2")
def summary_rollup(spark, d):
    return summarize_stored(spark, rolled_up(spark, d))


@check(
    "anomaly_rollup",
    f"""{ROLLED_SQL}, c AS (SELECT service, count(*) FILTER (received_at >= TIMESTAMP '2024-01-19 22:15:00') AS recent_count,
            count(*) FILTER (received_at <= TIMESTAMP '2024-01-19 22:15:00') AS baseline_count
          FROM kept WHERE level = 'error' AND received_at >= TIMESTAMP '2024-01-12 22:15:00'
            AND received_at <= TIMESTAMP '2024-01-20 00:15:00' GROUP BY service),
        r AS (SELECT service, {RATES.format(w=120)} FROM c) SELECT {CLASSED} FROM r""",
)
def anomaly_rollup(spark, d):
    return anomaly_stored(spark, rolled_up(spark, d), as_of="2024-01-20T00:15:00Z", window_minutes=120, by=("service",))
