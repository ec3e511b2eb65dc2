"""Counts, histograms, rate checks and the documented reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomlog.operators import aggregates as agg
from loomlog.operators.tenancy import over_quota, with_plan
from loomlog.operators.traces import correlate, correlate_within
from suite import check
from suite.views import LOGS_SQL, RICH_SQL, logs, rich_logs, table

WITH = f"WITH {LOGS_SQL}"
RICH = f"WITH {RICH_SQL}"


def label(width: str, column: str = "received_at") -> str:
    return (
        f"strftime(time_bucket(INTERVAL '{width}', {column}, TIMESTAMP '1970-01-01'), "
        "'%Y-%m-%dT%H:%M:%SZ')"
    )


@check(
    "hist_hour_errors",
    f"""{WITH} SELECT {label('1 hour')} AS bucket, service, count(*) AS count
        FROM logs WHERE level = 'error' GROUP BY 1, 2""",
)
def hist_hour_errors(spark, d):
    return agg.histogram(logs(spark, d), "1h", level="error", by=("service",))


def _plain_histogram(bucket: str, width: str) -> None:
    @check(
        f"hist_{bucket}",
        f"{WITH} SELECT {label(width)} AS bucket, count(*) AS count FROM logs GROUP BY 1",
    )
    def run(spark, d):
        return agg.histogram(logs(spark, d), bucket)


for _bucket, _width in {
    "1m": "1 minute",
    "5m": "5 minutes",
    "15m": "15 minutes",
    "1h": "1 hour",
    "6h": "6 hours",
    "1d": "1 day",
}.items():
    _plain_histogram(_bucket, _width)


@check(
    "hist_1d_default7d",
    f"""{WITH} SELECT {label('1 day')} AS bucket, count(*) AS count FROM logs
        WHERE received_at >= TIMESTAMP '2024-01-24' AND received_at <= TIMESTAMP '2024-01-31'
        GROUP BY 1""",
)
def hist_1d_default7d(spark, d):
    return agg.recent_histogram(logs(spark, d), "1d", as_of="2024-01-31")


@check(
    "count_filtered",
    f"""{WITH} SELECT count(*) AS count FROM logs WHERE service = 'svc2' AND level = 'warn'
        AND received_at >= TIMESTAMP '2024-01-03 04:05:06' AND received_at <= TIMESTAMP '2024-01-20'""",
)
def count_filtered(spark, d):
    return agg.count_logs(
        logs(spark, d), service="svc2", level="warn", since="2024-01-03T04:05:06Z", until="2024-01-20"
    )


@check("count_all", f"{WITH} SELECT count(*) AS count FROM logs")
def count_all(spark, d):
    return agg.count_logs(logs(spark, d))


@check("summary", f"{WITH} SELECT service, level, count(*) AS count FROM logs GROUP BY 1, 2")
def summary(spark, d):
    return agg.summarize(logs(spark, d))


@check(
    "summary_window",
    f"""{WITH} SELECT service, level, count(*) AS count FROM logs
        WHERE received_at >= TIMESTAMP '2024-01-10' AND received_at <= TIMESTAMP '2024-01-11'
        GROUP BY 1, 2""",
)
def summary_window(spark, d):
    return agg.summarize(logs(spark, d), since="2024-01-10", until="2024-01-11")


@check("services", f"{WITH} SELECT DISTINCT service FROM logs WHERE service IS NOT NULL")
def services(spark, d):
    return agg.list_services(logs(spark, d))


@check(
    "alert_60m",
    f"""{WITH} SELECT count(*) AS count FROM logs WHERE level = 'error'
        AND received_at >= TIMESTAMP '2024-01-19 23:00:00' AND received_at <= TIMESTAMP '2024-01-20'""",
)
def alert_60m(spark, d):
    return agg.alert_count(logs(spark, d), as_of="2024-01-20")


@check(
    "alert_week_any_level",
    f"""{WITH} SELECT count(*) AS count FROM logs WHERE service = 'svc4'
        AND received_at >= TIMESTAMP '2024-01-13' AND received_at <= TIMESTAMP '2024-01-20'""",
)
def alert_week_any_level(spark, d):
    return agg.alert_count(
        logs(spark, d), as_of="2024-01-20", minutes=99_999, service="svc4", level=None,
        max_minutes=agg.MAX_ALERT_MINUTES,
    )


@check(
    "alert_month",
    f"""{WITH} SELECT count(*) AS count FROM logs WHERE level = 'error'
        AND received_at >= TIMESTAMP '2024-01-01' AND received_at <= TIMESTAMP '2024-01-31'""",
)
def alert_month(spark, d):
    return agg.alert_count(logs(spark, d), as_of="2024-01-31", minutes=43_200)


@check(
    "alert_search",
    f"""{RICH} SELECT count(*) AS count FROM rich
        WHERE received_at >= TIMESTAMP '2024-01-19 16:00:00' AND received_at <= TIMESTAMP '2024-01-20'
        AND json_extract_string(body, '$.message') LIKE 'purchase %'""",
)
def alert_search(spark, d):
    return agg.alert_count(
        rich_logs(spark, d), as_of="2024-01-20", minutes=480, level="error", query="purchase"
    )


ANOMALY = """count(*) FILTER (received_at >= TIMESTAMP '2024-01-19 {hour}:00:00') AS recent_count,
  count(*) FILTER (received_at <= TIMESTAMP '2024-01-19 {hour}:00:00') AS baseline_count"""

RATES = """recent_count, baseline_count, recent_count / {w}::DOUBLE AS recent_rate,
  baseline_count / 10080::DOUBLE AS baseline_rate,
  (baseline_count / 10080::DOUBLE) * {w}::DOUBLE AS expected,
  CASE WHEN baseline_count > 0 THEN (recent_count / {w}::DOUBLE) / (baseline_count / 10080::DOUBLE)
       WHEN recent_count = 0 THEN 1.0::DOUBLE END AS factor"""

CLASSED = """*, CASE WHEN factor < 1.5 THEN 'normal' WHEN factor < 5 THEN 'mild'
  ELSE 'significant' END AS class"""


@check(
    "anomaly_global",
    f"""{WITH}, c AS (SELECT {ANOMALY.format(hour='23')} FROM logs WHERE level = 'error'
          AND received_at >= TIMESTAMP '2024-01-12 23:00:00' AND received_at <= TIMESTAMP '2024-01-20'),
        r AS (SELECT {RATES.format(w=60)} FROM c) SELECT {CLASSED} FROM r""",
)
def anomaly_global(spark, d):
    return agg.anomaly(logs(spark, d), as_of="2024-01-20")


@check(
    "anomaly_by_service",
    f"""{WITH}, c AS (SELECT service, {ANOMALY.format(hour='22')} FROM logs WHERE level = 'error'
          AND received_at >= TIMESTAMP '2024-01-12 22:00:00' AND received_at <= TIMESTAMP '2024-01-20'
          GROUP BY service),
        r AS (SELECT service, {RATES.format(w=120)} FROM c) SELECT {CLASSED} FROM r""",
)
def anomaly_by_service(spark, d):
    return agg.anomaly(logs(spark, d), as_of="2024-01-20", window_minutes=120, by=("service",))


@check(
    "errors_per_hour",
    f"""{WITH} SELECT service, strftime(received_at, '%Y-%m-%dT%H:00:00Z') AS hour, count(*) AS errors
        FROM logs WHERE level = 'error' GROUP BY 1, 2""",
)
def errors_per_hour(spark, d):
    return agg.errors_per_hour(logs(spark, d))


@check(
    "top_messages",
    f"""{RICH} SELECT json_extract_string(body, '$.message') AS msg, count(*) AS n FROM rich
        WHERE level = 'error' GROUP BY 1 ORDER BY n DESC, msg LIMIT 10""",
)
def top_messages(spark, d):
    return agg.top_messages(rich_logs(spark, d))


@check(
    "latency_by_service",
    f"""{RICH}, m AS (SELECT service, CAST(json_extract_string(body, '$.ms') AS DOUBLE) AS ms FROM rich)
        SELECT service, count(*) AS requests, max(ms) AS max_ms, quantile_disc(ms, 0.95) AS p95_ms
        FROM m WHERE ms IS NOT NULL GROUP BY service""",
)
def latency_by_service(spark, d):
    return agg.latency_by_service(rich_logs(spark, d))


@check("trace_services", f"{WITH} SELECT DISTINCT service FROM logs WHERE trace_id = 'u33'")
def trace_services(spark, d):
    return agg.trace_services(logs(spark, d), "u33")


@check(
    "slow_requests",
    f"""{RICH} SELECT id, service, CAST(json_extract_string(body, '$.ms') AS DOUBLE) AS ms, received_at
        FROM rich WHERE CAST(json_extract_string(body, '$.ms') AS DOUBLE) > 900""",
)
def slow_requests(spark, d):
    return agg.slow_requests(rich_logs(spark, d), 900)


@check(
    "error_share",
    f"""{WITH} SELECT service, count(*) FILTER (level = 'error') AS errors, count(*) AS total,
          count(*) FILTER (level = 'error') / count(*)::DOUBLE AS share FROM logs GROUP BY service""",
)
def error_share(spark, d):
    return agg.error_share(logs(spark, d))


def _usage(spark, d):
    rows = logs(spark, d).withColumn("project_id", F.coalesce("service", F.lit("none")))
    return agg.usage_by_month(rows, F.octet_length("body"))


USAGE_SQL = f"""{WITH}, u AS (SELECT coalesce(service, 'none') AS project_id,
    strftime(received_at, '%Y-%m') AS month, CAST(sum(strlen(body)) AS BIGINT) AS bytes,
    count(*) AS lines FROM logs GROUP BY 1, 2)"""


@check("usage_month", f"{USAGE_SQL} SELECT * FROM u")
def usage_month(spark, d):
    return _usage(spark, d)


PLAN_SQL = """plans AS (SELECT 'svc' || n_nationkey AS project_id,
    CAST(500 * n_nationkey AS BIGINT) AS max_bytes FROM nation)"""


@check(
    "over_quota",
    f"""{USAGE_SQL}, {PLAN_SQL} SELECT u.*, max_bytes, coalesce(bytes > max_bytes, false) AS over_limit
        FROM u LEFT JOIN plans USING (project_id)""",
)
def quota(spark, d):
    plans = table(spark, d, "nation").select(
        F.concat(F.lit("svc"), F.col("n_nationkey").cast("string")).alias("project_id"),
        (F.col("n_nationkey") * 500).cast("bigint").alias("max_bytes"),
    )
    return over_quota(_usage(spark, d), plans)


@check(
    "plan_lookup",
    """SELECT doc_id, lang, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)""",
)
def plan_lookup(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang")
    return with_plan(rows, table(spark, d, "labels"), key="doc_id", spread="doc_id")


@check(
    "deploy_impact",
    f"""{WITH}, c AS (SELECT service,
          count(*) FILTER (received_at < TIMESTAMP '2024-01-15 12:00:00') AS before,
          count(*) FILTER (received_at >= TIMESTAMP '2024-01-15 12:00:00') AS after
        FROM logs WHERE level = 'error' AND received_at >= TIMESTAMP '2024-01-15'
          AND received_at <= TIMESTAMP '2024-01-16' GROUP BY service)
        SELECT *, CASE WHEN before > 0 THEN after / before::DOUBLE END AS ratio FROM c""",
)
def deploy_impact(spark, d):
    return agg.deploy_impact(logs(spark, d), deployed_at="2024-01-15T12:00:00Z", minutes=720)


@check(
    "deploy_histogram",
    f"""{WITH} SELECT {label('5 minutes')} AS bucket, count(*) AS count FROM logs
        WHERE level = 'error' AND received_at >= TIMESTAMP '2024-01-15 06:00:00'
          AND received_at <= TIMESTAMP '2024-01-15 18:00:00' GROUP BY 1""",
)
def deploy_histogram(spark, d):
    return agg.histogram(
        logs(spark, d), "5m", level="error", since="2024-01-15T06:00:00Z", until="2024-01-15T18:00:00Z"
    )


@check(
    "correlate_orders",
    f"""{RICH} SELECT json_extract_string(body, '$.orderId') AS order_id, count(*) AS rows,
          count(*) FILTER (level = 'error') AS left_rows, count(*) FILTER (level = 'warn') AS right_rows,
          min(received_at) FILTER (level = 'error') AS first_left,
          min(received_at) FILTER (level = 'warn') AS first_right,
          count(DISTINCT service) AS services,
          count(*) FILTER (level = 'error') > 0 AND count(*) FILTER (level = 'warn') > 0 AS both
        FROM rich GROUP BY 1""",
)
def correlate_orders(spark, d):
    return correlate(
        rich_logs(spark, d),
        F.get_json_object("body", "$.orderId"),
        F.col("level") == "error",
        F.col("level") == "warn",
        key_name="order_id",
    )


@check(
    "correlate_within",
    f"""{WITH}, l AS (SELECT id, service, received_at AS at FROM logs WHERE level = 'error' AND service IS NOT NULL),
        r AS (SELECT id, service, received_at AS at FROM logs WHERE level = 'warn' AND service IS NOT NULL),
        p AS (SELECT l.service, l.id AS l, r.id AS r, epoch_us(r.at) - epoch_us(l.at) AS lag FROM l JOIN r
          ON l.service = r.service AND r.at > l.at AND r.at <= l.at + INTERVAL 10 MINUTES),
        f AS (SELECT service, count(DISTINCT l) AS left_followed, count(DISTINCT r) AS right_preceded, min(lag) AS lag
          FROM p GROUP BY 1),
        n AS (SELECT service, count(*) FILTER (level = 'error') AS left_rows, count(*) FILTER (level = 'warn') AS right_rows
          FROM logs WHERE level IN ('error', 'warn') AND service IS NOT NULL GROUP BY 1)
        SELECT service, left_rows, right_rows, coalesce(left_followed, 0) AS left_followed,
          coalesce(right_preceded, 0) AS right_preceded, lag / 1000.0::DOUBLE AS shortest_ms
        FROM n LEFT JOIN f USING (service)""",
)
def followed_within(spark, d):
    """Per service, how many errors a warning follows within ten minutes."""
    rows = logs(spark, d)
    return correlate_within(rows, F.col("service"), F.col("level") == "error", F.col("level") == "warn", 600, key_name="service")
