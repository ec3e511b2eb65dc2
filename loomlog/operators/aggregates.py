"""Counts, summaries, histograms and rate checks.

All of these combine map-side before they shuffle, so a service or level that holds a large
share of the rows costs one partial row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.functions.args import whole_number
from loomlog.functions.instants import When, back, instant, to_instant
from loomlog.functions.jsonbody import variant_of
from loomlog.operators.pages import search_rows
from loomlog.plans.predicates import log_filter

# Histogram bucket names and their widths in seconds.
BUCKET_SECONDS = {
    "1m": 60,
    "5m": 300,
    "15m": 900,
    "1h": 3600,
    "6h": 21600,
    "1d": 86400,
}

# Length of the comparison period and the bounds between the rate classes.
BASELINE_DAYS = 7
MILD_FACTOR = 1.5
SIGNIFICANT_FACTOR = 5.0

# Fixed value: text form of a bucket start.
BUCKET_FORMAT = "yyyy-MM-dd'T'HH:mm:ss'Z'"

#: Longest window of the route form; other callers have no bound.
MAX_ALERT_MINUTES = 10_080


def _rows() -> Column:
    return F.count(F.lit(1))


def count_logs(df: DataFrame, **filters) -> DataFrame:
    """Exact number of rows meeting the filters of ``log_filter``."""
    return log_filter(df, **filters).agg(_rows().alias("count"))


def count_search(df: DataFrame, query: str, **filters) -> DataFrame:
    """Exact number of rows matching a search."""
    return search_rows(df, query, **filters).agg(_rows().alias("count"))


def summarize(df: DataFrame, since: When | None = None, until: When | None = None) -> DataFrame:
    """Rows per service and level, largest first; rows without either form their own groups."""
    return (
        log_filter(df, since=since, until=until)
        .groupBy("service", "level")
        .agg(_rows().alias("count"))
        .orderBy(F.desc("count"), "service", "level")
    )


def list_services(df: DataFrame) -> DataFrame:
    """Distinct service names in order."""
    return df.select("service").filter(F.col("service").isNotNull()).distinct().orderBy("service")


def bucket_start(received_at: Column, seconds: int) -> Column:
    """Start of the epoch-aligned interval, in Unix seconds."""
    moment = F.unix_seconds(received_at)
    return moment - F.pmod(moment, F.lit(seconds))


def bucket_label(start: Column) -> Column:
    return F.date_format(F.timestamp_seconds(start), BUCKET_FORMAT)


def bucket_width(bucket: str) -> int:
    if bucket not in BUCKET_SECONDS:
        raise ValueError(f"unknown bucket {bucket!r}; use one of {', '.join(BUCKET_SECONDS)}")
    return BUCKET_SECONDS[bucket]


def histogram(
    df: DataFrame,
    bucket: str,
    *,
    service: str | None = None,
    level: str | None = None,
    since: When | None = None,
    until: When | None = None,
    by: tuple[str, ...] = (),
) -> DataFrame:
    """Rows per time bucket, oldest first; empty buckets are left out.

    Grouping runs on the bucket number; only the few result rows are formatted.
    """
    width = bucket_width(bucket)
    kept = log_filter(df, service=service, level=level, since=since, until=until)
    return (
        kept.groupBy(bucket_start(F.col("received_at"), width).alias("_start"), *by)
        .agg(_rows().alias("count"))
        .orderBy("_start", *by)
        .select(bucket_label(F.col("_start")).alias("bucket"), *by, "count")
    )


def recent_histogram(
    df: DataFrame,
    bucket: str,
    *,
    as_of: When,
    service: str | None = None,
    level: str | None = None,
    since: When | None = None,
    until: When | None = None,
) -> DataFrame:
    """Histogram of the seven days before ``as_of`` unless ``since`` says otherwise."""
    return histogram(
        df,
        bucket,
        service=service,
        level=level,
        since=since or back(as_of, days=7),
        until=until or as_of,
    )


def alert_count(
    df: DataFrame,
    *,
    as_of: When,
    minutes: int | None = None,
    service: str | None = None,
    level: str | None = "error",
    query: str | None = None,
    max_minutes: int | None = None,
) -> DataFrame:
    """Rows of the last minutes before ``as_of``.  With a search the level is not considered.

    ``max_minutes`` narrows longer windows, as the route form does with ``MAX_ALERT_MINUTES``.
    """
    span = whole_number(minutes, 60)
    span = span if max_minutes is None else min(span, max_minutes)
    bounds = {"since": back(as_of, minutes=span), "until": as_of, "service": service}
    if query:
        return count_search(df, query, **bounds)
    return count_logs(df, level=level, **bounds)


def anomaly(
    df: DataFrame,
    *,
    as_of: When,
    window_minutes: int = 60,
    service: str | None = None,
    level: str | None = "error",
    by: tuple[str, ...] = (),
) -> DataFrame:
    """Rate of the recent window against the rate of the seven days before it.

    One scan: both counts are conditional sums over the same bounded range.  A row exactly on
    the border counts on both sides.  ``factor`` is NULL where it would be infinite.
    """
    border = back(as_of, minutes=window_minutes)
    start = back(border, days=BASELINE_DAYS)
    kept = log_filter(df, service=service, level=level, since=start, until=as_of)
    at = F.col("received_at")
    counts = kept.groupBy(*by).agg(
        F.count_if(at >= instant(border)).alias("recent_count"),
        F.count_if(at <= instant(border)).alias("baseline_count"),
    )
    return rate_classes(counts, window_minutes, by)


def rate_classes(counts: DataFrame, window_minutes: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Rates, their factor and its class from ``recent_count`` and ``baseline_count``."""
    recent, baseline = F.col("recent_count"), F.col("baseline_count")
    rated = counts.select(
        *by,
        recent,
        baseline,
        (recent / F.lit(float(window_minutes))).alias("recent_rate"),
        (baseline / F.lit(float(BASELINE_DAYS * 24 * 60))).alias("baseline_rate"),
    )
    factor = F.when(baseline > 0, F.col("recent_rate") / F.col("baseline_rate")).when(
        recent == 0, F.lit(1.0)
    )
    return rated.withColumn("factor", factor).select(
        *by,
        "recent_count",
        "baseline_count",
        "recent_rate",
        "baseline_rate",
        (F.col("baseline_rate") * F.lit(float(window_minutes))).alias("expected"),
        "factor",
        F.when(F.col("factor") < MILD_FACTOR, "normal")
        .when(F.col("factor") < SIGNIFICANT_FACTOR, "mild")
        .otherwise("significant")
        .alias("class"),
    )


def errors_per_hour(df: DataFrame, level: str = "error") -> DataFrame:
    """Rows of one level per service and hour, newest hour first."""
    return (
        df.filter(F.col("level") == level)
        .groupBy("service", bucket_start(F.col("received_at"), 3600).alias("_start"))
        .agg(_rows().alias("errors"))
        .orderBy(F.desc("_start"), "service")
        .select("service", bucket_label(F.col("_start")).alias("hour"), "errors")
    )


def top_messages(
    df: DataFrame, k: int = 10, level: str = "error", field: str = "$.message"
) -> DataFrame:
    """The ``k`` most frequent messages of one level."""
    return (
        df.filter(F.col("level") == level)
        .groupBy(F.get_json_object("body", field).alias("msg"))
        .agg(_rows().alias("n"))
        .orderBy(F.desc("n"), "msg")
        .limit(k)
    )


def latency_by_service(df: DataFrame, field: str = "ms", accuracy: int = 10_000) -> DataFrame:
    """Requests, greatest latency and 95th percentile per service.

    The percentile is a mergeable sketch, so no group is collected.  Rows without a latency are
    skipped by the aggregates themselves, which spares a second look into every body.
    """
    latency = F.try_variant_get(variant_of(df), f"$.{field}", "double")
    return (
        df.select("service", latency.alias("_ms"))
        .groupBy("service")
        .agg(
            F.count("_ms").alias("requests"),
            F.max("_ms").alias("max_ms"),
            F.percentile_approx("_ms", 0.95, accuracy).alias("p95_ms"),
        )
        .filter(F.col("requests") > 0)
        .orderBy(F.desc("max_ms"), "service")
    )


def trace_services(df: DataFrame, trace_id: str) -> DataFrame:
    """Distinct services that took part in one trace."""
    return df.filter(F.col("trace_id") == trace_id).select("service").distinct()


def slow_requests(df: DataFrame, floor_ms: float, field: str = "ms") -> DataFrame:
    """Requests slower than the floor, slowest first."""

    def measured(variant: Column) -> Column:
        return F.try_variant_get(variant, f"$.{field}", "double")

    # The test binds the parsed body, so that a row is parsed once, and again only if it is kept.
    body = variant_of(df)
    slow = measured(body) > floor_ms if "fields" in df.columns else F.exists(F.array(body), lambda v: measured(v) > floor_ms)
    return (
        df.filter(slow)
        .select("id", "service", measured(body).alias("ms"), "received_at")
        .orderBy(F.desc("ms"), "id")
    )


def error_share(df: DataFrame, level: str = "error") -> DataFrame:
    """Share of one level in the rows of each service, highest first."""
    errors = F.count_if(F.coalesce(F.col("level") == level, F.lit(False)))
    return (
        df.groupBy("service")
        .agg(errors.alias("errors"), _rows().alias("total"))
        .withColumn("share", F.col("errors") / F.col("total"))
        .orderBy(F.desc("share"), "service")
    )


def usage_by_month(df: DataFrame, bytes_of: Column, by: str = "project_id") -> DataFrame:
    """Bytes sent and rows written per project and month."""
    return (
        df.groupBy(by, F.trunc("received_at", "month").alias("_month"))
        .agg(F.sum(bytes_of.cast("bigint")).alias("bytes"), _rows().alias("lines"))
        .select(by, F.date_format("_month", "yyyy-MM").alias("month"), "bytes", "lines")
    )


def deploy_impact(
    df: DataFrame,
    *,
    deployed_at: When,
    minutes: int = 30,
    level: str | None = "error",
    by: tuple[str, ...] = ("service",),
) -> DataFrame:
    """Rows shortly before and after a deployment, and their ratio (NULL without a before)."""
    moment = to_instant(deployed_at)
    kept = log_filter(
        df, level=level, since=back(moment, minutes=minutes), until=back(moment, minutes=-minutes)
    )
    at = F.col("received_at")
    return (
        kept.groupBy(*by)
        .agg(
            F.count_if(at < instant(moment)).alias("before"),
            F.count_if(at >= instant(moment)).alias("after"),
        )
        .withColumn("ratio", F.when(F.col("before") > 0, F.col("after") / F.col("before")))
    )
