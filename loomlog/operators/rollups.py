"""Counts, histograms and rate checks of a stored table from its hourly counts.

Each gives the rows of its namesake over ``read_logs``; of a window only the first and the last hour
are read as rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.functions.instants import When, back
from loomlog.operators.aggregates import BASELINE_DAYS, bucket_label, bucket_start, bucket_width, histogram, rate_classes
from loomlog.plans.predicates import all_of
from loomlog.sources.rollups import hour_counts
from loomlog.sources.store import read_logs


def _counted(
    spark: SparkSession, root: str, service: str | None, level: str | None, since: When | None, until: When | None
) -> DataFrame:
    asked = [F.col(name) == F.lit(value) for name, value in (("service", service), ("level", level)) if value]
    return hour_counts(spark, root, since, until).filter(all_of(asked))


def count_stored(
    spark: SparkSession,
    root: str,
    *,
    service: str | None = None,
    level: str | None = None,
    since: When | None = None,
    until: When | None = None,
) -> DataFrame:
    """``count_logs`` of a stored table."""
    return _counted(spark, root, service, level, since, until).agg(F.coalesce(F.sum("count"), F.lit(0)).alias("count"))


def summarize_stored(spark: SparkSession, root: str, since: When | None = None, until: When | None = None) -> DataFrame:
    """``summarize`` of a stored table."""
    counts = hour_counts(spark, root, since, until).groupBy("service", "level").agg(F.sum("count").alias("count"))
    return counts.orderBy(F.desc("count"), "service", "level")


def histogram_stored(
    spark: SparkSession,
    root: str,
    bucket: str,
    *,
    service: str | None = None,
    level: str | None = None,
    since: When | None = None,
    until: When | None = None,
    by: tuple[str, ...] = (),
) -> DataFrame:
    """``histogram`` of a stored table; buckets below an hour are counted from the rows."""
    width = bucket_width(bucket)
    if width % 3600:
        rows = read_logs(spark, root, since, until)
        return histogram(rows, bucket, service=service, level=level, since=since, until=until, by=by)
    return (
        _counted(spark, root, service, level, since, until)
        .groupBy(bucket_start(F.col("hour"), width).alias("_start"), *by)
        .agg(F.sum("count").alias("count"))
        .orderBy("_start", *by)
        .select(bucket_label(F.col("_start")).alias("bucket"), *by, "count")
    )


def anomaly_stored(
    spark: SparkSession,
    root: str,
    *,
    as_of: When,
    window_minutes: int = 60,
    service: str | None = None,
    level: str | None = "error",
    by: tuple[str, ...] = (),
) -> DataFrame:
    """``anomaly`` of a stored table: seven days of hourly counts, and the rows of the hours at the borders."""
    border = back(as_of, minutes=window_minutes)
    start = back(border, days=BASELINE_DAYS)
    none = F.lit(0).cast("bigint")
    recent = _counted(spark, root, service, level, border, as_of).select(
        *by, F.col("count").alias("recent_count"), none.alias("baseline_count")
    )
    baseline = _counted(spark, root, service, level, start, border).select(
        *by, none.alias("recent_count"), F.col("count").alias("baseline_count")
    )
    sums = [F.coalesce(F.sum(name), none).alias(name) for name in ("recent_count", "baseline_count")]
    return rate_classes(recent.unionByName(baseline).groupBy(*by).agg(*sums), window_minutes, by)
