"""Running counters, windowed counts and windowed duplicates of a stream of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.operators.aggregates import BUCKET_FORMAT, bucket_width
from loomlog.operators.counters import count_deltas
from loomlog.operators.dedup import WINDOW_SECONDS


def running_counts(rows: DataFrame) -> DataFrame:
    """Rows per service and level so far; state is one counter per pair."""
    return count_deltas(rows)


def windowed_counts(
    rows: DataFrame,
    bucket: str,
    *,
    lateness: str = "0 seconds",
    time: str = "received_at",
    by: tuple[str, ...] = (),
) -> DataFrame:
    """Rows per time bucket; a bucket is final once the watermark has passed its end.

    Receive times only grow, so they need no lateness; an event time taken from the body does.
    """
    width = bucket_width(bucket)
    return (
        rows.withWatermark(time, lateness)
        .groupBy(F.window(time, f"{width} seconds"), *by)
        .agg(F.count(F.lit(1)).alias("count"))
        .select(F.date_format("window.start", BUCKET_FORMAT).alias("bucket"), *by, "count")
    )


def alerts(
    rows: DataFrame,
    minutes: int,
    threshold: int,
    *,
    level: str = "error",
    lateness: str = "0 seconds",
    by: tuple[str, ...] = ("service",),
) -> DataFrame:
    """Windows of a few minutes in which one level reached the threshold."""
    return (
        rows.filter(F.col("level") == level)
        .withWatermark("received_at", lateness)
        .groupBy(F.window("received_at", f"{minutes} minutes"), *by)
        .agg(F.count(F.lit(1)).alias("count"))
        .filter(F.col("count") >= threshold)
        .select(F.col("window.start").alias("since"), *by, "count")
    )


def drop_copies_in_window(
    rows: DataFrame, seconds: float = WINDOW_SECONDS, key: str = "body_hash"
) -> DataFrame:
    """Drop copies arriving within the window of a first one, with bounded state.

    This removes at least the copies within ``seconds``, and may remove later ones of the same
    micro-batch.  State is kept per key, so all copies of one event meet in one task: where one
    event may dominate a stream, use ingest, whose exact rule spreads such events.
    """
    return rows.withWatermark("received_at", f"{seconds} seconds").dropDuplicatesWithinWatermark(
        [key]
    )
