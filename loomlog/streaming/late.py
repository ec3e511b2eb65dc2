"""Counts by the events' own time: windows that close, late rows kept apart, and sessions."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomlog.operators.aggregates import bucket_label, bucket_start, bucket_width
from loomlog.sources.store import file_system, path_exists, read_note, write_note

WINDOWS_DIR, LATE_DIR, MARKS_DIR = "windows", "late", "marks"


def _mark_path(root: str, batch_id: int) -> str:
    return f"{root}/{MARKS_DIR}/{batch_id:020d}.json"


def _mark_before(spark: SparkSession, root: str, batch_id: int | None) -> int | None:
    """The greatest event time, in microseconds, of the micro-batches before one (or of all)."""
    path = f"{root}/{MARKS_DIR}"
    if not path_exists(spark, path):
        return None
    files, hadoop = file_system(spark, path)
    names = sorted(e.getPath().getName() for e in files.listStatus(hadoop))
    numbers = [int(name[:20]) for name in names if name[:20].isdecimal()]
    earlier = [n for n in numbers if batch_id is None or n < batch_id]
    return read_note(spark, _mark_path(root, max(earlier)))["max"] if earlier else None


def event_windows_stream(
    rows: DataFrame,
    root: str,
    checkpoint: str,
    bucket: str,
    *,
    lateness_seconds: float,
    time: str = "event_time",
    by: tuple[str, ...] = (),
    interval: str | None = None,
) -> StreamingQuery:
    """Count a stream's rows per window of their own time; rows that come too late are counted apart.

    A window is closed once its end lies ``lateness_seconds`` or more before the greatest time of the
    micro-batches so far.  A row of a closed window, or one without a time, is late: it changes no
    window and is counted under its own window (null without a time) instead of vanishing.  Every
    micro-batch adds its own partial counts and then its mark, so a repeated one replaces itself.
    """
    width = bucket_width(bucket)

    def add(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = _mark_before(spark, root, batch_id)
        kept = batch.select(F.col(time).cast("timestamp").alias("_time"), *by).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            start = bucket_start(F.col("_time"), width)
            closed = F.lit(False) if before is None else (start + width) * 1_000_000 <= F.lit(before - round(lateness_seconds * 1_000_000))
            late = F.col("_time").isNull() | closed
            counts = kept.groupBy(start.alias("start"), late.alias("is_late"), *by).agg(F.count(F.lit(1)).alias("count"))
            for folder, condition in ((WINDOWS_DIR, ~F.col("is_late")), (LATE_DIR, F.col("is_late"))):
                counts.filter(condition).drop("is_late").write.mode("overwrite").parquet(f"{root}/{folder}/batch={batch_id}")
            latest = kept.agg(F.max(F.unix_micros("_time"))).first()[0]
        finally:
            kept.unpersist()
        known = [moment for moment in (before, latest) if moment is not None]
        if known and not path_exists(spark, _mark_path(root, batch_id)):
            write_note(spark, _mark_path(root, batch_id), {"max": max(known)})

    writer = rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return writer.trigger(**({"processingTime": interval} if interval else {"availableNow": True})).start()


def _summed(spark: SparkSession, root: str, folder: str, by: tuple[str, ...]) -> DataFrame:
    columns = ", ".join(["start BIGINT", *[f"{name} STRING" for name in by], "count BIGINT"])
    if not path_exists(spark, f"{root}/{folder}"):
        return spark.createDataFrame([], columns)
    parts = spark.read.schema(columns).parquet(f"{root}/{folder}/batch=*")
    return parts.groupBy("start", *by).agg(F.sum("count").alias("count"))


def closed_windows(
    spark: SparkSession, root: str, bucket: str, *, lateness_seconds: float, by: tuple[str, ...] = ()
) -> DataFrame:
    """(bucket, by, count) of the windows that are closed."""
    latest = _mark_before(spark, root, None)
    summed = _summed(spark, root, WINDOWS_DIR, by)
    border = F.lit((latest or 0) - round(lateness_seconds * 1_000_000))
    final = summed.filter((F.col("start") + bucket_width(bucket)) * 1_000_000 <= border) if latest is not None else summed.limit(0)
    return final.select(bucket_label(F.col("start")).alias("bucket"), *by, "count")


def late_rows(spark: SparkSession, root: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(bucket, by, count) of the rows that came too late, under their own window."""
    return _summed(spark, root, LATE_DIR, by).select(bucket_label(F.col("start")).alias("bucket"), *by, "count")


def sessions(
    rows: DataFrame, gap: str, *, lateness: str = "0 seconds", time: str = "received_at", by: tuple[str, ...] = ("trace_id",)
) -> DataFrame:
    """(by, start, end, count) of runs of rows with no pause as long as ``gap``; final once the watermark has passed."""
    return (
        rows.withWatermark(time, lateness)
        .groupBy(F.session_window(time, gap).alias("session"), *by)
        .agg(F.count(F.lit(1)).alias("count"))
        .select(*by, F.col("session.start").alias("start"), F.col("session.end").alias("end"), "count")
    )
