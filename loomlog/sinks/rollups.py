"""Keeping the hourly counts of a store beside its rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomlog.schema import STORED_LOGS
from loomlog.sources.rollups import KEPT_NOTE, READY_NOTE, ROLLUP_DIR, hour_rows, keeps_rollup, rollup_covers
from loomlog.sources.store import DayParts, GENERATIONS_DIR, KEPT_DIR, LOGS_DIR, folders, path_exists, remove, write_note


def write_rollup(rows: DataFrame, root: str, part: str | Column) -> None:
    """Write the counts of a part's rows; repeating it replaces the part on the days it has rows of."""
    part = F.lit(part) if isinstance(part, str) else part
    counts = hour_rows(rows.withColumn("part", part), "dt", "part")
    writer = counts.hint("rebalance", "dt", "part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("dt", "part").parquet(f"{root}/{ROLLUP_DIR}")


def keep_rollup(spark: SparkSession, root: str) -> None:
    """Keep hourly counts of a store from now on, and write those of what it holds already.

    The first note makes writers keep theirs; then all stored rows are counted, one job for the
    batches and one for the generations, and the second note says that readers may rely on them.  A
    run that breaks off is taken up by the next.  Neither upkeep nor a batch may run meanwhile.
    """
    if rollup_covers(spark, root):
        return
    if not keeps_rollup(spark, root):
        write_note(spark, f"{root}/{KEPT_NOTE}", {"rollup": True})
    place = ("received_at", "service", "level", "dt")
    if folders(spark, f"{root}/{LOGS_DIR}"):
        rows = spark.read.schema(STORED_LOGS).parquet(f"{root}/{LOGS_DIR}")
        write_rollup(rows.select(*place, "batch"), root, F.concat(F.lit("b"), "batch"))
    if path_exists(spark, f"{root}/{GENERATIONS_DIR}") and folders(spark, f"{root}/{KEPT_DIR}"):
        kept = T.StructType([f for f in STORED_LOGS.fields if f.name != "batch"] + [T.StructField("gen", T.LongType())])
        rows = spark.read.schema(kept).parquet(f"{root}/{KEPT_DIR}")
        write_rollup(rows.select(*place, "gen"), root, F.concat(F.lit("g"), "gen"))
    write_note(spark, f"{root}/{READY_NOTE}", {"covered": True})


def drop_dead_counts(spark: SparkSession, root: str, days: dict[str, DayParts]) -> None:
    """Remove the counts of replaced folders."""
    if not keeps_rollup(spark, root):
        return
    for day, parts in days.items():
        for name in [f"b{b}" for b in parts["batches"]] + [f"g{g}" for g in parts["kept"]]:
            remove(spark, f"{root}/{ROLLUP_DIR}/dt={day}/part={name}")
