"""All-time counters per service and level, kept as append-only deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def count_deltas(written: DataFrame) -> DataFrame:
    """Rows written per service and level; absent values count under the empty string."""
    return written.groupBy(
        F.coalesce("service", F.lit("")).alias("service"),
        F.coalesce("level", F.lit("")).alias("level"),
    ).agg(F.count(F.lit(1)).alias("count"))


def log_counts(deltas: DataFrame) -> DataFrame:
    """Totals of all deltas, largest first.  Deleting rows never lowers them."""
    return (
        deltas.groupBy("service", "level")
        .agg(F.sum("count").alias("count"))
        .orderBy(F.desc("count"), "service", "level")
    )
