"""Counters in the Prometheus text format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: label of a counter without service or level.
UNKNOWN = "unknown"


def label_text(column: Column) -> Column:
    """Escape backslash, quote and newline of a label value."""
    escaped = F.replace(column, F.lit("\\"), F.lit("\\\\"))
    escaped = F.replace(escaped, F.lit('"'), F.lit('\\"'))
    return F.replace(escaped, F.lit("\n"), F.lit("\\n"))


def prometheus_lines(counts: DataFrame, metric: str = "logs_total") -> DataFrame:
    """One exposition line per counter."""

    def label(name: str) -> Column:
        return label_text(F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit(UNKNOWN)))

    return counts.select(
        F.format_string(
            metric + '{service="%s",level="%s"} %d', label("service"), label("level"), "count"
        ).alias("value")
    )


def write_prometheus(counts: DataFrame, path: str, metric: str = "logs_total") -> None:
    """Write help, type and counter lines as one text file.

    There is one line per service and level, so a single task is enough.
    """
    spark = counts.sparkSession
    head = spark.createDataFrame(
        [
            (f"# HELP {metric} Total log entries by service and level",),
            (f"# TYPE {metric} counter",),
        ],
        "value string",
    ).coalesce(1)
    lines = prometheus_lines(counts, metric)
    head.unionByName(lines).coalesce(1).write.mode("overwrite").text(path)
