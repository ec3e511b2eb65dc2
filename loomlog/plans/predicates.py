"""Filter conditions over the log table."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.functions.instants import When, instant, to_instant
from loomlog.schema import ID_BITS


def all_of(conditions: list[Column]) -> Column:
    """AND of the conditions; none at all keeps every row."""
    return reduce(and_, conditions) if conditions else F.lit(True)


def day_bounds(since: When | None = None, until: When | None = None) -> list[Column]:
    """The same bounds on the partition column ``dt``."""
    conditions = []
    if since:
        conditions.append(F.col("dt") >= F.lit(to_instant(since).date()))
    if until:
        conditions.append(F.col("dt") <= F.lit(to_instant(until).date()))
    return conditions


def time_bounds(
    df: DataFrame, since: When | None = None, until: When | None = None
) -> list[Column]:
    """Inclusive receive-time bounds.

    Where the table is partitioned by ``dt`` the bounds are stated on it too, because Spark
    does not derive one from the other; this is what prunes whole days from the scan.
    """
    conditions = []
    if since:
        conditions.append(F.col("received_at") >= instant(since))
    if until:
        conditions.append(F.col("received_at") <= instant(until))
    return conditions + (day_bounds(since, until) if "dt" in df.columns else [])


def batch_bound(df: DataFrame, condition: Column) -> list[Column]:
    """A condition on the batch an id carries, for tables partitioned by it: it prunes batches."""
    return [condition] if {"batch", "dt"}.issubset(df.columns) else []


def log_filter(
    df: DataFrame,
    *,
    service: str | None = None,
    level: str | None = None,
    since: When | None = None,
    until: When | None = None,
    after_id: int | None = None,
    trace_id: str | None = None,
) -> DataFrame:
    """Keep rows meeting every condition given.

    Empty strings mean "no condition"; a cursor of 0 is a real cursor.
    """
    conditions = [
        F.col(name) == F.lit(value)
        for name, value in (("service", service), ("level", level), ("trace_id", trace_id))
        if value
    ]
    conditions += time_bounds(df, since, until)
    if after_id is not None:
        conditions.append(F.col("id") > F.lit(after_id))
        conditions += batch_bound(df, F.col("batch") >= F.lit(after_id >> ID_BITS))
    return df.filter(all_of(conditions)) if conditions else df


def for_project(df: DataFrame, project_id: str | None) -> DataFrame:
    """Rows of one project.  A missing project is an error, never all data."""
    if not project_id:
        raise ValueError("a project id is required")
    return df.filter(F.col("project_id") == F.lit(project_id))
