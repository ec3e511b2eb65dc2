"""Project plans: size limits, retention and quotas looked up per project."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.functions.instants import When, instant, to_instant
from loomlog.plans.skew import small_or_spread_join


def with_plan(
    df: DataFrame, plans: DataFrame, *, key: str = "project_id", spread: str = "id"
) -> DataFrame:
    """Add the plan columns of each row's project.

    The plan table is broadcast only while the optimizer's estimate is below the session's
    threshold; beyond it the join shuffles and spreads projects that hold many rows.
    """
    return small_or_spread_join(df, plans, [key], F.col(spread))


def retained(
    df: DataFrame,
    plans: DataFrame,
    as_of: When,
    *,
    key: str = "project_id",
    spread: str = "id",
) -> DataFrame:
    """Rows still within their project's ``retention_days``; no plan or 0 days keeps all."""
    joined = with_plan(df, plans.select(key, "retention_days"), key=key, spread=spread)
    days = F.col("retention_days")
    age_limit = instant(as_of) - F.make_dt_interval(days=days.cast("int"))
    keep = days.isNull() | (days <= 0) | (F.col("received_at") >= age_limit)
    return joined.filter(keep).drop("retention_days")


def over_quota(usage: DataFrame, plans: DataFrame, *, key: str = "project_id") -> DataFrame:
    """Monthly usage with a flag where the project's ``max_bytes`` is passed.

    ``usage`` has one row per project and month already, so no project dominates this join.
    """
    joined = usage.join(plans.select(key, "max_bytes"), key, "left")
    passed = F.coalesce(F.col("bytes") > F.col("max_bytes"), F.lit(False))
    return joined.withColumn("over_limit", passed)


def too_large(bytes_column: str = "bytes", limit_column: str = "max_row_bytes"):
    """True where a row is larger than its plan allows; a limit of 0 or none means no limit."""
    limit = F.coalesce(F.col(limit_column), F.lit(0))
    return (limit > 0) & (F.col(bytes_column) > limit)


def retention_cutoff(as_of: When, days: int):
    """The moment before which rows expire, or None where retention is switched off."""
    return None if days <= 0 else to_instant(as_of) - timedelta(days=days)
