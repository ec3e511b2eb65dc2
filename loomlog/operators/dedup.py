"""Recognising events that were stored moments ago."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.functions.jsonbody import minified
from loomlog.plans.skew import lookup_join

# Fixed value: copies arriving within this time of a stored event are dropped.
WINDOW_SECONDS = 5.0


def content_hash(payload: Column) -> Column:
    """Hash of an event without its receive time, for copies that arrive at another moment."""
    return F.sha2(minified(payload), 256)


def mark_recent_duplicates(
    batch: DataFrame,
    stored: DataFrame,
    *,
    seconds: float = WINDOW_SECONDS,
    keys: tuple[str, ...] = ("body_hash",),
    spread: Column | None = None,
) -> DataFrame:
    """Add ``is_duplicate``: the key was stored no earlier than ``seconds`` before the row.

    Only a lower bound applies, so the latest stored time per key decides; the stored side
    shrinks to one row per key before the join, and the join then finds at most one partner.
    Rows of ``batch`` are not compared with each other.
    """
    names = list(keys)
    last_seen = stored.groupBy(*names).agg(F.max("received_at").alias("_last_seen"))
    if spread is None:
        spread = F.col("_arrival") if "_arrival" in batch.columns else F.col("id")
    joined = lookup_join(batch, last_seen, names, spread)
    earliest = F.col("received_at") - F.lit(timedelta(seconds=seconds))
    seen = F.coalesce(F.col("_last_seen") >= earliest, F.lit(False))
    return joined.withColumn("is_duplicate", seen).drop("_last_seen")


def drop_recent_duplicates(
    batch: DataFrame,
    stored: DataFrame,
    *,
    seconds: float = WINDOW_SECONDS,
    keys: tuple[str, ...] = ("body_hash",),
    spread: Column | None = None,
    within_batch: bool = False,
) -> DataFrame:
    """Rows of ``batch`` that are new; ``within_batch`` also keeps one copy of each key."""
    marked = mark_recent_duplicates(batch, stored, seconds=seconds, keys=keys, spread=spread)
    fresh = marked.filter(~F.col("is_duplicate")).drop("is_duplicate")
    return first_of_key(fresh, keys) if within_batch else fresh


def first_of_key(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """One row per key, the first to arrive.

    The order number is reduced map-side to one value per key; rows then join on that unique
    number, so copies of one event never meet in one task.
    """
    number = "_arrival" if "_arrival" in df.columns else "id"
    winners = df.groupBy(*keys).agg(F.min(number).alias(number)).select(number)
    return df.join(winners, number, "left_semi")
