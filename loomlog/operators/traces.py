"""Trace timelines, latest rows, and correlation over a shared key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ids per block.  Ids are unique, so a (trace, block) group can never hold more rows.
BLOCK_IDS = 1 << 20

#: Time per block of a correlation within a distance; a block holds at most one mark per instant.
BLOCK_SECONDS = 900.0


def trace_gaps(df: DataFrame, block: int = BLOCK_IDS) -> DataFrame:
    """Each row of a trace with the time since the row before it, in id order.

    A plain ``lag`` per trace would put a huge trace into one task.  Here the window runs per
    trace and block of ids, whose size is bounded; only the first row of each block takes its
    predecessor from a summary holding one row per trace and block.
    """
    steps = df.filter(F.col("trace_id").isNotNull()).select(
        "trace_id",
        "id",
        "received_at",
        "service",
        F.floor(F.col("id") / F.lit(block)).alias("_block"),
    )
    inside = Window.partitionBy("trace_id", "_block").orderBy("id")
    lagged = steps.select(
        "*",
        F.lag("received_at").over(inside).alias("_before"),
        F.lag("service").over(inside).alias("_from"),
        F.row_number().over(inside).alias("_n"),
    )
    ends = steps.groupBy("trace_id", "_block").agg(
        F.max_by("received_at", "id").alias("_end_at"),
        F.max_by("service", "id").alias("_end_service"),
    )
    across = Window.partitionBy("trace_id").orderBy("_block")
    carried = ends.select(
        "trace_id",
        "_block",
        F.lag("_end_at").over(across).alias("_carry_at"),
        F.lag("_end_service").over(across).alias("_carry_service"),
    )
    joined = lagged.join(carried, ["trace_id", "_block"], "left")
    leads = F.col("_n") == 1
    before = F.when(leads, F.col("_carry_at")).otherwise(F.col("_before"))
    return joined.select(
        "trace_id",
        "id",
        "received_at",
        "service",
        F.when(leads, F.col("_carry_service")).otherwise(F.col("_from")).alias("from_service"),
        ((F.unix_micros("received_at") - F.unix_micros(before)) / F.lit(1000).cast("bigint")).alias(
            "gap_ms"
        ),
    )


def slowest_steps(df: DataFrame, k: int = 10, block: int = BLOCK_IDS) -> DataFrame:
    """Longest waits between two steps of a trace: where a trace loses its time."""
    return trace_gaps(df, block).orderBy(F.desc("gap_ms"), "id").limit(k)


def latest_per(df: DataFrame, key: str = "service") -> DataFrame:
    """The newest row of each key value, NULL included; ties in time go to the greater id.

    Spark turns the rank filter into a group limit before the shuffle, so every task sends at
    most one row per key value, however many rows the key holds.
    """
    newest_first = Window.partitionBy(key).orderBy(F.desc("received_at"), F.desc("id"))
    return (
        df.withColumn("_n", F.row_number().over(newest_first)).filter(F.col("_n") == 1).drop("_n")
    )


def correlate(
    df: DataFrame,
    shared_key: Column,
    left: Column,
    right: Column,
    *,
    key_name: str = "key",
) -> DataFrame:
    """Per value of a shared key: how often both conditions hold and which came first.

    Grouping with conditional sums answers "does A go with B" without pairing rows, so a key
    that holds a large share of the rows stays one result row.
    """
    return (
        df.select(
            shared_key.alias(key_name),
            "service",
            "received_at",
            F.coalesce(left, F.lit(False)).alias("_l"),
            F.coalesce(right, F.lit(False)).alias("_r"),
        )
        .groupBy(key_name)
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_if(F.col("_l")).alias("left_rows"),
            F.count_if(F.col("_r")).alias("right_rows"),
            F.min(F.when(F.col("_l"), F.col("received_at"))).alias("first_left"),
            F.min(F.when(F.col("_r"), F.col("received_at"))).alias("first_right"),
            F.countDistinct("service").alias("services"),
        )
        .filter(F.col(key_name).isNotNull())
        .withColumn("both", (F.col("left_rows") > 0) & (F.col("right_rows") > 0))
    )


def correlate_within(
    df: DataFrame,
    shared_key: Column,
    left: Column,
    right: Column,
    seconds: float,
    *,
    key_name: str = "key",
    block_seconds: float = BLOCK_SECONDS,
) -> DataFrame:
    """Per value of a shared key: does a ``right`` row follow a ``left`` row within some seconds?

    ``left_followed`` counts left rows with a right row after them and at most ``seconds`` later,
    ``right_preceded`` right rows with such a left row before them, and ``shortest_ms`` is the least
    time between two such rows.  A row of the same instant does not follow.  Rows without a key or a
    receive time take no part, nor do keys without a left or right row.

    No pairs are formed.  Rows of one instant become one mark, map-side; marks are put in order per
    key *and* block of time, so the marks of a hot key go to many tasks, and only the nearest mark
    outside a block comes from a summary holding one row per key and block.
    """
    at = F.unix_micros("received_at")
    marks = (
        df.select(
            shared_key.alias(key_name),
            at.alias("_at"),
            F.coalesce(left, F.lit(False)).alias("_l"),
            F.coalesce(right, F.lit(False)).alias("_r"),
        )
        .filter(F.col(key_name).isNotNull() & F.col("_at").isNotNull() & (F.col("_l") | F.col("_r")))
        .groupBy(key_name, "_at")
        .agg(F.count_if("_l").alias("_lefts"), F.count_if("_r").alias("_rights"))
        .withColumn("_block", F.floor(F.col("_at") / F.lit(int(block_seconds * 1_000_000))))
    )
    left_at, right_at = F.when(F.col("_lefts") > 0, F.col("_at")), F.when(F.col("_rights") > 0, F.col("_at"))
    inside, across = Window.partitionBy(key_name, "_block"), Window.partitionBy(key_name)
    earlier = (Window.unboundedPreceding, -1)
    near = marks.select(
        "*",
        F.max(left_at).over(inside.orderBy("_at").rowsBetween(*earlier)).alias("_left_before"),
        # Turned around, so that the frame grows by one row at a time.
        F.min(right_at).over(inside.orderBy(F.desc("_at")).rowsBetween(*earlier)).alias("_right_after"),
    )
    blocks = marks.groupBy(key_name, "_block").agg(F.max(left_at).alias("_last"), F.min(right_at).alias("_first"))
    outside = blocks.select(
        key_name,
        "_block",
        F.max("_last").over(across.orderBy("_block").rowsBetween(*earlier)).alias("_left_outside"),
        F.min("_first").over(across.orderBy(F.desc("_block")).rowsBetween(*earlier)).alias("_right_outside"),
    )
    lag_left = F.coalesce("_right_after", "_right_outside") - F.col("_at")
    lag_right = F.col("_at") - F.coalesce("_left_before", "_left_outside")
    within = F.lit(int(seconds * 1_000_000))
    followed = (F.col("_lefts") > 0) & (lag_left <= within)
    preceded = (F.col("_rights") > 0) & (lag_right <= within)
    return (
        near.join(outside, [key_name, "_block"])
        .groupBy(key_name)
        .agg(
            F.sum("_lefts").alias("left_rows"),
            F.sum("_rights").alias("right_rows"),
            F.coalesce(F.sum(F.when(followed, F.col("_lefts"))), F.lit(0)).alias("left_followed"),
            F.coalesce(F.sum(F.when(preceded, F.col("_rights"))), F.lit(0)).alias("right_preceded"),
            (F.min(F.when(followed, lag_left)) / F.lit(1000)).alias("shortest_ms"),
        )
    )


def key_trace(df: DataFrame, shared_key: Column, value: str) -> DataFrame:
    """Every row about one key value across services, oldest first."""
    return (
        df.filter(shared_key == value)
        .select("id", "received_at", "service", "level", "body")
        .orderBy("id")
    )
