"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: No task should get more than about this share of the rows for one key.
HEAVY_SHARE = 0.001


def heavy_keys(df: DataFrame, keys: list[str], share: float = HEAVY_SHARE) -> DataFrame:
    """Keys holding more than ``share`` of the rows, and into how many parts to split each.

    Counts are combined map-side, so the shuffle carries one row per key and task; the total is
    the sum of the same counts.  By construction there are fewer than ``1 / share`` such keys,
    and fewer than ``2 / share`` parts in all, whatever the size of ``df``.  NULL keys match
    nothing and are left out.
    """
    matchable = df.filter(reduce(and_, [F.col(key).isNotNull() for key in keys]))
    counts = matchable.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    floor = counts.agg((F.sum("_n") * F.lit(share)).alias("floor")).scalar()
    parts = F.ceil(F.col("_n") / floor).cast("int").alias("_parts")
    return counts.filter(F.col("_n") > floor).select(*keys, parts)


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    keys: list[str],
    spread: Column,
    how: str = "left",
    share: float = HEAVY_SHARE,
) -> DataFrame:
    """Join ``facts`` to ``lookup`` (at most one row per key) without a hot task.

    Rows of a heavy key are split into parts by ``spread``, more parts the heavier the key; the
    lookup row of such a key is repeated once per part.  Every other row joins as usual, so the
    result is that of a plain join.  ``spread`` must differ between rows of one key and be stable
    under retries.  Rows with a NULL key match nothing and are split too.
    """
    heavy = F.broadcast(heavy_keys(facts, keys, share))
    unmatched = reduce(or_, [F.col(key).isNull() for key in keys])
    parts = F.when(unmatched, F.lit(int(1 / share))).otherwise(F.coalesce("_parts", F.lit(1)))
    left = facts.join(heavy, keys, "left").withColumn(
        "_part", F.pmod(F.xxhash64(spread), parts).cast("int")
    )
    every_part = F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)
    right = lookup.join(heavy, keys, "left").withColumn("_part", F.explode(every_part))
    return left.drop("_parts").join(right.drop("_parts"), [*keys, "_part"], how).drop("_part")


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of a DataFrame, in bytes."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    return int(str(stats.sizeInBytes()))


def broadcast_limit(df: DataFrame) -> int:
    """The session's broadcast threshold in bytes; 0 where broadcasting is switched off."""
    conf = df.sparkSession._jsparkSession.sessionState().conf()
    return max(0, int(conf.autoBroadcastJoinThreshold()))


def small_or_spread_join(
    facts: DataFrame, lookup: DataFrame, keys: list[str], spread: Column, how: str = "left"
) -> DataFrame:
    """Broadcast ``lookup`` while its estimate is under the threshold, else spread heavy keys."""
    if plan_bytes(lookup) <= broadcast_limit(lookup):
        return facts.join(F.broadcast(lookup), keys, how)
    return lookup_join(facts, lookup, keys, spread, how)
