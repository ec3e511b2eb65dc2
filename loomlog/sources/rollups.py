"""Exact counts per hour, service and level, kept beside a store's rows.

They lie under ``rollup/dt=/part=``.  A part is what one write made: ``b`` and the number of a write
batch, or ``g`` and the number of a generation.  A part counts where the rows of that day and write
do, which the store's day folders tell, so that deletions and compaction are followed at once.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.functions.instants import When, instant, to_instant
from loomlog.plans.predicates import all_of
from loomlog.schema import ROLLUP
from loomlog.sources.store import day_parts, folders, path_exists, read_folders, read_logs

ROLLUP_DIR = "rollup"
#: Notes of a roll-up: that it is kept, and that it covers everything stored.
KEPT_NOTE, READY_NOTE = f"{ROLLUP_DIR}_state/kept.json", f"{ROLLUP_DIR}_state/ready.json"

HOUR = timedelta(hours=1)


def keeps_rollup(spark: SparkSession, root: str) -> bool:
    """Whether writers of this store keep a roll-up."""
    return path_exists(spark, f"{root}/{KEPT_NOTE}")


def rollup_covers(spark: SparkSession, root: str) -> bool:
    """Whether the roll-up covers every stored row."""
    return path_exists(spark, f"{root}/{READY_NOTE}")


def read_rollup(spark: SparkSession, root: str, since: When | None = None, until: When | None = None) -> DataFrame:
    """The counts (hour, service, level, count, dt, part) of the days within the bounds, of parts that count.

    Only these days' folders are listed.  An hour can have one row per part.
    """
    base = f"{root}/{ROLLUP_DIR}"
    days = day_parts(spark, root, since, until)
    known = set(folders(spark, base)) if days else set()
    whole, some = [], []
    for day, parts in days.items():
        path = f"{base}/dt={day}"
        if f"dt={day}" not in known:
            continue
        if parts is None:
            whole.append(path)
        else:
            live = {f"part=b{b}" for b in parts["batches"]} | {f"part=g{g}" for g in parts["kept"]}
            some += [f"{path}/{name}" for name in folders(spark, path) if name in live]
    # A generation under way may have left counts on days no note speaks of yet.
    untouched = read_folders(spark, base, whole, ROLLUP).filter(F.col("part").startswith("b"))
    return untouched.unionByName(read_folders(spark, base, some, ROLLUP)) if some else untouched


def whole_hours(since: When | None, until: When | None) -> tuple[datetime | None, datetime | None]:
    """The hours that lie within inclusive bounds as a whole: from the first on, before the second."""
    first = last = None
    if since:
        start = to_instant(since)
        floor = start.replace(minute=0, second=0, microsecond=0)
        first = floor if floor == start else floor + HOUR
    if until:
        last = to_instant(until).replace(minute=0, second=0, microsecond=0)
    return first, last


def hour_rows(rows: DataFrame, *by: str) -> DataFrame:
    """Rows counted per hour, service and level; combined map-side."""
    hour = F.date_trunc("hour", "received_at").alias("hour")
    return rows.groupBy(*by, hour, "service", "level").agg(F.count(F.lit(1)).alias("count"))


def hour_counts(spark: SparkSession, root: str, since: When | None = None, until: When | None = None) -> DataFrame:
    """Exact counts (hour, service, level, count) within inclusive bounds; an hour can have several rows.

    Hours that lie inside come from the roll-up, the rows before the first and from the last one on
    from the stored rows of those two hours.  Without a roll-up that covers the store, and where no
    hour lies inside, all rows are counted.
    """
    names = ("hour", "service", "level", "count")
    first, last = whole_hours(since, until)
    if not rollup_covers(spark, root) or (first and last and first >= last):
        return hour_rows(read_logs(spark, root, since, until))
    inside = []
    if first:
        inside.append(F.col("hour") >= instant(first))
    if last:
        inside.append(F.col("hour") < instant(last))
    counts = read_rollup(spark, root, first, last).filter(all_of(inside)).select(*names)
    if since and to_instant(since) < first:
        before = read_logs(spark, root, since, first).filter(F.col("received_at") < instant(first))
        counts = counts.unionByName(hour_rows(before))
    if until:
        counts = counts.unionByName(hour_rows(read_logs(spark, root, last, until)))
    return counts
