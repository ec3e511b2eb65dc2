"""One store for many projects: a batch holds the events of all, and upkeep is one job for all.

Rows lie under ``rows/project_id=/dt=/batch=``.  Beside them each batch leaves its part of the catalog
(rows per project and day) and of the usage (bytes sent and rows written per project and month), and
last its commit.  Retention works from the catalog: days that expire as a whole are never read, of the
day a cutoff falls in the rows that stay are written under ``rows_kept/gen=``, and the note of the
generation makes both count at once.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomlog.functions.instants import When, instant, iso_millis, to_instant
from loomlog.operators.dedup import WINDOW_SECONDS, mark_recent_duplicates
from loomlog.operators.normalize import assign_ids
from loomlog.plans.predicates import all_of, time_bounds
from loomlog.schema import LOGS
from loomlog.sinks.store import MALFORMED, OVERSIZED, WRITTEN, IngestCounts, dealt, measured, write_tasks
from loomlog.sources.store import commit_path, file_system, folders, generations, path_exists, project_root, read_note, remove, write_note

ROWS_DIR, KEPT_ROWS_DIR, CATALOG_DIR, USAGE_DIR = "rows", "rows_kept", "catalog", "usage"
RETIRED_DIR, REFUSED_DIR = "retired", "quarantine"

_PLACE = [T.StructField("project_id", T.StringType()), T.StructField("dt", T.DateType())]
ROWS = T.StructType([*LOGS.fields, *_PLACE, T.StructField("batch", T.LongType())])
CATALOG = T.StructType([*_PLACE, T.StructField("rows", T.LongType()), T.StructField("batch", T.LongType())])
USAGE = T.StructType([_PLACE[0], T.StructField("month", T.StringType()), T.StructField("bytes", T.LongType()), T.StructField("lines", T.LongType())])
#: Project days that expired: the rows kept of them, and the last batch they cover.
RETIRED = T.StructType([*_PLACE, T.StructField("kept", T.LongType()), T.StructField("up_to", T.LongType()), T.StructField("gen", T.LongType())])


def _table(spark: SparkSession, root: str, name: str, schema: T.StructType) -> DataFrame:
    path = f"{root}/{name}"
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(path).select(*schema.names)


def _write(rows: DataFrame, path: str, *parts: str) -> None:
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*parts).parquet(path)


def retired_days(spark: SparkSession, root: str) -> DataFrame:
    """(project_id, dt, kept, up_to, gen): the latest retirement of each project day."""
    known = [note["gen"] for note in generations(spark, root)]
    every = _table(spark, root, RETIRED_DIR, RETIRED).filter(F.col("gen").isin(known))
    latest = F.max_by(F.struct("kept", "up_to", "gen"), "gen").alias("r")
    return every.groupBy("project_id", "dt").agg(latest).select("project_id", "dt", "r.*")


def read_projects(
    spark: SparkSession, root: str, project_id: str | None = None, since: When | None = None, until: When | None = None
) -> DataFrame:
    """Rows of all projects, or of one, within inclusive time bounds; other projects and days are not read."""
    if project_id is not None:
        project_root(root, project_id)  # refuses what is no project id
    bounds = [F.col("project_id") == F.lit(project_id)] if project_id is not None else []
    rows, kept = (_table(spark, root, name, ROWS) for name in (ROWS_DIR, KEPT_ROWS_DIR))
    if not generations(spark, root):
        bounds += time_bounds(rows, since, until)
        return rows.filter(all_of(bounds)) if bounds else rows
    bounds += time_bounds(rows, since, until)
    gone = retired_days(spark, root)
    hidden = gone.select("project_id", "dt", "up_to")
    on = [rows[name] == hidden[name] for name in ("project_id", "dt")] + [rows["batch"] <= hidden["up_to"]]
    left = rows.filter(all_of(bounds)).join(hidden, on, "left_anti")
    with_gen = _kept_rows(spark, root).filter(all_of(bounds))
    live = with_gen.join(gone.select("project_id", "dt", "gen"), ["project_id", "dt", "gen"], "left_semi")
    return left.unionByName(live.select(*ROWS.names))


def _kept_rows(spark: SparkSession, root: str) -> DataFrame:
    return _table(spark, root, KEPT_ROWS_DIR, T.StructType([*ROWS.fields, T.StructField("gen", T.LongType())]))


def ingest_projects(
    events: DataFrame, root: str, batch_id: int, *, max_row_bytes: int | Column = 0, seconds: float = WINDOW_SECONDS
) -> IngestCounts:
    """Normalise, de-duplicate and append one batch of (project_id, payload, received_at) of many projects.

    A copy is one of the same project.  Rows, catalog, usage and refused rows are partitions of the
    batch, and its commit comes last: a replay of a committed batch changes nothing, one that broke
    off replaces what it left.  An event without a valid project id is refused with its reason.
    """
    spark = events.sparkSession
    rows = measured(dealt(events), max_row_bytes).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        done = read_note(spark, commit_path(root, batch_id))
        if done:
            return IngestCounts(**{name: done[name] for name in IngestCounts.__dataclass_fields__})
        known = F.coalesce(F.col("project_id").rlike("^[A-Za-z0-9_-]+$"), F.lit(False))
        reason = F.when(~known, "unknown project").when(~F.col("well_formed"), MALFORMED).when(F.col("oversized"), OVERSIZED)
        judged = rows.withColumn("reason", reason)
        counts = judged.agg(
            F.count(F.lit(1)).alias("total"), F.sum("bytes").alias("bytes"),
            iso_millis(F.min("received_at")).alias("first"), iso_millis(F.max("received_at")).alias("last"),
            F.count_if(F.col("reason") == OVERSIZED).alias(OVERSIZED),
            F.count_if(F.col("reason").isin(MALFORMED, "unknown project")).alias(MALFORMED),
        ).first()
        if not counts["total"]:
            return IngestCounts(0, 0, 0, 0)
        since = to_instant(counts["first"]) - timedelta(seconds=seconds)
        stored = read_projects(spark, root, since=since).filter(F.col("batch") != batch_id)
        keys = ("project_id", "body_hash")
        marked = mark_recent_duplicates(judged.filter("reason IS NULL"), stored.select(*keys, "received_at"), seconds=seconds, keys=keys)
        fresh = assign_ids(marked.filter(~F.col("is_duplicate")), batch_id, write_tasks(counts["bytes"]))
        batch = F.lit(batch_id).cast("bigint").alias("batch")
        dated = fresh.select(*LOGS.names, "project_id", F.to_date("received_at").alias("dt"), batch)
        _write(dated.hint("rebalance", "project_id", "dt").sortWithinPartitions("project_id", "dt", "id"), f"{root}/{ROWS_DIR}", "project_id", "dt", "batch")
        own = _own(spark, root, batch_id, counts["first"], counts["last"])
        catalog = own.groupBy("project_id", "dt").agg(F.count(F.lit(1)).alias("rows"))
        _write(catalog.withColumn("batch", batch), f"{root}/{CATALOG_DIR}", "batch")
        month = F.date_format("received_at", "yyyy-MM").alias("month")
        sent = judged.filter(known).groupBy("project_id", month).agg(F.sum(F.octet_length("payload").cast("bigint")).alias("bytes"))
        lines = own.groupBy("project_id", month).agg(F.count(F.lit(1)).alias("lines"))
        usage = sent.join(lines, ["project_id", "month"], "left").withColumn("lines", F.coalesce("lines", F.lit(0)))
        _write(usage.withColumn("batch", batch), f"{root}/{USAGE_DIR}", "batch")
        refused = judged.filter("reason IS NOT NULL").select("project_id", "received_at", "payload", "reason", batch)
        if counts[OVERSIZED] + counts[MALFORMED]:
            _write(refused, f"{root}/{REFUSED_DIR}", "batch")
    finally:
        rows.unpersist()
    written = spark.read.schema(CATALOG).parquet(f"{root}/{CATALOG_DIR}/batch={batch_id}").agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    outcome = IngestCounts(written, counts["total"] - written - counts[OVERSIZED] - counts[MALFORMED], counts[OVERSIZED], counts[MALFORMED])
    note = {"batch": batch_id, "first": counts["first"], "last": counts["last"]}
    write_note(spark, commit_path(root, batch_id), note | {name: getattr(outcome, name) for name in IngestCounts.__dataclass_fields__})
    return outcome


def _own(spark: SparkSession, root: str, batch_id: int, first: str, last: str) -> DataFrame:
    """The rows of one batch, looked for on its days only."""
    days = [F.col("dt").between(F.lit(date.fromisoformat(first[:10])), F.lit(date.fromisoformat(last[:10])))]
    return _table(spark, root, ROWS_DIR, ROWS).filter(all_of([*days, F.col("batch") == batch_id]))


def read_usage(spark: SparkSession, root: str) -> DataFrame:
    """(project_id, month, bytes, lines): bytes sent and rows written so far; deletions do not lower them."""
    return _table(spark, root, USAGE_DIR, USAGE).groupBy("project_id", "month").agg(F.sum("bytes").alias("bytes"), F.sum("lines").alias("lines"))


def _expiring(spark: SparkSession, root: str, plans: DataFrame, as_of: When) -> DataFrame:
    """(project_id, dt, rows, cutoff, border) of the project days at or before their project's cutoff."""
    catalog = _table(spark, root, CATALOG_DIR, CATALOG).filter(F.col("batch").isin(_committed(spark, root)) if _committed(spark, root) else F.lit(False))
    held = catalog.groupBy("project_id", "dt").agg(F.sum("rows").alias("rows"), F.max("batch").alias("newest"))
    before = retired_days(spark, root).select("project_id", "dt", "kept", "up_to")
    later = catalog.join(before, ["project_id", "dt"]).filter("batch > up_to").groupBy("project_id", "dt").agg(F.sum("rows").alias("more"))
    now = held.join(before, ["project_id", "dt"], "left").join(later, ["project_id", "dt"], "left")
    rows = F.when(F.col("up_to").isNull(), F.col("rows")).otherwise(F.col("kept") + F.coalesce("more", F.lit(0)))
    cutoff = instant(as_of) - F.make_dt_interval(days=F.col("retention_days").cast("int"))
    limits = plans.filter("retention_days > 0").select("project_id", cutoff.alias("cutoff"))
    due = now.withColumn("rows", rows).filter("rows > 0").join(limits, "project_id").filter(F.col("dt") <= F.to_date("cutoff"))
    return due.select("project_id", "dt", "rows", "cutoff", (F.col("dt") == F.to_date("cutoff")).alias("border"))


def _committed(spark: SparkSession, root: str) -> list[int]:
    path = f"{root}/commits"
    if not path_exists(spark, path):
        return []
    files, hadoop = file_system(spark, path)
    return [int(e.getPath().getName()[:20]) for e in files.listStatus(hadoop) if e.getPath().getName()[:20].isdecimal()]


def border_rows(spark: SparkSession, root: str, due: DataFrame) -> DataFrame:
    """The rows that stay of the days a cutoff falls in; no other day is read.

    There are as many such days as there are different retentions; the driver names them to the scan.
    """
    border = due.filter("border").select("project_id", "dt", "cutoff")
    days = [row["dt"] for row in border.select("dt").distinct().collect()]
    rows = read_projects(spark, root).filter(F.col("dt").isin(days) if days else F.lit(False))
    return rows.join(F.broadcast(border), ["project_id", "dt"]).filter(F.col("received_at") >= F.col("cutoff")).drop("cutoff")


def retention_all(spark: SparkSession, root: str, plans: DataFrame, as_of: When) -> DataFrame:
    """Apply every project's retention at once; returns (project_id, deleted).

    ``plans`` has project_id and retention_days, one row per project; none, or 0 days, keeps all.  The
    catalog says how many rows expire with whole days, so only the days of cutoffs are read and
    written.  Until the generation's note is there readers see the rows as before; a run that
    breaks off changes nothing.  Folders of retired days are removed by :func:`sweep_projects`.
    """
    gen = 1 + max([n["gen"] for n in generations(spark, root)] + [int(f[4:]) for f in folders(spark, f"{root}/{KEPT_ROWS_DIR}")], default=0)
    up_to = max(_committed(spark, root), default=-1)
    path = f"{root}/{RETIRED_DIR}/gen={gen}"
    due = _expiring(spark, root, plans, as_of).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        kept_path = f"{root}/{KEPT_ROWS_DIR}/gen={gen}"
        stays = border_rows(spark, root, due).hint("rebalance", "project_id", "dt").sortWithinPartitions("project_id", "dt", "id")
        stays.write.mode("overwrite").partitionBy("project_id", "dt").parquet(kept_path)
        schema = T.StructType([f for f in ROWS.fields])
        kept = spark.read.schema(schema).parquet(kept_path).groupBy("project_id", "dt").agg(F.count(F.lit(1)).alias("kept"))
        counted = due.join(kept, ["project_id", "dt"], "left").withColumn("kept", F.coalesce("kept", F.lit(0)))
        counted = counted.select("project_id", "dt", "rows", "kept", F.lit(up_to).cast("bigint").alias("up_to"))
        counted.write.mode("overwrite").parquet(path)
    finally:
        due.unpersist()
    write_note(spark, f"{root}/generations/{gen:012d}.json", {"gen": gen})
    result = spark.read.schema("project_id STRING, rows BIGINT, kept BIGINT").parquet(path)
    return result.groupBy("project_id").agg(F.sum(F.col("rows") - F.col("kept")).alias("deleted"))


def sweep_projects(spark: SparkSession, root: str, gen: int | None = None) -> None:
    """Remove the rows of retired days, up to generation ``gen``: call it once no reader that began before
    that generation is still at work.  Generations without a note, left by a run that broke off, go too.
    """
    known = {n["gen"] for n in generations(spark, root)}
    for folder in (KEPT_ROWS_DIR, RETIRED_DIR):
        for name in folders(spark, f"{root}/{folder}"):
            if int(name[4:]) not in known:
                remove(spark, f"{root}/{folder}/{name}")
    for row in retired_days(spark, root).toLocalIterator():
        if gen is not None and row["gen"] > gen:
            continue
        day = f"{root}/{ROWS_DIR}/project_id={row['project_id']}/dt={row['dt']}"
        for name in folders(spark, day):
            if int(name[6:]) <= row["up_to"]:
                remove(spark, f"{day}/{name}")
        for name in folders(spark, f"{root}/{KEPT_ROWS_DIR}"):
            if int(name[4:]) < row["gen"]:
                remove(spark, f"{root}/{KEPT_ROWS_DIR}/{name}/project_id={row['project_id']}/dt={row['dt']}")


__all__ = ["WRITTEN", "border_rows", "ingest_projects", "read_projects", "read_usage", "retention_all", "retired_days", "sweep_projects"]
