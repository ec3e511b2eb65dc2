"""Appending to the stored table, and rewriting parts of it."""

from __future__ import annotations

import time
import uuid
from collections.abc import Mapping
from dataclasses import asdict, dataclass
from datetime import timedelta
from itertools import takewhile

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.functions.instants import When, instant, iso_millis, to_instant
from loomlog.functions.jsonbody import parsed
from loomlog.operators.counters import count_deltas
from loomlog.operators.dedup import WINDOW_SECONDS, content_hash, mark_recent_duplicates
from loomlog.operators.normalize import MAX_WRITE_TASKS, arrival_number, assign_ids, normalize
from loomlog.operators.retention import deletion, excess_cutoff
from loomlog.operators.tenancy import retention_cutoff
from loomlog.schema import LOGS
from loomlog.sinks.postings import drop_dead_postings, write_postings
from loomlog.sinks.rollups import drop_dead_counts, write_rollup
from loomlog.sources.postings import is_indexed
from loomlog.sources.rollups import keeps_rollup
from loomlog.sources.store import (
    COUNTS_DIR,
    FIELDS_KEPT,
    FIELDS_READY,
    FOLDED_DIR,
    GENERATIONS_DIR,
    KEPT_DIR,
    LOGS_DIR,
    QUARANTINE_DIR,
    SNAPSHOT,
    TOKENS_DIR,
    commit_path,
    commits_from,
    day_parts,
    folders,
    generations,
    kept_by,
    note_names,
    path_exists,
    project_root,
    read_batch,
    read_counts,
    read_folders,
    read_logs,
    read_note,
    read_parts,
    remove,
    write_note,
)

#: Body bytes one write task handles; it decides how many files a batch gets.  Rows of short bodies
#: take several times as much to sort, and fewer tasks than cores would leave cores idle.
TASK_BYTES = 32 * 1024 * 1024

#: From this many notes of generations on, upkeep folds them into a snapshot.
FOLD_NOTES = 32

WRITTEN, DUPLICATE, OVERSIZED, MALFORMED = "written", "deduplicated", "oversized", "malformed"


@dataclass(frozen=True)
class IngestCounts:
    written: int
    deduplicated: int
    oversized: int
    malformed: int


def measured(events: DataFrame, max_row_bytes: int | Column = 0) -> DataFrame:
    """Normalised events, with ``oversized`` set for those above the limit.

    ``max_row_bytes`` may be a column of a joined plan table; 0 means no limit.
    """
    if "_arrival" not in events.columns:
        events = events.withColumn("_arrival", arrival_number())
    limit = max_row_bytes if isinstance(max_row_bytes, Column) else F.lit(max_row_bytes)
    limit = F.coalesce(limit, F.lit(0))
    return normalize(events).withColumn(
        "oversized", F.col("well_formed") & (limit > 0) & (F.col("bytes") > limit)
    )


def dealt(events: DataFrame) -> DataFrame:
    """Raw events with their arrival numbers, dealt evenly over the cores that parse them.

    A scan has no more tasks with rows than its files have row groups, and parsing costs far more
    than moving a payload.  Numbers are taken on the scan, so a repeated task deals alike.
    """
    if "_arrival" not in events.columns:
        events = events.withColumn("_arrival", arrival_number())
    return events.repartition("_arrival")


def write_tasks(body_bytes: int | None) -> int:
    """Write tasks of a batch: one for every ``TASK_BYTES``, but no more than ids have room for."""
    return min(MAX_WRITE_TASKS, 1 + (body_bytes or 0) // TASK_BYTES)


def classify(
    rows: DataFrame,
    stored: DataFrame | None,
    *,
    seconds: float = WINDOW_SECONDS,
    exclude_received_at: bool = False,
) -> DataFrame:
    """``measured`` rows with their ``outcome``; ``stored`` is None where there is nothing to compare with.

    Copies are recognised by the stored hash, which covers the receive time, so only events
    stamped alike count; ``exclude_received_at`` compares content alone.
    """
    key = "body_hash"
    if stored is None:
        marked = rows.withColumn("is_duplicate", F.lit(False))
    else:
        if exclude_received_at:
            key = "_content"
            unstamped = F.regexp_replace("body", r',?"received_at":"[^"]*"\}$', "}")
            rows = rows.withColumn(key, content_hash(unstamped))
            stored = stored.withColumn(key, content_hash(unstamped))
        marked = mark_recent_duplicates(
            rows, stored.select(key, "received_at"), seconds=seconds, keys=(key,)
        )
    outcome = (
        F.when(~F.col("well_formed"), MALFORMED)
        .when(F.col("oversized"), OVERSIZED)
        .when(F.col("is_duplicate"), DUPLICATE)
        .otherwise(WRITTEN)
    )
    return marked.withColumn("outcome", outcome).drop("oversized", "is_duplicate", "_content")


def outcome_counts(classified: DataFrame) -> DataFrame:
    """Rows per outcome, all outcomes in one row."""
    return classified.agg(
        *[
            F.count_if(F.col("outcome") == name).alias(name)
            for name in (WRITTEN, DUPLICATE, OVERSIZED, MALFORMED)
        ]
    )


def ingest_batch(
    events: DataFrame,
    root: str,
    batch_id: int,
    *,
    max_row_bytes: int | Column = 0,
    seconds: float = WINDOW_SECONDS,
    exclude_received_at: bool = False,
    tasks: int | None = None,
) -> IngestCounts:
    """Normalise, de-duplicate and append one batch of (payload, received_at).

    The batch owns its partitions: a replay after a failure overwrites them and nothing else,
    and the duplicate check never looks at rows of the same batch, so rerunning is harmless.  The
    batch's file in ``commits`` comes last; a replay that finds it changes nothing and returns the
    counts in it, and other events under a number that is taken are an error.
    Only stored days from shortly before the batch on are read.  ``tasks`` is the number of
    write tasks; by default it follows the size of the batch.
    """
    spark = events.sparkSession
    # Parsed once and kept for the passes below; lost blocks are recomputed from the source.
    rows = measured(dealt(events), max_row_bytes).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        counts = rows.agg(
            F.count(F.lit(1)).alias("total"),
            F.sum("bytes").alias("bytes"),
            iso_millis(F.min("received_at")).alias("earliest"),
            iso_millis(F.max("received_at")).alias("latest"),
            F.count_if("oversized").alias(OVERSIZED),
            F.count_if(~F.col("well_formed")).alias(MALFORMED),
            F.sum(F.xxhash64("payload", "received_at").cast("decimal(38,0)")).alias("mark"),
        ).first()
        if not counts["total"]:
            return IngestCounts(0, 0, 0, 0)
        mark = f"{counts['total']}:{counts['mark']}"
        done = read_note(spark, commit_path(root, batch_id))
        if done:
            if done["mark"] != mark:
                raise ValueError(f"batch {batch_id} holds other events already")
            return IngestCounts(**{name: done[name] for name in IngestCounts.__dataclass_fields__})
        since = to_instant(counts["earliest"]) - timedelta(seconds=seconds)
        days = day_parts(spark, root, since)
        stored = read_parts(spark, root, days).filter((F.col("received_at") >= instant(since)) & (F.col("batch") != batch_id)) if days else None
        fresh = classify(
            rows, stored, seconds=seconds, exclude_received_at=exclude_received_at
        ).filter(F.col("outcome") == WRITTEN)
        append_rows(assign_ids(fresh, batch_id, tasks or write_tasks(counts["bytes"])), root, batch_id)
        refused = counts[OVERSIZED] + counts[MALFORMED]
        if refused:
            _own_partition(set_aside(rows), f"{root}/{QUARANTINE_DIR}", batch_id)
    finally:
        rows.unpersist()
    own = read_batch(spark, root, batch_id, counts["earliest"], counts["latest"])
    _own_partition(count_deltas(own), f"{root}/{COUNTS_DIR}", batch_id)
    written = own.count()
    if is_indexed(spark, root):
        write_postings(own, root, f"b{batch_id}")
    if keeps_rollup(spark, root):
        write_rollup(own, root, f"b{batch_id}")
    outcome = IngestCounts(
        written=written,
        deduplicated=counts["total"] - refused - written,
        oversized=counts[OVERSIZED],
        malformed=counts[MALFORMED],
    )
    note = {"batch": batch_id, "first": counts["earliest"], "last": counts["latest"], "mark": mark}
    write_note(spark, commit_path(root, batch_id), note | asdict(outcome))
    return outcome


def set_aside(rows: DataFrame) -> DataFrame:
    """Index, size, payload and reason of the rows that are not stored."""
    index = F.col("index") if "index" in rows.columns else F.col("_arrival")
    return rows.filter(~F.col("well_formed") | F.col("oversized")).select(
        index.cast("bigint").alias("index"),
        F.coalesce("bytes", F.octet_length("payload").cast("bigint")).alias("bytes"),
        "payload",
        F.when(F.col("well_formed"), OVERSIZED).otherwise(MALFORMED).alias("reason"),
    )


def _with_fields(rows: DataFrame, root: str) -> DataFrame:
    """Rows with their bodies as VARIANT too, if the store keeps that; Spark shreds it as it writes."""
    if not path_exists(rows.sparkSession, f"{root}/{FIELDS_KEPT}"):
        return rows
    return rows.withColumn("fields", parsed(F.col("body")))


def _log_writer(rows: DataFrame):
    """The writer of all log files.

    Bloom filters serve lookups by trace, id and hash; rows of a file are in id order, so the
    row-group ranges of id and receive time are narrow.
    """
    return (
        rows.write.mode("overwrite")
        .option("parquet.bloom.filter.enabled#trace_id", "true")
        .option("parquet.bloom.filter.enabled#body_hash", "true")
    )


def append_rows(rows: DataFrame, root: str, batch_id: int) -> None:
    """Write rows as the partitions of one batch."""
    dated = (
        rows.select(*[field.name for field in LOGS.fields])
        .withColumn("dt", F.to_date("received_at"))
        .withColumn("batch", F.lit(batch_id).cast("bigint"))
    )
    dynamic = _log_writer(_with_fields(dated, root)).option("partitionOverwriteMode", "dynamic")
    dynamic.partitionBy("dt", "batch").parquet(f"{root}/{LOGS_DIR}")


def _own_partition(rows: DataFrame, path: str, batch_id: int) -> None:
    """Write rows as one partition; the rebalance keeps its files neither tiny nor huge."""
    (
        rows.withColumn("batch", F.lit(batch_id).cast("bigint"))
        .hint("rebalance")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch")
        .parquet(path)
    )


# --- upkeep -------------------------------------------------------------------------------


def delete_where(
    spark: SparkSession, root: str, before: When | None = None, service: str | None = None, *, grace_seconds: float = 0
) -> int:
    """Delete by time and/or service; returns the number of rows deleted.

    Readers that planned before the deletion need the replaced files: here and in the other upkeep
    they stay for ``grace_seconds`` and go in the first upkeep or :func:`sweep` after that.
    """
    going = deletion(before, service)
    logs = read_logs(spark, root, until=before)
    touched = logs.filter(going)
    return _rewrite(spark, root, touched, ~going, grace_seconds)


def purge_before(spark: SparkSession, root: str, cutoff: When | None, *, grace_seconds: float = 0) -> int:
    """Delete rows older than the cutoff; None keeps everything."""
    return 0 if cutoff is None else delete_where(spark, root, before=cutoff, grace_seconds=grace_seconds)


def purge_projects(
    spark: SparkSession, root: str, retention_days: Mapping[str, int], as_of: When
) -> dict[str, int]:
    """Apply each project's own retention to its tables; returns the rows deleted per project."""
    return {
        project: purge_before(spark, project_root(root, project), retention_cutoff(as_of, days))
        for project, days in retention_days.items()
    }


def purge_excess(spark: SparkSession, root: str, max_rows: int, *, grace_seconds: float = 0) -> int:
    """Delete the rows with the smallest ids until at most ``max_rows`` remain."""
    logs = read_logs(spark, root)
    cutoff = excess_cutoff(logs, max_rows)
    if cutoff is None:
        return 0
    return _rewrite(spark, root, logs.filter(F.col("id") <= cutoff), F.col("id") > cutoff, grace_seconds)


def _rewrite(spark: SparkSession, root: str, going: DataFrame, keep: Column, grace_seconds: float) -> int:
    """Leave out the rows of ``going`` from the days that hold some; returns how many."""
    per_day = going.groupBy("dt").agg(F.count(F.lit(1)).alias("n"))
    touched = {str(row["dt"]): row["n"] for row in per_day.toLocalIterator()}
    _replace_days(spark, root, sorted(touched), F.coalesce(keep, F.lit(True)), grace_seconds)
    return sum(touched.values())


def compact(spark: SparkSession, root: str, day: str, *, grace_seconds: float = 0) -> None:
    """Write a closed day's batches as one folder of well-sized files."""
    _replace_days(spark, root, [day], F.lit(True), grace_seconds)


def keep_fields(spark: SparkSession, root: str) -> None:
    """Keep bodies as shredded VARIANTs beside their text from now on, and add them to what is stored.

    The first note makes writers add the column; the days stored by then are written anew, one
    generation for all, and the second note says that readers may rely on it.  A run that breaks
    off is taken up by the next.
    """
    if path_exists(spark, f"{root}/{FIELDS_READY}"):
        return
    if not path_exists(spark, f"{root}/{FIELDS_KEPT}"):
        write_note(spark, f"{root}/{FIELDS_KEPT}", {"fields": True})
    _replace_days(spark, root, list(day_parts(spark, root)), F.lit(True))
    write_note(spark, f"{root}/{FIELDS_READY}", {"fields": True})


def _replace_days(spark: SparkSession, root: str, days: list[str], keep: Column, grace_seconds: float = 0) -> None:
    """Write the rows of whole days that stay as a new generation, then drop what has been replaced long enough.

    Only these days are read.  Until the generation's note is in place readers see the old
    folders, afterwards the new one; what an interrupted run leaves is removed by the next.  One
    run of upkeep at a time; batches may be appended meanwhile.
    """
    sweep(spark, root, grace_seconds)
    parts = {day: _listed(spark, root, day) for day in days}
    parts = {day: found for day, found in parts.items() if found["batches"] or found["kept"]}
    if not parts:
        return
    gen = 1 + max([int(name[4:]) for name in folders(spark, f"{root}/{KEPT_DIR}")] + [n["gen"] for n in generations(spark, root)], default=0)
    path = f"{root}/{KEPT_DIR}/gen={gen}"
    rows = read_parts(spark, root, parts).filter(keep)
    ordered = _with_fields(rows, root).hint("rebalance", "dt").sortWithinPartitions("dt", "id")
    _log_writer(ordered).partitionBy("dt").parquet(path)
    kept = {name[3:]: True for name in folders(spark, path) if name.startswith("dt=")}
    if is_indexed(spark, root) or keeps_rollup(spark, root):
        stayed = read_folders(spark, f"{root}/{KEPT_DIR}", [f"{path}/dt={day}" for day in kept])
        if is_indexed(spark, root):
            write_postings(stayed, root, f"g{gen}")
        if keeps_rollup(spark, root):
            write_rollup(stayed, root, f"g{gen}")
    write_note(spark, f"{root}/{GENERATIONS_DIR}/{gen:012d}.json", {"gen": gen, "days": parts, "kept": kept, "at": time.time()})
    if grace_seconds <= 0:
        _drop_replaced(spark, root, parts)


def _listed(spark: SparkSession, root: str, day: str) -> dict[str, list[int]]:
    """The folders of a day that count now."""
    found = day_parts(spark, root, day, day).get(day)
    if found is None:
        names = folders(spark, f"{root}/{LOGS_DIR}/dt={day}")
        return {"batches": [int(name[6:]) for name in names if name.startswith("batch=")], "kept": []}
    return found


def _drop_replaced(spark: SparkSession, root: str, days: dict[str, dict[str, list[int]]]) -> None:
    for day, parts in days.items():
        folder = f"{root}/{LOGS_DIR}/dt={day}"
        names, gone = folders(spark, folder), {f"batch={b}" for b in parts["batches"]}
        for path in [folder] if gone.issuperset(names) else [f"{folder}/{name}" for name in gone.intersection(names)]:
            remove(spark, path)
        for gen in parts["kept"]:
            remove(spark, f"{root}/{KEPT_DIR}/gen={gen}/dt={day}")
    drop_dead_counts(spark, root, days)
    drop_dead_postings(
        spark, root, {b for parts in days.values() for b in parts["batches"]}, {g for parts in days.values() for g in parts["kept"]}
    )


def sweep(spark: SparkSession, root: str, grace_seconds: float = 0) -> None:
    """Remove folders replaced ``grace_seconds`` ago or earlier, and generations an interrupted run left without a note.

    Notes that have piled up are folded into a snapshot, so that readers open few files.
    """
    notes, latest = generations(spark, root), time.time() - grace_seconds
    for note in notes:
        if note.get("at", 0) > latest:
            continue
        replaced = {day: p for day, p in note["days"].items() if p["batches"] or p["kept"]}
        _drop_replaced(spark, root, {day: p for day, p in replaced.items() if _left_over(spark, root, day, p)})
    _fold_notes(spark, root, notes, latest)
    known = {f"gen={gen}" for note in notes for gen in (note["gen"], *(kept_by(note, day) for day in note["kept"]))}
    for name in folders(spark, f"{root}/{KEPT_DIR}"):
        if name not in known:
            days = [day[3:] for day in folders(spark, f"{root}/{KEPT_DIR}/{name}") if day.startswith("dt=")]
            drop_dead_counts(spark, root, {day: {"batches": [], "kept": [int(name[4:])]} for day in days})
            remove(spark, f"{root}/{KEPT_DIR}/{name}")
            remove(spark, f"{root}/{TOKENS_DIR}/part=g{name[4:]}")


def _left_over(spark: SparkSession, root: str, day: str, parts: dict[str, list[int]]) -> bool:
    names = set(folders(spark, f"{root}/{LOGS_DIR}/dt={day}"))
    kept = (f"{root}/{KEPT_DIR}/gen={gen}/dt={day}" for gen in parts["kept"])
    return any(f"batch={b}" in names for b in parts["batches"]) or any(path_exists(spark, path) for path in kept)


def _fold_notes(spark: SparkSession, root: str, notes: list[dict], latest: float) -> None:
    """Put the notes up to ``latest``, whose replaced folders are gone, into one snapshot.

    It names each day's generation, and of the replaced batches only those without a commit: a replay
    may write these once more.  Its size follows the days that upkeep has changed, not the runs.  The
    notes it covers are removed in a later upkeep, after the same grace.
    """
    folded = note_names(spark, root)[1]
    if notes and notes[0].get("folded_at", latest + 1) <= latest:
        for name in folded:
            remove(spark, f"{root}/{GENERATIONS_DIR}/{name}")
    aged = list(takewhile(lambda note: note.get("at", 0) <= latest, notes))
    if sum("folded_at" not in note for note in aged) < FOLD_NOTES:
        return
    gone = {b for note in aged for parts in note["days"].values() for b in parts["batches"]}
    replayable = gone.difference(commits_from(spark, root, min(gone))) if gone else set()
    days: dict[str, dict[str, list[int]]] = {}
    kept: dict[str, int | None] = {}
    for note in aged:
        for day, parts in note["days"].items():
            found = days.setdefault(day, {"batches": [], "kept": []})["batches"]
            found.extend(replayable.intersection(parts["batches"]))
            kept[day] = kept_by(note, day)
    last = aged[-1]
    snapshot = {"gen": last["gen"], "days": days, "kept": kept, "at": last.get("at", 0), "folded_at": time.time()}
    write_note(spark, f"{root}/{GENERATIONS_DIR}/{SNAPSHOT}{last['gen']:012d}.json", snapshot)


def fold_counts(spark: SparkSession, root: str, up_to_batch: int) -> None:
    """Fold the counter deltas of finished batches into one sum, so readers open few files.

    The sum lies apart under the last batch it covers, and readers skip the batches it covers,
    so an interrupted run neither loses nor doubles a count.  What it covers is then removed.
    """
    old = read_counts(spark, root).filter(F.col("batch") <= up_to_batch)
    stage = f"{root}/_stage-{uuid.uuid4().hex}"
    old.groupBy("service", "level").agg(F.sum("count").alias("count")).write.parquet(stage)
    _own_partition(spark.read.parquet(stage), f"{root}/{FOLDED_DIR}", up_to_batch)
    remove(spark, stage)
    for name in folders(spark, f"{root}/{COUNTS_DIR}"):
        if name.startswith("batch=") and int(name[6:]) <= up_to_batch:
            remove(spark, f"{root}/{COUNTS_DIR}/{name}")
    for name in folders(spark, f"{root}/{FOLDED_DIR}"):
        if name.startswith("batch=") and int(name[6:]) < up_to_batch:
            remove(spark, f"{root}/{FOLDED_DIR}/{name}")


__all__ = [
    "IngestCounts",
    "append_rows",
    "classify",
    "compact",
    "delete_where",
    "fold_counts",
    "ingest_batch",
    "keep_fields",
    "measured",
    "outcome_counts",
    "purge_before",
    "purge_excess",
    "purge_projects",
    "set_aside",
    "sweep",
]
