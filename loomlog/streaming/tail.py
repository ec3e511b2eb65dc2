"""Following the stored table as it grows.

A tail follows the commits of write batches, and its cursor is its checkpoint.  A batch is
committed once, and upkeep commits none, so a tail emits every row once, whatever is deleted,
compacted or replayed meanwhile.
"""

from __future__ import annotations

import fnmatch
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomlog.functions.args import page_limit
from loomlog.operators.pages import rows_only
from loomlog.plans.predicates import log_filter
from loomlog.schema import ID_BITS, STORED_LOGS
from loomlog.sinks.exports import write_ndjson
from loomlog.sources.store import COMMITS_DIR, LOGS_DIR, commit_path, commits_from, file_system, read_days, read_note

#: Commits one micro-batch of a tail takes at most, which bounds what the driver reads of them.
COMMITS_PER_BATCH = 1000
#: Seconds between two looks of a waiting reader, at first and at most.
FIRST_WAIT, LONGEST_WAIT = 0.25, 4.0
#: Batches a waiting reader reads at a time.
LOOKED_AT = 64
COMMIT_DDL = "batch BIGINT, first STRING, last STRING"

#: How often an idle tail looks for new rows.
HEARTBEAT = "5 seconds"


def stored_stream(
    spark: SparkSession, root: str, files_per_batch: int | None = None, days: str | None = None
) -> DataFrame:
    """The stored table as a stream of newly written files, for counts that may see a row again.

    It starts with the batches not yet rewritten by upkeep, which it never sees; a batch that
    failed before its commit and is written again comes twice.  Every trigger lists what is watched; ``days``, a pattern such as ``2024-0[3-9]-*``, keeps a
    long history out of that.
    """
    path = f"{root}/{LOGS_DIR}"
    reader = spark.readStream.schema(STORED_LOGS)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if days:
        return reader.option("basePath", path).parquet(f"{path}/dt={days}")
    return reader.parquet(path)


def tail_stream(
    spark: SparkSession,
    root: str,
    out: str,
    checkpoint: str,
    *,
    service: str | None = None,
    level: str | None = None,
    after_id: int | None = None,
    files_per_batch: int | None = None,
    days: str | None = None,
    available_now: bool = False,
) -> StreamingQuery:
    """Write matching rows as NDJSON, first those already stored, then each new one.

    Every micro-batch is one folder, in id order.  A repeated micro-batch replaces its folder.
    ``files_per_batch`` is the number of write batches a micro-batch takes at most.
    """
    folder = f"{root}/{COMMITS_DIR}"
    files, path = file_system(spark, folder)
    files.mkdirs(path)
    commits = (
        spark.readStream.schema(COMMIT_DDL)
        .option("maxFilesPerTrigger", files_per_batch or COMMITS_PER_BATCH)
        .json(folder)
    )

    def emit(batch: DataFrame, batch_id: int) -> None:
        found = batch.collect()  # as many as the option above allows
        if not found:
            return
        # Whole days: a commit names its times in milliseconds, rows may have finer ones.
        rows = read_days(spark, root, min(c["first"] for c in found), max(c["last"] for c in found))
        rows = rows.filter(F.col("batch").isin([c["batch"] for c in found]))
        if days:
            rows = rows.filter(F.col("dt").cast("string").rlike(fnmatch.translate(days)))
        rows = log_filter(rows, service=service, level=level, after_id=after_id)
        write_ndjson(rows_only(rows).orderBy("id"), f"{out}/batch={batch_id:010d}", "overwrite")

    writer = commits.writeStream.foreachBatch(emit).option("checkpointLocation", checkpoint)
    if available_now:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=HEARTBEAT).start()


@dataclass(frozen=True)
class Watched:
    """Rows that came, in id order, and the id to go on from."""

    rows: list[Row]
    last_id: int | None


def watch(
    spark: SparkSession,
    root: str,
    after_id: int | None = None,
    *,
    timeout_seconds: float = 15,
    limit: int | str | None = None,
    **filters,
) -> Watched:
    """Wait until matching rows with larger ids are there, or the time is up.

    Looks again after ever longer pauses.  A look asks for the commits from the cursor's batch on that
    it has not seen, and reads the days of these alone, ``LOOKED_AT`` batches at a time until a page
    is full.  Returns at most a page of rows with the last id among them; where none came, the id it
    was given.
    """
    stop, pause = time.monotonic() + timeout_seconds, FIRST_WAIT
    size, seen = page_limit(limit, 50), set()
    first = 0 if after_id is None else max(after_id, 0) >> ID_BITS
    while True:
        page: list[Row] = []
        new = [batch for batch in commits_from(spark, root, first) if batch not in seen]
        for at in range(0, len(new), LOOKED_AT):
            if len(page) == size:
                break
            page += _rows_of(spark, root, new[at : at + LOOKED_AT], after_id, size - len(page), filters)
        seen.update(new)
        left = stop - time.monotonic()
        if page or left <= 0:
            return Watched(page, page[-1]["id"] if page else after_id)
        time.sleep(min(pause, left))
        pause = min(2 * pause, LONGEST_WAIT)


def _rows_of(spark: SparkSession, root: str, batches: list[int], after_id: int | None, size: int, filters: dict) -> list[Row]:
    """The first matching rows of some batches, in id order."""
    notes = [read_note(spark, commit_path(root, batch)) for batch in batches]
    rows = read_days(spark, root, min(n["first"] for n in notes), max(n["last"] for n in notes))
    rows = log_filter(rows.filter(F.col("batch").isin(batches)), after_id=after_id, **filters)
    return rows_only(rows).orderBy("id").limit(size).collect()
