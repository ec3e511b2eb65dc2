"""From raw JSON payloads to rows of the log table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.functions.hashing import body_hash
from loomlog.functions.instants import iso_millis
from loomlog.functions.jsonbody import (
    LEVEL_KEYS,
    SERVICE_KEYS,
    TRACE_KEYS,
    first_text,
    lifted_members,
    minified,
    parsed,
    splice,
    without_members,
)

# An id is batch | partition | row, most significant first; all three fit a positive LONG.
PARTITION_BITS = 14
ROW_BITS = 26
MAX_WRITE_TASKS = 1 << PARTITION_BITS


def normalize(events: DataFrame) -> DataFrame:
    """Lift the envelope out of ``payload`` and stamp, measure and hash the body.

    Columns of ``events`` other than ``payload`` are kept.  The steps are separate projections
    so that each parse happens once per row.  The body is the payload without insignificant
    white space and with its receive time as last member; it is NULL for anything but an object.
    """
    kept = [name for name in events.columns if name != "payload"]
    payload, flat = F.col("payload"), F.col("_flat")
    read = events.select(
        *kept,
        "payload",
        lifted_members(payload).alias("_members"),
        F.when(parsed(payload).isNotNull(), minified(payload)).alias("_flat"),
    )
    members = F.col("_members")
    lifted = read.select(
        *kept,
        "payload",
        first_text(members, SERVICE_KEYS).alias("service"),
        first_text(members, LEVEL_KEYS).alias("level"),
        first_text(members, TRACE_KEYS).alias("trace_id"),
        F.when(flat.startswith("{"), without_members(flat, ("received_at",))).alias("_flat"),
    )
    stamp = F.concat(F.lit('"received_at":"'), iso_millis(F.col("received_at")), F.lit('"'))
    stamped = lifted.select(
        *kept, "payload", "service", "level", "trace_id", splice(flat, stamp).alias("body")
    )
    return stamped.select(
        "*",
        F.col("body").isNotNull().alias("well_formed"),
        F.octet_length("body").cast("bigint").alias("bytes"),
        body_hash(F.col("body")).alias("body_hash"),
    )


def arrival_number() -> Column:
    """Position of a raw row in its source.

    Taken directly on the scan, where row order is fixed, so a retried task gives the same
    numbers.  It breaks ties in receive time and spreads identical events over tasks.
    """
    return F.monotonically_increasing_id()


def assign_ids(df: DataFrame, batch_id: int, tasks: int) -> DataFrame:
    """Give rows ids that grow with batch, receive time and arrival.

    Rows are range-partitioned by (receive time, arrival), which is unique, so neither one
    busy moment nor many copies of one event end up in one task.  Ids have gaps.
    """
    if not 0 <= batch_id < 1 << (63 - PARTITION_BITS - ROW_BITS):
        raise ValueError(f"batch id out of range: {batch_id}")
    if not 1 <= tasks <= MAX_WRITE_TASKS:
        raise ValueError(f"a batch has 1 to {MAX_WRITE_TASKS} write tasks, not {tasks}")
    ordered = df.repartitionByRange(tasks, "received_at", "_arrival").sortWithinPartitions(
        "received_at", "_arrival"
    )
    number = F.monotonically_increasing_id()
    row = number.bitwiseAND(F.lit((1 << 33) - 1))
    checked = F.when(row < F.lit(1 << ROW_BITS), row).otherwise(
        F.raise_error(F.lit("too many rows in one write task; raise `tasks`")).cast("bigint")
    )
    partition = F.shiftright(number, 33)
    base = F.lit(batch_id << (PARTITION_BITS + ROW_BITS))
    return ordered.withColumn("id", base + F.shiftleft(partition, ROW_BITS) + checked)
