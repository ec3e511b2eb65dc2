"""Copies of a stream's rows by the exact rule: dropped if one was let through shortly before."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loomlog.operators.dedup import WINDOW_SECONDS

#: State stores that custom state needs.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _LastSeen(StatefulProcessor):
    """Per key the time of the last row let through, in microseconds; a timer clears it."""

    def __init__(self, seconds: float, order: str):
        self.window, self.order = round(seconds * 1_000_000), order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", T.StructType().add("at", "long"))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = sorted(rows, key=lambda row: (row["_at"], row[self.order] is None, row[self.order]))
        known = self.last.get()
        last = known[0] if known else None
        for row in held:
            if last is None or row["_at"] > last + self.window:
                last = row["_at"]
                yield Row(**{name: row[name] for name in row.__fields__ if name != "_at"})
        if not known or last != known[0]:
            self.last.update((last,))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer((last + self.window) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.last.clear()
        yield from ()

    def close(self) -> None:
        pass


def drop_recent_copies(
    rows: DataFrame,
    key: str = "body_hash",
    *,
    seconds: float = WINDOW_SECONDS,
    lateness: str = "1 minute",
    order: str = "id",
) -> DataFrame:
    """Rows of a stream without copies: a row goes if one with its key was let through no earlier than
    ``seconds`` before it.

    Rows of a key are taken in the order of ``received_at``, then ``order``, within a micro-batch.  The
    first step removes copies of the very same receive time, keyed by both, so that a key with half
    of all rows is worked on in many tasks; of what is left a key has one row per receive time, and
    the second step keeps one time per key, cleared by a timer once no row can be near it any more.
    Rows later than ``lateness`` are dropped.  A null key is a key.
    """
    spark = rows.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    first = rows.withWatermark("received_at", lateness).dropDuplicates([key, "received_at"])
    timed = first.withColumn("_at", F.unix_micros("received_at"))
    return timed.groupBy(key).transformWithState(
        _LastSeen(seconds, order), rows.schema, "append", "eventTime", eventTimeColumnName="received_at"
    )
