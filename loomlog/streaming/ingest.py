"""Continuous ingest: lines or records in, rows of the stored table out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomlog.sinks.store import ingest_batch
from loomlog.sources.events import explode_records
from loomlog.sources.syslog import syslog_events

Shape = Callable[[DataFrame], DataFrame]


def json_events(lines: DataFrame) -> DataFrame:
    """Records holding one event or an array of events; the others end up in quarantine."""
    return explode_records(lines).drop("problem")


def logger_events(lines: DataFrame) -> DataFrame:
    """Newline-delimited logger output; malformed lines end up in quarantine."""
    return lines


def syslog_lines(lines: DataFrame) -> DataFrame:
    """Syslog lines; the year of a line without one is inferred from its receive time."""
    return syslog_events(lines, as_of=F.col("received_at"))


def ingest_stream(
    lines: DataFrame,
    root: str,
    checkpoint: str,
    *,
    shape: Shape = json_events,
    interval: str | None = None,
    **options,
) -> StreamingQuery:
    """Ingest a stream of (payload, received_at); ``options`` go to ``ingest_batch``.

    Each micro-batch is appended under its own number, which makes a replay overwrite itself.
    Without an ``interval`` everything available is ingested and the query ends.
    """

    def append(batch: DataFrame, batch_id: int) -> None:
        ingest_batch(shape(batch), root, batch_id, **options)

    writer = lines.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return writer.trigger(**trigger).start()
