"""Which rows stay when others expire or are deleted (pure operators; the store applies them)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.functions.instants import When, instant

#: Ranges one counting pass divides the ids into; also the rows the driver sees per pass.
RANGES_PER_PASS = 4096
#: Below this many rows the cutoff is read off directly.
DIRECT_ROWS = 4096


def deletion(before: When | None = None, service: str | None = None) -> Column:
    """True for rows to delete: older than ``before`` (strictly) and of ``service``.

    Without any condition every row would go, so that is refused.
    """
    if not before and not service:
        raise ValueError("at least one of before and service is required")
    condition = F.lit(True)
    if before:
        condition = condition & (F.col("received_at") < instant(before))
    if service:
        condition = condition & (F.col("service") == F.lit(service))
    return F.coalesce(condition, F.lit(False))


def kept_rows(df: DataFrame, before: When | None = None, service: str | None = None) -> DataFrame:
    """Rows that stay; rows without a service are not touched by a service delete."""
    return df.filter(~deletion(before, service))


def deleted_rows(
    df: DataFrame, before: When | None = None, service: str | None = None
) -> DataFrame:
    """Rows that go."""
    return df.filter(deletion(before, service))


def excess_cutoff(df: DataFrame, max_rows: int) -> int | None:
    """The greatest id to delete so that at most ``max_rows`` rows remain; None for no excess.

    The id at that rank is found exactly without sorting the table: each pass counts rows in at
    most ``RANGES_PER_PASS`` equal id ranges (combined map-side) and continues inside the one
    range that holds the rank.  The driver sees only those counts.
    """
    ids = df.select("id")
    low, high, total = ids.agg(F.min("id"), F.max("id"), F.count(F.lit(1))).first()
    rank = total - max(0, max_rows)
    if rank <= 0:
        return None
    if rank == total:
        return high
    inside = total
    while inside > DIRECT_ROWS and high > low:
        width = (high - low) // RANGES_PER_PASS + 1
        counts = (
            ids.filter(F.col("id").between(low, high))
            .groupBy(F.expr(f"(id - {low}) div {width}").alias("range"))
            .agg(F.count(F.lit(1)).alias("n"))
            .collect()
        )
        for number, inside in sorted((row["range"], row["n"]) for row in counts):
            if rank <= inside:
                break
            rank -= inside
        low, high = low + number * width, min(high, low + (number + 1) * width - 1)
    last = ids.filter(F.col("id").between(low, high)).orderBy("id").limit(rank)
    return last.agg(F.max("id")).first()[0]


def newest_rows(df: DataFrame, max_rows: int) -> DataFrame:
    """The ``max_rows`` rows with the greatest ids."""
    cutoff = excess_cutoff(df, max_rows)
    return df if cutoff is None else df.filter(F.col("id") > cutoff)
