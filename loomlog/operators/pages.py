"""Pages of rows: newest first, after a cursor, by trace, by field, by search, by id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.functions.args import export_limit, page_limit
from loomlog.functions.instants import When
from loomlog.functions.jsonbody import compare_field, parsed
from loomlog.plans.predicates import all_of, batch_bound, log_filter
from loomlog.plans.textquery import search_condition
from loomlog.schema import ID_BITS, ROW_COLUMNS


def rows_only(df: DataFrame) -> DataFrame:
    """The columns a page shows."""
    return df.select(*ROW_COLUMNS)


def newest(df: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` newest rows.  Ties in time are broken by id, so a page is repeatable.

    Sort and limit plan as one per-task top-k; only ``limit`` rows per task leave it.
    """
    return rows_only(df).orderBy(F.desc("received_at"), F.desc("id")).limit(limit)


def oldest_by_id(df: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` rows in id order."""
    return rows_only(df).orderBy("id").limit(limit)


def query_logs(
    df: DataFrame,
    *,
    service: str | None = None,
    level: str | None = None,
    since: When | None = None,
    until: When | None = None,
    after_id: int | None = None,
    trace_id: str | None = None,
    limit: int | str | None = None,
) -> DataFrame:
    """Filtered page: newest first, or oldest first once a cursor is given."""
    kept = log_filter(
        df,
        service=service,
        level=level,
        since=since,
        until=until,
        after_id=after_id,
        trace_id=trace_id,
    )
    size = page_limit(limit, 100)
    return newest(kept, size) if after_id is None else oldest_by_id(kept, size)


def search_rows(
    df: DataFrame,
    query: str,
    *,
    service: str | None = None,
    since: When | None = None,
    until: When | None = None,
    after_id: int | None = None,
) -> DataFrame:
    """Every row whose body matches the search; the cheap filters come first."""
    kept = log_filter(df, service=service, since=since, until=until, after_id=after_id)
    return kept.filter(search_condition(query, F.col("body")))


def search_logs(
    df: DataFrame,
    query: str,
    *,
    service: str | None = None,
    since: When | None = None,
    until: When | None = None,
    after_id: int | None = None,
    limit: int | str | None = None,
) -> DataFrame:
    """Search page, in the two orders of ``query_logs``; 500 rows by default."""
    kept = search_rows(df, query, service=service, since=since, until=until, after_id=after_id)
    size = page_limit(limit, 500)
    return newest(kept, size) if after_id is None else oldest_by_id(kept, size)


def get_log(df: DataFrame, log_id: int) -> DataFrame:
    """The row with this id, or no row."""
    bound = batch_bound(df, F.col("batch") == F.lit(log_id >> ID_BITS))
    return rows_only(df.filter(all_of([F.col("id") == F.lit(log_id), *bound])))


def field_rows(
    df: DataFrame,
    field: str,
    op: str,
    value: str | int | float,
    *,
    types: str = "ranked",
    service: str | None = None,
    since: When | None = None,
    until: When | None = None,
) -> DataFrame:
    """Every row whose JSON body field compares true.

    Rows with a column ``fields`` are tested on it, and the bodies are not read; the comparison is
    stated on the column itself, so that the members it names become columns of the scan.
    """
    kept = log_filter(df, service=service, since=since, until=until)
    if "fields" in df.columns:
        return kept.filter(compare_field(F.col("body"), F.col("fields"), field, op, value, types))
    # Bound, so that the branches of the comparison share one parse of the body.
    return kept.filter(
        F.exists(
            F.array(parsed(F.col("body"))),
            lambda variant: compare_field(F.col("body"), variant, field, op, value, types),
        )
    )


def query_field(
    df: DataFrame,
    field: str,
    op: str,
    value: str | int | float,
    *,
    types: str = "ranked",
    service: str | None = None,
    since: When | None = None,
    until: When | None = None,
    limit: int | str | None = None,
) -> DataFrame:
    """Newest rows whose JSON body field compares true."""
    kept = field_rows(
        df, field, op, value, types=types, service=service, since=since, until=until
    )
    return newest(kept, page_limit(limit, 100))


def trace_logs(df: DataFrame, trace_id: str, limit: int | str | None = None) -> DataFrame:
    """Rows of one trace in arrival order."""
    return query_logs(df, trace_id=trace_id, after_id=0, limit=page_limit(limit, 200))


def tail_logs(
    df: DataFrame,
    after_id: int,
    *,
    query: str | None = None,
    service: str | None = None,
    level: str | None = None,
    limit: int | str | None = None,
) -> DataFrame:
    """Rows after a cursor.  With a search the level is not considered."""
    size = page_limit(limit, 50)
    if query:
        return search_logs(df, query, after_id=after_id, service=service, limit=size)
    return query_logs(df, after_id=after_id, service=service, level=level, limit=size)


def tail_cursor(page: DataFrame, after_id: int) -> DataFrame:
    """One row ``last_id``: where the next tail starts; the old cursor if nothing is new."""
    return page.agg(F.coalesce(F.max("id"), F.lit(after_id).cast("bigint")).alias("last_id"))


def bodies(page: DataFrame) -> DataFrame:
    """Only the bodies of a page, order kept."""
    return page.select("body")


def export_logs(
    df: DataFrame,
    *,
    service: str | None = None,
    level: str | None = None,
    since: When | None = None,
    until: When | None = None,
    limit: int | str | None = None,
) -> DataFrame:
    """Bulk read, newest first: 1000 rows by default, 10 000 at most."""
    kept = log_filter(df, service=service, level=level, since=since, until=until)
    return newest(kept, export_limit(limit))
