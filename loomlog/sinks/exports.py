"""NDJSON and CSV exports, oldest first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.functions.args import export_limit
from loomlog.functions.instants import When, iso_millis
from loomlog.operators.pages import oldest_by_id, rows_only
from loomlog.plans.predicates import log_filter

# CSV columns, and the first characters a spreadsheet would take for a formula.
CSV_COLUMNS = ("id", "received_at", "service", "level", "body")
FORMULA_START = r"^[=+\-@\t]"


def formula_safe(column: Column) -> Column:
    """Prefix text that a spreadsheet would evaluate with an apostrophe."""
    return F.when(column.rlike(FORMULA_START), F.concat(F.lit("'"), column)).otherwise(column)


def export_page(df: DataFrame, limit: int | str | None = None, **filters) -> DataFrame:
    """Filtered rows in id order, at most 10 000."""
    return oldest_by_id(log_filter(df, **filters), export_limit(limit))


def csv_columns(rows: DataFrame) -> DataFrame:
    """The CSV columns as text, guarded against formulas.  There is no trace id in a CSV."""
    text = {"received_at": iso_millis(F.col("received_at"))}
    return rows.select(
        "id",
        *[
            formula_safe(F.coalesce(text.get(name, F.col(name)), F.lit(""))).alias(name)
            for name in CSV_COLUMNS[1:]
        ],
    )


def write_csv(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header in every part file; quotes are doubled, nothing is trimmed."""
    (
        csv_columns(rows)
        .write.mode(mode)
        .options(
            header=True,
            quote='"',
            escape='"',
            emptyValue="",
            nullValue="",
            ignoreLeadingWhiteSpace=False,
            ignoreTrailingWhiteSpace=False,
        )
        .csv(path)
    )


def write_ndjson(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per row; NULLs are written out."""
    (
        rows_only(rows)
        .withColumn("received_at", iso_millis(F.col("received_at")))
        .write.mode(mode)
        .option("ignoreNullFields", False)
        .json(path)
    )


def export_csv(df: DataFrame, path: str, limit: int | str | None = None, **filters) -> None:
    """Write one capped CSV page; an empty page is still a file with a header."""
    write_csv(export_page(df, limit, **filters).coalesce(1), path)


def export_ndjson(df: DataFrame, path: str, limit: int | str | None = None, **filters) -> None:
    """Write one capped NDJSON page."""
    write_ndjson(export_page(df, limit, **filters).coalesce(1), path)


def export_everything(
    df: DataFrame,
    path: str,
    format: str = "ndjson",
    since: When | None = None,
    until: When | None = None,
    **filters,
) -> None:
    """Write all matching rows as one distributed job.

    Part files follow each other in id order: rows are range-partitioned, not funnelled
    through one task or fetched page by page.
    """
    rows = rows_only(log_filter(df, since=since, until=until, **filters)).orderBy("id")
    {"ndjson": write_ndjson, "csv": write_csv}[format](rows, path)
