"""JSON events from text files, and checks on them.

A text source gives one record per line: a JSON object, or an array of objects.  Everything
works on batch and streaming DataFrames alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.functions.jsonbody import array_elements, is_object, opens_with, parsed
from loomlog.functions.text import wide_trim


def read_lines(
    spark: SparkSession,
    path: str | list[str],
    *,
    streaming: bool = False,
    max_files: int | None = None,
    max_bytes: int | None = None,
    line_sep: str | None = None,
) -> DataFrame:
    """Trimmed, non-empty lines of text files as ``payload`` with the file's landing time.

    ``max_files`` and ``max_bytes`` bound one micro-batch of a streaming read.
    """
    reader = spark.readStream if streaming else spark.read
    if line_sep:
        reader = reader.option("lineSep", line_sep)
    if streaming and max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if streaming and max_bytes:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    lines = reader.text(path).select(
        wide_trim(F.col("value")).alias("payload"),
        F.col("_metadata.file_modification_time").alias("received_at"),
    )
    return lines.filter(F.length("payload") > 0)


def explode_records(records: DataFrame, max_rows: int | None = None) -> DataFrame:
    """One row per event: objects as they are, array records element by element.

    ``problem`` names why a record or element is not an event: ``malformed json``,
    ``empty batch``, ``too many rows`` or ``not an object``; it is NULL for events.
    """
    kept = [name for name in records.columns if name != "payload"]
    looked_at = records.select(
        *kept,
        "payload",
        parsed(F.col("payload")).isNotNull().alias("_valid"),
        opens_with(F.col("payload"), "[").alias("_is_array"),
    )
    is_array = F.col("_is_array")
    elements = array_elements(F.col("payload"))
    too_many = F.size(elements) > max_rows if max_rows else F.lit(False)
    whole = F.array(F.col("payload"))
    problem = (
        F.when(~F.col("_valid"), "malformed json")
        .when(is_array & (F.size(elements) == 0), "empty batch")
        .when(is_array & too_many, "too many rows")
    )
    staged = looked_at.select(
        *kept,
        problem.alias("_refused"),
        F.when(problem.isNull() & is_array, elements).otherwise(whole).alias("_items"),
    )
    exploded = staged.select(*kept, "_refused", F.posexplode("_items").alias("index", "payload"))
    fine = is_object(F.col("payload"))
    return exploded.select(
        *kept,
        F.col("index").cast("bigint").alias("index"),
        "payload",
        F.coalesce(F.col("_refused"), F.when(~fine, "not an object")).alias("problem"),
    )


def split_events(exploded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events, and the rows set aside with their reason."""
    events = exploded.filter(F.col("problem").isNull()).drop("problem")
    refused = exploded.filter(F.col("problem").isNotNull()).select(
        "index",
        F.octet_length("payload").cast("bigint").alias("bytes"),
        "payload",
        F.col("problem").alias("reason"),
    )
    return events, refused


def logger_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Newline-delimited logger output: JSON objects, and the malformed lines set aside."""
    fine = is_object(F.col("payload"))
    refused = lines.filter(~fine).select(
        F.lit(None).cast("bigint").alias("index"),
        F.octet_length("payload").cast("bigint").alias("bytes"),
        "payload",
        F.lit("malformed json").alias("reason"),
    )
    return lines.filter(fine), refused


def size_of(body: Column) -> Column:
    """Bytes of the serialised body."""
    return F.octet_length(body).cast("bigint")


def split_oversized(
    df: DataFrame, body: str, max_bytes: int, index: str
) -> tuple[DataFrame, DataFrame]:
    """Rows within the limit, and (index, bytes) of the others; 0 switches the limit off."""
    size = size_of(F.col(body))
    over = (size > max_bytes) if max_bytes > 0 else F.lit(False)
    return df.filter(~over), df.filter(over).select(
        F.col(index).alias("index"), size.alias("bytes")
    )
