"""Table schemas.  ``dt`` and ``batch`` are the partition columns of the stored table."""

from __future__ import annotations

from pyspark.sql import types as T

LOGS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("received_at", T.TimestampType()),
        T.StructField("service", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("trace_id", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("body_hash", T.StringType()),
    ]
)

#: Columns every page of rows shows; the hash is internal.
ROW_COLUMNS = ("id", "received_at", "service", "level", "trace_id", "body")

STORED_LOGS = T.StructType(
    LOGS.fields + [T.StructField("dt", T.DateType()), T.StructField("batch", T.LongType())]
)

#: The body as a shredded VARIANT, in stores that keep it.
FIELDS = T.StructField("fields", T.VariantType())

RAW_EVENT = T.StructType(
    [
        T.StructField("project_id", T.StringType()),
        T.StructField("received_at", T.TimestampType()),
        T.StructField("payload", T.StringType()),
    ]
)

DELIVERY = T.StructType(
    [
        T.StructField("provider", T.StringType()),
        T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
        T.StructField("raw", T.BinaryType()),
        T.StructField("received_at", T.TimestampType()),
    ]
)

LOG_COUNTS = T.StructType(
    [
        T.StructField("service", T.StringType(), False),
        T.StructField("level", T.StringType(), False),
        T.StructField("count", T.LongType()),
    ]
)

#: An id is its batch, then this many bits for the place in it.
ID_BITS = 40

COUNT_DELTAS = T.StructType(LOG_COUNTS.fields + [T.StructField("batch", T.LongType())])

TOKENS = T.StructType(
    [
        T.StructField("token", T.StringType()),
        T.StructField("id", T.LongType()),
        T.StructField("dt", T.DateType()),
        T.StructField("bucket", T.IntegerType()),
    ]
)

POSTINGS = T.StructType(
    [
        T.StructField("token", T.StringType()),
        T.StructField("dt", T.DateType()),
        T.StructField("id", T.LongType()),
        T.StructField("part", T.StringType()),
        T.StructField("head", T.IntegerType()),
    ]
)

ROLLUP = T.StructType(
    [
        T.StructField("hour", T.TimestampType()),
        T.StructField("service", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("count", T.LongType()),
        T.StructField("dt", T.DateType()),
        T.StructField("part", T.StringType()),
    ]
)

QUARANTINE = T.StructType(
    [
        T.StructField("index", T.LongType()),
        T.StructField("bytes", T.LongType()),
        T.StructField("payload", T.StringType()),
        T.StructField("reason", T.StringType()),
    ]
)
