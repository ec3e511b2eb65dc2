"""The test tables seen as log tables: once as DataFrames, once as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Reading ``ts`` as TIMESTAMP at the source keeps time filters in the Parquet scan.
EVENTS_DDL = (
    "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
)

LEVELS = {"error": "error", "purchase": "warn", "view": "debug", "click": "info"}

_CASES = " ".join(f"WHEN '{key}' THEN '{value}'" for key, value in LEVELS.items())

LOGS_SQL = f"""logs AS (
  SELECT event_id AS id, ts AS received_at,
    CASE WHEN user_id % 8 = 7 THEN NULL ELSE 'svc' || (user_id % 8) END AS service,
    CASE event_type {_CASES} END AS level,
    CASE WHEN user_id % 10 = 9 THEN NULL ELSE 'u' || user_id END AS trace_id,
    props AS body
  FROM events)"""

RICH_SQL = f"""{LOGS_SQL}, rich AS (
  SELECT id, received_at, service, level, trace_id,
    '{{"message":"' || event_type || ' k' || json_extract_string(props, '$.k') || '","ms":'
      || (CAST(json_extract_string(props, '$.k') AS BIGINT) * 10 + user_id % 7)
      || ',"orderId":"ord-' || user_id || '"}}' AS body
  FROM logs JOIN events ON id = event_id)"""

DOCS_SQL = """docs AS (
  SELECT doc_id AS id, TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS received_at,
    source AS service, 'info' AS level, lang AS trace_id, text AS body,
    list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^\\p{L}\\p{N}]+'),
                lambda x: x <> '') AS toks
  FROM documents),
  spaced AS (SELECT *, ' ' || array_to_string(toks, ' ') || ' ' AS joined FROM docs)"""

ROW_SQL = "id, received_at, service, level, trace_id, body"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(EVENTS_DDL).parquet(f"{sf_dir}/events.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _level():
    level = F
    for key, value in LEVELS.items():
        level = level.when(F.col("event_type") == key, value)
    return level


def _envelope():
    user = F.col("user_id")
    return [
        F.col("event_id").alias("id"),
        F.col("ts").alias("received_at"),
        F.when(user % 8 != 7, F.concat(F.lit("svc"), (user % 8).cast("string"))).alias("service"),
        _level().alias("level"),
        F.when(user % 10 != 9, F.concat(F.lit("u"), user.cast("string"))).alias("trace_id"),
    ]


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as log rows."""
    return events(spark, sf_dir).select(*_envelope(), F.col("props").alias("body"))


def rich_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log rows whose body has a message, a latency and an order id."""
    k = F.get_json_object("props", "$.k")
    user = F.col("user_id")
    body = F.concat(
        F.lit('{"message":"'),
        "event_type",
        F.lit(" k"),
        k,
        F.lit('","ms":'),
        (k.cast("bigint") * 10 + user % 7).cast("string"),
        F.lit(',"orderId":"ord-'),
        user.cast("string"),
        F.lit('"}'),
    )
    return events(spark, sf_dir).select(*_envelope(), body.alias("body"))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table as log rows with prose bodies."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60).alias("received_at"),
        F.col("source").alias("service"),
        F.lit("info").alias("level"),
        F.col("lang").alias("trace_id"),
        F.col("text").alias("body"),
    )
