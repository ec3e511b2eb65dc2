"""Syslog lines (RFC 5424 and RFC 3164) as event payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.functions.instants import When, instant
from loomlog.functions.jsonbody import json_fields
from loomlog.functions.text import wide_trim

# Severity names 0 to 7, months, and the greatest valid priority.
SEVERITIES = ("emergency", "alert", "critical", "error", "warning", "notice", "info", "debug")
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
MAX_PRIORITY = 191

# The patterns of a priority and of the two header formats.
PRIORITY = r"(?s)^<(\d{1,3})>(.*)"
RFC5424 = r"(?s)^1 (\S+) (\S+) (\S+) (\S+) (\S+) (\S+|(?:\[.*?\])*|-) ?(.*)"
RFC3164 = (
    r"(?s)^([A-Z][a-z]{2})\s+(\d{1,2})\s+(\d{2}:\d{2}:\d{2})\s+(\S+)\s+"
    r"([A-Za-z0-9_/.-]{1,32})(?:\[\d+\])?:\s*(.*)"
)


def _groups(text: Column, pattern: str, references: str, count: int) -> Column:
    """Header fields in one pass: white-space-free groups, then the message, split on newlines."""
    return F.split(F.regexp_replace(text, pattern, references), "\n", count)


def parse_syslog(df: DataFrame, column: str, as_of: When | Column) -> DataFrame:
    """Add level, service, message, facility, severity, hostname, timestamp and raw.

    RFC 3164 has no year.  Counted forward around the year from ``as_of``, months more than six
    ahead belong to the year before; this includes the months just past.
    """
    raw = F.col(column)
    now = as_of if isinstance(as_of, Column) else instant(as_of)
    number = F.regexp_extract(raw, PRIORITY, 1)
    priority = F.when(number != "", number.cast("int"))
    head = df.select(
        "*",
        F.when(priority <= MAX_PRIORITY, priority).alias("_pri"),
        F.regexp_extract(raw, PRIORITY, 2).alias("_rest"),
    )
    pri, rest, modern = F.col("_pri"), F.col("_rest"), F.col("_is_modern")
    legacy = pri.isNotNull() & ~modern & rest.rlike(RFC3164)
    told_apart = head.select("*", (pri.isNotNull() & rest.rlike(RFC5424)).alias("_is_modern"))
    fields = told_apart.select(
        *df.columns,
        "_pri",
        "_rest",
        F.when(modern, _groups(rest, RFC5424, "$1\n$2\n$3\n$7", 4)).alias("_modern"),
        F.when(legacy, _groups(rest, RFC3164, "$1\n$2\n$3\n$4\n$5\n$6", 6)).alias("_legacy"),
    )
    new, old = F.col("_modern"), F.col("_legacy")

    def stated(item: Column) -> Column:
        return F.nullif(item, F.lit("-"))

    months = F.array(*[F.lit(name) for name in MONTHS])
    position = F.array_position(months, old[0])
    month = F.when(position > 0, position).otherwise(F.lit(1)).cast("int")
    ahead = F.pmod(month - F.month(now), F.lit(12))
    year = F.year(now) - F.when(ahead > 6, 1).otherwise(0)
    legacy_time = F.concat(
        year.cast("string"),
        F.lit("-"),
        F.lpad(month.cast("string"), 2, "0"),
        F.lit("-"),
        F.lpad(old[1], 2, "0"),
        F.lit("T"),
        old[2],
    )
    severity = F.pmod(pri, F.lit(8))
    names = F.array(*[F.lit(name) for name in SEVERITIES])
    plain = wide_trim(rest)
    return fields.select(
        *df.columns,
        F.coalesce(F.get(names, severity), F.lit("info")).alias("level"),
        F.coalesce(stated(new[2]), old[4]).alias("service"),
        F.when(pri.isNull(), raw)
        .when(new.isNotNull(), wide_trim(new[3]))
        .when(old.isNotNull(), wide_trim(old[5]))
        .when(plain != "", plain)
        .otherwise(raw)
        .alias("message"),
        F.floor(pri / 8).cast("int").alias("facility"),
        severity.cast("int").alias("severity"),
        F.coalesce(stated(new[1]), old[3]).alias("hostname"),
        F.coalesce(stated(new[0]), legacy_time).alias("timestamp"),
        raw.alias("raw"),
    )


def syslog_payload() -> Column:
    """The parsed columns as one JSON event; absent ones are left out."""
    names = ("level", "service", "message", "facility", "severity", "hostname", "timestamp", "raw")
    return json_fields(**{name: F.col(name) for name in names})


def syslog_events(lines: DataFrame, as_of: When | Column) -> DataFrame:
    """Raw rows whose payload is the parsed line; other columns are kept."""
    kept = [name for name in lines.columns if name != "payload"]
    parsed_lines = parse_syslog(lines.withColumnRenamed("payload", "_line"), "_line", as_of)
    return parsed_lines.select(*kept, syslog_payload().alias("payload"))
