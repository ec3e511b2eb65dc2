"""Landed files and streams: framing, logger output, continuous ingest, exports, late rows, sessions."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.functions.instants import event_time
from loomlog.functions.jsonbody import parsed
from loomlog.operators.aggregates import count_search
from loomlog.operators.counters import log_counts
from loomlog.operators.retention import kept_rows
from loomlog.operators.tenancy import retention_cutoff
from loomlog.plans.textquery import SearchSyntaxError, parse_search
from loomlog.session import shared_dir
from loomlog.sinks.exports import export_everything
from loomlog.sinks.store import ingest_batch
from loomlog.sources.events import logger_lines, read_lines
from loomlog.sources.store import read_counts, read_logs
from loomlog.streaming.ingest import ingest_stream, json_events, syslog_lines
from loomlog.streaming.late import closed_windows, event_windows_stream, late_rows, sessions
from loomlog.streaming.tail import stored_stream, tail_stream, watch
from suite import check
from suite.sources import KIND, SEVERITY
from suite.sources import syslog_lines as syslog_rows
from suite.storage import STORED_SQL, number, raw_events, stored
from suite.views import DOCS_SQL, LOGS_SQL, docs, events, logs

WITH = f"WITH {LOGS_SQL}"


def folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def landed(spark, lines: DataFrame, column: str) -> str:
    """The folder of text files that hold a column's lines."""
    path = folder(spark, "landed")
    lines.select(F.col(column).alias("value")).write.text(path)
    return path


# Several messages a line, blank ones between, white space of all kinds around.
@check(
    "syslog_frames",
    """SELECT payload, count(*) AS n FROM (
         SELECT '<' || event_id % 192 || '>host app: ' || event_type AS payload FROM events
         UNION ALL SELECT 'again ' || user_id FROM events) GROUP BY payload""",
)
def syslog_frames(spark, d):
    first = F.concat(F.lit("<"), (F.col("event_id") % 192).cast("string"), F.lit(">host app: "), "event_type")
    second = F.concat(F.lit("again "), F.col("user_id").cast("string"))
    line = F.concat(F.lit("\t "), first, F.lit("  ;;  ;;"), second, F.lit("\x0b;;"))
    path = landed(spark, events(spark, d).select(line.alias("line")), "line")
    frames = read_lines(spark, path, line_sep=";;")
    return frames.groupBy("payload").agg(F.count(F.lit(1)).alias("n"))


@check(
    "logger_output",
    """SELECT CASE event_id % 4 WHEN 3 THEN 'malformed json' END AS reason, event_type, count(*) AS lines
       FROM events GROUP BY 1, 2""",
)
def logger_output(spark, d):
    """Newline-delimited logger output: events, and the malformed lines set aside."""
    kind = F.col("event_id") % 4
    text = F.concat(F.lit('{"level":30,"kind":"'), "event_type", F.lit('"}'))
    line = F.when(kind == 3, F.expr("substring(concat('{\"kind\":\"', event_type, '\"'), 1)")).otherwise(text)
    lines = read_lines(spark, landed(spark, events(spark, d).select(line.alias("line")), "line"))
    fine, refused = logger_lines(lines)
    kind_of = F.regexp_extract("payload", '"kind":"(\\w+)"', 1).alias("event_type")
    both = fine.select(F.lit(None).cast("string").alias("reason"), kind_of).union(refused.select("reason", kind_of))
    return both.groupBy("reason", "event_type").agg(F.count(F.lit(1)).alias("lines"))


@check(
    "retention_cutoffs",
    f"""{WITH} SELECT n AS days, (SELECT count(*) FROM logs
          WHERE n <= 0 OR received_at >= TIMESTAMP '2024-01-31 06:30:00' - to_days(n::INT)) AS rows
        FROM (VALUES (-1), (0), (1), (12), (90)) t(n)""",
)
def retention_cutoffs(spark, d):
    """Rows that stay under retentions of so many days; none at 0 and below."""
    rows, found = logs(spark, d), []
    for days in (-1, 0, 1, 12, 90):
        cutoff = retention_cutoff("2024-01-31T06:30:00Z", days)
        kept = rows if cutoff is None else kept_rows(rows, before=cutoff)
        found.append(kept.agg(F.lit(days).alias("days"), F.count(F.lit(1)).alias("rows")))
    return reduce(DataFrame.union, found)


# Searches in turn, with the condition on a document's tokens that a readable one stands for.
SEARCHES = (
    ("the", "' the ' IN joined"), ("load-test", None), ("a.b", None), ("the AND", None), ("   ", None), ("the OR OR of", None),
    ('"of the"', "' of the ' IN joined"), ('"load-test"', "' load test ' IN joined"), ("(the", None), ("the) of", None), ("title : the", None),
    ("the" + " of" * 332, "' the ' IN joined AND ' of ' IN joined"), ("the" + " of" * 333, None), ("NEAR(the, x)", None),
)


def _counted(n: int, test: str | None) -> str:
    if test is None:
        return f"SELECT {n} AS search, NULL::BIGINT AS rows"
    return f"SELECT {n}, count(*) FILTER ({' AND '.join(_contains(part) for part in test.split(' AND '))}) FROM spaced"


def _contains(part: str) -> str:
    return f"contains(joined, {part.removesuffix(' IN joined')})"


@check(
    "search_errors",
    f"WITH {DOCS_SQL} " + " UNION ALL ".join(_counted(n, test) for n, (_, test) in reversed(list(enumerate(SEARCHES)))),
)
def search_errors(spark, d):
    """Which searches can be read, and how many documents each of those finds; up to 1000 characters are allowed."""
    rows, found = docs(spark, d), []
    for n, (query, _) in enumerate(SEARCHES):
        try:
            parse_search(query)
        except SearchSyntaxError:
            counted = spark.range(1).select(F.lit(None).cast("long").alias("rows"))
        else:
            counted = count_search(rows, query).withColumnRenamed("count", "rows")
        found.append(counted.select(F.lit(n).alias("search"), "rows"))
    return reduce(DataFrame.union, found)


@check(
    "export_everything",
    f"""{WITH} SELECT id, service, level, body, strftime(received_at, '%Y-%m-%dT%H:%M:%S.%gZ') AS received_at FROM logs
        WHERE level = 'error' AND received_at >= TIMESTAMP '2024-01-03'""",
)
def everything_exported(spark, d):
    """The whole of a filtered export as it is read back, without the cap of a page."""
    path = folder(spark, "export")
    export_everything(logs(spark, d), path, since="2024-01-03", level="error")
    written = "id BIGINT, service STRING, level STRING, body STRING, received_at STRING"
    return spark.read.schema(written).json(path)


@check("stream_subscribe", f"{STORED_SQL} SELECT n, received_at >= TIMESTAMP '2024-01-16' AS later FROM stored WHERE service = 's1'")
def stream_subscribe(spark, d):
    """A follower of one service is told of each write once, in the run after it."""
    root = folder(spark, "store")
    rows, border = raw_events(spark, d), "2024-01-16"
    parts = [rows.filter(F.col("received_at") < border), rows.filter(F.col("received_at") >= border)]
    for batch, part in enumerate(parts):
        ingest_batch(part, root, batch)
        tail_stream(spark, root, f"{root}/told", f"{root}/told-state", service="s1", available_now=True).awaitTermination()
    lines = spark.read.schema("body STRING").json(f"{root}/told/*").withColumn("run", F.expr("regexp_extract(_metadata.file_path, 'batch=(\\\\d+)', 1)"))
    return lines.select(number(), (F.col("run").cast("int") == 1).alias("later"))


@check(
    "watch_after_cursor",
    f"""{STORED_SQL}, late AS (SELECT * FROM stored WHERE service = 's1' AND received_at >= TIMESTAMP '2024-01-16')
        SELECT n, service, false AS echoed FROM late ORDER BY received_at, n LIMIT 50""",
)
def watch_after_cursor(spark, d):
    """What comes after a cursor at the end of the first batch; a look that finds nothing echoes its cursor."""
    root = folder(spark, "store")
    rows, border = raw_events(spark, d), "2024-01-16"
    ingest_batch(rows.filter(F.col("received_at") < border), root, 0)
    cursor = read_logs(spark, root).agg(F.max("id")).first()[0]
    empty = watch(spark, root, cursor, timeout_seconds=0, service="s1")
    ingest_batch(rows.filter(F.col("received_at") >= border), root, 1)
    seen = watch(spark, root, empty.last_id, timeout_seconds=5, service="s1")
    echoed = empty.last_id != cursor or bool(empty.rows)
    found = spark.createDataFrame([(r["service"], r["body"], echoed) for r in seen.rows], "service STRING, body STRING, echoed BOOLEAN")
    return found.select(number(), "service", "echoed")


@check(
    "stream_syslog",
    f"""SELECT CASE {KIND} WHEN 0 THEN CASE WHEN event_id % 2 = 0 THEN NULL ELSE 'app' END WHEN 1 THEN 'cron.d/job' END AS service,
          CASE WHEN {KIND} < 3 THEN {SEVERITY} ELSE 'info' END AS level, count(*) AS rows
        FROM events GROUP BY 1, 2""",
)
def stream_syslog(spark, d):
    """Landed syslog lines, ingested as a stream."""
    root = folder(spark, "store")
    # A message of two lines is two messages when framed by lines, so its line end becomes a blank.
    path = landed(spark, syslog_rows(spark, d).select(F.translate("line", "\n", " ").alias("line"), "event_id").withColumn(
        "line", F.concat("line", F.lit(" "), F.col("event_id").cast("string"))), "line")
    ingest_stream(read_lines(spark, path, streaming=True), root, f"{root}/state", shape=syslog_lines).awaitTermination()
    return read_logs(spark, root).groupBy("service", "level").agg(F.count(F.lit(1)).alias("rows"))


@check(
    "stream_ingest",
    f"""{STORED_SQL} SELECT service, level, count(*) AS count, count(*) AS rows FROM stored GROUP BY 1, 2""",
)
def stream_ingest(spark, d):
    """Landed JSON lines, ingested as a stream in several micro-batches: the counters and the rows."""
    root, path = folder(spark, "store"), folder(spark, "landed")
    raw_events(spark, d).select(F.col("payload").alias("value")).repartition(3).write.text(path)
    stream = read_lines(spark, path, streaming=True, max_files=1)
    ingest_stream(stream, root, f"{root}/state", shape=json_events).awaitTermination()
    rows = read_logs(spark, root).groupBy("service", "level").agg(F.count(F.lit(1)).alias("rows"))
    return log_counts(read_counts(spark, root)).join(rows, ["service", "level"])


# Three landings: the first days, then stragglers of them among later events, then the rest.
LANDING = "CASE WHEN ts < TIMESTAMP '2024-01-12' AND event_id % 5 < 3 THEN 0 WHEN ts < TIMESTAMP '2024-01-20' AND event_id % 5 < 4 THEN 1 ELSE 2 END"
LATE_SQL = f"""WITH e AS (SELECT event_type, ts, {LANDING} AS landing,
      time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS start FROM events),
    m AS (SELECT landing, max(ts) AS top FROM e GROUP BY landing),
    b AS (SELECT l.landing, (SELECT max(top) FROM m WHERE m.landing < l.landing) - INTERVAL 2 DAYS AS border FROM m l),
    j AS (SELECT e.*, coalesce(start + INTERVAL 6 HOURS <= border, false) AS is_late FROM e JOIN b USING (landing))"""


def event_windows(spark, d) -> str:
    """Events landed in three steps, counted by their own time."""
    root, path = folder(spark, "windows"), folder(spark, "landed")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    line = F.concat(F.lit('{"ts":"'), stamp, F.lit('","kind":"'), "event_type", F.lit('"}'))
    rows = events(spark, d).select(line.alias("value"), F.expr(LANDING).alias("landing"))
    for landing in range(3):
        rows.filter(F.col("landing") == landing).select("value").coalesce(1).write.mode("append").text(path)
        lines = read_lines(spark, path, streaming=True)
        timed = lines.select(event_time(parsed(F.col("payload"))).alias("event_time"), F.get_json_object("payload", "$.kind").alias("kind"))
        event_windows_stream(timed, root, f"{root}/state", "6h", lateness_seconds=2 * 86400, by=("kind",)).awaitTermination()
    return root


@check(
    "late_events",
    f"""{LATE_SQL} SELECT strftime(start, '%Y-%m-%dT%H:%M:%SZ') AS bucket, event_type AS kind, count(*) AS count
        FROM j WHERE is_late GROUP BY start, event_type""",
)
def late_events(spark, d):
    """Rows that came after their window had closed, under the window they belong to."""
    return late_rows(spark, event_windows(spark, d), by=("kind",))


@check(
    "event_windows",
    f"""{LATE_SQL} SELECT strftime(start, '%Y-%m-%dT%H:%M:%SZ') AS bucket, event_type AS kind, count(*) AS count
        FROM j WHERE NOT is_late AND start + INTERVAL 6 HOURS <= (SELECT max(ts) FROM e) - INTERVAL 2 DAYS
        GROUP BY start, event_type""",
)
def closed_event_windows(spark, d):
    return closed_windows(spark, event_windows(spark, d), "6h", lateness_seconds=2 * 86400, by=("kind",))


@check(
    "sessions",
    f"""{STORED_SQL}, g AS (SELECT trace_id, received_at, received_at >= lag(received_at) OVER w + INTERVAL 1 DAY AS fresh
          FROM stored WINDOW w AS (PARTITION BY trace_id ORDER BY received_at)),
        s AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY trace_id ORDER BY received_at ROWS UNBOUNDED PRECEDING) AS k FROM g),
        r AS (SELECT trace_id, min(received_at) AS start, max(received_at) + INTERVAL 1 DAY AS "end", count(*) AS count
              FROM s GROUP BY trace_id, k)
        SELECT * FROM r WHERE "end" <= (SELECT max(received_at) FROM stored)""",
)
def trace_sessions(spark, d):
    """Runs of a trace's rows with no pause of a day, as a stream gives them once they are over."""
    root = stored(spark, d)
    found = sessions(stored_stream(spark, root), "1 day")
    query = found.writeStream.format("parquet").outputMode("append").option("path", f"{root}/sessions")
    query.option("checkpointLocation", f"{root}/session-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("trace_id STRING, start TIMESTAMP, end TIMESTAMP, count BIGINT").parquet(f"{root}/sessions")
