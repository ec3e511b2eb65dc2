"""Row pages and the SQL surface."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.operators import pages
from loomlog.operators.sqlsurface import query_sql, refusal
from loomlog.operators.traces import key_trace, latest_per, slowest_steps, trace_gaps
from loomlog.plans.predicates import for_project, log_filter
from loomlog.sinks.exports import csv_columns, export_page
from suite import check
from suite.views import LOGS_SQL, RICH_SQL, ROW_SQL, logs, rich_logs, table

WITH = f"WITH {LOGS_SQL}"
RICH = f"WITH {RICH_SQL}"
NEWEST = "ORDER BY received_at DESC, id DESC"


@check("page_newest", f"{WITH} SELECT {ROW_SQL} FROM logs {NEWEST} LIMIT 100")
def page_newest(spark, d):
    return pages.query_logs(logs(spark, d))


@check(
    "page_filtered",
    f"""{WITH} SELECT {ROW_SQL} FROM logs WHERE service = 'svc3' AND level = 'error'
        AND received_at >= TIMESTAMP '2024-01-05' AND received_at <= TIMESTAMP '2024-01-25 12:00:00'
        {NEWEST} LIMIT 500""",
)
def page_filtered(spark, d):
    return pages.query_logs(
        logs(spark, d),
        service="svc3",
        level="error",
        since="2024-01-05",
        until="2024-01-25T12:00:00Z",
        limit=9999,
    )


@check("page_after_cursor", f"{WITH} SELECT {ROW_SQL} FROM logs WHERE id > 500 ORDER BY id LIMIT 100")
def page_after_cursor(spark, d):
    return pages.query_logs(logs(spark, d), after_id=500)


@check("rows_filtered", f"{WITH} SELECT {ROW_SQL} FROM logs WHERE trace_id = 'u12' AND level = 'warn'")
def rows_filtered(spark, d):
    return pages.rows_only(log_filter(logs(spark, d), trace_id="u12", level="warn", service=""))


@check("get_log", f"{WITH} SELECT {ROW_SQL} FROM logs WHERE id = 77")
def get_log(spark, d):
    return pages.get_log(logs(spark, d), 77)


@check("trace_page", f"{WITH} SELECT {ROW_SQL} FROM logs WHERE trace_id = 'u21' AND id > 0 ORDER BY id LIMIT 200")
def trace_page(spark, d):
    return pages.trace_logs(logs(spark, d), "u21")


@check(
    "tail_page",
    f"""{WITH} SELECT {ROW_SQL} FROM logs WHERE id > 300 AND service = 'svc1' AND level = 'info'
        ORDER BY id LIMIT 50""",
)
def tail_page(spark, d):
    return pages.tail_logs(logs(spark, d), 300, service="svc1", level="info")


@check(
    "tail_last_id",
    f"""{WITH}, page AS (SELECT id FROM logs WHERE id > 300 AND service = 'svc1' ORDER BY id LIMIT 50)
        SELECT coalesce(max(id), 300) AS last_id FROM page""",
)
def tail_last_id(spark, d):
    return pages.tail_cursor(pages.tail_logs(logs(spark, d), 300, service="svc1"), 300)


@check("tail_nothing_new", f"{WITH} SELECT coalesce(max(id), 1099511627776) AS last_id FROM logs WHERE id > 1099511627776")
def tail_nothing_new(spark, d):
    return pages.tail_cursor(pages.tail_logs(logs(spark, d), 1 << 40), 1 << 40)


@check(
    "bodies_newest",
    f"""{WITH}, page AS (SELECT * FROM logs WHERE level = 'error' {NEWEST} LIMIT 100)
        SELECT body FROM page""",
)
def bodies_newest(spark, d):
    return pages.bodies(pages.query_logs(logs(spark, d), level="error"))


@check("export_newest", f"{WITH} SELECT {ROW_SQL} FROM logs WHERE level = 'debug' {NEWEST} LIMIT 1000")
def export_newest(spark, d):
    return pages.export_logs(logs(spark, d), level="debug")


@check("export_oldest", f"{WITH} SELECT {ROW_SQL} FROM logs WHERE service = 'svc2' ORDER BY id LIMIT 10000")
def export_oldest(spark, d):
    return export_page(logs(spark, d), 20_000, service="svc2")


@check(
    "csv_columns",
    """WITH rows AS (SELECT conv_id * 1000 + turn AS id,
          TIMESTAMP '2024-01-01' + to_seconds(conv_id) AS received_at, role AS service,
          CASE turn % 4 WHEN 0 THEN '=' WHEN 1 THEN '-' WHEN 2 THEN '@' ELSE '' END || text AS body
        FROM conversations)
       SELECT id, strftime(received_at, '%Y-%m-%dT%H:%M:%S.%gZ') AS received_at, service, '' AS level,
         CASE WHEN regexp_matches(body, '^[=+\\-@\\t]') THEN '''' || body ELSE body END AS body
       FROM rows""",
)
def guarded_columns(spark, d):
    start = F.element_at(F.array(F.lit("="), F.lit("-"), F.lit("@"), F.lit("")), (F.col("turn") % 4 + 1).cast("int"))
    rows = table(spark, d, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id")).alias("received_at"),
        F.col("role").alias("service"),
        F.lit(None).cast("string").alias("level"),
        F.concat(start, "text").alias("body"),
    )
    return csv_columns(rows)


@check(
    "trace_gaps",
    f"""{WITH} SELECT trace_id, id, received_at, service,
          lag(service) OVER w AS from_service,
          (epoch_us(received_at) - epoch_us(lag(received_at) OVER w)) / 1000.0::DOUBLE AS gap_ms
        FROM logs WHERE trace_id IS NOT NULL WINDOW w AS (PARTITION BY trace_id ORDER BY id)""",
)
def gaps(spark, d):
    return trace_gaps(logs(spark, d), block=1 << 10)


@check(
    "slowest_steps",
    f"""{WITH}, steps AS (SELECT trace_id, id, received_at, service,
          lag(service) OVER w AS from_service,
          (epoch_us(received_at) - epoch_us(lag(received_at) OVER w)) / 1000.0::DOUBLE AS gap_ms
        FROM logs WHERE trace_id IS NOT NULL WINDOW w AS (PARTITION BY trace_id ORDER BY id))
        SELECT * FROM steps ORDER BY gap_ms DESC NULLS LAST, id LIMIT 10""",
)
def slow_steps(spark, d):
    return slowest_steps(logs(spark, d))


@check(
    "turn_timeline",
    """WITH steps AS (SELECT 'c' || conv_id AS trace_id, conv_id * 1000 + turn AS id,
          TIMESTAMP '2024-01-01' + to_seconds(conv_id * 60 + turn * turn) AS received_at, role AS service
        FROM conversations)
       SELECT *, lag(service) OVER w AS from_service,
         (epoch_us(received_at) - epoch_us(lag(received_at) OVER w)) / 1000.0::DOUBLE AS gap_ms
       FROM steps WINDOW w AS (PARTITION BY trace_id ORDER BY id)""",
)
def turn_timeline(spark, d):
    turn, conv = F.col("turn"), F.col("conv_id")
    rows = table(spark, d, "conversations").select(
        F.concat(F.lit("c"), conv.cast("string")).alias("trace_id"),
        (conv * 1000 + turn).alias("id"),
        F.timestamp_seconds(F.lit(1704067200) + conv * 60 + turn * turn).alias("received_at"),
        F.col("role").alias("service"),
    )
    return trace_gaps(rows, block=2)


@check(
    "latest_per_service",
    f"""{WITH}, ranked AS (SELECT *, row_number() OVER (PARTITION BY service
          ORDER BY received_at DESC, id DESC) AS n FROM logs)
        SELECT {ROW_SQL} FROM ranked WHERE n = 1""",
)
def latest_per_service(spark, d):
    return latest_per(logs(spark, d))


@check(
    "order_trace",
    f"""{RICH} SELECT id, received_at, service, level, body FROM rich
        WHERE json_extract_string(body, '$.orderId') = 'ord-42'""",
)
def order_trace(spark, d):
    return key_trace(rich_logs(spark, d), F.get_json_object("body", "$.orderId"), "ord-42")


@check(
    "project_rows",
    f"{WITH} SELECT {ROW_SQL}, 'p' || (id % 5) AS project_id FROM logs WHERE 'p' || (id % 5) = 'p3'",
)
def project_rows(spark, d):
    rows = logs(spark, d).withColumn(
        "project_id", F.concat(F.lit("p"), (F.col("id") % 5).cast("string"))
    )
    return for_project(rows, "p3")


@check(
    "sql_surface",
    f"""{WITH} SELECT service, count(*) AS n, max(id) AS last_id FROM logs WHERE level = 'error'
        GROUP BY service ORDER BY n DESC, service NULLS LAST LIMIT 100""",
)
def sql_surface(spark, d):
    return query_sql(
        logs(spark, d),
        "SELECT service, count(*) AS n, max(id) AS last_id FROM logs WHERE level = 'error' "
        "GROUP BY service ORDER BY n DESC, service NULLS LAST",
    )


@check(
    "sql_capped",
    f"""{WITH} SELECT id, level FROM logs WHERE service IS NOT NULL ORDER BY received_at DESC, id DESC
        LIMIT 500""",
)
def sql_capped(spark, d):
    return query_sql(
        logs(spark, d),
        "SELECT id, level FROM logs WHERE service IS NOT NULL ORDER BY received_at DESC, id DESC",
        limit=5000,
    )


@check(
    "sql_functions",
    f"""{RICH} SELECT json_extract_string(body, '$.message') AS msg,
          strftime(received_at, '%Y-%m-%dT%H:00:00Z') AS hour,
          CAST(floor(epoch(received_at)) AS BIGINT) AS at_second, id
        FROM rich WHERE CAST(json_extract_string(body, '$.ms') AS DOUBLE) > 900
        ORDER BY id LIMIT 500""",
)
def sql_functions(spark, d):
    return query_sql(
        rich_logs(spark, d),
        "SELECT json_extract(body, '$.message') AS msg, "
        "strftime('%Y-%m-%dT%H:00:00Z', received_at) AS hour, "
        "cast(strftime('%s', received_at) AS bigint) AS at_second, id "
        "FROM logs WHERE json_number(body, '$.ms') > 900 ORDER BY id",
        limit=500,
    )


@check(
    "sql_window",
    f"""{WITH}, daily AS (SELECT service, CAST(received_at AS DATE) AS day, count(*) AS n
          FROM logs GROUP BY 1, 2)
        SELECT service, day, n, n - lag(n) OVER (PARTITION BY service ORDER BY day) AS change
        FROM daily ORDER BY service NULLS FIRST, day LIMIT 500""",
)
def sql_window(spark, d):
    return query_sql(
        logs(spark, d),
        "SELECT service, day, n, n - lag(n) OVER (PARTITION BY service ORDER BY day) AS change FROM "
        "(SELECT service, to_date(received_at) AS day, count(*) AS n FROM logs GROUP BY 1, 2) "
        "ORDER BY service NULLS FIRST, day",
        limit=500,
    )


@check(
    "sql_joins",
    f"""{WITH} SELECT a.service, count(*) AS pairs FROM
          (SELECT service, level, count(*) AS n FROM logs GROUP BY 1, 2) a
          JOIN (SELECT level, max(id) AS top FROM logs GROUP BY 1) b ON a.level = b.level
        GROUP BY a.service ORDER BY a.service NULLS FIRST LIMIT 100""",
)
def sql_joins(spark, d):
    return query_sql(
        logs(spark, d),
        "SELECT a.service, count(*) AS pairs FROM "
        "(SELECT service, level, count(*) AS n FROM logs GROUP BY 1, 2) a "
        "JOIN (SELECT level, max(id) AS top FROM logs GROUP BY 1) b ON a.level = b.level "
        "GROUP BY a.service ORDER BY a.service NULLS FIRST",
    )


@check(
    "sql_setops",
    f"""{WITH} SELECT * FROM (
          (SELECT trace_id FROM logs WHERE level = 'error' INTERSECT
           SELECT trace_id FROM logs WHERE level = 'warn') EXCEPT
          SELECT trace_id FROM logs WHERE service = 'svc0')
        ORDER BY trace_id NULLS FIRST LIMIT 500""",
)
def sql_setops(spark, d):
    return query_sql(
        logs(spark, d),
        "SELECT * FROM ((SELECT trace_id FROM logs WHERE level = 'error' INTERSECT "
        "SELECT trace_id FROM logs WHERE level = 'warn') EXCEPT "
        "SELECT trace_id FROM logs WHERE service = 'svc0') ORDER BY trace_id NULLS FIRST",
        limit=500,
    )


@check(
    "sql_union",
    f"""{WITH} SELECT kind, count(*) AS n FROM (
          SELECT 'e' AS kind, id FROM logs WHERE level = 'error' UNION ALL
          SELECT 's' AS kind, id FROM logs WHERE service = 'svc1') GROUP BY kind ORDER BY kind LIMIT 100""",
)
def sql_union(spark, d):
    return query_sql(
        logs(spark, d),
        "SELECT kind, count(*) AS n FROM (SELECT 'e' AS kind, id FROM logs WHERE level = 'error' "
        "UNION ALL SELECT 's' AS kind, id FROM logs WHERE service = 'svc1') GROUP BY kind ORDER BY kind",
    )


@check(
    "sql_slow_requests",
    f"""{RICH} SELECT service, json_extract_string(body, '$.ms') AS ms, received_at FROM rich
        WHERE CAST(json_extract_string(body, '$.ms') AS BIGINT) > 500
        ORDER BY CAST(json_extract_string(body, '$.ms') AS BIGINT) DESC, received_at, id LIMIT 500""",
)
def sql_slow_requests(spark, d):
    return query_sql(
        rich_logs(spark, d),
        """SELECT service, json_extract(body, '$.ms') AS ms, received_at
FROM logs WHERE json_extract(body, '$.ms') > 500
ORDER BY ms DESC, received_at, id""",
        limit=500,
    )


@check(
    "sql_latency",
    f"""{RICH} SELECT service, count(*) AS requests,
          CAST(max(CAST(json_extract_string(body, '$.ms') AS BIGINT)) AS VARCHAR) AS max_ms
        FROM rich WHERE json_extract_string(body, '$.ms') IS NOT NULL GROUP BY service""",
)
def sql_latency(spark, d):
    return query_sql(
        rich_logs(spark, d),
        """SELECT service,
       COUNT(*) AS requests,
       MAX(json_extract(body, '$.ms')) AS max_ms
FROM logs WHERE json_extract(body, '$.ms') IS NOT NULL
GROUP BY service ORDER BY max_ms DESC""",
    )


@check(
    "sql_hour_errors",
    f"""{WITH} SELECT service, strftime(date_trunc('hour', received_at), '%Y-%m-%dT%H:00:00Z') AS hour, count(*) AS errors
        FROM logs WHERE level = 'error' GROUP BY 1, 2 ORDER BY hour DESC, service NULLS FIRST LIMIT 500""",
)
def sql_hour_errors(spark, d):
    return query_sql(
        logs(spark, d),
        """SELECT service,
       strftime('%Y-%m-%dT%H:00:00Z', received_at) AS hour,
       COUNT(*) AS errors
FROM logs WHERE level = 'error'
GROUP BY service, hour ORDER BY hour DESC, service""",
        limit=500,
    )


@check(
    "sql_typed_json",
    f"""{RICH}, v AS (SELECT service, CAST(json_extract_string(body, '$.ms') AS BIGINT) AS ms FROM rich)
        SELECT service, (max(ms) - min(ms))::DOUBLE AS span, sum(ms) AS total,
          count(*) FILTER (ms > (SELECT avg(ms) FROM v)) AS above, min(ms)::VARCHAR AS least
        FROM v GROUP BY service""",
)
def sql_typed_json(spark, d):
    """JSON values in differences, casts, COALESCE, CASE and against a sub-query."""
    return query_sql(
        rich_logs(spark, d),
        """SELECT service, MAX(json_extract(body, '$.ms')) - MIN(json_extract(body, '$.ms')) AS span,
             SUM(CAST(COALESCE(json_extract(body, '$.none'), json_extract(body, '$.ms'), 'x') AS BIGINT)) AS total,
             COUNT(CASE WHEN json_extract(body, '$.ms') > (SELECT AVG(json_extract(body, '$.ms')) FROM logs) THEN 1 END) AS above,
             MIN(COALESCE(json_extract(body, '$.ms'), 0)) AS least
           FROM logs GROUP BY service""",
        limit=500,
    )


# Statements in turn, and the rows a pass gives; None is refused.
STATEMENTS = (
    ("SELECT id FROM logs WHERE level = 'error'", "SELECT count(*) FROM logs WHERE level = 'error'"),
    ("SELECT a.id FROM logs a JOIN logs b ON a.id = b.id", "SELECT count(*) FROM logs"),
    ("SELECT a.id FROM logs a JOIN logs b ON a.id = a.id", None),
    ("SELECT a.id FROM logs a JOIN logs b ON a.id + b.id = b.id + a.id", None),
    ("SELECT a.id FROM logs a, logs b WHERE a.id = b.id AND a.service = 'svc1'", "SELECT count(*) FROM logs WHERE service = 'svc1'"),
    ("SELECT DISTINCT service FROM logs", "SELECT count(*) FROM (SELECT DISTINCT service FROM logs)"),
    ("DELETE FROM logs", None),
    ("SELECT id FROM logs; SELECT 1", None),
    ("SELECT id FROM users", None),
    ("SELECT reflect('java.lang.System', 'exit', 1) FROM logs", None),
    ("SELECT id FROM logs a WHERE EXISTS (SELECT 1 FROM logs b WHERE b.id = a.id + 1)",
     "SELECT count(*) FROM logs a WHERE EXISTS (SELECT 1 FROM logs b WHERE b.id = a.id + 1)"),
)


@check(
    "sql_statements",
    WITH + " UNION ALL ".join(f" SELECT {n} AS statement, ({sql or 'NULL'})::BIGINT AS rows" for n, (_, sql) in enumerate(STATEMENTS)),
)
def sql_statements(spark, d):
    """Which statements the guard lets through, and how many rows each of those gives over all logs."""
    rows = logs(spark, d)
    counts = []
    for n, (sql, _) in enumerate(STATEMENTS):
        passes = refusal(spark, sql) is None
        found = query_sql(rows, f"SELECT count(*) AS rows FROM ({sql}) x") if passes else spark.range(1).select(F.lit(None).cast("long").alias("rows"))
        counts.append(found.select(F.lit(n).alias("statement"), "rows"))
    return reduce(DataFrame.union, counts)
