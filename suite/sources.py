"""Syslog lines and webhook deliveries derived from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomlog.functions.hashing import hmac_hex
from loomlog.sources.syslog import parse_syslog, syslog_payload
from loomlog.sources.webhooks import delivery_events, signature_valid
from suite import check
from suite.views import events, table

PRI = "(event_id % 192)"
SEVERITY = (
    "CASE event_id % 8 WHEN 0 THEN 'emergency' WHEN 1 THEN 'alert' WHEN 2 THEN 'critical' "
    "WHEN 3 THEN 'error' WHEN 4 THEN 'warning' WHEN 5 THEN 'notice' WHEN 6 THEN 'info' ELSE 'debug' END"
)
# Five kinds of lines, in turn: both header formats, no header, no priority, priority too high.
KIND = "((event_id // 192) % 5)"


def syslog_lines(spark, d):
    event = F.col("event_id")
    kind = F.floor(event / 192) % 5
    head = F.concat(F.lit("<"), (event % 192).cast("string"), F.lit(">"))
    user = F.col("user_id").cast("string")
    modern = F.concat(
        head, F.lit("1 "), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(" host"), user,
        F.when(event % 2 == 0, " -").otherwise(" app"), F.lit(" 12 ID47 - "), F.col("event_type"),
        F.lit(" of\n"), F.col("props"), F.lit("  "),
    )
    legacy = F.concat(
        head, F.date_format("ts", "MMM d HH:mm:ss"), F.lit(" host"), user,
        F.lit(" cron.d/job[77]: "), F.col("event_type"),
    )
    line = (
        F.when(kind == 0, modern)
        .when(kind == 1, legacy)
        .when(kind == 2, F.concat(head, F.lit(" no header "), F.col("event_type")))
        .when(kind == 3, F.concat(F.lit("plain "), F.col("event_type")))
        .otherwise(F.concat(F.lit("<192>1 "), F.col("event_type")))
    )
    return events(spark, d).select("event_id", "ts", line.alias("line"))


@check(
    "syslog_parse",
    f"""SELECT event_id,
         CASE WHEN {KIND} < 3 THEN {SEVERITY} ELSE 'info' END AS level,
         CASE {KIND} WHEN 0 THEN CASE WHEN event_id % 2 = 0 THEN NULL ELSE 'app' END
           WHEN 1 THEN 'cron.d/job' END AS service,
         CASE {KIND} WHEN 0 THEN event_type || ' of' || chr(10) || props WHEN 1 THEN event_type
           WHEN 2 THEN 'no header ' || event_type WHEN 3 THEN 'plain ' || event_type
           ELSE '<192>1 ' || event_type END AS message,
         CASE WHEN {KIND} < 3 THEN CAST({PRI} // 8 AS INT) END AS facility,
         CASE WHEN {KIND} < 3 THEN CAST(event_id % 8 AS INT) END AS severity,
         CASE WHEN {KIND} < 2 THEN 'host' || user_id END AS hostname,
         CASE {KIND} WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ')
           WHEN 1 THEN strftime(ts, '2023-%m-%dT%H:%M:%S') END AS timestamp
       FROM events""",
)
def syslog_parse(spark, d):
    # Seen from June, a January line is seven months ahead and belongs to the year before.
    parsed = parse_syslog(syslog_lines(spark, d), "line", "2024-06-15")
    return parsed.select(
        "event_id", "level", "service", "message", "facility", "severity", "hostname", "timestamp"
    )


@check(
    "syslog_payloads",
    f"""SELECT level, facility, count(*) AS lines FROM (SELECT
          CASE WHEN {KIND} < 3 THEN {SEVERITY} ELSE 'info' END AS level,
          CASE WHEN {KIND} < 3 THEN {PRI} // 8 END AS facility FROM events) GROUP BY ALL""",
)
def syslog_payloads(spark, d):
    payload = parse_syslog(syslog_lines(spark, d), "line", F.col("ts")).select(
        syslog_payload().alias("payload")
    )
    return payload.groupBy(
        F.get_json_object("payload", "$.level").alias("level"),
        F.get_json_object("payload", "$.facility").cast("bigint").alias("facility"),
    ).agg(F.count(F.lit(1)).alias("lines"))


SECRETS = {"vercel": "first", "github": "second", "render": "third"}
PROVIDERS = ("vercel", "github", "render", "stripe")


def deliveries(spark, d):
    """Turns of conversations as deliveries: signed, tampered with, late, or from a stranger."""
    number = F.col("conv_id") + F.col("turn")
    text = (
        F.when(F.col("turn") % 5 == 0, F.concat(F.lit('{"conv":'), F.col("conv_id"), F.lit("}")))
        .when(F.col("turn") % 5 == 1, F.concat(F.lit('[{"c":'), F.col("conv_id"), F.lit('},{"d":1}]')))
        .when(F.col("turn") % 5 == 2, F.concat(F.lit('"'), F.col("role"), F.lit('"')))
        .when(F.col("turn") % 5 == 3, F.lit(""))
        .otherwise(F.lit("{bad"))
    )
    rows = table(spark, d, "conversations").select(
        "conv_id",
        "turn",
        F.get(F.array(*[F.lit(p) for p in PROVIDERS]), (number % 4).cast("int")).alias("provider"),
        F.encode(text, "UTF-8").alias("raw"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id")).alias("received_at"),
        (F.col("conv_id") % 3).alias("state"),
    )
    provider, raw = F.col("provider"), F.col("raw")
    signed = F.when(F.col("state") == 1, F.concat(raw, F.encode(F.lit(" "), "UTF-8"))).otherwise(raw)
    stamp = F.unix_seconds("received_at") - F.when(F.col("state") == 2, 301).otherwise(300)
    header = (
        F.when(provider == "vercel", hmac_hex(SECRETS["vercel"], signed, "sha1"))
        .when(provider == "github", F.concat(F.lit("sha256="), hmac_hex(SECRETS["github"], signed)))
        .otherwise(F.concat(F.lit("t="), stamp, F.lit(",v1="), hmac_hex(SECRETS["render"], signed)))
    )
    name = (
        F.when(provider == "vercel", "x-vercel-signature")
        .when(provider == "github", "x-hub-signature-256")
        .otherwise("render-signature")
    )
    return rows.withColumn("headers", F.create_map(name, header))


@check(
    "webhook_signatures",
    """WITH c AS (SELECT *, (conv_id + turn) % 4 AS p, conv_id % 3 AS state FROM conversations)
       SELECT conv_id, turn, CASE p WHEN 0 THEN state <> 1 WHEN 1 THEN state <> 1 WHEN 2 THEN state = 0
         ELSE false END AS valid FROM c""",
)
def webhook_signatures(spark, d):
    return deliveries(spark, d).select("conv_id", "turn", signature_valid(SECRETS).alias("valid"))


@check(
    "webhook_unsigned",
    """SELECT (conv_id + turn) % 4 < 3 AS valid, count(*) AS deliveries FROM conversations GROUP BY 1""",
)
def webhook_unsigned(spark, d):
    rows = deliveries(spark, d).select(signature_valid({}).alias("valid"))
    return rows.groupBy("valid").agg(F.count(F.lit(1)).alias("deliveries"))


@check(
    "webhook_events",
    """WITH c AS (SELECT *, CASE (conv_id + turn) % 4 WHEN 0 THEN 'vercel' WHEN 1 THEN 'github'
           WHEN 2 THEN 'render' END AS provider FROM conversations WHERE (conv_id + turn) % 4 < 3)
       SELECT conv_id, turn, CASE turn % 5
           WHEN 0 THEN '{"conv":' || conv_id || ',"_provider":"' || provider || '"}'
           WHEN 1 THEN '{"c":' || conv_id || '}'
           WHEN 2 THEN '{"payload":"' || role || '","_provider":"' || provider || '"}'
           ELSE '{"payload":null,"_provider":"' || provider || '"}' END AS payload
       FROM c WHERE turn % 5 < 4
       UNION ALL SELECT conv_id, turn, '{"d":1}' FROM c WHERE turn % 5 = 1""",
)
def webhook_events(spark, d):
    return delivery_events(deliveries(spark, d))[0].select("conv_id", "turn", "payload")


@check(
    "webhook_refused",
    """SELECT CASE WHEN (conv_id + turn) % 4 = 3 THEN 'unknown provider' ELSE 'invalid json' END AS reason,
         count(*) AS deliveries FROM conversations
       WHERE (conv_id + turn) % 4 = 3 OR turn % 5 = 4 GROUP BY 1""",
)
def webhook_refused(spark, d):
    refused = delivery_events(deliveries(spark, d))[1]
    return refused.groupBy("reason").agg(F.count(F.lit(1)).alias("deliveries"))
