"""Comparisons on JSON fields of the body, and scalar expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomlog.functions.hashing import body_hash, hmac_hex
from loomlog.functions.instants import event_time, is_iso
from loomlog.functions.jsonbody import FIELD_OPS, compare_field, parsed
from loomlog.operators import pages
from loomlog.operators.shapes import exception_text, url_path
from loomlog.sources.events import size_of
from suite import check
from suite.views import LOGS_SQL, RICH_SQL, ROW_SQL, events, logs, rich_logs, table

WITH = f"WITH {LOGS_SQL}"
RICH = f"WITH {RICH_SQL}"
K = "CAST(json_extract_string(body, '$.k') AS BIGINT)"


@check(
    "field_gt",
    f"""{WITH} SELECT {ROW_SQL} FROM logs WHERE {K} > 50 AND service = 'svc1'
        ORDER BY received_at DESC, id DESC LIMIT 100""",
)
def field_gt(spark, d):
    return pages.query_field(logs(spark, d), "k", ">", 50, service="svc1")


@check(
    "field_ne",
    f"""{WITH} SELECT {ROW_SQL} FROM logs WHERE {K} <> 7
          AND received_at >= TIMESTAMP '2024-01-03' AND received_at <= TIMESTAMP '2024-01-28'
        ORDER BY received_at DESC, id DESC LIMIT 500""",
)
def field_ne(spark, d):
    return pages.query_field(
        logs(spark, d), "k", "!=", 7, since="2024-01-03", until="2024-01-28", limit=1000
    )


@check(
    "field_text",
    f"{RICH} SELECT {ROW_SQL} FROM rich WHERE json_extract_string(body, '$.orderId') = 'ord-17'",
)
def field_text(spark, d):
    return pages.rows_only(pages.field_rows(rich_logs(spark, d), "orderId", "=", "ord-17"))


@check("field_rows_le", f"{WITH} SELECT id FROM logs WHERE {K} <= 3")
def field_rows_le(spark, d):
    return pages.field_rows(logs(spark, d), "k", "<=", 3).select("id")


# Bodies whose field takes every JSON type in turn.
MIXED = (
    '{"m":{"ms":KK}}',
    '{"m":{"ms":"abc"}}',
    '{"m":{"ms":true}}',
    '{"m":{"ms":KK.5}}',
    '{"m":{"ms":null}}',
    '{"m":{"other":1}}',
    '{"m":{"ms":"900"}}',
    '{"m":{"ms":{"z":1,"x":KK}}}',
    '{"m":{"ms":[KK]}}',
    '{"m":{"ms":"KK"}}',
    "not json",
)
_MIXED_SQL = " ".join(
    f"WHEN {i} THEN replace('{text}', 'KK', k)" for i, text in enumerate(MIXED)
)
MIXED_SQL = f"""WITH e AS (SELECT event_id AS id, json_extract_string(props, '$.k') AS k FROM events),
  b AS (SELECT id, CASE id % {len(MIXED)} {_MIXED_SQL} END AS body FROM e),
  t AS (SELECT id, CASE WHEN json_valid(body) THEN json_type(body, '$.m.ms') END AS t,
          CASE WHEN json_valid(body) THEN json_extract_string(body, '$.m.ms') END AS s FROM b),
  x AS (SELECT id,
          CASE WHEN t IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST(s AS DOUBLE)
               WHEN t = 'BOOLEAN' THEN CASE s WHEN 'true' THEN 1.0 ELSE 0.0 END END AS num,
          t IN ('UBIGINT', 'BIGINT', 'DOUBLE') AS is_num,
          CASE WHEN t IN ('VARCHAR', 'OBJECT', 'ARRAY') THEN s END AS txt, t FROM t)"""


def mixed(spark, d):
    k = F.get_json_object("props", "$.k")
    body = F
    for i, text in enumerate(MIXED):
        body = body.when(
            F.col("event_id") % len(MIXED) == i, F.replace(F.lit(text), F.lit("KK"), k)
        )
    return events(spark, d).select(F.col("event_id").alias("id"), body.alias("body"))


NAMES = dict(zip(FIELD_OPS, ("eq", "ne", "gt", "ge", "lt", "le")))
SQL_OPS = dict(zip(FIELD_OPS, ("=", "<>", ">", ">=", "<", "<=")))


def _flags(spark, d, value, types):
    body = F.col("body")
    return mixed(spark, d).select(
        "id",
        *[
            compare_field(body, parsed(body), "m.ms", op, value, types).alias(NAMES[op])
            for op in FIELD_OPS
        ],
    )


def _flags_sql(condition) -> str:
    columns = ", ".join(f"coalesce({condition(op)}, false) AS {NAMES[op]}" for op in FIELD_OPS)
    return f"{MIXED_SQL} SELECT id, {columns} FROM x"


@check(
    "field_mixed_types",
    _flags_sql(
        lambda op: f"CASE WHEN num IS NOT NULL THEN num {SQL_OPS[op]} 50 "
        f"WHEN txt IS NOT NULL THEN {str(op in ('!=', '>', '>=')).lower()} END"
    ),
)
def field_mixed_types(spark, d):
    return _flags(spark, d, 50, "ranked")


@check(
    "field_mixed_text",
    _flags_sql(
        lambda op: f"CASE WHEN num IS NOT NULL THEN {str(op in ('!=', '<', '<=')).lower()} "
        f"WHEN txt IS NOT NULL THEN txt {SQL_OPS[op]} '50' END"
    ),
)
def field_mixed_text(spark, d):
    return _flags(spark, d, "50", "ranked")


@check("field_strict_number", _flags_sql(lambda op: f"CASE WHEN is_num THEN num {SQL_OPS[op]} 50.5 END"))
def field_strict_number(spark, d):
    return _flags(spark, d, 50.5, "strict")


@check(
    "field_strict_text",
    _flags_sql(lambda op: f"CASE WHEN t = 'VARCHAR' THEN txt {SQL_OPS[op]} '50' END"),
)
def field_strict_text(spark, d):
    return _flags(spark, d, "50", "strict")


@check("body_hash", "SELECT doc_id, sha256(text) AS body_hash, strlen(text) AS bytes FROM documents")
def hashes(spark, d):
    return table(spark, d, "documents").select(
        "doc_id",
        body_hash(F.col("text")).alias("body_hash"),
        size_of(F.col("text")).alias("bytes"),
    )


def _blob(pad: int, secret: bytes) -> str:
    return "'" + "".join(f"\\x{b ^ pad:02X}" for b in secret.ljust(64, b"\0")) + "'::BLOB"


def _hmac_sql(secret: str, digest: str) -> str:
    inner, outer = (_blob(pad, secret.encode()) for pad in (0x36, 0x5C))
    return f"{digest}({outer} || unhex({digest}({inner} || encode(text))))"


@check(
    "hmac_digest",
    f"""SELECT conv_id, turn, {_hmac_sql('first secret', 'sha256')} AS by_sha256,
          {_hmac_sql('second secret', 'sha1')} AS by_sha1 FROM conversations""",
)
def digests(spark, d):
    raw = F.encode("text", "UTF-8")
    return table(spark, d, "conversations").select(
        "conv_id",
        "turn",
        hmac_hex("first secret", raw).alias("by_sha256"),
        hmac_hex("second secret", raw, "sha1").alias("by_sha1"),
    )


ISO_FORMS = (
    ("yyyy-MM-dd", "%Y-%m-%d"),
    ("yyyy-MM-dd'T'HH:mm'Z'", "%Y-%m-%dT%H:%MZ"),
    ("yyyy-MM-dd'T'HH:mm:ss", "%Y-%m-%dT%H:%M:%S"),
    ("yyyy-MM-dd'T'HH:mm:ss.SSS'+05:00'", "%Y-%m-%dT%H:%M:%S.%g+05:00"),
    ("yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S"),
    ("yyyy/MM/dd", "%Y/%m/%d"),
    ("yyyy-MM-dd'T'HH", "%Y-%m-%dT%H"),
    ("yyyy-MM-dd'T'HH:mm:ss'+0500'", "%Y-%m-%dT%H:%M:%S+0500"),
)
_ISO_SQL = " ".join(f"WHEN {i} THEN strftime(ts, '{form}')" for i, (_, form) in enumerate(ISO_FORMS))


@check(
    "iso_check",
    f"""SELECT event_id, event_id % {len(ISO_FORMS)} < 4 AS valid,
          CASE event_id % {len(ISO_FORMS)} {_ISO_SQL} END AS shown FROM events""",
)
def iso_check(spark, d):
    shown = F
    for i, (form, _) in enumerate(ISO_FORMS):
        shown = shown.when(F.col("event_id") % len(ISO_FORMS) == i, F.date_format("ts", form))
    return events(spark, d).select(
        "event_id", is_iso(shown).alias("valid"), shown.alias("shown")
    )


@check(
    "event_time",
    """SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL ELSE date_trunc('milliseconds', ts) END AS event_time
       FROM events""",
)
def producer_time(spark, d):
    millis = F.unix_millis("ts").cast("string")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    which = F.col("event_id") % 4
    payload = (
        F.when(which == 0, F.concat(F.lit('{"ts":"'), iso, F.lit('"}')))
        .when(which == 1, F.concat(F.lit('{"ts":"soon","time":'), millis, F.lit("}")))
        .when(which == 2, F.concat(F.lit('{"ts":true,"timestamp":"'), iso, F.lit('"}')))
        .otherwise(F.col("props"))
    )
    return events(spark, d).select("event_id", event_time(parsed(payload)).alias("event_time"))


@check(
    "url_path",
    """SELECT page_id, CASE WHEN path = '' THEN '/' ELSE path END AS path FROM
       (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages)""",
)
def paths(spark, d):
    return table(spark, d, "pages").select("page_id", url_path(F.col("url")).alias("path"))


@check(
    "truncate_text",
    """SELECT doc_id, CASE WHEN length(text) > 8192
         THEN substring(text, 1, 8192) || chr(10) || '[truncated]' ELSE text END AS exc_text FROM documents""",
)
def truncated(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", exception_text(F.col("text")).alias("exc_text")
    )


@check(
    "text_functions",
    """SELECT doc_id, upper(source) AS up, lower(text) AS low, trim('  ' || lang || ' ') AS lang,
         lpad(CAST(doc_id AS VARCHAR), 9, '0') AS padded, strlen(text) AS bytes,
         regexp_extract(source, '([0-9]+)', 1) AS digits, sha1(text) AS sha1,
         CAST(n_chars AS BIGINT) // 60 * 60 AS snapped
       FROM documents""",
)
def text_functions(spark, d):
    return table(spark, d, "documents").selectExpr(
        "doc_id",
        "upper(source) AS up",
        "lower(text) AS low",
        "trim(concat('  ', lang, ' ')) AS lang",
        "lpad(cast(doc_id AS string), 9, '0') AS padded",
        "cast(octet_length(text) AS bigint) AS bytes",
        "regexp_extract(source, '([0-9]+)', 1) AS digits",
        "sha1(text) AS sha1",
        "n_chars div 60 * 60 AS snapped",
    )
