import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from loomlog.functions.hashing import hmac_hex
from loomlog.operators import shapes
from loomlog.sources.events import explode_records, logger_lines, read_lines, split_events
from loomlog.sources.syslog import parse_syslog, syslog_events
from loomlog.sources.webhooks import delivery_events, verify_webhooks
from tests.conftest import at


def parsed_line(spark, line, as_of="2024-11-20"):
    return parse_syslog(spark.createDataFrame([(line,)], "line STRING"), "line", as_of).first()


def test_syslog_rfc3164(spark):
    row = parsed_line(spark, "<34>Oct 11 22:14:15 mymachine su: 'su root' failed on /dev/pts/8")
    assert (row["level"], row["facility"], row["severity"]) == ("critical", 4, 2)
    assert (row["service"], row["hostname"]) == ("su", "mymachine")
    assert row["message"] == "'su root' failed on /dev/pts/8"
    # Counted around the year October is eleven months ahead of November: the year before.
    assert row["timestamp"] == "2023-10-11T22:14:15"
    row = parsed_line(spark, "<6>Jan  1 00:00:00 host cron.d/x[12]: a\nb ")
    assert (row["service"], row["message"], row["level"]) == ("cron.d/x", "a\nb", "info")


@pytest.mark.parametrize(
    ("as_of", "month", "year"),
    [("2024-01-01", "Dec", 2023), ("2024-06-30", "Dec", 2024), ("2024-05-31", "Dec", 2023),
     ("2024-12-31", "Jan", 2024), ("2024-07-01", "Feb", 2023), ("2024-03-01", "Mar", 2024)],
)
def test_syslog_year(spark, as_of, month, year):
    row = parsed_line(spark, f"<6>{month}  5 01:02:03 h t: m", as_of)
    assert row["timestamp"].startswith(f"{year}-") and row["timestamp"].endswith("-05T01:02:03")


def test_syslog_rfc5424(spark):
    row = parsed_line(spark, "<165>1 2003-10-11T22:14:15.003Z mymachine evntslog - ID47 - An event.")
    assert (row["level"], row["facility"]) == ("notice", 20)
    assert (row["service"], row["hostname"], row["message"]) == ("evntslog", "mymachine", "An event.")
    assert row["timestamp"] == "2003-10-11T22:14:15.003Z"
    row = parsed_line(spark, "<165>1 - - - - - - msg")
    assert (row["service"], row["hostname"], row["timestamp"]) == (None, None, None)
    row = parsed_line(spark, '<165>1 t h a p m [a@1 k="v" j="w"] hello')
    assert row["message"] == 'k="v" j="w"] hello'


def test_syslog_fallbacks(spark):
    row = parsed_line(spark, "totally invalid")
    assert (row["level"], row["message"], row["facility"], row["severity"]) == ("info", "totally invalid", None, None)
    row = parsed_line(spark, "<192>Oct 11 22:14:15 host su: msg")
    assert (row["level"], row["service"], row["facility"]) == ("info", None, None)
    row = parsed_line(spark, "<22>some unstructured content ")
    assert (row["level"], row["severity"], row["message"]) == ("info", 6, "some unstructured content")
    assert parsed_line(spark, "<22>  ")["message"] == "<22>  "
    levels = [parsed_line(spark, f"<{i}>x")["level"] for i in (0, 3, 7)]
    assert levels == ["emergency", "error", "debug"]


def test_syslog_framing_and_payload(spark, tmp_path):
    (tmp_path / "in.log").write_text("<34>Oct 11 22:14:15 h su: one\r\n\n   \n<22>two\t\nthree")
    lines = read_lines(spark, str(tmp_path))
    events = [json.loads(r["payload"]) for r in syslog_events(lines, "2024-11-01").collect()]
    assert [e["message"] for e in events] == ["one", "two", "three"]
    assert "hostname" not in events[1] and "facility" not in events[2]
    assert list(events[0]) == ["level", "service", "message", "facility", "severity", "hostname", "timestamp", "raw"]


def test_records(spark):
    cases = ['{"a":1}', '[{"a": 1}, {"b": [2]}]', "[]", "nope", "3", "[1]", '[{"a":1},{"a":2},{"a":3},{"a":4}]']
    rows = spark.createDataFrame([(c,) for c in cases], "payload STRING")
    good, bad = split_events(explode_records(rows, max_rows=3))
    assert sorted((r["index"], r["payload"]) for r in good.collect()) == [
        (0, '{"a":1}'), (0, '{"a":1}'), (1, '{"b":[2]}')
    ]
    assert sorted(r["reason"] for r in bad.collect()) == [
        "empty batch", "malformed json", "not an object", "not an object", "too many rows"
    ]


def test_logger_lines(spark, tmp_path):
    (tmp_path / "p.log").write_text('{"level":30,"msg":"a"}\n\nbroken\n {"msg":"b"} \n[1]\n')
    good, bad = logger_lines(read_lines(spark, str(tmp_path)))
    assert [r["payload"] for r in good.collect()] == ['{"level":30,"msg":"a"}', '{"msg":"b"}']
    assert [r["payload"] for r in bad.collect()] == ["broken", "[1]"]


@pytest.mark.parametrize("secret", ["k", "x" * 64, "long " * 40, "ключ"])
@pytest.mark.parametrize("digest", ["sha1", "sha256"])
def test_hmac(spark, secret, digest):
    raws = [b"", b"{}", bytes(range(256)), b"z" * 5000]
    rows = spark.createDataFrame([(r,) for r in raws], "raw BINARY")
    got = [r[0] for r in rows.select(hmac_hex(secret, F.col("raw"), digest)).collect()]
    assert got == [hmac.new(secret.encode(), r, digest).hexdigest() for r in raws]


NOW = 1_700_000_000
SECRETS = {"vercel": "v", "github": "g", "render": "r"}
BODY = b'{"deploy":"ok"}'


def sign(secret, digest, body=BODY):
    return hmac.new(secret.encode(), body, getattr(hashlib, digest)).hexdigest()


G, R = sign("g", "sha256"), sign("r", "sha256")

DELIVERIES = [
    # provider, header value, valid with secrets, valid without
    ("vercel", sign("v", "sha1"), True, True),
    ("vercel", sign("x", "sha1"), False, True),
    ("vercel", sign("v", "sha1", b"tampered"), False, True),
    ("vercel", "", False, True),
    ("vercel", None, False, True),
    ("github", f"sha256={G}", True, True),
    ("github", G, False, True),
    ("github", f"sha256={G.upper()}", False, True),
    ("github", f"sha256={G}0", False, True),
    ("github", "sha256=" + "z" * 64, False, True),
    ("github", None, False, True),
    ("render", f"t={NOW},v1={R}", True, True),
    ("render", f"t={NOW - 300},v1={R}", True, True),
    ("render", f"t={NOW + 300},v1={R}", True, True),
    ("render", f"t={NOW - 301},v1={R}", False, True),
    ("render", f"t={NOW + 301},v1={R}", False, True),
    ("render", f"t=99999999999999999999,v1={R}", False, True),
    ("render", f"v1={R}", False, True),
    ("render", f"t={NOW}", False, True),
    ("render", f"t={NOW},v1={sign('r', 'sha256', b'no')}", False, True),
    ("stripe", "anything", False, False),
]
HEADER = {"vercel": "x-vercel-signature", "github": "x-hub-signature-256", "render": "render-signature", "stripe": "s"}


def test_webhook_signatures(spark):
    rows = spark.createDataFrame(
        [
            (i, p, {HEADER[p]: value} if value is not None else {}, BODY, at("2023-11-14T22:13:20"))
            for i, (p, value, _, _) in enumerate(DELIVERIES)
        ],
        "n INT, provider STRING, headers MAP<STRING,STRING>, raw BINARY, received_at TIMESTAMP",
    )
    signed = {r["n"] for r in verify_webhooks(rows, SECRETS).collect()}
    assert signed == {i for i, d in enumerate(DELIVERIES) if d[2]}
    unsigned = {r["n"] for r in verify_webhooks(rows, {"vercel": "", "github": None}).collect()}
    assert unsigned == {i for i, d in enumerate(DELIVERIES) if d[3]}


def test_webhook_events(spark):
    bodies = [b'{"a": {"b": 1}}', b'[{"x":1},{"y":2}]', b"null", b"", b" 5 ", b'"s \\" q"', b"[]", b"{oops",
              b'{"_provider":"forged"}', b"true"]
    rows = spark.createDataFrame(
        [("github", {}, b, at("2024-01-01T00:00:00")) for b in bodies] + [("other", {}, b"{}", at("2024-01-01T00:00:00"))],
        "provider STRING, headers MAP<STRING,STRING>, raw BINARY, received_at TIMESTAMP",
    )
    good, bad = delivery_events(rows)
    own = '"_provider":"github"}'
    assert sorted(r["payload"] for r in good.collect()) == sorted([
        '{"a":{"b":1},' + own, '{"x":1}', '{"y":2}', '{"payload":null,' + own, '{"payload":null,' + own,
        '{"payload":5,' + own, '{"payload":"s \\" q",' + own, "{" + own, '{"payload":true,' + own,
    ])
    assert sorted(r["reason"] for r in bad.collect()) == ["empty body", "invalid json", "unknown provider"]


def shaped(spark, column, **values):
    frame = spark.range(1).select(*[v.alias(k) for k, v in values.items()])
    return json.loads(frame.select(column.alias("p")).first()["p"])


def test_console_shapes(spark):
    def record(method, args):
        return shaped(
            spark, shapes.console_record(F.lit(method), F.from_json(F.lit(args), "array<variant>"))
        )

    assert record("log", '["hi"]') == {"level": "info", "message": "hi"}
    assert record("warn", '["hi",{"a":1},2]') == {"level": "warn", "message": "hi", "args": [{"a": 1}, 2]}
    assert record("error", '[{"service":"x"},"b"]') == {"level": "error", "args": [{"service": "x"}, "b"]}
    assert record("debug", "[]") == {"level": "debug", "args": []}


def test_record_shapes(spark):
    null = F.lit(None).cast("string")
    assert shaped(spark, shapes.leveled_record(F.lit("info"), F.lit("m"))) == {"level": "info", "message": "m"}
    meta = F.lit('{"message":"lost","order":"o1"}')
    assert shaped(spark, shapes.leveled_record(F.lit("info"), F.lit("m"), meta)) == {
        "order": "o1", "level": "info", "message": "m"
    }
    start, end = F.timestamp_millis(F.lit(1000)), F.timestamp_millis(F.lit(1250))
    url = F.lit("https://x.test/a/b?token=1#f")
    assert shaped(spark, shapes.access_record(F.lit("GET"), url, start, end, F.lit(200), null)) == {
        "level": "info", "service": "next", "method": "GET", "path": "/a/b", "status": 200, "duration_ms": 250,
    }
    assert shaped(spark, shapes.access_record(F.lit("GET"), F.lit("https://x.test"), start, end, F.lit(200), F.lit("boom"))) == {
        "level": "error", "service": "next", "method": "GET", "path": "/", "error": "boom", "duration_ms": 250,
    }
    yes, no = F.lit(True), F.lit(False)
    assert shaped(spark, shapes.browser_error(F.lit("m"), F.lit("f.js"), F.lit(3), null, no)) == {
        "level": "error", "type": "uncaught_error", "message": "m", "_source": "f.js:3"
    }
    assert "_source" not in shaped(spark, shapes.browser_error(F.lit("m"), F.lit("f.js"), F.lit(0), null, no))
    assert shaped(spark, shapes.browser_error(F.lit("m"), F.lit("f"), F.lit(3), F.lit("s"), yes)) == {
        "level": "error", "type": "unhandled_rejection", "message": "m", "stack": "s"
    }
    long = F.repeat(F.lit("é"), 9000)
    python = shaped(
        spark,
        shapes.python_record(F.lit("WARNING"), F.lit("m"), F.lit("l"), F.lit("mod"), F.lit("f"), F.lit(7), long),
    )
    assert python["level"] == "warning" and python["exc_text"] == "é" * 8192 + "\n[truncated]"
    empty = F.map_filter(F.create_map(F.lit("a"), F.lit("b")), lambda _k, _v: F.lit(False))
    assert shaped(
        spark,
        shapes.channel_record(F.lit("Error"), F.lit("m"), F.lit("web"), start, F.create_map(F.lit("a"), F.lit("b")), empty),
    ) == {
        "level": "error", "message": "m", "channel": "web", "datetime": "1970-01-01T00:00:01.000+00:00",
        "context": {"a": "b"},
    }


def test_string_elements_are_no_events(spark):
    from loomlog.sources.events import explode_records

    lines = ['["{\\"a\\":1}", {"b":2}, 3]', '{"c":1}', '["x"]']
    rows = explode_records(spark.createDataFrame([(line,) for line in lines], "payload string")).collect()
    assert [(r.payload, r.problem) for r in rows] == [
        ('"{\\"a\\":1}"', "not an object"), ('{"b":2}', None), ("3", "not an object"),
        ('{"c":1}', None), ('"x"', "not an object"),
    ]
