import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from loomlog.functions.instants import event_time
from loomlog.functions.jsonbody import parsed
from loomlog.operators.aggregates import histogram
from loomlog.operators.counters import log_counts
from loomlog.sinks.store import ingest_batch
from loomlog.sources.events import read_lines
from loomlog.sinks.store import compact, delete_where
from loomlog.sources.store import read_counts, read_logs
from loomlog.streaming import aggregates as running
from loomlog.streaming.ingest import ingest_stream, logger_events, syslog_lines
from loomlog.streaming.tail import Watched, stored_stream, tail_stream, watch
from tests.conftest import at

RAW = "received_at TIMESTAMP, payload STRING"


def add(spark, root, batch, *rows):
    ingest_batch(spark.createDataFrame([(at(t), json.dumps(p)) for t, p in rows], RAW), root, batch)


def emitted(path):
    """Rows of all micro-batches, in the order a follower reads them."""
    lines = []
    for folder in sorted(path.glob("batch=*")):
        for part in sorted(folder.glob("part-*")):
            lines += [json.loads(line) for line in part.read_text().splitlines()]
    return lines


@pytest.fixture
def paths(tmp_path):
    return str(tmp_path / "root"), str(tmp_path / "state"), tmp_path / "out"


def test_tail_continues_where_it_stopped(spark, paths):
    root, state, out = paths
    add(spark, root, 0, *[("2024-01-01T00:00:00", {"service": "ab"[i % 2], "i": i}) for i in range(6)])
    follow = lambda: tail_stream(
        spark, root, str(out), state, service="a", available_now=True
    ).awaitTermination()
    follow()
    assert [json.loads(r["body"])["i"] for r in emitted(out)] == [0, 2, 4]
    follow()
    assert len(emitted(out)) == 3
    add(spark, root, 1, ("2024-01-01T00:01:00", {"service": "a", "i": 6}))
    follow()
    rows = emitted(out)
    assert [json.loads(r["body"])["i"] for r in rows] == [0, 2, 4, 6]
    assert [r["id"] for r in rows] == sorted(r["id"] for r in rows)


def test_tail_in_small_steps(spark, paths):
    root, state, out = paths
    for batch in (0, 1):
        add(spark, root, batch, *[(f"2024-01-01T00:00:0{i}", {"i": batch * 4 + i}) for i in range(4)])
    tail_stream(spark, root, str(out), state, available_now=True, files_per_batch=1).awaitTermination()
    assert len(list(out.glob("batch=*"))) > 1
    assert sorted(json.loads(r["body"])["i"] for r in emitted(out)) == list(range(8))


def test_tail_from_a_cursor(spark, paths):
    root, state, out = paths
    add(spark, root, 0, *[(f"2024-01-01T00:00:0{i}", {"i": i}) for i in range(5)])
    cursor = read_logs(spark, root).orderBy("id").collect()[2]["id"]
    seen = watch(spark, root, cursor, timeout_seconds=60)
    assert [json.loads(r["body"])["i"] for r in seen.rows] == [3, 4]
    assert seen.last_id == seen.rows[-1]["id"]
    later = threading.Timer(1.0, add, (spark, root, 1, ("2024-01-01T00:01:00", {"i": 9})))
    later.start()
    came = watch(spark, root, seen.last_id, timeout_seconds=90)
    later.join()
    assert [json.loads(r["body"])["i"] for r in came.rows] == [9]
    started = time.monotonic()
    assert watch(spark, root, came.last_id, timeout_seconds=1.5) == Watched([], came.last_id)
    assert time.monotonic() - started >= 1.5


def test_tail_after_upkeep_gives_every_id_once(spark, paths):
    root, state, out = paths

    def tail():
        tail_stream(spark, root, str(out), state, available_now=True).awaitTermination()

    first = [(f"2024-01-01T00:00:{i:02d}", {"i": i, "service": "ab"[i % 2]}) for i in range(20)]
    second = [(f"2024-01-02T00:00:{i:02d}", {"i": 20 + i, "service": "ab"[i % 2]}) for i in range(20)]
    add(spark, root, 0, *first)
    add(spark, root, 1, *second)
    tail()
    delete_where(spark, root, service="b")
    tail()
    add(spark, root, 1, *second)
    tail()
    compact(spark, root, "2024-01-01")
    add(spark, root, 2, ("2024-01-02T01:00:00", {"i": 40, "service": "a"}))
    tail()
    assert [json.loads(r["body"])["i"] for r in emitted(out)] == list(range(41))
    left = [json.loads(r["body"])["i"] for r in read_logs(spark, root).orderBy("id").collect()]
    assert left == [*range(0, 40, 2), 40]


def test_tail_of_some_days(spark, paths):
    root, state, out = paths
    add(spark, root, 0, *[(f"2024-01-0{i}T00:00:00", {"i": i}) for i in range(1, 6)])
    tail_stream(spark, root, str(out), state, days="2024-01-0[34]", available_now=True).awaitTermination()
    assert [json.loads(r["body"])["i"] for r in emitted(out)] == [3, 4]


def test_json_ingest(spark, paths, tmp_path):
    root, state, _ = paths
    landing = tmp_path / "in"
    landing.mkdir()
    (landing / "1.json").write_text('{"service":"a","level":"error"}\n[{"service":"a"},{"service":"b"}]\nbroken\n')
    run = lambda: ingest_stream(
        read_lines(spark, str(landing), streaming=True, max_files=1), root, state
    ).awaitTermination()
    run()
    (landing / "2.json").write_text('{"service":"b","level":"info"}\n')
    run()
    run()
    rows = read_logs(spark, root).collect()
    assert sorted((r["service"], r["level"]) for r in rows if r["level"]) == [("a", "error"), ("b", "info")]
    assert len(rows) == 4 and len({r["id"] for r in rows}) == 4
    counts = {(r["service"], r["level"]): r["count"] for r in log_counts(read_counts(spark, root)).collect()}
    assert counts == {("a", "error"): 1, ("a", ""): 1, ("b", ""): 1, ("b", "info"): 1}
    assert spark.read.parquet(f"{root}/quarantine").first()["payload"] == "broken"


def test_syslog_and_logger_ingest(spark, paths, tmp_path):
    root, state, _ = paths
    for name, text in (("sys", "<11>Oct 11 22:14:15 h su: no\n\n<14>hello\n"), ("app", '{"name":"n","lvl":"warn"}\nbad\n')):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x").write_text(text)
    ingest_stream(
        read_lines(spark, str(tmp_path / "sys"), streaming=True), root, state + "1", shape=syslog_lines
    ).awaitTermination()
    assert sorted((r["service"] or "", r["level"]) for r in read_logs(spark, root).collect()) == [("", "info"), ("su", "error")]
    other = root + "2"
    ingest_stream(
        read_lines(spark, str(tmp_path / "app"), streaming=True), other, state + "2", shape=logger_events
    ).awaitTermination()
    assert [(r["service"], r["level"]) for r in read_logs(spark, other).collect()] == [("n", "warn")]


def test_stream_equals_batch(spark, paths, tmp_path):
    root, state, _ = paths
    rows = [(f"2024-01-01T{i % 5:02d}:{i:02d}:00", {"service": "s", "level": "error"}) for i in range(50)]
    add(spark, root, 0, *rows)
    add(spark, root, 1, ("2024-01-02T00:00:00", {"service": "s", "level": "error"}))

    def run(df, mode, name):
        query = (
            df.writeStream.format("memory").queryName(name).outputMode(mode)
            .option("checkpointLocation", f"{state}-{name}").trigger(availableNow=True).start()
        )
        query.awaitTermination()
        return [tuple(r) for r in spark.table(name).collect()]

    stream = stored_stream(spark, root)
    batch = [tuple(r) for r in histogram(read_logs(spark, root), "1h").collect()]
    windows = sorted(run(running.windowed_counts(stream, "1h"), "append", "windows"))
    assert windows == batch[:-1]  # the last hour is still open
    counts = run(running.running_counts(stream), "complete", "counts")
    assert sorted(counts) == sorted(tuple(r) for r in log_counts(read_counts(spark, root)).collect())
    alerts = run(running.alerts(stream, 60, 5), "append", "alerts")
    assert len(alerts) == sum(1 for b in batch[:-1] if b[1] >= 5)
    once = run(
        running.drop_copies_in_window(stream.withColumn("k", F.lit("same")), key="k").select("k"), "append", "once"
    )
    assert 1 <= len(once) <= 2


def test_late_events_by_their_own_time(spark, paths, tmp_path):
    """Producers' times arrive out of order; the watermark decides what is too late."""
    _, state, _ = paths
    landing = tmp_path / "in"
    landing.mkdir()
    stream = (
        read_lines(spark, str(landing), streaming=True, max_files=1)
        .withColumn("event_time", event_time(parsed(F.col("payload"))))
    )
    counts = running.windowed_counts(stream, "5m", lateness="10 minutes", time="event_time")

    def step(name, *times):
        (landing / name).write_text("".join(f'{{"ts":"2024-01-01T{t}:00Z"}}\n' for t in times))
        query = (
            counts.writeStream.format("json").outputMode("append").option("path", str(tmp_path / "windows"))
            .option("checkpointLocation", state).trigger(availableNow=True).start()
        )
        query.awaitTermination()

    step("1", "10:00", "10:01", "10:07")
    step("2", "10:02", "10:30")  # still in time
    step("3", "10:03", "10:31")  # the first window is closed by now
    step("4", "11:00")
    rows = spark.read.schema("bucket STRING, count BIGINT").json(str(tmp_path / "windows")).collect()
    assert sorted(map(tuple, rows)) == [
        ("2024-01-01T10:00:00Z", 3), ("2024-01-01T10:05:00Z", 1), ("2024-01-01T10:30:00Z", 2)
    ]
