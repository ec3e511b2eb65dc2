"""Event windows with late rows kept apart; commits asked for by number."""

import pytest
from pyspark.sql import functions as F

from loomlog.sources.store import commit_path, commits_from, write_note
from loomlog.streaming import late
from loomlog.streaming import tail as tails
from loomlog.streaming.tail import Watched, watch
from tests.conftest import at
from tests.test_streaming import add

DDL = "event_time TIMESTAMP, kind STRING"


@pytest.fixture
def step(spark, tmp_path):
    def run(*rows):
        spark.createDataFrame([(at(t) if t else None, k) for t, k in rows], DDL).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(DDL).parquet(f"{tmp_path}/in")
        late.event_windows_stream(stream, f"{tmp_path}/w", f"{tmp_path}/state", "5m", lateness_seconds=600, by=("kind",)).awaitTermination()
        return f"{tmp_path}/w"

    return run


def rows_of(df):
    return sorted((r["bucket"] or "", r["kind"], r["count"]) for r in df.collect())


def test_late_rows_are_counted_apart(spark, step):
    step(("2024-01-01T10:00:00", "a"), ("2024-01-01T10:04:59", "a"), ("2024-01-01T10:07:00", "b"))
    step(("2024-01-01T10:02:00", "a"), ("2024-01-01T10:30:00", "a"), (None, "b"))
    root = step(("2024-01-01T10:03:00", "a"), ("2024-01-01T10:16:00", "a"), ("2024-01-01T10:31:00", "b"))
    closed = late.closed_windows(spark, root, "5m", lateness_seconds=600, by=("kind",))
    assert rows_of(closed) == [("2024-01-01T10:00:00Z", "a", 3), ("2024-01-01T10:05:00Z", "b", 1)]
    assert rows_of(late.late_rows(spark, root, by=("kind",))) == [("", "b", 1), ("2024-01-01T10:00:00Z", "a", 1), ("2024-01-01T10:15:00Z", "a", 1)]


def test_a_repeated_micro_batch_counts_once(spark, step, monkeypatch):
    step(("2024-01-01T10:00:00", "a"))
    real = late.write_note

    def fails(*_):
        raise RuntimeError("host lost")

    monkeypatch.setattr(late, "write_note", fails)
    with pytest.raises(Exception, match="host lost"):
        step(("2024-01-01T10:01:00", "a"), ("2024-01-01T11:00:00", "a"))
    monkeypatch.setattr(late, "write_note", real)
    root = step(("2024-01-01T10:02:00", "a"))
    closed = late.closed_windows(spark, root, "5m", lateness_seconds=600, by=("kind",))
    counted = {b: n for b, _, n in rows_of(closed)}
    apart = {b: n for b, _, n in rows_of(late.late_rows(spark, root, by=("kind",)))}
    assert counted["2024-01-01T10:00:00Z"] + apart.get("2024-01-01T10:00:00Z", 0) == 3


def test_nothing_yet(spark, tmp_path):
    assert late.closed_windows(spark, str(tmp_path), "1h", lateness_seconds=0).count() == 0
    assert late.late_rows(spark, str(tmp_path)).count() == 0


def test_commits_from_a_number(spark, tmp_path):
    root = str(tmp_path)
    numbers = [0, 1, 9, 10, 19, 20, 99, 100, 12345, 99999, 123456]
    for n in numbers:
        write_note(spark, commit_path(root, n), {"batch": n})
    for n in (0, 1, 2, 9, 10, 11, 99, 100, 12344, 12345, 12346, 99999, 100000, 123457):
        assert commits_from(spark, root, n) == [x for x in numbers if x >= n]
    assert commits_from(spark, f"{root}/none", 0) == []


def test_a_look_reads_only_new_commits(spark, tmp_path, monkeypatch):
    root, read = str(tmp_path / "root"), []
    real = tails.read_note
    monkeypatch.setattr(tails, "read_note", lambda s, path: (read.append(int(path[-25:-5])), real(s, path))[1])
    for batch in range(6):
        add(spark, root, batch, *[(f"2024-01-0{batch + 1}T00:00:0{i}", {"b": batch, "i": i}) for i in range(3)])
    cursor = 4 << 40
    seen = watch(spark, root, cursor, timeout_seconds=3)
    assert len(seen.rows) == 5 and set(read) == {4, 5}
    read.clear()
    assert watch(spark, root, seen.last_id, timeout_seconds=1.2) == Watched([], seen.last_id)
    assert read == [5]
    monkeypatch.setattr(tails, "LOOKED_AT", 2)
    read.clear()
    assert len(watch(spark, root, None, timeout_seconds=3, limit=4).rows) == 4
    assert read == [0, 1]


def test_sessions_close_with_the_watermark(spark, tmp_path):
    rows = [("t", at(f"2024-01-01T{h:02d}:00:00")) for h in (0, 1, 5, 6, 7, 20)]
    spark.createDataFrame(rows, "trace_id STRING, received_at TIMESTAMP").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("trace_id STRING, received_at TIMESTAMP").parquet(f"{tmp_path}/in")
    query = late.sessions(stream, "2 hours").writeStream.format("memory").queryName("runs").outputMode("append")
    query.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = spark.table("runs").select(F.hour("start"), F.hour("end"), "count").collect()
    assert sorted(map(tuple, got)) == [(0, 3, 2), (5, 9, 3)]
