import csv
import json

import pytest
from pyspark.sql import functions as F

from loomlog.operators.counters import log_counts
from loomlog.operators.retention import excess_cutoff, kept_rows, newest_rows
from loomlog.schema import ROW_COLUMNS
from loomlog.sinks import projects, store
from loomlog.sinks.exports import export_csv, export_everything, export_ndjson
from loomlog.sources.store import day_folders, project_root, read_batch, read_counts, read_logs
from tests.conftest import at


@pytest.fixture
def events(spark):
    def make(*rows):
        return spark.createDataFrame(
            [(at(t), json.dumps(p) if not isinstance(p, str) else p) for t, p in rows],
            "received_at TIMESTAMP, payload STRING",
        )

    return make


def stored(spark, root):
    return read_logs(spark, root).orderBy("id").collect()


T0 = "2024-01-01T10:00:00"


def test_ingest_lifts_and_stamps(spark, events, tmp_path):
    root = str(tmp_path)
    counts = store.ingest_batch(
        events(
            (T0, {"app": "api", "severity": "warn", "requestId": "r1", "n": {"z": 1, "a": 1.0}}),
            (T0, {"service": "", "source": "src", "level": 30, "traceId": ""}),
            (T0, {"service": ["x"]}),
            (T0, {"trace.id": "dotted", "x-trace-id": "later"}),
        ),
        root,
        0,
    )
    assert (counts.written, counts.deduplicated, counts.oversized, counts.malformed) == (4, 0, 0, 0)
    rows = stored(spark, root)
    assert [(r["service"], r["level"], r["trace_id"]) for r in rows] == [
        ("api", "warn", "r1"), ("src", None, None), (None, None, None), (None, None, "dotted")
    ]
    assert rows[0]["body"] == (
        '{"app":"api","severity":"warn","requestId":"r1","n":{"z":1,"a":1.0},'
        '"received_at":"2024-01-01T10:00:00.000Z"}'
    )
    assert all(len(r["body_hash"]) == 64 for r in rows)
    assert len({r["id"] for r in rows}) == 4
    assert read_logs(spark, root, since="2024-01-02").count() == 0


@pytest.mark.parametrize("sink", [store, projects])
def test_one_row_group_is_parsed_by_several_tasks(spark, tmp_path, monkeypatch, sink):
    payload = F.concat(F.lit('{"svc":"'), F.sha2(F.col("id").cast("string"), 256), F.lit('"}')).alias("payload")
    time, project = F.timestamp_seconds(F.lit(1704100000) + F.col("id") % 7).alias("received_at"), F.lit("p").alias("project_id")
    events = spark.range(0, 90_000, 1, 1).select(project, time, payload)
    parsed, measured = [], store.measured
    monkeypatch.setattr(sink, "measured", lambda rows, *limit: parsed.append(rows) or measured(rows, *limit))
    ingest = store.ingest_batch if sink is store else projects.ingest_projects
    assert ingest(events, str(tmp_path), 0).written == 90_000
    tasks = parsed[0].groupBy(F.spark_partition_id()).agg(F.sum(F.octet_length("payload")).alias("bytes")).collect()
    assert len(tasks) > 1 and max(row["bytes"] for row in tasks) < 60_000 * 74
    numbers = parsed[0].agg(F.min("_arrival"), F.max("_arrival"), F.count_distinct("_arrival")).first()
    assert tuple(numbers) == (0, 89_999, 90_000)


def test_only_wanted_days_are_listed(spark, events, tmp_path):
    root = str(tmp_path)
    filled(events, root)
    assert [p[-10:] for p in day_folders(spark, root, "2024-01-02", "2024-01-02T23:00Z")] == ["2024-01-02"]
    part = read_logs(spark, root, since="2024-01-02T12:00:00Z")
    assert part.count() == 36 and all("2024-01-01" not in f for f in part.inputFiles())
    assert read_logs(spark, root, since="2024-02-01").count() == 0
    assert read_batch(spark, root, 1).count() == 24
    assert read_batch(spark, root, 1, "2024-01-03").count() == 0


def test_batches_are_written_by_several_tasks(spark, tmp_path):
    """70 MB of bodies are three tasks' work, and the ids still follow receive time and arrival."""
    payload = F.concat(F.lit('{"n":'), F.col("id"), F.lit(',"m":"'), F.repeat(F.lit("x"), 70_000), F.lit('"}'))
    received = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id"))
    rows = spark.range(1000, numPartitions=4).select(payload.alias("payload"), received.alias("received_at"))
    assert store.ingest_batch(rows, str(tmp_path), 0).written == 1000
    stored = read_logs(spark, str(tmp_path)).select("id", F.get_json_object("body", "$.n").cast("int").alias("n")).orderBy("id").collect()
    assert [r["n"] for r in stored] == list(range(1000))
    assert len({r["id"] >> 26 for r in stored}) == 3


def test_duplicates(spark, events, tmp_path):
    root = str(tmp_path)
    ingest = lambda batch, *rows, **k: store.ingest_batch(events(*rows), root, batch, **k)
    same = {"m": "x"}
    assert ingest(0, (T0, same), (T0, same)).written == 2  # copies within a batch both stay
    mixed = ingest(1, (T0, same), (T0, {"m": "y"}))
    assert (mixed.written, mixed.deduplicated) == (1, 1)
    assert ingest(2, ("2024-01-01T10:00:04", same)).written == 1  # other time, other body
    alike = ingest(3, ("2024-01-01T10:00:08", same), exclude_received_at=True)
    assert alike.deduplicated == 1
    late = ingest(4, ("2024-01-01T10:00:20", same), exclude_received_at=True)
    assert late.written == 1
    counted = {(r["service"], r["level"]): r["count"] for r in log_counts(read_counts(spark, root)).collect()}
    assert counted == {("", ""): 5}


def test_limits_and_quarantine(spark, events, tmp_path):
    root = str(tmp_path)
    counts = store.ingest_batch(
        events((T0, {"pad": "x" * 500}), (T0, {"ok": 1}), (T0, "{broken"), (T0, "[1]")), root, 7, max_row_bytes=200
    )
    assert (counts.written, counts.oversized, counts.malformed) == (1, 1, 2)
    kept = spark.read.parquet(f"{root}/quarantine").orderBy("index").collect()
    assert [r["reason"] for r in kept] == ["oversized", "malformed", "malformed"]
    assert kept[0]["bytes"] > 500 and kept[1]["payload"] == "{broken"


def test_replay_replaces_the_batch(spark, events, tmp_path):
    root = str(tmp_path)
    rows = [(T0, {"i": i}) for i in range(50)]
    first = store.ingest_batch(events(*rows), root, 3)
    before = {r["body"] for r in stored(spark, root)}
    again = store.ingest_batch(events(*rows), root, 3)
    assert first == again and {r["body"] for r in stored(spark, root)} == before
    assert log_counts(read_counts(spark, root)).first()["count"] == 50


def test_ids_grow_with_batch_and_time(spark, events, tmp_path):
    root = str(tmp_path)
    for batch in range(3):
        rows = [(f"2024-01-0{batch + 1}T{h:02d}:00:00", {"h": h}) for h in (5, 3, 9, 1)]
        store.ingest_batch(events(*rows), root, batch)
    times = [r["received_at"] for r in stored(spark, root)]
    assert times == sorted(times) and len(times) == 12


def filled(events, root):
    for batch, day in enumerate(("2024-01-01", "2024-01-02", "2024-01-03")):
        rows = [(f"{day}T{h:02d}:00:00", {"service": "ab"[h % 2], "n": batch * 24 + h}) for h in range(24)]
        store.ingest_batch(events(*rows), root, batch)


def numbers(spark, root):
    got = read_logs(spark, root).select(F.get_json_object("body", "$.n").cast("int")).collect()
    return sorted(r[0] for r in got)


def test_purge_before(spark, events, tmp_path):
    root = str(tmp_path)
    filled(events, root)
    assert store.purge_before(spark, root, None) == 0
    assert store.purge_before(spark, root, "2024-01-02T06:00:00Z") == 30
    assert numbers(spark, root) == list(range(30, 72))
    assert not list(tmp_path.glob("logs/dt=2024-01-01/*"))
    assert store.purge_before(spark, root, "2024-01-02T06:00:00Z") == 0


def test_delete(spark, events, tmp_path):
    root = str(tmp_path)
    filled(events, root)
    with pytest.raises(ValueError):
        store.delete_where(spark, root)
    assert store.delete_where(spark, root, before="2024-01-02", service="a") == 12
    assert store.delete_where(spark, root, service="absent") == 0
    assert store.delete_where(spark, root, service="b") == 36
    assert numbers(spark, root) == list(range(24, 72, 2))
    # Counters never fall.
    assert sum(r["count"] for r in read_counts(spark, root).collect()) == 72


def test_readers_that_planned_before_keep_their_files(spark, events, tmp_path):
    root = str(tmp_path)
    filled(events, root)
    store.compact(spark, root, "2024-01-02")
    planned = read_logs(spark, root)
    planned.explain()
    assert store.delete_where(spark, root, service="b", grace_seconds=3600) == 36
    assert store.purge_before(spark, root, "2024-01-02", grace_seconds=3600) == 12
    assert planned.count() == 72 and numbers(spark, root) == list(range(24, 72, 2))
    store.sweep(spark, root, 3600)
    assert planned.count() == 72
    store.sweep(spark, root)
    assert numbers(spark, root) == list(range(24, 72, 2))
    assert not list(tmp_path.glob("logs/dt=*/batch=*")) and len(list(tmp_path.glob("logs_kept/gen=*/dt=*"))) == 2


def test_purge_excess(spark, events, tmp_path):
    root = str(tmp_path)
    filled(events, root)
    assert store.purge_excess(spark, root, 100) == 0
    assert store.purge_excess(spark, root, 30) == 42
    assert numbers(spark, root) == list(range(42, 72))
    assert store.purge_excess(spark, root, 0) == 30
    assert numbers(spark, root) == []


def test_interrupted_rewrite_loses_nothing(spark, events, tmp_path, monkeypatch):
    root = str(tmp_path)
    filled(events, root)
    real = store.remove

    def fails(*_):
        raise RuntimeError("executor host lost")

    monkeypatch.setattr(store, "remove", fails)
    with pytest.raises(RuntimeError):
        store.purge_before(spark, root, "2024-01-02T06:00:00Z")
    assert set(numbers(spark, root)) >= set(range(30, 72))
    monkeypatch.setattr(store, "remove", real)
    store.purge_before(spark, root, "2024-01-02T06:00:00Z")
    assert numbers(spark, root) == list(range(30, 72))


@pytest.mark.parametrize("step", ["write_note", "_log_writer", "_drop_replaced"])
def test_a_failure_at_any_step_loses_and_repeats_nothing(spark, events, tmp_path, monkeypatch, step):
    root = str(tmp_path)
    filled(events, root)
    store.compact(spark, root, "2024-01-01")
    real = getattr(store, step)

    def fails(*_):
        raise RuntimeError("host lost")

    monkeypatch.setattr(store, step, fails)
    with pytest.raises(RuntimeError):
        store.delete_where(spark, root, service="b")
    left = numbers(spark, root)
    assert left in (list(range(72)), list(range(0, 72, 2)))
    monkeypatch.setattr(store, step, real)
    store.delete_where(spark, root, service="b")
    assert numbers(spark, root) == list(range(0, 72, 2))
    store.sweep(spark, root)
    assert numbers(spark, root) == list(range(0, 72, 2))
    assert len(list(tmp_path.glob("logs_kept/gen=*/dt=*"))) == len({p.name for p in tmp_path.glob("logs_kept/gen=*/dt=*")})


def test_only_days_with_rows_to_delete_are_rewritten(spark, events, tmp_path):
    root = str(tmp_path)
    filled(events, root)
    untouched = sorted(tmp_path.glob("logs/dt=2024-01-03/*/*.parquet"))
    assert store.purge_before(spark, root, "2024-01-02T06:00:00Z") == 30
    assert sorted(tmp_path.glob("logs/dt=2024-01-03/*/*.parquet")) == untouched
    assert not list(tmp_path.glob("logs/dt=2024-01-0[12]"))


def test_a_batch_number_is_used_once(spark, events, tmp_path):
    root = str(tmp_path)
    store.ingest_batch(events((T0, {"i": 1})), root, 0)
    with pytest.raises(ValueError):
        store.ingest_batch(events((T0, {"i": 2})), root, 0)


def test_rewritten_files_have_bloom_filters(spark, events, tmp_path):
    root = str(tmp_path)
    filled(events, root)
    store.delete_where(spark, root, service="b")
    (file, *_) = tmp_path.glob("logs_kept/gen=*/dt=*/*.parquet")
    fresh = tmp_path / "plain"
    spark.read.parquet(str(file)).write.parquet(str(fresh))
    (plain, *_) = fresh.glob("*.parquet")
    assert file.stat().st_size > plain.stat().st_size + 100_000


def test_each_project_has_its_retention(spark, events, tmp_path):
    root = str(tmp_path)
    for project in ("p1", "p2"):
        filled(events, project_root(root, project))
    gone = store.purge_projects(spark, root, {"p1": 1, "p2": 0, "p3": 5}, "2024-01-03T12:00:00Z")
    assert gone == {"p1": 36, "p2": 0, "p3": 0}
    assert numbers(spark, project_root(root, "p2")) == list(range(72))
    for bad in ("", None, "../p1"):
        with pytest.raises(ValueError):
            project_root(root, bad)


def test_folding_counters_keeps_the_totals(spark, events, tmp_path):
    root = str(tmp_path)
    filled(events, root)
    totals = lambda: sorted(map(tuple, log_counts(read_counts(spark, root)).collect()))
    before = totals()
    store.fold_counts(spark, root, 1)
    assert totals() == before
    store.fold_counts(spark, root, 2)
    assert totals() == before
    assert read_counts(spark, root).count() == 2
    assert not list(tmp_path.glob("counts/batch=*")) and len(list(tmp_path.glob("counts_folded/batch=*"))) == 1
    store.ingest_batch(events(("2024-01-04T00:00:00", {"service": "a"})), root, 3)
    assert sum(t[2] for t in totals()) == 73


def test_kept_rows_ignore_absent_services(make_logs):
    rows = make_logs((T0, "a"), (T0, None))
    assert [r["id"] for r in kept_rows(rows, service="a").collect()] == [2]


@pytest.mark.parametrize("keep", [0, 1, 4, 999, 2500, 5000, 20_000])
def test_cutoff_rank_is_exact(spark, keep, monkeypatch):
    monkeypatch.setattr("loomlog.operators.retention.RANGES_PER_PASS", 16)
    monkeypatch.setattr("loomlog.operators.retention.DIRECT_ROWS", 8)
    ids = sorted({(i * 2654435761) % (1 << 50) for i in range(5000)} | {0, (1 << 62) + 1})
    rows = spark.createDataFrame([(i,) for i in ids], "id BIGINT")
    left = sorted(r["id"] for r in newest_rows(rows, keep).collect())
    assert left == (ids[-keep:] if keep else [])
    if keep >= len(ids):
        assert excess_cutoff(rows, keep) is None


def read_csv(path):
    (part,) = path.glob("part-*")
    with open(part, newline="", encoding="utf-8") as file:
        return list(csv.reader(file))


def test_csv_export(make_logs, tmp_path):
    bodies = ['=1+1', '+a', "-b", "@c", "\td", 'q"uote, comma', "line\nbreak", "cr\rhere", " padded ", "", "plain"]
    rows = make_logs(*[(T0, "s" if i else None, "info", "t", b) for i, b in enumerate(bodies)])
    export_csv(rows, str(tmp_path / "out"))
    table = read_csv(tmp_path / "out")
    assert table[0] == ["id", "received_at", "service", "level", "body"]
    want = ["'" + b if b[:1] in "=+-@\t" and b else b for b in bodies]
    assert [line[4] for line in table[1:]] == want
    assert table[1][:4] == ["1", "2024-01-01T10:00:00.000Z", "", "info"]
    export_csv(rows, str(tmp_path / "none"), service="absent")
    assert read_csv(tmp_path / "none") == [["id", "received_at", "service", "level", "body"]]


def test_ndjson_export(spark, make_logs, tmp_path):
    rows = make_logs((T0, "a", None, None, '{"x":"é\\n"}'), (T0, "b"), (T0, "a"))
    export_ndjson(rows, str(tmp_path / "out"), service="a", limit=5)
    (part,) = (tmp_path / "out").glob("part-*")
    lines = [json.loads(line) for line in part.read_text().splitlines()]
    assert [tuple(line) for line in lines] == [ROW_COLUMNS] * 2
    assert lines[0] == {"id": 1, "received_at": "2024-01-01T10:00:00.000Z", "service": "a", "level": None,
                        "trace_id": None, "body": '{"x":"é\\n"}'}
    export_everything(rows, str(tmp_path / "all"))
    parts = sorted((tmp_path / "all").glob("part-*"))
    ids = [json.loads(line)["id"] for part in parts for line in part.read_text().splitlines()]
    assert ids == [1, 2, 3]
