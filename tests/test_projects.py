"""One store for many projects: ingest, usage, and retention of all as one job."""

import json

import pytest
from pyspark.sql import functions as F

from loomlog.sinks import projects
from tests.conftest import at

DDL = "project_id STRING, received_at TIMESTAMP, payload STRING"


def events(spark, *rows):
    return spark.createDataFrame([(p, at(t), x if isinstance(x, str) else json.dumps(x)) for p, t, x in rows], DDL)


def held(spark, root, **bounds):
    rows = projects.read_projects(spark, root, **bounds).select("project_id", F.get_json_object("body", "$.i").cast("int").alias("i"))
    return sorted((r["project_id"], r["i"]) for r in rows.collect())


def day(n, hour=0):
    return f"2024-01-{n:02d}T{hour:02d}:00:00"


@pytest.fixture
def root(spark, tmp_path):
    path = str(tmp_path / "root")
    for batch in range(2):
        rows = [(p, day(d, h), {"i": 1000 * batch + 10 * d + h}) for p in ("p1", "p2", "p3") for d in range(1, 6) for h in (3, 9)]
        projects.ingest_projects(events(spark, *rows), path, batch)
    return path


def test_copies_are_those_of_the_same_project(spark, tmp_path):
    path = str(tmp_path / "root")
    first = projects.ingest_projects(events(spark, ("a", day(1), {"x": 1}), ("b", day(1), {"x": 1})), path, 0)
    assert first.written == 2
    again = projects.ingest_projects(events(spark, ("a", day(1), {"x": 1}), ("c", day(1), {"x": 1})), path, 1)
    assert (again.written, again.deduplicated) == (1, 1)


def test_refused_rows_keep_their_reason_and_a_replay_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "root")
    batch = events(spark, ("a", day(1), {"i": 1}), ("a", day(1), "{bad"), ("../x", day(1), {"i": 2}), (None, day(1), {"i": 3}), ("b", day(1), {"pad": "x" * 99}))
    real = projects.write_note

    def fails(*_):
        raise RuntimeError("host lost")

    monkeypatch.setattr(projects, "write_note", fails)
    with pytest.raises(RuntimeError):
        projects.ingest_projects(batch, path, 0, max_row_bytes=80)
    monkeypatch.setattr(projects, "write_note", real)
    counts = projects.ingest_projects(batch, path, 0, max_row_bytes=80)
    assert (counts.written, counts.oversized, counts.malformed) == (1, 1, 3)
    assert projects.ingest_projects(batch, path, 0, max_row_bytes=80) == counts
    assert held(spark, path) == [("a", 1)]
    reasons = [r["reason"] for r in spark.read.parquet(f"{path}/quarantine").collect()]
    assert sorted(reasons) == ["malformed", "oversized", "unknown project", "unknown project"]
    used = {r["project_id"]: (r["month"], r["lines"]) for r in projects.read_usage(spark, path).collect()}
    assert used == {"a": ("2024-01", 1), "b": ("2024-01", 0)}


def test_one_project_is_read_alone(spark, root):
    rows = projects.read_projects(spark, root, "p2", since=day(2), until=day(3, 5))
    plan = spark._jvm.PythonSQLUtils.explainString(rows._jdf.queryExecution(), "formatted")
    assert "project_id" in next(line for line in plan.splitlines() if "PartitionFilters" in line)
    assert held(spark, root, project_id="p2", since=day(2), until=day(3, 5)) == [("p2", 1000 * b + i) for b in (0, 1) for i in (23, 29, 33)]
    for bad in ("", "../p"):
        with pytest.raises(ValueError):
            projects.read_projects(spark, root, bad)


PLANS = [("p1", 2), ("p2", 0), ("p4", 5), ("p3", 1)]


def test_retention_of_all_projects_at_once(spark, root, tmp_path):
    plans = spark.createDataFrame(PLANS, "project_id STRING, retention_days INT")
    before = held(spark, root)
    deleted = {r["project_id"]: r["deleted"] for r in projects.retention_all(spark, root, plans, "2024-01-05T06:00:00Z").collect()}
    limit = {"p1": 36, "p2": 0, "p3": 46}
    expected = [(p, i) for p, i in before if i % 1000 >= limit[p]]
    assert held(spark, root) == expected
    assert deleted == {p: sum(q == p and i % 1000 < limit[p] for q, i in before) for p in ("p1", "p3")}
    again = {r["project_id"]: r["deleted"] for r in projects.retention_all(spark, root, plans, "2024-01-05T06:00:00Z").collect()}
    assert set(again.values()) <= {0} and held(spark, root) == expected
    projects.ingest_projects(events(spark, ("p1", day(1), {"i": 7777})), root, 2)
    assert ("p1", 7777) in held(spark, root)
    projects.sweep_projects(spark, root)
    assert held(spark, root) == sorted([*expected, ("p1", 7777)])
    assert not list(tmp_path.glob("root/rows/project_id=p1/dt=2024-01-02/batch=*"))
    later = {r["project_id"]: r["deleted"] for r in projects.retention_all(spark, root, plans, "2024-01-05T06:00:00Z").collect()}
    assert later["p1"] == 1 and held(spark, root) == expected
    assert sum(r["lines"] for r in projects.read_usage(spark, root).collect()) == 61


def test_only_border_days_are_read(spark, root, tmp_path):
    plans = spark.createDataFrame(PLANS, "project_id STRING, retention_days INT")
    due = projects._expiring(spark, root, plans, "2024-01-05T06:00:00Z")
    assert sorted((r["project_id"], str(r["dt"])) for r in due.filter("border").collect()) == [("p1", "2024-01-03"), ("p3", "2024-01-04")]
    plan = spark._jvm.PythonSQLUtils.explainString(projects.border_rows(spark, root, due)._jdf.queryExecution(), "formatted")
    assert all("dt#" in line for line in plan.splitlines() if "PartitionFilters" in line and "batch" not in line) and "dynamicpruning" in plan
    for file in tmp_path.glob("root/rows/project_id=p[13]/dt=2024-01-0[12]/*/*.parquet"):
        file.write_bytes(b"unreadable")
    assert len(projects.retention_all(spark, root, plans, "2024-01-05T06:00:00Z").collect()) == 2


def test_a_run_that_breaks_off_changes_nothing(spark, root, monkeypatch):
    plans, before, real = spark.createDataFrame(PLANS, "project_id STRING, retention_days INT"), held(spark, root), projects.write_note

    def fails(*_):
        raise RuntimeError("host lost")

    monkeypatch.setattr(projects, "write_note", fails)
    with pytest.raises(RuntimeError):
        projects.retention_all(spark, root, plans, "2024-01-05T06:00:00Z")
    assert held(spark, root) == before
    monkeypatch.setattr(projects, "write_note", real)
    projects.sweep_projects(spark, root)
    assert held(spark, root) == before
    projects.retention_all(spark, root, plans, "2024-01-05T06:00:00Z")
    assert len(held(spark, root)) < len(before)
