"""Hourly counts of a store: the same figures as its rows give, and little read for them."""

import json
import random

import pytest
from pyspark.sql import functions as F

from loomlog.operators import rollups as ops
from loomlog.operators.aggregates import anomaly, count_logs, histogram, summarize
from loomlog.sinks import rollups, store
from loomlog.sources import rollups as sources
from loomlog.sources.store import read_logs
from tests.conftest import at

WINDOWS = [
    {},
    {"since": "2024-01-02T03:00:00Z"},
    {"until": "2024-01-03T04:00:00Z"},
    {"since": "2024-01-01T22:10:00.500Z", "until": "2024-01-03T01:00:00Z"},
    {"since": "2024-01-02T05:10:00Z", "until": "2024-01-02T05:40:00Z"},
    {"since": "2024-01-02T05:10:00Z", "until": "2024-01-02T06:10:00Z"},
    {"since": "2024-01-02T05:00:00Z", "until": "2024-01-02T05:00:00Z"},
    {"since": "2024-02-01", "until": "2024-02-02"},
]


def batch(spark, seed, day, n=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        minute = rng.choice([0, 0, 10, 59])
        moment = at(f"2024-01-{day + rng.randrange(3):02d}T{rng.randrange(24):02d}:{minute:02d}:00")
        body = {"service": rng.choice(["a", "b", None]), "level": rng.choice(["error", "info", None]), "i": f"{seed}-{i}"}
        rows.append((moment, json.dumps({k: v for k, v in body.items() if v is not None})))
    return spark.createDataFrame(rows, "received_at TIMESTAMP, payload STRING")


@pytest.fixture
def root(spark, tmp_path):
    path = str(tmp_path / "store")
    rollups.keep_rollup(spark, path)
    store.ingest_batch(batch(spark, 1, 1), path, 0)
    store.ingest_batch(batch(spark, 2, 3), path, 1)
    return path


def same(left, right):
    assert left.columns == right.columns
    rows = [sorted(map(tuple, df.collect()), key=repr) for df in (left, right)]
    assert rows[0] == rows[1]


def compare(spark, root):
    """A few windows after each change; ``test_same_figures_as_the_rows`` goes through all."""
    rows = read_logs(spark, root)
    for bounds in ({}, WINDOWS[3]):
        same(ops.histogram_stored(spark, root, "6h", by=("service",), **bounds), histogram(rows, "6h", by=("service",), **bounds))
    options = {"as_of": "2024-01-04T10:20:00Z", "window_minutes": 45, "by": ("service",)}
    same(ops.anomaly_stored(spark, root, **options), anomaly(rows, **options))


def test_same_figures_as_the_rows(spark, root):
    rows = read_logs(spark, root)
    for bounds in WINDOWS:
        same(ops.count_stored(spark, root, level="error", **bounds), count_logs(rows, level="error", **bounds))
    for bounds in (WINDOWS[0], WINDOWS[5]):
        same(ops.summarize_stored(spark, root, **bounds), summarize(rows, **bounds))
        same(ops.histogram_stored(spark, root, "6h", by=("service",), **bounds), histogram(rows, "6h", by=("service",), **bounds))
    asked = {"level": "error", "service": "a", "since": "2024-01-02T03:10:00Z"}
    for bucket in ("1h", "15m"):
        same(ops.histogram_stored(spark, root, bucket, **asked), histogram(rows, bucket, **asked))
    for options in ({"as_of": "2024-01-05T05:00:00Z"}, {"as_of": "2024-01-04T10:20:00Z", "window_minutes": 45}, {"as_of": "2024-03-01"}):
        same(ops.anomaly_stored(spark, root, **options), anomaly(rows, **options))


def test_figures_follow_upkeep(spark, root):
    store.purge_before(spark, root, "2024-01-01T12:30:00Z")
    store.delete_where(spark, root, service="b")
    store.compact(spark, root, "2024-01-04")
    store.ingest_batch(batch(spark, 3, 4), root, 2)
    store.delete_where(spark, root, before="2024-01-05T03:00:00Z", service="a", grace_seconds=3600)
    compare(spark, root)
    store.purge_before(spark, root, "2025-01-01")
    assert ops.count_stored(spark, root).first()["count"] == 0


def test_counts_of_what_was_stored_before(spark, tmp_path):
    root = str(tmp_path / "store")
    store.ingest_batch(batch(spark, 1, 1), root, 0)
    store.delete_where(spark, root, before="2024-01-01T12:00:00Z", service="a")
    store.ingest_batch(batch(spark, 2, 3), root, 1)
    compare(spark, root)  # from the rows
    rollups.keep_rollup(spark, root)
    assert sources.rollup_covers(spark, root)
    compare(spark, root)


def test_replay_and_empty_store(spark, tmp_path):
    root = str(tmp_path / "store")
    rollups.keep_rollup(spark, root)
    assert ops.count_stored(spark, root).first()["count"] == 0
    assert ops.histogram_stored(spark, root, "1d").count() == 0
    for _ in range(2):
        store.ingest_batch(batch(spark, 1, 1), root, 0)
    # A write that broke off before its commit is repeated: the part is replaced.
    rollups.write_rollup(read_logs(spark, root), root, "b0")
    compare(spark, root)


def test_counts_of_an_interrupted_generation_do_not_count(spark, root):
    rollups.write_rollup(read_logs(spark, root), root, "g7")
    read_logs(spark, root).limit(1).write.partitionBy("dt").parquet(f"{root}/logs_kept/gen=7")
    compare(spark, root)
    store.sweep(spark, root)
    compare(spark, root)


def test_only_the_border_days_are_read_as_rows(spark, root):
    counts = sources.hour_counts(spark, root, "2024-01-01T10:30:00Z", "2024-01-05T10:30:00Z")
    files = counts.inputFiles()
    as_rows = {f.split("/dt=")[1][:10] for f in files if "/logs/" in f}
    assert as_rows == {"2024-01-01", "2024-01-05"}
    days = {f.split("/dt=")[1][:10] for f in files if "/rollup/" in f}
    assert days == {f"2024-01-{n:02d}" for n in range(1, 6)}
    assert not any("/logs/" in f for f in sources.hour_counts(spark, root).inputFiles())
    assert "body" not in counts._jdf.queryExecution().executedPlan().toString()


def test_huge_counts_stay_whole_numbers(spark, tmp_path):
    root = str(tmp_path / "store")
    rollups.keep_rollup(spark, root)
    store.ingest_batch(batch(spark, 1, 1, 3), root, 0)
    row = spark.range(2).select(
        F.timestamp_seconds(F.lit(1704103200)).alias("hour"), F.lit("a").alias("service"), F.lit("error").alias("level"),
        F.lit(3_000_000_000).alias("count"), F.lit("2024-01-01").cast("date").alias("dt"), F.concat(F.lit("b"), "id").alias("part"),
    )
    row.write.mode("append").partitionBy("dt", "part").parquet(f"{root}/rollup")
    assert ops.count_stored(spark, root, service="a", level="error", until="2024-01-09").first()["count"] >= 6_000_000_000
