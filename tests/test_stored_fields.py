"""Field tests over the stored VARIANT column: same rows as over the bodies, and only members are read."""

import json

import pytest

from loomlog.operators.aggregates import latency_by_service, slow_requests
from loomlog.operators.pages import field_rows
from loomlog.sinks import store
from loomlog.sources.store import read_fields, read_logs
from tests.conftest import at

VALUES = [1, 2.5, "2", "abc", True, None, {"z": 1, "a": 2}, [3, 1], "", "{", 10**18, "zz", [], {}]
SHAPES = [{"m": {"ms": v}} for v in VALUES] + [{"other": 1}, {"m": 5}, {"m.ms": 3}]


def batch(spark, day, copies=6):
    rows = [(at(f"2024-01-{day:02d}T{i % 24:02d}:00:00"), json.dumps({**s, "k": i, "service": "ab"[i % 2]})) for i, s in enumerate(SHAPES * copies)]
    return spark.createDataFrame(rows, "received_at TIMESTAMP, payload STRING")


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("fields") / "store")
    store.ingest_batch(batch(spark, 1), path, 0)
    store.keep_fields(spark, path)
    store.ingest_batch(batch(spark, 2), path, 1)
    store.delete_where(spark, path, service="b", before="2024-01-02T12:00:00Z")
    return path


def formatted(df):
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.mark.parametrize("types", ["ranked", "strict"])
@pytest.mark.parametrize("op", ["=", "!=", "<", ">="])
def test_same_rows_as_over_the_bodies(spark, root, op, types):
    kept, plain = read_fields(spark, root), read_logs(spark, root)
    assert "fields" in kept.columns and "fields" not in plain.columns
    for value in (2, 2.5, "2", "abc", "", "{", '{"z":1,"a":2}', "[3,1]", "|"):
        found = [sorted(r["id"] for r in field_rows(df, "m.ms", op, value, types=types).select("id").collect()) for df in (kept, plain)]
        assert found[0] == found[1], (op, value, types)


def test_the_plan_reads_members_and_no_body(spark, root):
    for op, value in (("<=", 3), ("=", "abc"), (">", "m")):
        plan = formatted(field_rows(read_fields(spark, root), "k", op, value).select("id"))
        scans = [line for line in plan.splitlines() if "ReadSchema" in line]
        assert scans and all("body" not in line and "fields:struct<" in line for line in scans), plan
    assert "body" in formatted(field_rows(read_logs(spark, root), "k", "<=", 3).select("id"))


def test_members_are_columns_of_the_files(spark, root):
    import glob

    import pyarrow.parquet as pq

    files = glob.glob(f"{root}/logs*/**/*.parquet", recursive=True)
    assert files
    for file in files:
        names = [pq.ParquetFile(file).schema.column(i).path for i in range(len(pq.ParquetFile(file).schema))]
        assert "fields.typed_value.k.typed_value" in names


def test_aggregates_take_the_column(spark, root):
    kept, plain = read_fields(spark, root), read_logs(spark, root)
    for df in (kept, plain):
        df.cache()
    assert [tuple(r) for r in latency_by_service(kept, "k").collect()] == [tuple(r) for r in latency_by_service(plain, "k").collect()]
    assert [r["id"] for r in slow_requests(kept, 50, "k").collect()] == [r["id"] for r in slow_requests(plain, 50, "k").collect()]
    for df in (kept, plain):
        df.unpersist()
    assert "body" not in formatted(latency_by_service(kept, "k"))


def test_a_broken_off_start_is_taken_up(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    store.ingest_batch(batch(spark, 1, 1), path, 0)
    real = store._replace_days

    def fails(*_):
        raise RuntimeError("host lost")

    monkeypatch.setattr(store, "_replace_days", fails)
    with pytest.raises(RuntimeError):
        store.keep_fields(spark, path)
    assert "fields" not in read_fields(spark, path).columns
    monkeypatch.setattr(store, "_replace_days", real)
    store.keep_fields(spark, path)
    store.keep_fields(spark, path)
    assert field_rows(read_fields(spark, path), "k", ">=", 0).count() == len(SHAPES)
