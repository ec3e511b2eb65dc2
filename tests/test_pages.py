import pytest

from loomlog.functions.args import export_limit, page_limit, whole_number
from loomlog.functions.instants import check_iso, is_iso, to_instant
from loomlog.operators.pages import (
    export_logs,
    get_log,
    query_logs,
    search_logs,
    tail_cursor,
    tail_logs,
    trace_logs,
)
from loomlog.operators.traces import latest_per, trace_gaps
from loomlog.plans.predicates import for_project
from loomlog.sinks.exports import export_page
from tests.conftest import at


def ids(df):
    return [row["id"] for row in df.collect()]


@pytest.fixture
def rows(make_logs):
    return make_logs(
        ("2024-01-01T00:00:00", "a", "error", "t1", '{"m":"one"}'),
        ("2024-01-01T01:00:00", "b", "error", "t1", '{"m":"two"}'),
        ("2024-01-01T02:00:00", "a", "info", "t2", '{"m":"three"}'),
        ("2024-01-01T02:00:00", None, None, None, '{"m":"four"}'),
    )


def test_orders(rows):
    assert ids(query_logs(rows)) == [4, 3, 2, 1]
    assert ids(query_logs(rows, after_id=0)) == [1, 2, 3, 4]
    assert ids(query_logs(rows, after_id=2)) == [3, 4]
    assert ids(query_logs(rows, after_id=4)) == []


def test_filters(rows):
    assert ids(query_logs(rows, service="a")) == [3, 1]
    assert ids(query_logs(rows, level="error")) == [2, 1]
    assert ids(query_logs(rows, level="ERROR")) == []
    assert ids(query_logs(rows, since="2024-01-01T01:00:00Z", until="2024-01-01T01:00:00.000Z")) == [2]
    assert ids(query_logs(rows, since="2024-01-01T06:00:00+05:00")) == [4, 3, 2]
    assert ids(query_logs(rows, until="2024-01-01")) == [1]
    assert ids(query_logs(rows, service="", level="", since="", trace_id="")) == [4, 3, 2, 1]
    assert ids(query_logs(rows, service="a", trace_id="t1")) == [1]


def test_limits(spark):
    many = spark.range(1, 12_001).selectExpr(
        "id", "timestamp_seconds(id) AS received_at", "'s' AS service", "'info' AS level",
        "cast(null AS string) AS trace_id", "'{\"k\": \"word\"}' AS body",
    )
    assert query_logs(many).count() == 100
    assert query_logs(many, limit=9999).count() == 500
    assert query_logs(many, limit=0).count() == 0
    assert search_logs(many, "word").count() == 500
    assert tail_logs(many, 0).count() == 50
    assert export_logs(many).count() == 1000
    assert export_logs(many, limit=99_999).count() == 10_000
    assert export_page(many, -5).count() == 0
    assert ids(export_page(many, 2, since="1970-01-01T00:01:00Z")) == [60, 61]


def test_argument_helpers():
    assert [whole_number(v, 7) for v in ("12abc", " 3", "x", "-1", None, 5, 2**60, True)] == [12, 3, 7, 7, 7, 5, 7, 7]
    assert [page_limit(v) for v in (None, "501", "-3", "0")] == [100, 500, 100, 0]
    assert [export_limit(v) for v in (None, 0, "x", "20000", "-1", "15")] == [1000, 1000, 1000, 10_000, 0, 15]


def test_lookup_and_tail(rows):
    assert ids(get_log(rows, 3)) == [3]
    assert ids(get_log(rows, 99)) == []
    assert ids(trace_logs(rows, "t1")) == [1, 2]
    page = tail_logs(rows, 1, service="a")
    assert ids(page) == [3]
    assert tail_cursor(page, 1).first()["last_id"] == 3
    assert tail_cursor(tail_logs(rows, 4), 4).first()["last_id"] == 4
    assert ids(tail_logs(rows, 0, query="one OR three", level="nonsense")) == [1, 3]
    assert ids(tail_logs(rows, 1, query="one OR three")) == [3]


GOOD = ["2024-01-15", "2024-01-15T10:30", "2024-01-15T10:30Z", "2024-01-15T10:30:00", "2024-01-15T10:30:00Z",
        "2024-01-15T10:30:00.123Z", "2024-01-15T10:30:00+05:30", "2024-02-30"]
BAD = ["", "now", "2024", "2024-1-5", "2024-01-15 10:30", "2024-01-15T10", "2024-01-15T10:30:00.Z", "'; DROP--",
       "2024-01-15T10:30:00+0530", "2024-01-15Z", "2024-01-15\n", " 2024-01-15"]


def test_iso_shape(spark):
    frame = spark.createDataFrame([(v,) for v in GOOD + BAD], "v STRING")
    kept = {r["v"] for r in frame.filter(is_iso("v")).collect()}
    assert kept == set(GOOD)
    for value in GOOD:
        check_iso(value)
    for value in BAD:
        with pytest.raises(ValueError):
            check_iso(value)
    assert to_instant("2024-01-15T10:30:00+05:30") == at("2024-01-15T05:00:00")


def test_a_project_is_mandatory(rows):
    from pyspark.sql import functions as F

    tagged = rows.withColumn("project_id", F.when(F.col("id") < 3, "p1").otherwise("p2"))
    assert ids(for_project(tagged, "p1")) == [1, 2]
    for missing in (None, ""):
        with pytest.raises(ValueError):
            for_project(tagged, missing)


@pytest.mark.parametrize("block", [1, 2, 3, 1 << 20])
def test_gaps_do_not_depend_on_the_block(spark, block):
    frame = spark.range(40).selectExpr(
        "id", "timestamp_seconds(id * id) AS received_at", "concat('s', id % 3) AS service",
        "IF(id % 7 = 0, NULL, concat('t', id % 2)) AS trace_id",
    )
    got = {r["id"]: (r["gap_ms"], r["from_service"]) for r in trace_gaps(frame, block).collect()}
    last, want = {}, {}
    for i in range(40):
        if i % 7 == 0:
            continue
        before = last.get(i % 2)
        want[i] = (None, None) if before is None else ((i * i - before * before) * 1000.0, f"s{before % 3}")
        last[i % 2] = i
    assert got == want


def test_latest_row_per_service(rows):
    assert sorted(ids(latest_per(rows))) == [2, 3, 4]
