import pytest

from loomlog.operators import aggregates as agg
from loomlog.operators.counters import count_deltas, log_counts
from loomlog.operators.tenancy import over_quota, retained, retention_cutoff, with_plan
from loomlog.sinks.metrics import prometheus_lines, write_prometheus
from tests.conftest import at


def tuples(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture
def rows(make_logs):
    return make_logs(
        ("2024-01-01T10:00:00", "a", "error"),
        ("2024-01-01T10:04:59", "a", "error"),
        ("2024-01-01T10:05:00", "b", "error"),
        ("2024-01-02T00:00:00", None, None),
    )


def test_histogram(rows):
    assert tuples(agg.histogram(rows, "1d")) == [("2024-01-01T00:00:00Z", 3), ("2024-01-02T00:00:00Z", 1)]
    assert tuples(agg.histogram(rows, "5m", level="error")) == [
        ("2024-01-01T10:00:00Z", 2),
        ("2024-01-01T10:05:00Z", 1),
    ]
    assert tuples(agg.histogram(rows, "6h", since="2024-01-01T10:05:00Z", service="b")) == [
        ("2024-01-01T06:00:00Z", 1)
    ]
    assert tuples(agg.histogram(rows, "1h", level="absent")) == []
    with pytest.raises(ValueError):
        agg.histogram(rows, "2h")


def test_histogram_default_range(make_logs):
    rows = make_logs(("2024-01-01T00:00:00",), ("2024-01-08T12:00:00",), ("2024-01-09T12:00:00",))
    week = agg.recent_histogram(rows, "1d", as_of="2024-01-09")
    assert tuples(week) == [("2024-01-08T00:00:00Z", 1)]
    everything = agg.recent_histogram(rows, "1d", as_of="2024-01-09", since="2023-12-01")
    assert len(tuples(everything)) == 2


def test_summary_and_services(rows):
    assert tuples(agg.summarize(rows)) == [("a", "error", 2), (None, None, 1), ("b", "error", 1)]
    assert tuples(agg.summarize(rows, since="2024-01-01T10:05:00Z", until="2024-01-01T10:05:00Z")) == [
        ("b", "error", 1)
    ]
    assert tuples(agg.list_services(rows)) == [("a",), ("b",)]


def test_counts_are_not_capped(spark, make_logs):
    rows = make_logs(*[("2024-01-01T00:00:00", "a", "error", None, '{"m":"boom"}')] * 501)
    assert agg.count_logs(rows, service="a").first()[0] == 501
    assert agg.count_search(rows, "boom").first()[0] == 501


def test_alerts(make_logs):
    rows = make_logs(
        ("2024-01-01T11:00:00", "a", "error", None, '{"m":"boom"}'),
        ("2024-01-01T11:30:00", "a", "info", None, '{"m":"boom"}'),
        ("2024-01-01T12:00:01", "a", "error", None, '{"m":"boom"}'),
    )
    count = lambda **k: agg.alert_count(rows, as_of="2024-01-01T12:00:00Z", **k).first()[0]
    assert count() == 1
    assert count(minutes=59) == 0
    assert count(level=None) == 2
    assert count(query="boom", level="error") == 2
    assert count(service="b") == 0


def test_anomaly_classes(make_logs):
    as_of = "2024-01-09T12:00:00Z"

    def judged(*rows):
        return agg.anomaly(make_logs(*rows), as_of=as_of, window_minutes=60).first()

    quiet = judged(("2024-01-09T11:30:00", "a", "info"))
    assert (quiet["factor"], quiet["class"]) == (1.0, "normal")
    sudden = judged(("2024-01-09T11:30:00", "a", "error"))
    assert (sudden["recent_count"], sudden["factor"], sudden["class"]) == (1, None, "significant")
    border = judged(("2024-01-09T11:00:00", "a", "error"))
    assert (border["recent_count"], border["baseline_count"]) == (1, 1)
    later = judged(("2024-01-09T12:00:01", "a", "error"), ("2024-01-02T11:00:00", "a", "error"))
    assert (later["recent_count"], later["baseline_count"], later["class"]) == (0, 1, "normal")
    before = [("2024-01-05T00:00:00", "a", "error")] * 84
    mild = judged(*before, ("2024-01-09T11:30:00", "a", "error"))
    assert mild["factor"] == pytest.approx(2.0) and mild["class"] == "mild"
    assert mild["expected"] == pytest.approx(0.5)


def test_alert_and_anomaly_agree(make_logs):
    rows = make_logs(*[("2024-01-09T11:30:00", "a", "error")] * 3)
    as_of = "2024-01-09T12:00:00Z"
    assert agg.alert_count(rows, as_of=as_of).first()[0] == 3
    assert agg.anomaly(rows, as_of=as_of).first()["recent_count"] == 3


def test_counters_and_metrics(make_logs, tmp_path):
    deltas = count_deltas(make_logs(("2024-01-01T00:00:00", "a", "error"), ("2024-01-01T00:00:00",)))
    totals = log_counts(deltas.unionByName(deltas).unionByName(deltas.filter("service = 'a'")))
    assert tuples(totals) == [("a", "error", 3), ("", "", 2)]
    odd = totals.sparkSession.createDataFrame(
        [('q"s', "b\\s", 1), ("", "l\nf", 2)], "service STRING, level STRING, count BIGINT"
    )
    assert [r["value"] for r in prometheus_lines(odd).collect()] == [
        'logs_total{service="q\\"s",level="b\\\\s"} 1',
        'logs_total{service="unknown",level="l\\nf"} 2',
    ]
    write_prometheus(odd, str(tmp_path / "m"), "events_total")
    (part,) = (tmp_path / "m").glob("part-*")
    lines = part.read_text().splitlines()
    assert lines[0].startswith("# HELP events_total ") and lines[1] == "# TYPE events_total counter"
    assert len(lines) == 4


def test_plans(spark, make_logs):
    rows = make_logs(
        ("2024-01-01T00:00:00", "p1"), ("2024-01-09T00:00:00", "p1"), ("2024-01-01T00:00:00", "p2"),
        ("2024-01-01T00:00:00", "p3"), ("2024-01-01T00:00:00", None),
    ).withColumnRenamed("service", "project_id")
    plans = spark.createDataFrame(
        [("p1", 5, 10), ("p2", 0, 10)], "project_id STRING, retention_days INT, max_bytes BIGINT"
    )
    assert sorted(r["id"] for r in retained(rows, plans, "2024-01-10").collect()) == [2, 3, 4, 5]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        spread = with_plan(rows, plans).collect()
        assert sorted(r["id"] for r in retained(rows, plans, "2024-01-10").collect()) == [2, 3, 4, 5]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 * 1024 * 1024))
    assert sorted((r["id"], r["max_bytes"]) for r in spread if r["max_bytes"]) == [(1, 10), (2, 10), (3, 10)]
    usage = spark.createDataFrame(
        [("p1", "2024-01", 11, 1), ("p9", "2024-01", 99, 1)], "project_id STRING, month STRING, bytes BIGINT, lines BIGINT"
    )
    assert {r["project_id"]: r["over_limit"] for r in over_quota(usage, plans).collect()} == {"p1": True, "p9": False}
    assert retention_cutoff("2024-01-10", 0) is None
    assert retention_cutoff("2024-01-10", 9) == at("2024-01-01T00:00:00")
