"""The plans Spark makes of the operators."""

import re

import pytest
from pyspark.sql import functions as F

import suite
from loomlog.operators.dedup import drop_recent_duplicates
from loomlog.operators.pages import get_log, query_logs
from loomlog.plans.predicates import log_filter
from loomlog.plans.skew import heavy_keys, lookup_join
from loomlog.sinks.store import ingest_batch
from loomlog.sources.store import read_logs
from suite.views import logs

SF = "/root/testdata/sf0.001"
suite.load()

# Queries that write and read back tables of their own are exercised by the store tests.
LAZY = [n for n in suite.QUERIES if not n.startswith(("store_", "stream_"))]


def plan_of(df) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


@pytest.mark.parametrize("name", LAZY)
def test_native_and_balanced(spark, name):
    plan = plan_of(suite.QUERIES[name](spark, SF))
    assert not re.search(r"PythonUDF|ArrowEvalPython|BatchEvalPython|MapInPandas", plan)
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin", plan)
    for window in re.findall(r"\) Window\n.*?Arguments: (.*?)\n\n", plan, re.S):
        assert re.search(r"\], \[[^\]]+\]", window), f"window without partition: {window}"


def test_filters_reach_the_scan(spark):
    plan = plan_of(logs(spark, SF).filter("received_at >= '2024-01-05'").select("id"))
    assert "GreaterThanOrEqual(ts" in plan
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp>" in plan


def test_counts_do_not_read_bodies(spark):
    plan = plan_of(suite.QUERIES["hist_1h"](spark, SF))
    assert "ReadSchema: struct<ts:timestamp>" in plan


def test_pages_are_top_k(spark):
    assert "TakeOrderedAndProject" in plan_of(query_logs(logs(spark, SF)))


def test_latest_row_limits_before_the_shuffle(spark):
    plan = plan_of(suite.QUERIES["latest_per_service"](spark, SF))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_days_are_pruned(spark, tmp_path):
    raw = logs(spark, SF).select("received_at", F.col("body").alias("payload"))
    ingest_batch(raw, str(tmp_path), 0)
    df = query_logs(read_logs(spark, str(tmp_path)), since="2024-01-10", until="2024-01-12")
    plan = plan_of(df)
    filters = re.search(r"PartitionFilters: \[(.*?)\]\n", plan).group(1)
    assert "2024-01-10" in filters and "2024-01-12" in filters
    whole = logs(spark, SF).filter("received_at BETWEEN '2024-01-10' AND '2024-01-12'")
    assert df.count() == min(100, whole.count()) > 0


def test_a_cursor_and_an_id_prune_batches(spark, tmp_path):
    raw = logs(spark, SF).select("received_at", F.col("body").alias("payload"))
    for batch in range(3):
        part = raw.filter(F.dayofmonth("received_at") % 3 == batch)
        ingest_batch(part, str(tmp_path), batch)
    stored = read_logs(spark, str(tmp_path))
    last = stored.orderBy(F.desc("id")).first()["id"]
    for df in (log_filter(stored, after_id=last - 1), get_log(stored, last)):
        filters = re.search(r"PartitionFilters: \[(.*?)\]\n", plan_of(df)).group(1)
        assert "batch" in filters and [r["id"] for r in df.collect()] == [last]


@pytest.fixture
def skewed(spark):
    """A third of the rows share one key, and some have none."""
    return spark.range(9000).selectExpr(
        "id", "timestamp_seconds(id) AS received_at",
        "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 100 = 1 THEN NULL ELSE concat('k', id % 2000) END AS key",
    )


def test_heavy_keys_are_few(skewed):
    (hot,) = heavy_keys(skewed, ["key"], 0.01).collect()
    assert hot["key"] == "hot" and 33 <= hot["_parts"] <= 36
    assert heavy_keys(skewed, ["key"], 0.5).count() == 0


def test_heavy_keys_are_spread_and_nothing_is_lost(spark, skewed):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        lookup = skewed.groupBy("key").agg(F.max("id").alias("top"))
        joined = lookup_join(skewed, lookup, ["key"], F.col("id"), share=0.01)
        got = joined.withColumn("p", F.spark_partition_id()).collect()
        plain = skewed.join(lookup, "key", "left").select("id", "top").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 * 1024 * 1024))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted((r["id"], r["top"]) for r in got) == sorted(map(tuple, plain)) != []
    per_task = {}
    for row in got:
        if row["key"] == "hot":
            per_task[row["p"]] = per_task.get(row["p"], 0) + 1
    assert len(per_task) > 8 and max(per_task.values()) < 600


def test_duplicates_under_skew(skewed):
    stored = skewed.filter("id < 300")
    fresh = drop_recent_duplicates(skewed, stored, seconds=100, keys=("key",))
    last = {}
    for row in stored.collect():
        if row["key"] is not None:
            last[row["key"]] = row["id"]
    want = sum(1 for r in skewed.collect() if r["key"] is None or last.get(r["key"], -(10**9)) < r["id"] - 100)
    assert fresh.count() == want
