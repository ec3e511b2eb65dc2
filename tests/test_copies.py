"""Streamed removal of copies by the exact rule, over restarts and with one dominating key."""

import random

import pytest
from pyspark.sql import functions as F

from loomlog.streaming.copies import drop_recent_copies
from tests.conftest import at

DDL = "id BIGINT, received_at TIMESTAMP, body_hash STRING"


def brute(batches, seconds=5.0):
    last, kept = {}, []
    for rows in batches:
        for i, t, key in sorted(rows, key=lambda r: (r[1], r[0])):
            if key not in last or (t - last[key]).total_seconds() > seconds:
                last[key] = t
                kept.append(i)
    return sorted(kept)


def batches(seed, n, keys):
    rng, out, i = random.Random(seed), [], 0
    start = at("2024-01-01T00:00:00")
    for part in range(3):
        rows = []
        for _ in range(n):
            moment = start.replace(minute=part, second=rng.randrange(60), microsecond=1000 * rng.randrange(5))
            rows.append((i, moment, rng.choice(keys)))
            i += 1
        out.append(rows)
    return out


class Runs:
    """Each batch is landed and taken by a query that starts anew from its checkpoint."""

    def __init__(self, spark, path):
        self.spark, self.path = spark, path

    def __call__(self, parts):
        for n, rows in enumerate(parts):
            self.spark.createDataFrame(rows, DDL).coalesce(1).write.mode("append").parquet(f"{self.path}/in")
            stream = self.spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(f"{self.path}/in")
            query = (
                drop_recent_copies(stream, lateness="5 minutes").writeStream.format("parquet").outputMode("append")
                .option("path", f"{self.path}/out").option("checkpointLocation", f"{self.path}/state")
                .trigger(availableNow=True).start()
            )
            query.awaitTermination()
        return sorted(r["id"] for r in self.spark.read.schema(DDL).parquet(f"{self.path}/out").collect())


@pytest.fixture
def run(spark, tmp_path):
    return Runs(spark, str(tmp_path))


def test_exact_rule_over_restarts(run):
    parts = batches(1, 60, ["a", "b", "c", None, "d"])
    assert run(parts) == brute(parts)


def test_half_of_the_rows_have_one_key(run, spark):
    parts = batches(2, 200, ["hot"] * 10 + [f"k{i}" for i in range(10)])
    assert run(parts) == brute(parts)


def test_a_dominating_key_is_spread_before_it_meets(spark, tmp_path):
    spark.createDataFrame([], DDL).write.parquet(f"{tmp_path}/in")
    stream = drop_recent_copies(spark.readStream.schema(DDL).parquet(f"{tmp_path}/in"))
    plan = stream._jdf.queryExecution().analyzed().toString()
    assert plan.index("TransformWithState") < plan.index("Deduplicate [body_hash")
    assert "received_at" in plan[plan.index("Deduplicate [") :].splitlines()[0]


def test_the_border_counts_as_near(run):
    times = ["2024-01-01T00:00:00", "2024-01-01T00:00:05", "2024-01-01T00:00:05.000001", "2024-01-01T00:00:10"]
    parts = [[(i, at(t), "x")] for i, t in enumerate(times)]
    assert run(parts) == [0, 2] == brute(parts)


def test_columns_stay(spark, tmp_path):
    rows = spark.createDataFrame([(1, at("2024-01-01T00:00:00"), "k", "extra")], DDL + ", more STRING")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in").withColumn("later", F.lit(2))
    assert drop_recent_copies(stream).columns == [*rows.columns, "later"]
