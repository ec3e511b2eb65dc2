"""Does A follow B within a time: against plain loops, with ties, borders of blocks and a hot key."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from loomlog.operators.traces import correlate_within
from tests.conftest import at

START = at("2024-01-01T00:00:00")
DDL = "k STRING, received_at TIMESTAMP, kind STRING"


def brute(rows, within):
    found = {}
    for key in {r[0] for r in rows if r[0] is not None}:
        own = [r for r in rows if r[0] == key and r[1] is not None]
        lefts, rights = ([r[1] for r in own if r[2] and c in r[2]] for c in "lr")
        if not lefts and not rights:
            continue
        lags = [r - t for t in lefts for r in rights if timedelta(0) < r - t <= within]
        found[key] = (
            len(lefts),
            len(rights),
            sum(any(timedelta(0) < r - t <= within for r in rights) for t in lefts),
            sum(any(timedelta(0) < r - t <= within for t in lefts) for r in rights),
            min(lags) / timedelta(milliseconds=1) if lags else None,
        )
    return found


def run(spark, rows, seconds, **options):
    df = spark.createDataFrame(rows, DDL)
    found = correlate_within(df, F.col("k"), F.col("kind").contains("l"), F.col("kind").contains("r"), seconds, **options)
    return {r["key"]: tuple(r)[1:] for r in found.collect()}


@pytest.mark.parametrize("seconds, block", [(5, 60), (90, 10), (0.25, 1), (4000, 900)])
def test_as_by_loops(spark, seconds, block):
    rng = random.Random(seconds)
    rows = []
    for _ in range(700):
        key = rng.choice(["hot", "hot", "a", "b", "quiet", None])
        kind = rng.choice(["l", "r", "lr", "x", None]) if key != "quiet" else "x"
        moment = START + timedelta(milliseconds=250 * rng.randrange(8000)) if rng.random() > 0.02 else None
        rows.append((key, moment, kind))
    rows += rows[:50]
    assert run(spark, rows, seconds, block_seconds=block) == brute(rows, timedelta(seconds=seconds))


def test_borders_ties_and_empty(spark):
    def rows(*marks):
        return [("k", START + timedelta(seconds=s), kind) for s, kind in marks]

    assert run(spark, rows((0, "l"), (5, "r")), 5) == {"k": (1, 1, 1, 1, 5000.0)}
    assert run(spark, rows((0, "l"), (5.001, "r")), 5) == {"k": (1, 1, 0, 0, None)}
    assert run(spark, rows((0, "lr"), (0, "r"), (0, "l")), 5) == {"k": (2, 2, 0, 0, None)}
    assert run(spark, rows((5, "l"), (0, "r")), 60) == {"k": (1, 1, 0, 0, None)}
    assert run(spark, [], 5) == {}


def test_a_hot_key_goes_to_many_tasks_and_forms_no_pairs(spark):
    df = spark.range(20_000).select(
        F.lit("k").alias("k"), F.timestamp_seconds(F.lit(1704067200) + F.col("id")).alias("received_at"),
        F.when(F.col("id") % 2 == 0, "l").otherwise("r").alias("kind"),
    )
    found = correlate_within(df, F.col("k"), F.col("kind") == "l", F.col("kind") == "r", 3600)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert tuple(found.first())[1:] == (10_000, 10_000, 10_000, 10_000, 1000.0)
