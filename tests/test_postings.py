"""The text index of a store: same rows as the scan, few files, kept through upkeep."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from loomlog.operators import tokens
from loomlog.operators.pages import search_rows
from loomlog.sinks import postings, store
from loomlog.sources.postings import HEAD_STARTS, head_of, heads_of, is_covered
from loomlog.sources.store import read_logs
from tests.conftest import at

WORDS = ["alpha", "beta", "gamma", "delta", "épée", "zeta9", "99", "x1", "über", "alphabet", "日本"]
QUERIES = [
    "alpha", "alph*", "alpha beta", '"alpha beta"', "alpha NOT beta", "alpha OR zeta9", "b* NOT (99 OR x1)", "^msg", "epee",
    "NEAR(alpha beta, 2)", "z* AND u*", "nothing", "日*", "9*", "body : alpha", "-body : alpha",
]


def batch(spark, seed, day, n=120):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(WORDS) for _ in range(rng.randrange(7)))
        rows.append((at(f"2024-01-{day + i % 3:02d}T{i % 24:02d}:00:00"), json.dumps({"msg": text, "service": "ab"[i % 2], "i": f"{seed}-{i}"})))
    return spark.createDataFrame(rows, "received_at TIMESTAMP, payload STRING")


@pytest.fixture
def root(spark, tmp_path):
    path = str(tmp_path / "store")
    postings.index_store(spark, path)
    store.ingest_batch(batch(spark, 1, 1), path, 0)
    store.ingest_batch(batch(spark, 2, 3), path, 1)
    return path


def ids(df):
    return sorted(r["id"] for r in df.collect())


def compare(spark, root, **filters):
    logs = read_logs(spark, root)
    for query in QUERIES:
        expected = ids(search_rows(logs, query, **filters))
        assert ids(tokens.search_stored(spark, root, query, **filters)) == expected, query
        assert tokens.count_search_stored(spark, root, query, **filters).first()["count"] == len(expected), query
    assert any(ids(search_rows(logs, query)) for query in QUERIES)


def test_same_rows_as_the_scan(spark, root):
    compare(spark, root)


@pytest.mark.parametrize(
    "filters",
    [
        {"service": "a"},
        {"since": "2024-01-02"},
        {"since": "2024-01-02T05:00:00Z", "until": "2024-01-04T03:00:00Z"},
        {"after_id": (1 << 40) + 20, "service": "b"},
    ],
)
def test_same_rows_with_filters(spark, root, filters, monkeypatch):
    monkeypatch.setattr("tests.test_postings.QUERIES", QUERIES[:6])
    compare(spark, root, **filters)


def test_upkeep_keeps_the_index(spark, root, monkeypatch, tmp_path):
    monkeypatch.setattr("tests.test_postings.QUERIES", QUERIES[:7])
    store.delete_where(spark, root, service="a", before="2024-01-03T12:00:00Z")
    compare(spark, root)
    store.compact(spark, root, "2024-01-04")
    store.ingest_batch(batch(spark, 3, 2), root, 2)
    compare(spark, root)
    store.purge_excess(spark, root, 90)
    store.sweep(spark, root)
    compare(spark, root)
    store.purge_before(spark, root, "2024-02-01")
    store.sweep(spark, root)
    assert ids(tokens.search_stored(spark, root, "alpha")) == []
    assert not list((tmp_path / "store" / "tokens").glob("part=*/head=*/*.parquet"))


def test_a_replayed_batch_is_indexed_once(spark, root, monkeypatch):
    real = store.write_note

    def fails(*_):
        raise RuntimeError("host lost")

    monkeypatch.setattr(store, "write_note", fails)
    with pytest.raises(RuntimeError):
        store.ingest_batch(batch(spark, 4, 1), root, 2)
    monkeypatch.setattr(store, "write_note", real)
    store.ingest_batch(batch(spark, 4, 1), root, 2)
    monkeypatch.setattr("tests.test_postings.QUERIES", QUERIES[:3])
    compare(spark, root)


def test_an_existing_store_can_be_indexed_later(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "plain")
    store.ingest_batch(batch(spark, 1, 1), path, 0)
    store.ingest_batch(batch(spark, 2, 3), path, 1)
    store.delete_where(spark, path, service="b", before="2024-01-02")
    assert not is_covered(spark, path)
    monkeypatch.setattr("tests.test_postings.QUERIES", QUERIES[:7])
    compare(spark, path)
    real, calls = postings.write_postings, []

    def once(*args):
        if calls:
            raise RuntimeError("host lost")
        calls.append(args[2])
        real(*args)

    monkeypatch.setattr(postings, "write_postings", once)
    with pytest.raises(RuntimeError):
        postings.index_store(spark, path)
    assert not is_covered(spark, path)
    store.ingest_batch(batch(spark, 5, 2), path, 2)
    monkeypatch.setattr(postings, "write_postings", real)
    postings.index_store(spark, path)
    assert is_covered(spark, path)
    compare(spark, path)


def formatted(df):
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_only_the_heads_of_the_words_are_read(spark, root):
    for query, words in (("alpha", [("alpha", False)]), ("zet* OR beta", [("zet", True), ("beta", False)])):
        plan = formatted(tokens.count_search_stored(spark, root, query))
        (filters,) = [line for line in plan.splitlines() if "PartitionFilters" in line]
        heads = heads_of(words)
        wanted = f"(head#x = {heads[0]})" if len(heads) == 1 else f"head#x IN ({','.join(map(str, heads))})"
        assert wanted in re.sub(r"#\d+", "#x", filters)
        assert "body" not in plan and "EqualTo(token" in plan or "StringStartsWith(token" in plan


def test_rows_are_read_only_on_the_days_of_the_candidates(spark, root):
    found = tokens.search_stored(spark, root, '"delta gamma"')
    plan = formatted(found)
    assert "BroadcastHashJoin" in plan and "dynamicpruning" in plan


def test_common_words_scan_the_bodies(spark, root, monkeypatch):
    monkeypatch.setattr(tokens, "MAX_CANDIDATES", 5)
    monkeypatch.setattr("tests.test_postings.QUERIES", QUERIES[:4])
    compare(spark, root)
    plan = tokens.search_stored(spark, root, "alpha")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_heads_agree_and_keep_order(spark):
    words = sorted({*WORDS, *HEAD_STARTS, "0", "zz", "~", "a", "ab"})
    rows = spark.createDataFrame([(w,) for w in words], "w STRING").select("w", head_of(F.col("w")).alias("h")).collect()
    assert all(heads_of([(r["w"], False)]) == [r["h"]] for r in rows)
    ordered = [r["h"] for r in sorted(rows, key=lambda r: r["w"].encode())]
    assert ordered == sorted(ordered)
