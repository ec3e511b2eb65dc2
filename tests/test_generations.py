"""Notes of generations are folded into snapshots: same rows, few files, nothing lost on the way."""

import json

import pytest
from pyspark.sql import functions as F

from loomlog.sinks import store
from loomlog.sources.store import GENERATIONS_DIR, folders, generations, note_names, read_logs, remove
from tests.conftest import at


def batch(spark, batch_id, days=(1, 2, 3)):
    rows = [(at(f"2024-01-{d:02d}T0{batch_id}:00:00"), json.dumps({"service": s, "i": f"{batch_id}-{d}-{s}"})) for d in days for s in "abcdef"]
    return spark.createDataFrame(rows, "received_at TIMESTAMP, payload STRING")


def names(spark, root):
    return sorted(r[0] for r in read_logs(spark, root).select(F.get_json_object("body", "$.i")).collect())


def expected(batches, gone="", days=(1, 2, 3)):
    return sorted(f"{b}-{d}-{s}" for b in batches for d in days for s in "abcdef" if s not in gone)


@pytest.fixture
def root(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "FOLD_NOTES", 2)
    path = str(tmp_path / "store")
    store.ingest_batch(batch(spark, 0), path, 0)
    return path


def test_rows_and_number_of_notes(spark, root):
    gone = ""
    for service in "abcd":
        store.delete_where(spark, root, service=service)
        gone += service
        assert names(spark, root) == expected([0], gone)
    store.sweep(spark, root)
    assert names(spark, root) == expected([0], gone)
    assert len(generations(spark, root)) <= 2 and note_names(spark, root)[0][0].startswith("folded-")
    # Batches and upkeep after a snapshot, on days it covers and on others.
    store.ingest_batch(batch(spark, 1, (2, 4)), root, 1)
    assert names(spark, root) == sorted(expected([0], gone) + expected([1], days=(2, 4)))
    store.delete_where(spark, root, service="e")
    store.compact(spark, root, "2024-01-02")
    store.sweep(spark, root)
    assert names(spark, root) == sorted(expected([0], gone + "e") + expected([1], "e", (2, 4)))
    store.purge_before(spark, root, "2025-01-01")
    store.sweep(spark, root)
    assert names(spark, root) == []


def test_covered_notes_go_and_dead_generations_too(spark, root):
    for service in "abc":
        store.delete_where(spark, root, service=service)
    store.sweep(spark, root)  # folds
    store.sweep(spark, root)  # removes what is covered
    assert note_names(spark, root)[1] == []
    live = {note["gen"] for note in generations(spark, root)}
    assert {int(name[4:]) for name in folders(spark, f"{root}/logs_kept")} <= live
    assert names(spark, root) == expected([0], "abc")


def test_a_snapshot_that_was_not_followed_by_its_removals(spark, root):
    """Covered notes beside a snapshot, and two snapshots, change nothing."""
    for service in "abcde":
        store.delete_where(spark, root, service=service)
    counted, covered = note_names(spark, root)
    assert covered and names(spark, root) == expected([0], "abcde")
    for name in covered:
        remove(spark, f"{root}/{GENERATIONS_DIR}/{name}")
    assert note_names(spark, root) == (counted, []) and names(spark, root) == expected([0], "abcde")


def test_grace_keeps_notes(spark, root):
    for service in "abc":
        store.delete_where(spark, root, service=service, grace_seconds=3600)
    store.sweep(spark, root, 3600)
    assert len(generations(spark, root)) == 3
    assert names(spark, root) == expected([0], "abc")


def test_a_batch_without_commit_stays_replaced(spark, root):
    """A batch that broke off before its commit and was rewritten by upkeep may be replayed after a snapshot."""
    store.ingest_batch(batch(spark, 1), root, 1)
    remove(spark, f"{root}/commits/{1:020d}.json")
    for service in "abc":
        store.delete_where(spark, root, service=service)
    store.sweep(spark, root)
    assert note_names(spark, root)[0][0].startswith("folded-")
    before = names(spark, root)
    store.append_rows(read_logs(spark, root).filter("false"), root, 1)
    store.ingest_batch(batch(spark, 1), root, 1)
    assert names(spark, root) == before == expected([0, 1], "abc")
