import re

import numpy as np
import pytest

import __spark_entry__ as entry
from loomlog.llm import mixture

from .cases import DOCS, empty, odd_docs

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes, share=1.5):
    """Target by source, by resharing what is above twice a source's size."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, full = share * sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in full]
        unit = left / sum(weight[s] for s in rest) if rest else 0
        over = [s for s in rest if weight[s] * unit > 2 * sizes[s]]
        if not over:
            return {**full, **{s: weight[s] * unit for s in rest}}
        for s in over:
            full[s] = 2 * sizes[s]
            left -= full[s]


def check(rows, docs, near):
    """Sizes and targets are exact; what is taken is near the target and at most twice the size."""
    size = {i: len(WORD.findall(t or "")) for i, (_, t, _) in enumerate(docs)}
    per = {}
    for i, (_, _, source) in enumerate(docs):
        per[source] = per.get(source, 0) + size[i]
    target = brute_targets(per)
    expected = sorted((d is not None, d or 0, size[i], per[s], round(target[s], 6)) for i, (d, _, s) in enumerate(docs))
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.size, r.source_size, round(r.target, 6)) for r in rows) == expected
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    got, sought = {}, {}
    for r in rows:
        key = (r.source_size, round(r.target, 6))
        got[key] = got.get(key, 0) + r.taken
    for s in per:
        key = (per[s], round(target[s], 6))
        sought[key] = sought.get(key, 0) + target[s]
    for key, n in sought.items():
        assert abs(got[key] - n) <= near * n + mixture.BLOCK, key


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def test_whole_table_twice(spark, documents):
    first, second = (entry.queries()["op12_source_mix"](spark, SF).collect() for _ in range(2))
    assert sorted(map(tuple, first)) == sorted(map(tuple, second))
    check(first, documents, 0.01)


def test_small_bins_shards_and_teams(spark, documents, monkeypatch):
    for name, value in {"BIN": 2000, "SHARD": 16, "GROUP": 3, "SPAN": 4, "HELD": 100}.items():
        monkeypatch.setattr(mixture, name, value)
    docs = [(i, t, f"s{i % 11}" if i % 3 else "hot") for i, t, _ in documents[:400]]
    frame = spark.createDataFrame([(i, t, None, s, 0) for i, t, s in docs], DOCS).repartition(7)
    check(mixture.taken(frame, block=32).collect(), docs, 0.02)


def test_the_mix_is_made_of_the_documents_blocks(spark, documents):
    docs = [(i, t, f"s{i % 4}") for i, t, _ in documents[:120]]
    frame = spark.createDataFrame([(i, t, None, s, 0) for i, t, s in docs], DOCS)
    rows, counts = mixture.mix(frame, block=16).collect(), {}
    words = {i: WORD.findall(t) for i, t, _ in docs}
    blocks = {}
    for r in rows:
        assert r.tokens == words[r.doc_id][r.part : r.part + len(r.tokens)]
        blocks.setdefault((r.shard, r.place), []).append(r)
        counts[r.doc_id] = counts.get(r.doc_id, 0) + len(r.tokens)
    assert all(len({(r.source, r.block) for r in parts}) == 1 and sum(len(r.tokens) for r in parts) <= 16 for parts in blocks.values())
    assert sum(sum(len(r.tokens) for r in parts) == 16 for parts in blocks.values()) >= 0.95 * len(blocks)
    assert counts == {r.doc_id: r.taken for r in mixture.taken(frame, block=16).collect() if r.taken}
    source = {i: s for i, _, s in docs}
    assert all(source[r.doc_id] == r.source for r in rows)


def test_permutations_are_permutations():
    for size in (1, 2, 3, 16, 17, 1000):
        for key in (0, 1, 2**63 + 5):
            got = mixture.permuted(np.arange(size), np.full(size, size), np.full(size, key, np.uint64))
            assert sorted(got.tolist()) == list(range(size))
    orders = [tuple(mixture.permuted(np.arange(50), np.full(50, 50), np.full(50, k, np.uint64))) for k in range(20)]
    assert len(set(orders)) == 20


def test_shards_follow_the_targets(spark):
    """Counts per shard are near what a multinomial draw gives, neither all alike nor far off."""
    sources = spark.createDataFrame([(0, 8000, 4000), (1, 2000, 1000), (2, 6384, 9000)], "rank long, slots long, blocks long")
    runs = mixture._fitted(mixture._draws(spark, sources, 7), sources).collect()
    total = {k: sum(r.n for r in runs if r.rank == k) for k in range(3)}
    assert total == {0: 8000, 1: 2000, 2: 6384}
    shares = [sum(r.n for r in runs if r.rank == 0 and r.shard == s) for s in range(4)]
    assert len(set(shares)) > 1 and all(abs(n - 2000) < 200 for n in shares)
    for k in range(3):
        places = sorted(p for r in runs if r.rank == k for p in range(r.first, r.first + r.n))
        assert places == list(range(total[k]))


def test_odd_and_empty_tables(spark):
    odd = odd_docs(spark, clashing=True)
    docs = [(r.doc_id, r.text, r.source) for r in odd.collect()]
    check(mixture.taken(odd).collect(), docs, 0.02)
    assert mixture.taken(empty(spark)).count() == 0
    blank = spark.createDataFrame([(1, None, None, None, 0), (2, " ", None, "s", 0)], DOCS)
    assert sorted(map(tuple, mixture.taken(blank).collect())) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_null_source_is_last_and_a_small_source_is_capped(spark):
    docs = [(i, "word " * n, s) for i, (n, s) in enumerate([(4000, "b"), (30, "a"), (2000, None), (1, "c"), (3000, "é"), (500, "Z")])]
    frame = spark.createDataFrame([(i, t, None, s, 0) for i, t, s in docs], DOCS)
    check(mixture.taken(frame, block=8).collect(), docs, 0.02)
