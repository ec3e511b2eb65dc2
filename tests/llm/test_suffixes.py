import hashlib
import random

import numpy as np
import pytest

from loomlog.llm import suffixes

from .cases import documents, empty, odd_docs


def brute(pairs):
    seen, out = {}, {}
    for doc_id, text in sorted(pairs):
        raw = (text or "").encode()
        mark = bytearray(len(raw))
        for i in range(len(raw) - 99):
            if seen.setdefault(raw[i : i + 100], (doc_id, i)) < (doc_id, i):
                mark[i : i + 100] = b"\x01" * 100
        kept = bytes(c for c, m in zip(raw, mark, strict=True) if not m)
        spans = sum(1 for i, m in enumerate(mark) if m and not (i and mark[i - 1]))
        out[doc_id] = (len(raw), sum(mark), spans, hashlib.sha256(kept).hexdigest())
    return out


def mixed(seed, n=40):
    """Texts cut from shared passages, with edits, runs of one letter and repeats of their own."""
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abcd éü") for _ in range(rng.randrange(60, 400))) for _ in range(6)]
    pairs = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            parts.append(p[a : a + rng.randrange(20, 400)])
            parts.append("".join(rng.choice("xyz") for _ in range(rng.randrange(0, 30))))
        if rng.random() < 0.2:
            parts.append("q" * rng.randrange(90, 260))
        pairs.append((i, "".join(parts)))
    return pairs


def check(spark, pairs):
    rows = suffixes.remove_repeats(documents(spark, pairs)).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows}
    assert got == brute(pairs)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in rows)


def test_equals_brute_force(spark):
    check(spark, mixed(1))


def test_large_groups_are_shuffled_on_with_the_same_result(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "GROUP", 1)
    check(spark, mixed(2))


def test_many_runs_ranges_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "PIECE", 700)
    monkeypatch.setattr(suffixes, "RUN_BYTES", 3000)
    monkeypatch.setattr(suffixes, "RANGE_BYTES", 4000)
    check(spark, mixed(3))


@pytest.mark.parametrize("n_runs", [1, 2, 3, 7])
def test_merge_of_packed_runs_is_the_sorted_whole(n_runs):
    rng = random.Random(n_runs)
    entries = [(bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 30))), 1, i, i, 0) for i in range(300)]
    runs = [suffixes.pack_run(sorted(entries[i::n_runs])) for i in range(n_runs)]
    merged = list(suffixes.merge_runs(runs))
    assert [e for _, e in merged] == sorted(entries)
    for (_, a), (shared, b) in zip(merged, merged[1:], strict=False):
        assert shared == suffixes.common_prefix(a[0], b[0])


def test_equal_windows_have_their_anchor_at_one_offset():
    rng = np.random.default_rng(5)
    core = rng.integers(97, 101, 300).astype(np.uint8)
    texts = [np.r_[rng.integers(97, 101, k).astype(np.uint8), core, rng.integers(97, 101, 50).astype(np.uint8)] for k in (0, 13, 77)]
    seen = {}
    for text in texts:
        for place, low, high, gram in zip(*suffixes.anchors(text, np.array([len(text)])), strict=True):
            for start in range(low, high + 1):
                assert seen.setdefault(text[start : start + 100].tobytes(), (place - start, gram)) == (place - start, gram)


def test_ranges_hold_equal_shares(spark):
    """Anchors have small hashes; the ranges of the order are of about one size all the same."""
    rng = random.Random(7)
    pairs = [(i, "".join(rng.choice("abcdefgh") for _ in range(3000))) for i in range(40)]
    keyed = suffixes._keyed(documents(spark, [*pairs, *[(i + 40, text) for i, text in pairs]]))
    runs = suffixes.sorted_runs(suffixes._packed(keyed).join(suffixes.repeated_grams(keyed), ["doc", "tid"]), 16)
    sizes = {r.part: r.size for r in runs.filter("run IS NOT NULL").groupBy("part").sum("size").toDF("part", "size").collect()}
    assert len(sizes) == 16 and max(sizes.values()) < 1.5 * sum(sizes.values()) / 16


def test_odd_rows(spark):
    rows = suffixes.remove_repeats(odd_docs(spark, clashing=True)).collect()
    assert len(rows) == 14
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[1].n_bytes == by[1].n_removed == 0
    assert by[8].n_removed == by[8].n_bytes and by[8].n_spans == 1 and by[7].n_removed == 0
    assert by[11].n_removed > 1500
    assert suffixes.remove_repeats(empty(spark)).count() == 0
