import random

import numpy as np
import pytest
import xxhash

from loomlog.llm import toxicity

from .cases import documents, empty, odd_docs

LABELS = "doc_id BIGINT, quality INT, toxic INT"


def brute_segments(scores):
    """Maximal segments by their definition: recursively the best segment, then left and right of it."""
    if not scores or max(s for _, s in scores) <= 0:
        return []
    best = None
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j][1]
            if best is None or total > best[0] + 1e-9:
                best = (total, i, j)
    total, i, j = best
    return brute_segments(scores[:i]) + [(scores[i][0], scores[j][0] + 1, total)] + brute_segments(scores[j + 1 :])


@pytest.mark.parametrize("seed", range(30))
def test_segments_are_the_maximal_ones(seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(toxicity, "GAP", -0.37)
    n = rng.randrange(1, 60)
    places = sorted(rng.sample(range(n), rng.randrange(0, n + 1) // 2))
    values = [rng.choice([0.31, 0.83, 1.7, 2.9]) + rng.random() / 100 for _ in places]
    whole = [(i, -0.37) for i in range(n)]
    for place, value in zip(places, values, strict=True):
        whole[place] = (place, value)
    got = toxicity.maximal_segments(places, values)
    expected = brute_segments(whole)
    assert [s[:2] for s in got] == [s[:2] for s in expected]
    assert [s[2] for s in got] == pytest.approx([s[2] for s in expected])


def labelled(seed=5, n=600):
    rng = random.Random(seed)
    pairs, marks = [], []
    for i in range(n):
        words = [f"word{min(int(rng.expovariate(0.02)), 400)}" for _ in range(rng.randrange(20, 80))]
        bad = i % 6 == 0
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["Vile!", "vilest", "filth,", "scorn"]))
        pairs.append((i, " ".join(words)))
        if i % 5:
            marks.append((i, 1, int(bad)))
    return pairs, marks


def test_held_out_documents_are_told_apart(spark):
    pairs, marks = labelled()
    rows = toxicity.score_documents(documents(spark, pairs), spark.createDataFrame(marks, LABELS)).collect()
    assert len(rows) == len(pairs)
    wrong = [r for r in rows if r.predicted != (r.doc_id % 6 == 0)]
    assert len(wrong) <= 6 and len([r for r in wrong if r.held_out]) <= 3
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert any(p.score > 0 for r in rows if r.predicted for p in r.passages)


def test_the_held_out_fold_teaches_nothing(spark):
    pairs, marks = labelled()
    docs = documents(spark, pairs)
    held = {r.doc_id for r in docs.select("doc_id").filter(toxicity.held_out()).collect()}
    flipped = [(i, q, 1 - t if i in held else t) for i, q, t in marks]
    a, b = (toxicity.fit(docs, spark.createDataFrame(m, LABELS)) for m in (marks, flipped))
    assert a.weights == b.weights and a[1:] == pytest.approx(b[1:])


def test_odd_rows(spark):
    pairs, marks = labelled(n=120)
    docs = odd_docs(spark, clashing=True)
    labels = spark.createDataFrame([(1, 1, 1), (4, 1, None), (None, 0, 1), (7, 1, 0), (7, 1, 0)], LABELS)
    rows = toxicity.score_documents(docs, labels).collect()
    assert len(rows) == 14 and len({r.score for r in rows if r.doc_id in (1, 2, 3)}) == 1
    assert toxicity.score_documents(empty(spark), labels).count() == 0
    assert toxicity.score_documents(docs, empty(spark, LABELS)).count() == 14
    left = toxicity.drop_toxic(docs, empty(spark, LABELS))
    assert left.columns == docs.columns and left.count() == 14


def test_drop_keeps_clean_documents(spark):
    pairs, marks = labelled()
    docs = documents(spark, pairs)
    left = {r.doc_id for r in toxicity.drop_toxic(docs, spark.createDataFrame(marks, LABELS)).collect()}
    clean = {i for i in range(600) if i % 6}
    assert len(clean - left) <= 3 and len(left - clean) <= 6


def test_rare_words_keep_their_weight_in_a_large_table(spark):
    """A word of 40 toxic texts and no clean one counts however many other toxic features there are."""
    counted = spark.range(8_000_000).selectExpr("concat('=w', id) AS feature", "1L AS toxic", "1L AS clean")
    own = spark.createDataFrame([("=vile", 40, 0), ("=vilest", 40, 0), ("vile-", 70, 1)], "feature string, toxic long, clean long")
    weights, rates = toxicity.weighted_features(counted.union(own))
    weight = weights.lookup()
    assert weight("=vile") > 1 and weight("=vilest") > 1 and weight("vile-") > 1 and rates.shape == (2, 3)
    assert weight("=w5") is None


@pytest.mark.parametrize("n", [0, 1, 2, 3, 1000])
def test_lookup_finds_every_weight_and_no_other(n):
    names = [f"=w{i}" for i in range(n)]
    hashes = np.array([xxhash.xxh64_intdigest(name.encode(), toxicity.SEED) for name in names], np.uint64).view(np.int64)
    weight = toxicity.Weights.of(hashes, np.arange(n, dtype=float)).lookup()
    assert [weight(name) for name in names] == list(range(n))
    assert all(weight(f"=x{i}") is None for i in range(1000))


def test_words_with_one_beginning_look_it_up_once():
    hashes = np.array([xxhash.xxh64_intdigest(name.encode(), toxicity.SEED) for name in ("=vile", "filt-", "filth-")], np.uint64).view(np.int64)
    weights = toxicity._Weights(toxicity.Weights.of(hashes, np.array([3.0, 1.5, 2.5])))
    asked, known = [], weights.known
    weights.known = lambda feature: asked.append(feature) or known(feature)
    assert [weights[f"filth{i}"] for i in range(100)] == [2.5] * 100
    assert [weights["Vile!"], weights["filter"], weights["other"], weights["!"]] == [3.0, 1.5, 0.0, 0.0]
    assert len(asked) == 107 and asked.count("filt-") == asked.count("filth-") == 1
