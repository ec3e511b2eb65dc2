import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from loomlog.llm import ngram

from .cases import documents, empty, odd_docs


def corpus():
    rng = random.Random(6)
    follow = {w: rng.sample(range(60), 4) for w in range(60)}
    pairs = []
    for i in range(300):
        w, out = rng.randrange(60), []
        for _ in range(rng.randrange(0, 60)):
            w = rng.choice(follow[w]) if rng.random() < 0.9 else rng.randrange(60)
            out.append(f"W{w}")
        pairs.append((i, " ".join(out)))
    return pairs


def brute(pairs):
    """Scores by direct counting, with the weights that EM on exact estimates gives."""
    rows = [(i, (t or "").encode().lower().split() + [b""], zlib.crc32(str(i).encode())) for i, t in pairs]
    train = [r for r in rows if r[2] % 10]
    deleted = [r for r in train if r[2] // 10 % 10 == 0]
    kept = [r for r in train if r[2] // 10 % 10]

    def counts(part):
        one = Counter(w for _, t, _ in part for w in t)
        two = Counter(p for _, t, _ in part for p in zip([b"", *t], t, strict=False))
        return one, two, sum(one.values())

    one, two, n = counts(train)
    return rows, one, two, n, counts(kept), deleted


def test_scores_equal_a_model_counted_directly(spark):
    pairs = corpus()
    got = {r.doc_id: r for r in ngram.score_documents(documents(spark, pairs)).collect()}
    rows, one, two, n, (e1, e2, en), deleted = brute(pairs)
    v = len(one)
    cells = Counter()
    for _, tokens, _ in deleted:
        for a, b in zip([b"", *tokens], tokens, strict=False):
            second = np.array([e2[a, b] / e1[a] if e1[a] else 0.0])
            first = np.array([e1[b] / en])
            cells[int(ngram.context_bucket(np.array([e1[a]]))[0]), int(ngram._step(second)[0]), int(ngram._step(first)[0])] += 1
    weights = ngram._weight_table(ngram.learn_weights([(*k, c) for k, c in sorted(cells.items())], v))
    for doc_id, tokens, crc in rows:
        row = got[doc_id]
        assert (row.held_out, row.n_tokens, row.train_tokens) == (crc % 10 == 0, len(tokens), n)
        assert row.n_known == sum(one[t] > 0 for t in tokens)
        base = sum(math.log10((one[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens)
        assert math.isclose(row.base_score, base, rel_tol=1e-9)
        score = 0.0
        for a, b in zip([b"", *tokens], tokens, strict=False):
            mix = weights[ngram.context_bucket(np.array([one[a]]))[0]]
            score += math.log10(mix[0] * (two[a, b] / one[a] if one[a] else 0) + mix[1] * one[b] / n + mix[2] / (v + 1))
        assert math.isclose(row.score, score, rel_tol=1e-6, abs_tol=1e-9)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > 1.1 * sum(r.base_score for r in held)  # both are negative


def test_block_and_range_sizes_change_nothing(spark, monkeypatch):
    docs = documents(spark, corpus())
    whole = {r.doc_id: tuple(r) for r in ngram.score_documents(docs).collect()}
    monkeypatch.setattr(ngram, "RANGE_KEYS", 50)
    parts = {r.doc_id: tuple(r) for r in ngram.score_documents(docs).collect()}
    for doc_id, row in whole.items():
        assert np.allclose(row[2:], parts[doc_id][2:], rtol=1e-9)


def test_odd_rows(spark):
    rows = ngram.score_documents(odd_docs(spark, clashing=True)).collect()
    assert len(rows) == 14 and all(r.score <= 0 and math.isfinite(r.score) for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2, 3)} == {1}
    assert ngram.score_documents(empty(spark)).count() == 0


def test_weights_by_em():
    cells = [(5, -8, -64, 900), (5, ngram.NONE, -64, 100)]
    mix = ngram.learn_weights(cells, 10**6)[5]
    assert math.isclose(mix.sum(), 1) and mix[0] > 0.85 and mix[1] > 0.05


def test_counts_beyond_32_bits():
    keys, many = np.array([7, 9], np.uint64), np.array([3_000_000_000, 2], np.uint32)
    cell = {"pair": False, "part": 0, "keys": keys.tobytes(), "counts": many.tobytes()}
    table = pa.Table.from_pylist([{"block": b, "role": ngram.ESTIMATE, **cell} for b in (0, 1)], ngram.CELL_ARROW)
    found = ngram._sum_range(table).to_pylist()
    assert [r["tokens"] for r in found] == [6_000_000_004, 0] and found[0]["distinct"] == 2
    by_word, _ = ngram._answers({"answers": [found[0]], "words": keys.tobytes()}, "total")
    assert by_word.tolist() == [6_000_000_000, 4]
    small = ngram._sum_range(pa.Table.from_pylist([{"block": 0, "role": ngram.ESTIMATE, **cell}], ngram.CELL_ARROW)).to_pylist()
    assert len(small[0]["total"]) == 8 and not small[0]["wide"]
