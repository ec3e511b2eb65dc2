"""A bigram model by deleted interpolation, and the log probability of every document under it.

Tokens travel as packed arrays: documents are gathered into blocks of one role, each block sends the
hashes of its distinct words and word pairs with their counts to hash ranges, and gets the corpus
counts back in the same order.  Nothing but the mixture weights passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.llm.common import staged, text_of

#: Tokens a block is meant to hold, and keys a hash range is meant to get.
BLOCK_TOKENS = 1_500_000
RANGE_KEYS = 2_000_000
#: Roles of a document: its counts make the estimates, the weights, or nothing.
ESTIMATE, DELETED, HELD_OUT = 0, 1, 2
#: Smoothing of the base model.
BASE_ADD = 0.1
#: EM stops when the mean log likelihood of the deleted part gains less, or after so many rounds.
EM_GAIN, EM_ROUNDS = 1e-7, 200
#: Estimates are told apart by eighths of a power of two when weights are learned.
STEPS = 8
NONE = -10_000

BLOCK_SCHEMA = (
    "block long, role int, doc_ids array<long>, lengths binary, words binary, seq binary, n_keys long"
)


class _Local(dict):
    """Numbers words in order of their first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (doc_id, role, text) as blocks of one role each."""
    number = TaskContext.get().partitionId() << 32
    held: dict[int, list] = {role: [] for role in (ESTIMATE, DELETED, HELD_OUT)}
    local = {role: _Local({b"": 0}) for role in held}
    size = dict.fromkeys(held, 0)

    def flush(role: int) -> pa.RecordBatch:
        nonlocal number
        ids, seqs = zip(*held[role], strict=True)
        words = np.array([xxhash.xxh64_intdigest(word) for word in local[role]], np.uint64)
        lengths = np.array([len(seq) for seq in seqs], np.uint32)
        row = {
            "block": number, "role": role, "doc_ids": list(ids), "lengths": lengths.tobytes(),
            "words": words.tobytes(), "seq": np.concatenate(seqs).tobytes(), "n_keys": len(words) + size[role],
        }
        number += 1
        held[role], local[role], size[role] = [], _Local({b"": 0}), 0
        return pa.RecordBatch.from_pylist([row], BLOCK_ARROW)

    for batch in batches:
        for doc_id, role, raw in zip(*batch.columns, strict=True):
            role = role.as_py()
            tokens = raw.as_buffer().to_pybytes().lower().split()
            tokens.append(b"")
            seq = np.fromiter(map(local[role].__getitem__, tokens), np.uint32, len(tokens))
            held[role].append((doc_id.as_py(), seq))
            size[role] += len(seq)
            if size[role] >= BLOCK_TOKENS:
                yield flush(role)
    for role in held:
        if held[role]:
            yield flush(role)


BLOCK_ARROW = pa.schema(
    [("block", pa.int64()), ("role", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.binary()),
     ("words", pa.binary()), ("seq", pa.binary()), ("n_keys", pa.int64())]
)


def _pairs(words: np.ndarray, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per token the word before it (the end mark at a document's start) and the pair's hash."""
    before = np.empty_like(seq)
    before[0] = 0
    before[1:] = seq[:-1]
    mixed = words[before] * np.uint64(0x9E3779B97F4A7C15) ^ (words[seq] >> np.uint64(29) | words[seq] << np.uint64(35))
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return before, mixed ^ mixed >> np.uint64(31)


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row["words"], np.uint64), np.frombuffer(row["seq"], np.uint32)


def count_keys(blocks: DataFrame, ranges: int) -> DataFrame:
    """(block, role, pair, part, total, estimate): corpus counts of each block's sorted keys.

    ``total`` counts all training documents, ``estimate`` (for deleted blocks) those that make the
    estimates.  A block sends a key once however often it has it, so no key is hot.  The first
    row of each range of words also has the training tokens and distinct words of the range.
    """
    edges = np.arange(1, ranges, dtype=np.float64) * (2.0**64 / ranges)
    edges = np.array([int(x) for x in edges], np.uint64)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                words, seq = _unpack(row)
                order = np.argsort(words)
                ones = np.bincount(seq, minlength=len(words)).astype(np.uint32)
                twos, counts = np.unique(_pairs(words, seq)[1], return_counts=True)
                for pair, keys, n in ((False, words[order], ones[order]), (True, twos, counts.astype(np.uint32))):
                    cuts = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
                    out = [
                        {"block": row["block"], "role": row["role"], "pair": pair, "part": part,
                         "keys": keys[a:b].tobytes(), "counts": n[a:b].tobytes()}
                        for part, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))
                    ]
                    yield pa.RecordBatch.from_pylist(out, CELL_ARROW)

    sent = blocks.select("block", "role", "words", "seq").mapInArrow(
        cells, "block long, role int, pair boolean, part int, keys binary, counts binary"
    )
    return sent.groupBy("pair", "part").applyInArrow(
        _sum_range,
        "block long, role int, pair boolean, part int, wide boolean, total binary, estimate binary, tokens long, distinct long",
    )


CELL_ARROW = pa.schema(
    [("block", pa.int64()), ("role", pa.int32()), ("pair", pa.bool_()), ("part", pa.int32()),
     ("keys", pa.binary()), ("counts", pa.binary())]
)


def _sum_range(table: pa.Table) -> pa.Table:
    """Add up the counts of one hash range and hand every block its keys' sums.

    Sums are exact 64-bit numbers; a range in which all fit in 32 bits is sent in 32.
    """
    keys = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["keys"]]
    counts = [np.frombuffer(x.as_buffer(), np.uint32) for x in table["counts"]]
    roles, sizes = table["role"].to_numpy(), np.array([len(k) for k in keys])
    distinct, which = np.unique(np.concatenate(keys), return_inverse=True)
    role, n = np.repeat(roles, sizes), np.concatenate(counts)
    estimate, deleted = (
        np.bincount(which[role == r], n[role == r], len(distinct)).astype(np.uint64) for r in (ESTIMATE, DELETED)
    )
    total = estimate + deleted
    wide = bool(total.max(initial=0) >= 1 << 32)
    sent, chosen = total.astype(_width(wide)), estimate.astype(_width(wide))
    stops = np.cumsum(sizes)
    spans = [which[stop - size : stop] for size, stop in zip(sizes.tolist(), stops.tolist(), strict=True)]
    words = not table["pair"][0].as_py()
    facts = [[int(x) if i == 0 and words else 0 for i in range(len(spans))] for x in (total.sum(dtype=np.int64), (total > 0).sum())]
    return pa.table(
        {
            "block": table["block"], "role": table["role"], "pair": table["pair"], "part": table["part"],
            "wide": pa.array([wide] * len(spans), pa.bool_()),
            "total": pa.array([sent[s].tobytes() for s in spans], pa.binary()),
            "estimate": pa.array(
                [chosen[s].tobytes() if r == DELETED else b"" for s, r in zip(spans, roles, strict=True)], pa.binary()
            ),
            "tokens": pa.array(facts[0], pa.int64()), "distinct": pa.array(facts[1], pa.int64()),
        }
    )


def _width(wide: bool) -> type:
    return np.uint64 if wide else np.uint32


def _answered(blocks: DataFrame, counted: DataFrame) -> DataFrame:
    """Each block with the counts of its keys, range by range."""
    answers = counted.groupBy("block").agg(F.collect_list(F.struct("pair", "part", "wide", "total", "estimate")).alias("answers"))
    return blocks.join(answers, "block")


def _answers(row: dict, field: str) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the block's words by local number, and of its sorted pairs."""
    parts = sorted(row["answers"], key=lambda a: (a["pair"], a["part"]))
    ones, twos = (
        np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(a[field], _width(a["wide"])).astype(np.int64) for a in parts if a["pair"] == pair]])
        for pair in (False, True)
    )
    by_word = np.empty_like(ones)
    by_word[np.argsort(np.frombuffer(row["words"], np.uint64))] = ones
    return by_word, twos


def context_bucket(counts: np.ndarray) -> np.ndarray:
    """0 for contexts never seen, else one more than the whole part of log2 of the count."""
    return np.where(counts > 0, np.floor(np.log2(np.maximum(counts, 1))).astype(np.int64) + 1, 0)


def _estimates(row: dict, field: str, seq: np.ndarray, before: np.ndarray, pair: np.ndarray, n: int):
    """Context bucket and the two maximum-likelihood estimates of tokens."""
    ones, twos = _answers(row, field)
    context, word = ones[before].astype(float), ones[seq].astype(float)
    second = np.divide(twos[pair], context, out=np.zeros(len(seq)), where=context > 0)
    return context_bucket(ones[before]), second, word / max(n, 1), ones[seq]


def _step(estimate: np.ndarray) -> np.ndarray:
    """The estimate's power of two in eighths; ``NONE`` for zero."""
    known = np.log2(estimate, out=np.zeros(len(estimate)), where=estimate > 0)
    return np.where(estimate > 0, np.rint(known * STEPS).astype(np.int64), NONE)


def held_out_cells(answered: DataFrame, n_estimate: int) -> DataFrame:
    """How many tokens of the deleted part have each context bucket and pair of estimates.

    At most a few hundred steps for each estimate and one bucket per power of two: the size does
    not grow with the corpus.
    """

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                words, seq = _unpack(row)
                before, hashes = _pairs(words, seq)
                pair = np.unique(hashes, return_inverse=True)[1]
                bucket, second, first, _ = _estimates(row, "estimate", seq, before, pair, n_estimate)
                cell, n = np.unique(np.stack([bucket, _step(second), _step(first)]), axis=1, return_counts=True)
                columns = [pa.array(x.astype(np.int64)) for x in (*cell, n)]
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "second", "first", "n"])

    found = answered.mapInArrow(cells, "bucket long, second long, first long, n long")
    return found.groupBy("bucket", "second", "first").agg(F.sum("n").alias("n"))


def learn_weights(cells: list[tuple[int, int, int, int]], distinct: int) -> dict[int, np.ndarray]:
    """Weights of pair, word and uniform estimate per context bucket, by expectation-maximisation."""
    weights = {}
    table = np.array(cells, np.int64).reshape(-1, 4)
    for bucket in np.unique(table[:, 0]).tolist():
        rows = table[table[:, 0] == bucket]
        parts = np.stack(
            [np.where(rows[:, k] == NONE, 0.0, 2.0 ** (rows[:, k] / STEPS)) for k in (1, 2)] + [np.full(len(rows), 1 / (distinct + 1))]
        )
        n, mix, reached = rows[:, 3].astype(float), np.full(3, 1 / 3), -np.inf
        for _ in range(EM_ROUNDS):
            joint = mix[:, None] * parts
            whole = joint.sum(axis=0)
            gain = float((n * np.log(whole)).sum() / n.sum())
            mix = (joint / whole * n).sum(axis=1) / n.sum()
            if gain - reached < EM_GAIN:
                break
            reached = gain
        weights[bucket] = mix
    return weights


def _weight_table(weights: dict[int, np.ndarray]) -> np.ndarray:
    """A row per bucket up to 64; buckets the deleted part lacks take the nearest below, or above."""
    known = sorted(weights)
    default = np.array([0.4, 0.5, 0.1])
    rows = [weights[max([k for k in known if k <= b], default=known[0])] if known else default for b in range(65)]
    return np.maximum(np.array(rows), 1e-6) / np.maximum(np.array(rows), 1e-6).sum(axis=1, keepdims=True)


def score_documents(docs: DataFrame) -> DataFrame:
    """Score every row of ``docs`` (doc_id, text) under a bigram model of the training rows.

    Rows with crc32(doc_id as text) mod 10 = 0 are held out; null ids count as the empty text.  Of
    the others, those whose crc32 has 0 as its second-last digit are the deleted part: the weights
    are learned on them by EM against estimates from the rest, one set for each power of two of
    the context's frequency; the scores then use the estimates from all training rows.
    Words are runs between ASCII white space, A-Z lower-cased; an end mark closes each text and is
    the context of its first word.  Null texts are empty.

    Columns: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).
    """
    check = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    role = F.when(check % 10 == 0, HELD_OUT).when((check / 10).cast("long") % 10 == 0, DELETED).otherwise(ESTIMATE)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), role.cast("int").alias("role"), text_of().cast("binary").alias("text"))
    blocks = staged(texts.mapInArrow(_blocks, BLOCK_SCHEMA), "blocks")
    keys = blocks.agg(F.coalesce(F.sum("n_keys"), F.lit(0))).first()[0]
    counted = staged(count_keys(blocks, max(1, -(-keys // RANGE_KEYS))), "counts")
    corpus = counted.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n"), F.coalesce(F.sum("distinct"), F.lit(0)).alias("v")).first()
    n, distinct = int(corpus.n), int(corpus.v)
    sized = blocks.filter(F.col("role") == ESTIMATE).agg(F.coalesce(F.sum(F.octet_length("seq")), F.lit(0))).first()[0] // 4
    deleted = _answered(blocks.filter(F.col("role") == DELETED), counted.filter(F.col("role") == DELETED))
    cells = [tuple(r) for r in held_out_cells(deleted, sized).collect()]
    weights = _weight_table(learn_weights(cells, distinct))

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield _scored(batch.slice(i, 1).to_pylist()[0], weights, n, distinct)

    return _answered(blocks, counted).mapInArrow(
        scores,
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )


def _scored(row: dict, weights: np.ndarray, n: int, distinct: int) -> pa.RecordBatch:
    words, seq = _unpack(row)
    before, hashes = _pairs(words, seq)
    pair = np.unique(hashes, return_inverse=True)[1]
    bucket, second, first, seen = _estimates(row, "total", seq, before, pair, n)
    mix = weights[bucket]
    model = np.log10(mix[:, 0] * second + mix[:, 1] * first + mix[:, 2] / (distinct + 1))
    base = np.log10((seen + BASE_ADD) / (n + BASE_ADD * (distinct + 1)))
    lengths = np.frombuffer(row["lengths"], np.uint32).astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    held_out = np.full(len(lengths), row["role"] == HELD_OUT)
    known = np.add.reduceat((seen > 0).astype(np.int64), starts)
    columns = [
        pa.array(row["doc_ids"], pa.int64()), pa.array(held_out), pa.array(lengths), pa.array(known),
        pa.array(np.full(len(lengths), n, np.int64)), pa.array(np.add.reduceat(base, starts)),
        pa.array(np.add.reduceat(model, starts)),
    ]
    return pa.RecordBatch.from_arrays(
        columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    )
