"""Benchmark passages in documents, found in a latent semantic space and checked word by word."""

from __future__ import annotations

import functools
import math
import re
import string
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomlog.llm.common import released, text_of

#: Hashed features, latent dimensions, and rows of the random sketch of all passages.
FEATURES, LATENT, SKETCH = 1 << 14, 128, 256
#: Singular values below this share of the largest count as that share.
FLOOR = 0.1
#: Bits of a word's hash that tell whether it is a word of the benchmark.
VOCABULARY_BITS = 24
#: Words of a block; passages are whole blocks, eight of them where the space is learned.
BLOCK, PASSAGE_BLOCKS = 8, 8
#: Least common subsequence of a copy; and of a paraphrase that has the answer too.
COPY, PARAPHRASE, ANSWER = 0.8, 0.6, 0.6
#: Bytes worked on at a time, and items of a benchmark searched for in one scan.
CHUNK_BYTES, ITEM_BLOCK = 1 << 19, 20_000
#: Items of one length whose words are counted at a time, and blocks of a stretch looked at as a whole first.
ITEM_SLICE, STRETCH = 256, 16

#: A word is a run of bytes that are neither ASCII white space nor ASCII punctuation, A-Z lower-cased.
_IN_WORD = np.ones(256, bool)
_IN_WORD[list(b" \t\n\x0b\x0c\r" + string.punctuation.encode())] = False
#: A random number per byte, the same for both cases of a letter.
_BYTE = np.random.default_rng(11).integers(1, 1 << 63, 256, np.uint64)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_BASE = 0x9E3779B97F4A7C15


@functools.lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse modulo 2**64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(CHUNK_BYTES + 1, base, np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps, dtype=np.uint64))
    return out[0], out[1]


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, place of its first byte) in texts laid end to end that begin at ``starts``.

    A word's hash is a polynomial in its bytes, taken from running sums over the whole input.  Long
    inputs are worked on in pieces, cut between words where a piece has a place to cut.
    """
    powers, inverse = _powers()
    hashes, places, at = [], [], 0
    first = np.zeros(len(data) + 1, bool)
    first[starts] = True
    while at < len(data):
        stop = min(at + CHUNK_BYTES, len(data))
        inside = _IN_WORD[data[at:stop]]
        if stop < len(data) and inside[-1] and not first[stop]:
            cut = np.flatnonzero(~inside | first[at:stop])
            if len(cut) and cut[-1] > 0:
                stop = at + int(cut[-1])
                inside = inside[: stop - at]
        edge = first[at:stop]
        begin = np.flatnonzero(inside & np.r_[True, ~inside[:-1] | edge[1:]])
        end = np.flatnonzero(inside & np.r_[~inside[1:] | edge[1:], True]) + 1
        n = stop - at
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data[at:stop]] * powers[:n], out=sums[1:])
        mixed = (sums[end] - sums[begin]) * inverse[begin]
        mixed ^= mixed >> np.uint64(32)
        hashes.append(mixed * np.uint64(0xD6E8FEB86659FD93))
        places.append(begin + at)
        at = stop
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(places)


class Words(NamedTuple):
    """Word hashes of a slice of rows, and where each row's words begin (and the end)."""

    hashes: np.ndarray
    first: np.ndarray

    def features(self, vocabulary: np.ndarray) -> np.ndarray:
        """Hashed feature of each word; ``FEATURES`` for words that are not the benchmark's."""
        known = vocabulary[(self.hashes >> np.uint64(64 - VOCABULARY_BITS)).astype(np.int64)]
        return np.where(known, (self.hashes >> np.uint64(50)).astype(np.int64), FEATURES)


def words_of(texts: list[bytes]) -> Words:
    sizes = np.array([len(text) for text in texts], np.int64)
    stops = np.cumsum(sizes)
    hashes, places = word_hashes(np.frombuffer(b"".join(texts), np.uint8), (stops - sizes)[sizes > 0])
    return Words(hashes, np.r_[0, np.searchsorted(places, stops)])


def _chunks(batches: Iterator[pa.RecordBatch], text_of_batch) -> Iterator[tuple[pa.RecordBatch, Words]]:
    """Rows in slices of about ``CHUNK_BYTES`` with their words; null texts are empty."""
    for batch in batches:
        start, size, held = 0, 0, []
        for i, text in enumerate(text_of_batch(batch)):
            held.append(text.as_buffer() or b"")
            size += len(held[-1])
            if size >= CHUNK_BYTES or i + 1 == batch.num_rows:
                yield batch.slice(start, i + 1 - start), words_of(held)
                start, size, held = i + 1, 0, []


def _binary_text(batch: pa.RecordBatch) -> pa.Array:
    return batch.column("text")


def _carried_text(batch: pa.RecordBatch) -> pa.Array:
    return batch.column("_row").field("text")


def _padded(words: Words, vocabulary: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Features in rows of ``width`` words, filled up with ``FEATURES``; each text's first row (and the end)."""
    sizes = np.diff(words.first)
    rows = -(-sizes // width)
    first = np.r_[0, np.cumsum(rows)]
    out = np.full(int(first[-1]) * width, FEATURES, np.int64)
    out[np.arange(len(words.hashes)) + np.repeat(first[:-1] * width - words.first[:-1], sizes)] = words.features(vocabulary)
    return out.reshape(-1, width), first


class Space(NamedTuple):
    """The benchmark's words as packed bits, and a vector per hashed feature.

    A passage is the sum of its words' vectors.
    """

    vocabulary: np.ndarray
    vectors: np.ndarray


def benchmark_words(benchmark: DataFrame) -> np.ndarray:
    """Which hashes are words of the benchmark: a table of fixed size, as packed bits."""
    table = np.zeros(1 << VOCABULARY_BITS, bool)
    for items in item_blocks(benchmark):
        for item in items:
            table[(np.array(item.words, np.uint64) >> np.uint64(64 - VOCABULARY_BITS)).astype(np.int64)] = True
    return np.packbits(table)


def document_frequencies(docs: DataFrame, words_known: np.ndarray) -> tuple[np.ndarray, int]:
    """How many documents have each hashed feature, and how many documents there are."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n, vocabulary = np.zeros(FEATURES + 1, np.int64), 0, np.unpackbits(words_known).view(bool)
        for rows, words in _chunks(batches, _binary_text):
            features = words.features(vocabulary)
            for at in range(0, rows.num_rows, 256):
                first = words.first[at : at + 257]
                has = np.zeros((len(first) - 1, FEATURES + 1), bool)
                has[np.repeat(np.arange(len(has)), np.diff(first)), features[first[0] : first[-1]]] = True
                seen += has.sum(axis=0)
            n += rows.num_rows
        found = np.flatnonzero(seen[:-1])
        columns = [pa.array(np.r_[found, -1]), pa.array(np.r_[seen[found], n])]
        yield pa.RecordBatch.from_arrays(columns, ["feature", "n"])

    rows = _texts(docs).mapInArrow(released(counts), "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    seen = np.zeros(FEATURES + 1)
    for row in rows.collect():  # one row per hashed feature at most
        seen[row.feature] = row.n
    return seen[:-1], int(seen[-1])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(text_of().cast("binary").alias("text"))


def learn_space(docs: DataFrame, benchmark: DataFrame) -> Space:
    """The latent space of the TF-IDF passages of all of ``docs``, by a randomised decomposition.

    Terms are the benchmark's words, weighted by their squared inverse document frequency.  One
    scan counts document frequencies; one multiplies the matrix of all passages from the left
    with a random sketch: every passage is added, with a random sign, to one of ``SKETCH`` rows.
    Each task adds up its own sketch, whose size depends on the features alone, and the sketches
    are summed row by row.  The singular vectors of the sum, which the driver takes, are those of
    the passages up to the sketch's error.  Vectors are scaled by the inverse singular values, the
    small ones taken as a share of the largest, as they are mostly the sketch's own noise.
    """
    known = benchmark_words(benchmark)
    seen, n = document_frequencies(docs, known)
    weight = np.log((n + 1) / (seen + 0.5)).clip(0) ** 2

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, vocabulary = np.zeros(SKETCH * FEATURES), np.unpackbits(known).view(bool)
        for _, words in _chunks(batches, _binary_text):
            features, _ = _padded(words, vocabulary, BLOCK * PASSAGE_BLOCKS)
            real = features < FEATURES
            # The passage's own words choose its row and sign, so a repeated task repeats itself.
            mark = (np.where(real, features, 0) * np.arange(1, features.shape[1] + 1)).sum(axis=1) * 0x9E3779B1
            row, sign = (mark >> 7) % SKETCH, 1.0 - 2.0 * (mark >> 17 & 1)
            np.add.at(total, (row[:, None] * FEATURES + features)[real], np.broadcast_to(sign[:, None], features.shape)[real])
        parts = total.reshape(SKETCH, FEATURES)
        columns = [pa.array(range(SKETCH), pa.int32()), pa.array([p.astype("f4").tobytes() for p in parts], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["row", "sums"])

    def add(table: pa.Table) -> pa.Table:
        whole = np.sum([np.frombuffer(x.as_buffer(), "f4") for x in table["sums"]], axis=0, dtype=float)
        return pa.table({"row": table["row"][:1], "sums": pa.array([whole.astype("f4").tobytes()], pa.binary())})

    summed = _texts(docs).mapInArrow(released(sketches), "row int, sums binary")
    rows = summed.groupBy("row").applyInArrow(add, "row int, sums binary").collect()
    sketch = np.zeros((SKETCH, FEATURES))
    for row in rows:
        sketch[row.row] = np.frombuffer(row.sums, "f4")
    sketch *= weight
    _, sizes, right = np.linalg.svd(sketch, full_matrices=False)
    keep = sizes[:LATENT] > 1e-6 * max(sizes[0], 1e-12)
    axes = right[:LATENT][keep].T / np.maximum(sizes[:LATENT][keep], FLOOR * sizes[0])
    vectors = np.vstack([weight[:, None] * axes, np.zeros((1, axes.shape[1]))]).astype(np.float32)
    return Space(known, vectors)


class Item(NamedTuple):
    item_id: int
    words: list[int]
    answer: list[int]


def read_item(item_id: int, text: str) -> Item | None:
    """An item's words; its answer is its last sentence, or its last five words if that is shorter."""
    words = words_of([text.encode()]).hashes.tolist()
    sentences = [s for s in re.split(r"(?<=[.!?])\s+|\n+", text.strip()) if s.strip()]
    answer = words_of([sentences[-1].encode()]).hashes.tolist() if sentences else []
    return Item(item_id, words, answer if len(answer) >= 5 else words[-5:]) if words else None


def common_subsequence(pattern: list[int], text: list[int]) -> int:
    """Length of the longest common subsequence, with all columns of the table as bits of one number."""
    masks: dict[int, int] = {}
    for i, word in enumerate(pattern):
        masks[word] = masks.get(word, 0) | 1 << i
    full = (1 << len(pattern)) - 1
    state = full
    for word in text:
        matched = state & masks.get(word, 0)
        state = (state + matched | state - matched) & full
    return len(pattern) - state.bit_count()


def searcher(items: list[Item], space: Space) -> Callable[[int, Words, np.ndarray], list[list[dict]]]:
    """What finds the matches of a slice of texts: of each text a list of (item_id, cosine, lcs, answer, start).

    For an item of n words the passages are all runs of blocks that are sure to hold n words from
    any start on, with a block before and after.  Candidates are those that hold as many distinct
    words of the item as its least common subsequence needs, counted in running sums over the
    blocks, so no passage that meets the rule is left out; they are checked by their longest common
    subsequence with the item.  The best passage of each item is reported, with its cosine to the
    item in the latent space.
    """
    vocabulary = np.unpackbits(space.vocabulary).view(bool)
    terms = [Words(np.array(item.words, np.uint64), None).features(vocabulary) for item in items]
    del vocabulary
    vectors = _unit(np.array([space.vectors[t].sum(axis=0) for t in terms]).reshape(len(items), -1))
    widths: dict[int, list[int]] = {}
    for i, item in enumerate(items):
        widths.setdefault(-(-len(item.words) // BLOCK) + 1, []).append(i)
    slices = [(w, which[i : i + ITEM_SLICE]) for w, which in widths.items() for i in range(0, len(which), ITEM_SLICE)]
    bags = [np.unique(t) for t in terms]
    used = np.unique(np.concatenate([*bags, np.zeros(0, np.int64)])).astype(np.int64)
    place = np.full(FEATURES + 1, -1)
    place[used] = np.arange(len(used))
    # Repeats of words can make up for so many distinct ones; two words may share a feature.
    least = np.array([math.ceil(PARAPHRASE * len(t) - 1e-9) - (len(t) - len(bag)) for t, bag in zip(terms, bags, strict=True)], np.int32)

    def check(near: list[int], which: int) -> dict | None:
        item = items[which]
        lcs = common_subsequence(item.words, near) / len(item.words)
        if lcs < PARAPHRASE:
            return None
        answer = common_subsequence(item.answer, near) / len(item.answer)
        if lcs >= COPY or answer >= ANSWER:
            return {"item_id": item.item_id, "lcs": lcs, "answer": answer}
        return None

    def cosine(near: np.ndarray, width: int, which: int) -> float:
        """The largest cosine of a run of ``width`` blocks in the features ``near``."""
        blocks = [space.vectors[near[at : at + BLOCK]].sum(axis=0) for at in range(0, len(near), BLOCK)]
        runs = [np.sum(blocks[at : at + width], axis=0) for at in range(max(len(blocks) - width, 0) + 1)]
        return float(max(_unit(np.array(runs)) @ vectors[which]))

    def matches(n: int, words: Words, vocabulary: np.ndarray) -> list[list[dict]]:
        found: list[dict[int, dict]] = [{} for _ in range(n)]
        features = words.features(vocabulary)
        sizes = np.diff(words.first)
        blocks = -(-sizes // BLOCK)
        first = np.r_[0, np.cumsum(blocks)]
        owner = np.repeat(np.arange(n), blocks)
        known = np.flatnonzero(place[features] >= 0)
        doc = np.searchsorted(words.first, known, "right") - 1
        feature, block = place[features[known]], first[doc] + (known - words.first[doc]) // BLOCK
        order = np.argsort(doc * FEATURES + feature, kind="stable")
        again = (np.diff(feature[order]) == 0) & (np.diff(doc[order]) == 0)
        before = np.full(len(known), -1)
        before[order[1:][again]] = block[order[:-1][again]]
        # A word counts in the runs that begin after its last occurrence's block; none for a
        # second occurrence in a block.
        begin = np.maximum(before + 1, first[doc])
        new = begin <= block
        feature, block, begin = feature[new], block[new], begin[new]
        stretches: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for width, which in slices:
            size = max(STRETCH, width + 2)
            if size not in stretches:
                stretches[size] = _stretches(feature, block, first, size, len(used))
            part = stretches[size][0]
            has = np.zeros((len(used), len(which)), np.float32)
            for i, item in enumerate(which):
                has[place[bags[item]], i] = 1
            alive = (stretches[size][1] @ has >= np.maximum(least[which], 1)).any(axis=1)
            alive[1:] |= alive[:-1]
            kept = alive[part]
            near = kept[block]
            at = np.flatnonzero(kept)
            index = np.r_[0, np.cumsum(kept)]
            low = index[np.maximum(begin[near], block[near] - width - 1)]
            runs = _enough(feature[near], index[block[near]], low, len(at), has, least[which])
            for at, column in zip(at[runs[0]].tolist(), runs[1].tolist(), strict=True):
                row = owner[at]
                start = int(at - first[row]) * BLOCK
                low = int(words.first[row]) + start
                high = min(low + (width + 2) * BLOCK, int(words.first[row + 1]))
                match = check(words.hashes[low:high].tolist(), which[column])
                if match:
                    match |= {"start": start, "cosine": cosine(features[low:high], width, which[column])}
                    old = found[row].get(match["item_id"])
                    if old is None or (match["lcs"], match["cosine"]) > (old["lcs"], old["cosine"]):
                        found[row][match["item_id"]] = match
        return [sorted(x.values(), key=lambda m: (-m["lcs"], m["item_id"])) for x in found]

    return matches


def search(docs: DataFrame, items: list[Item], space: Space) -> DataFrame:
    """``docs`` (text and others) with ``matches``, as :func:`searcher` finds them."""
    found = searcher(items, space)
    others = [name for name in docs.columns if name != "text"]

    def matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = np.unpackbits(space.vocabulary).view(bool)
        for rows, words in _chunks(batches, _binary_text):
            listed = found(rows.num_rows, words, vocabulary)
            columns = [*[rows.column(name) for name in others], pa.array(listed, MATCHES)]
            yield pa.RecordBatch.from_arrays(columns, [*others, "matches"])

    match = T.StructType().add("item_id", "long").add("cosine", "double").add("lcs", "double").add("answer", "double")
    schema = T.StructType(list(docs.select(*others).schema.fields)).add("matches", T.ArrayType(match.add("start", "long")))
    return docs.mapInArrow(released(matches), schema)


def _stretches(feature: np.ndarray, block: np.ndarray, first: np.ndarray, size: int, used: int) -> tuple[np.ndarray, np.ndarray]:
    """The stretch of ``size`` blocks each block is in; and which of ``used`` features a stretch
    and the next of its text have, so that any run of up to ``size`` blocks from the stretch is in it.
    """
    blocks = np.diff(first)
    parts = -(-blocks // size)
    begin = np.r_[0, np.cumsum(parts)]
    part = np.repeat(begin[:-1], blocks) + (np.arange(first[-1]) - np.repeat(first[:-1], blocks)) // size
    has = np.zeros((begin[-1], used), np.float32)
    has[part[block], feature] = 1
    joined = has.copy()
    if len(has):
        same = np.diff(np.repeat(np.arange(len(parts)), parts)) == 0
        np.maximum(joined[:-1], has[1:] * same[:, None], out=joined[:-1])
    return part, joined


def _enough(
    feature: np.ndarray, block: np.ndarray, begin: np.ndarray, n: int, has: np.ndarray, least: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """(first block, item) of the runs that hold ``least`` distinct features of an item.

    ``has`` tells which features an item has.  A feature counts in the runs that begin from ``begin``
    to ``block``.
    """
    if not len(feature):
        return (np.zeros(0, np.int64),) * 2
    change = np.zeros((n + 1, has.shape[1]), np.float32)
    for sign, places in ((1, begin), (-1, block + 1)):
        order = np.argsort(places, kind="stable")
        at = np.flatnonzero(np.r_[True, np.diff(places[order]) > 0])
        change[places[order][at]] += sign * np.add.reduceat(has[feature[order]], at, axis=0)
    return np.nonzero(np.cumsum(change[:-1], axis=0) >= np.maximum(least, 1))


MATCHES = pa.list_(
    pa.struct([("item_id", pa.int64()), ("cosine", pa.float64()), ("lcs", pa.float64()), ("answer", pa.float64()), ("start", pa.int64())])
)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def item_blocks(benchmark: DataFrame) -> Iterator[list[Item]]:
    """The benchmark's items in blocks of ``ITEM_BLOCK``: a stated query set, read block by block."""
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("text IS NOT NULL")
    block: list[Item] = []
    for row in rows.orderBy("item_id", "text").toLocalIterator():
        item = read_item(row[0], row[1])
        if item:
            block.append(item)
        if len(block) == ITEM_BLOCK:
            yield block
            block = []
    if block:
        yield block


def mark(docs: DataFrame, benchmark: DataFrame, space: Space) -> DataFrame:
    """``docs`` (text and others) with ``matches`` over all items; a scan of it per block of items."""
    others = [name for name in docs.columns if name != "text"]
    carried = docs.withColumn("matches", F.expr(f"cast(array() AS array<struct<{MATCH_DDL}>>)"))
    for items in item_blocks(benchmark):
        before = carried.withColumnRenamed("matches", "_before").withColumn("_text", F.col("text"))
        carried = search(before, items, space).select(*others, F.col("_text").alias("text"), F.concat("_before", "matches").alias("matches"))
    return carried.select(*others, "matches")


MATCH_DDL = "item_id:long,cosine:double,lcs:double,answer:double,start:long"


def find_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, contaminated, items, best_item, best_lcs, best_cosine.

    A document is contaminated if a passage of it has 80 % of an item's words in order, or 60 % of
    them together with 60 % of the item's answer.  The space is learned from all documents.  Null
    and empty texts match nothing, null and empty items are left out.
    """
    space = learn_space(docs, benchmark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().cast("binary").alias("text"))
    return mark(rows, benchmark, space).select(
        "doc_id",
        (F.size("matches") > 0).alias("contaminated"),
        F.expr("array_sort(transform(matches, m -> m.item_id))").alias("items"),
        F.expr("get(matches, 0).item_id").alias("best_item"),
        F.expr("get(matches, 0).lcs").alias("best_lcs"),
        F.expr("get(matches, 0).cosine").alias("best_cosine"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that match no item; no row is shuffled.

    Rows go through the workers with their text once and come back in slices of bounded size.
    """
    space = learn_space(docs, benchmark)
    rows = docs.select(F.struct("*").alias("_row"))
    for items in item_blocks(benchmark):
        rows = rows.mapInArrow(released(_without(searcher(items, space), space)), rows.schema)
    return rows.select("_row.*")


def _without(found: Callable, space: Space) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Lets the rows pass that match no item."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = np.unpackbits(space.vocabulary).view(bool)
        for rows, words in _chunks(batches, _carried_text):
            yield rows.filter(pa.array([not listed for listed in found(rows.num_rows, words, vocabulary)], pa.bool_()))

    return clean
