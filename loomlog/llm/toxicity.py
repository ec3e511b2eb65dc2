"""Toxic passages as maximum-scoring segments of token log-odds, calibrated by extreme values."""

from __future__ import annotations

import math
import string
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomlog.llm.common import released, staged, text_of

#: Lengths of the word beginnings that count beside whole words; inflected words share them.
STEMS = (4, 5)
#: Weight of the background prior, as a share of all counted features.
PRIOR_SHARE = 0.1
#: A feature carries weight from this z value on.
LEAST_Z = 4.0
#: Counted features from which on a word is known by itself.
KNOWN = 2
#: Score of a token without weight: about sixty of them part two passages of one strong word each.
GAP = -0.1
#: Evidence from here on counts as this much; the calibrated score is 1 long before.
FULL_EVIDENCE = 60.0
THRESHOLD = 0.3
#: Words and beginnings whose weight a worker remembers, and bytes of rows it hands back at a time.
CACHED, CACHED_STEMS, SLICE_BYTES = 250_000, 50_000, 1 << 20
#: Words counted at a time; their features take about 600 bytes each.
COUNTED = 250_000
EULER = 0.5772156649015329
#: Of the hash of a feature; Spark's own.
SEED = 42


class Weights(NamedTuple):
    """Weights by the sorted hashes of their features, as packed arrays: 16 bytes a feature."""

    hashes: bytes
    values: bytes

    @staticmethod
    def of(hashes: np.ndarray, values: np.ndarray) -> Weights:
        order = np.argsort(hashes)
        return Weights(hashes[order].tobytes(), values[order].tobytes())

    def lookup(self) -> Callable[[str], float | None]:
        """The weight of a feature, None where it has none.

        The first bits of a hash say between which places it can stand; there are about as many
        places as hashes, so one or two are looked at, without a call of numpy for each word.
        """
        if not self.hashes:
            return lambda feature: None
        hashes, values = memoryview(self.hashes).cast("Q"), memoryview(self.values).cast("d")
        bits = len(hashes).bit_length()
        sign, rest = 1 << 63, 64 - bits
        first = (np.frombuffer(self.hashes, np.uint64) ^ np.uint64(sign)) >> np.uint64(rest)
        begins = np.searchsorted(first, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.uint32)
        begins = memoryview(begins.tobytes()).cast("I")
        digest = xxhash.xxh64_intdigest

        def weight(feature: str) -> float | None:
            key = digest(feature.encode(), SEED)
            part = (key ^ sign) >> rest
            for at in range(begins[part], begins[part + 1]):
                if hashes[at] == key:
                    return values[at]
            return None

        return weight


class Model(NamedTuple):
    """Weights of features, the tail's decay and scale, and the calibration of the evidence."""

    weights: Weights
    decay: float
    log_scale: float
    intercept: float
    slope: float


def features(word: str) -> list[str]:
    """A word without the punctuation around it, in lower case, and its beginnings."""
    plain = word.strip(string.punctuation).lower()
    return [f"={plain}", *[f"{plain[:n]}-" for n in STEMS if len(plain) > n]] if plain else []


def train_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(toxic, text) of the labelled rows that may be learned from: crc32(doc_id) mod 4 is not 2.

    A text counts once for each label, so that many copies say no more than one.
    """
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    learnable = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).filter(~held_out())
    likely = learnable.join(F.broadcast(_id_filter(known)), F.expr(WORD) == F.col("_word")).filter(f"(_bits & {MASK}) = {MASK}")
    labelled = likely.join(known.hint("shuffle_hash"), "doc_id")
    once = labelled.select(F.col("toxic").cast("int").alias("toxic"), "text", F.xxhash64("text").alias("_same"))
    return once.dropDuplicates(["toxic", "_same"]).select("toxic", "text")


def _id_filter(known: DataFrame) -> DataFrame:
    """A Bloom filter of the labelled ids, so that few texts without a label are shuffled.

    At most ``FILTER_WORDS`` rows of one 64-bit word each, however many labels there are.
    """
    return known.selectExpr(f"{WORD} AS _word", f"{MASK} AS _mask").groupBy("_word").agg(F.bit_or("_mask").alias("_bits"))


FILTER_WORDS = 1 << 17
WORD = f"(xxhash64(doc_id) & {FILTER_WORDS - 1}L)"
MASK = "(" + " | ".join(f"shiftleft(1L, cast(shiftrightunsigned(xxhash64(doc_id), {n}) & 63 AS INT))" for n in (24, 30, 36)) + ")"


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def count_features(rows: DataFrame) -> DataFrame:
    """(feature, toxic, clean): in how many texts of either label each word form counts, summed."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = (Counter(), Counter())
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words[label > 0].update(set(text.as_py().split()))
            if len(words[0]) + len(words[1]) > COUNTED:
                yield _feature_batch(words)
                words = (Counter(), Counter())
        yield _feature_batch(words)

    found = rows.mapInArrow(released(counts), "feature string, clean long, toxic long")
    return found.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _feature_batch(words: tuple[Counter, Counter]) -> pa.RecordBatch:
    sums: dict[str, list[int]] = {}
    for label in (0, 1):
        for word, n in words[label].items():
            for feature in features(word):
                sums.setdefault(feature, [0, 0])[label] += n
    columns = [pa.array(sums, pa.string()), *[pa.array([n[k] for n in sums.values()], pa.int64()) for k in (0, 1)]]
    return pa.RecordBatch.from_arrays(columns, ["feature", "clean", "toxic"])


def weighted_features(counted: DataFrame) -> tuple[Weights, np.ndarray]:
    """Features whose log-odds speak for toxicity, and columns of their rate in clean text and weight.

    A word that is known well enough and does not speak for toxicity has weight 0, whatever its
    beginning says.

    The log-odds of a feature between the classes have a Dirichlet prior that is the background of
    both classes together, weighted as ``PRIOR_SHARE`` of all counts.  The driver takes hashes and
    weights of all that pass, and hands them to the workers.
    """
    total = counted.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"), F.coalesce(F.sum("clean"), F.lit(0)).alias("clean")).first()
    everything = total.toxic + total.clean
    if not total.toxic or not total.clean:
        return Weights(b"", b""), np.zeros((2, 0))
    prior = PRIOR_SHARE * everything
    rate = f"((toxic + clean) * {prior / everything!r}D)"

    def odds(own: str, n: int) -> str:
        return f"ln(({own} + {rate}) / ({n + prior!r}D - {own} - {rate}))"

    scored = counted.selectExpr(
        "feature", "toxic", "clean", f"{odds('toxic', total.toxic)} - {odds('clean', total.clean)} AS weight",
        f"sqrt(1 / (toxic + {rate}) + 1 / (clean + {rate})) AS deviation",
    )
    strong = f"weight >= {LEAST_Z} * deviation AND weight > 1"
    rows = scored.filter(strong).select(F.xxhash64("feature").alias("hash"), "weight", (F.col("clean") / total.clean).alias("rate")).toArrow()
    known = scored.filter(f"toxic + clean >= {KNOWN} AND NOT ({strong})")
    usual = [
        known.filter("startswith(feature, '=')")
        .withColumn("stem", F.concat(F.expr(f"substring(feature, 2, {n})"), F.lit("-")))
        .join(scored.filter(strong).select(F.col("feature").alias("stem")), "stem", "left_semi")
        .select("feature")
        for n in STEMS
    ]
    zero = usual[0].union(usual[1]).distinct().select(F.xxhash64("feature").alias("hash")).toArrow()
    rate, weight = (rows[name].to_numpy().astype(float) for name in ("rate", "weight"))
    hashes = np.r_[rows["hash"].to_numpy().astype(np.int64), zero["hash"].to_numpy().astype(np.int64)]
    return Weights.of(hashes, np.r_[weight, np.zeros(zero.num_rows)]), np.array([rate, weight])


def tail_decay(rates: np.ndarray) -> float:
    """The positive root of E[exp(decay * score)] = 1 over tokens of clean text."""
    if not rates.size:
        return 1.0
    rate, weight = rates
    rate = np.maximum(rate, 1e-9)
    rest = max(1 - rate.sum(), 0.5)

    def excess(x: float) -> float:
        return rest * math.exp(x * GAP) + float((rate * np.exp(x * weight)).sum()) - rest - rate.sum()

    low, high = 0.0, 1.0
    while excess(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    return max(low, 1e-3)


def maximal_segments(places: list[int], scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments, (first token, end, score), of tokens that score ``GAP`` but for
    those at ``places``, which have the positive ``scores``.

    The linear-time scan: each positive token is a candidate; a candidate is joined with the
    nearest earlier one that starts lower and ends lower in the running sum, and with all between.
    """
    out: list[tuple[int, int, float, float]] = []
    total, at = 0.0, 0
    for place, score in zip(places, scores, strict=True):
        low = total + GAP * (place - at)
        total, at = low + score, place + 1
        start, high = place, total
        while True:
            k = len(out) - 1
            while k >= 0 and out[k][2] >= low:
                k -= 1
            if k < 0 or out[k][3] >= high:
                out.append((start, at, low, high))
                break
            start, low = out[k][0], out[k][2]
            del out[k:]
    return [(start, stop, high - low) for start, stop, low, high in out]


class _Weights(dict):
    """The weight of a token: its word's, else the larger of its beginnings', else 0."""

    def __init__(self, weights: Weights):
        super().__init__()
        self.known = weights.lookup()
        self.stems: dict[str, float] = {}

    def __missing__(self, word: str) -> float:
        if len(self) > CACHED:
            self.clear()
        found = features(word)
        weight = self.known(found[0]) if found else 0.0
        if weight is None:
            weight = max(map(self._stem, found[1:]), default=0.0)
        self[word] = weight
        return weight

    def _stem(self, stem: str) -> float:
        """The weight of a word's beginning; words that are not remembered often share one that is."""
        weight = self.stems.get(stem)
        if weight is None:
            if len(self.stems) > CACHED_STEMS:
                self.stems.clear()
            weight = self.stems[stem] = self.known(stem) or 0.0
        return weight


def scan(rows: DataFrame, weights: Weights) -> DataFrame:
    """``rows`` (text and others) with n_tokens and segments: array of (start, stop, score)."""

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight_of = _Weights(weights).__getitem__
        for batch in batches:
            found = [_text_segments(text.as_py(), weight_of) for text in batch.column("text")]
            spans = [[{"start": a, "stop": b, "score": s} for a, b, s in part] for _, part in found]
            kept = [batch.column(name) for name in others]
            columns = [*kept, pa.array([n for n, _ in found], pa.int64()), pa.array(spans, SEGMENTS)]
            yield pa.RecordBatch.from_arrays(columns, [*others, "n_tokens", "segments"])

    others = [name for name in rows.columns if name != "text"]
    span = T.StructType().add("start", "long").add("stop", "long").add("score", "double")
    schema = rows.select(*others).schema.add("n_tokens", "long").add("segments", T.ArrayType(span))
    return rows.mapInArrow(released(segments), schema)


def _text_segments(text: str | None, weight_of: Callable[[str], float]) -> tuple[int, list[tuple[int, int, float]]]:
    """The number of tokens of a text, and its maximal segments."""
    words = (text or "").split()
    weight = np.fromiter(map(weight_of, words), float, len(words))
    places = np.flatnonzero(weight)
    return len(words), maximal_segments(places.tolist(), weight[places].tolist())


SEGMENTS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64())]))


def evidence(model: Model) -> str:
    """SQL: what the segments say beyond chance in a text of this length, each by its extreme value."""
    beyond = f"{model.decay!r}D * s.score - {model.log_scale!r}D - ln(greatest(n_tokens, 1))"
    return f"least(aggregate(segments, 0D, (t, s) -> t + greatest(0D, {beyond})), {FULL_EVIDENCE}D)"


def score_of(model: Model) -> str:
    return f"1 / (1 + exp(-({model.intercept!r}D + {model.slope!r}D * ({evidence(model)}))))"


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn weights and calibration from the labelled rows of ``docs`` outside the held-out fold."""
    rows = staged(train_rows(docs, labels), "toxic-train")
    weights, rates = weighted_features(staged(count_features(rows), "toxic-features"))
    decay = tail_decay(rates)
    scanned = staged(scan(rows, weights), "toxic-scan")
    best = F.expr(f"{decay!r}D * aggregate(segments, 0D, (t, s) -> greatest(t, s.score)) - ln(greatest(n_tokens, 1))")
    # Mean of an extreme-value variable: its mode and Euler's constant.
    mean = scanned.filter("toxic = 0 AND n_tokens > 0").agg(F.avg(best)).first()[0]
    model = Model(weights, decay, (mean or 0.0) - EULER, 0.0, 1.0)
    bins = scanned.groupBy(F.round(F.expr(evidence(model)) * 4).cast("int").alias("bin")).agg(
        F.sum(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"), F.count(F.lit(1)).alias("n")
    )
    # At most four bins for each unit of evidence up to FULL_EVIDENCE.
    intercept, slope = _logistic([(r.bin / 4, r.toxic, r.n) for r in bins.collect()])
    return model._replace(intercept=intercept, slope=slope)


def _logistic(bins: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Intercept and slope by Newton's method with a weak pull towards slope 1."""
    if not bins:
        return -6.0, 1.0
    x, y, n = (np.array(column, float) for column in zip(*bins, strict=True))
    design = np.stack([np.ones(len(x)), x], axis=1)
    rate = (y.sum() + 0.5) / (n.sum() + 1)
    beta = np.array([math.log(rate / (1 - rate)), 0.5])
    pull, target = np.array([0.01, 1.0]), np.array([beta[0], 1.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-design @ beta))
        gradient = design.T @ (y - n * p) - pull * (beta - target)
        step = np.linalg.solve((design * (n * p * (1 - p))[:, None]).T @ design + np.diag(pull), gradient)
        beta = beta + np.clip(step, -1, 1)
        if abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(max(beta[1], 0.0))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted, passages.

    Token weights, the tail of segment scores in clean text and the calibration are learned from
    labelled rows with crc32(doc_id as text) mod 4 other than 2; labels, language, source and id
    are no inputs of a score.  ``passages`` are the segments as token ranges with their scores.
    Null and empty texts have no evidence and the score that goes with that.  Without labels of
    both kinds no token has weight.  A doc_id with several labels is toxic if one says so.
    """
    model = fit(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return (
        scan(rows, model.weights)
        .withColumns({"held_out": held_out(), "score": F.expr(score_of(model))})
        .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
        .select("doc_id", "held_out", "score", "predicted", F.col("segments").alias("passages"))
    )


def text_score(model: Model, n_tokens: int, segments: list[tuple[int, int, float]]) -> float:
    """What :func:`score_of` gives for one text."""
    floor = model.log_scale + math.log(max(n_tokens, 1))
    total = min(sum(max(0.0, model.decay * score - floor) for _, _, score in segments), FULL_EVIDENCE)
    return 1 / (1 + math.exp(-(model.intercept + model.slope * total)))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below the threshold; no row is shuffled.

    Rows go through the workers once, with their text once, and come back in slices of bounded size.
    """
    model = fit(docs, labels)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight_of = _Weights(model.weights).__getitem__
        for batch in batches:
            texts = batch.column(0).field("text")
            kept = [text_score(model, *_text_segments(text.as_py(), weight_of)) < THRESHOLD for text in texts]
            left = batch.filter(pa.array(kept, pa.bool_()))
            step = max(1, SLICE_BYTES * left.num_rows // max(left.nbytes, 1))
            for at in range(0, left.num_rows, step):
                yield left.slice(at, step)

    rows = docs.select(F.struct("*").alias("_row"))
    return rows.mapInArrow(released(clean), rows.schema).select("_row.*")
