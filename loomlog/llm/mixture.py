"""Mixing sources to target weights: blocks of tokens, dealt to output shards by multinomial draws."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomlog.llm.common import salted_lookup, staged, text_of

#: A token is a run of characters other than the six ASCII white-space ones.
TOKEN = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in order, again and again, and the mix's size as a share of all tokens.
WEIGHTS, SHARE = (3, 1, 2), 1.5
#: No source is taken more often than this.
MOST = 2
#: Tokens of a block, blocks of an output shard, tokens meant for a bin of documents.
BLOCK, SHARD, BIN = 128, 4096, 1 << 20
#: Sources of one draw; more are drawn in two steps.
GROUP = 4096
#: Shards whose draws are summed up first.
SPAN = 1024
#: Slots a worker hands out at a time.
HELD = 1 << 16
SEED = 42
#: What tells the rounds of a permutation apart.
TURNS = [np.uint64((turn + 1) * 0x9E3779B97F4A7C15 % 2**64) for turn in range(4)]


def sized(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """(row, doc_id, source, size, mix[, text]) per row of ``docs``; ``row`` numbers the rows.

    ``mix`` is a hash of id and text that spreads and orders the rows of a source; rows that agree
    in both are alike in all that matters here.
    """
    text = text_of()
    columns = [
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.size(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))).cast("long").alias("size"),
        F.xxhash64("doc_id", text).alias("mix"),
    ]
    rows = docs.select(*columns, *([text.alias("text")] if keep_text else []))
    return staged(rows.withColumn("row", F.monotonically_increasing_id()), "sized")


def _numbered(rows: DataFrame, name: str, *keys: Column) -> DataFrame:
    """``rows`` with their place from 0 in the order of ``keys`` as column ``name``.

    Ranges are sorted each by itself; the ranges' sizes, one number each, give where they begin.
    """
    ranges = staged(rows.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "ranges")
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*keys)) - 1
    sizes = ranges.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    begins = sizes.select("_part", _sum_before("_n", Window.orderBy("_part")).alias("_begin"))
    placed = ranges.withColumn("_within", within).join(begins, "_part")
    return placed.withColumn(name, F.col("_begin") + F.col("_within")).drop("_part", "_begin", "_within")


def _sum_before(column: str, window) -> Column:
    """The sum over the earlier rows of the window, 0 for the first."""
    return F.coalesce(F.sum(column).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, rank, target) of (source, source_size), one row per source.

    Sources stand by code point, null last, and have the weights in turn.  They share ``share``
    times all tokens by weight; a target stops at ``most`` times its source's size, and what is
    over goes to the others by weight, until none is above.  The driver sees three sums a round.
    """
    ranked = _numbered(sizes, "rank", F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = staged(ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(most)), "sources")
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0] * share
    level, capped = 0.0, -1
    while True:
        # A target is the smaller of the cap and the level times the weight.
        full = F.col("cap") <= F.col("weight") * level
        sums = ranked.agg(
            F.count(F.when(full, 1)).alias("n"),
            F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)).alias("held"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("open"),
        ).first()
        if sums.n == capped or not sums.open:
            break
        capped, level = sums.n, max(level, (total - sums.held) / sums.open)
    target = F.least(F.col("cap"), F.col("weight") * level).alias("target")
    return ranked.select("source", "source_size", "rank", target)


def lay_out(rows: DataFrame, sources: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Blocks of every source: (rank, block, row, doc_id, part, n_tokens[, tokens]) and (rank, blocks).

    The documents of a source are spread over bins of bounded size by their hash, stand one after
    the other in each, and are cut every ``block`` tokens; the last block of a bin may be shorter.
    Blocks count through the bins of a source.
    """
    bins = F.greatest(F.ceil(F.col("source_size") / BIN), F.lit(1))
    binned = salted_lookup(rows.filter("size > 0"), sources.select("source", "rank", bins.alias("_bins")), ["source"], ["mix", "row"])
    binned = binned.withColumn("_bin", F.pmod("mix", "_bins")).drop("_bins", "source")
    order = Window.partitionBy("rank", "_bin").orderBy("doc_id", "mix", "row").rowsBetween(Window.unboundedPreceding, 0)
    placed = binned.withColumn("_stop", F.sum("size").over(order)).withColumn("_start", F.col("_stop") - F.col("size"))
    counts = binned.groupBy("rank", "_bin").agg(F.ceil(F.sum("size") / block).alias("_blocks"))
    begins = staged(counts.withColumn("_first", _sum_before("_blocks", Window.partitionBy("rank").orderBy("_bin"))), "bins")
    placed = placed.join(begins.drop("_blocks"), ["rank", "_bin"])
    lo, hi = f"greatest(_start, b * {block}L)", f"least(_stop, (b + 1) * {block}L)"
    tokens = f", slice(tokens, cast({lo} - _start + 1 AS INT), cast({hi} - {lo} AS INT)) AS tokens" if "text" in rows.columns else ""
    cut = f"struct(_first + b AS block, {lo} - _start AS part, {hi} - {lo} AS n_tokens{tokens})"
    steps = f"sequence(_start div {block}L, (_stop - 1) div {block}L)"
    if tokens:
        words = F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))
        placed = placed.withColumn("tokens", words).drop("text")
    cuts = placed.select("rank", "row", "doc_id", F.explode(F.expr(f"transform({steps}, b -> {cut})")).alias("c"))
    return cuts.select("rank", "row", "doc_id", "c.*"), begins.groupBy("rank").agg(F.sum("_blocks").alias("blocks"))


def permuted(places: np.ndarray, sizes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Each place sent through the pseudorandom permutation of 0 … size - 1 that its key names.

    A Feistel network of four rounds over the next even power of two, walked until inside.
    """
    half = np.maximum(np.ceil(np.log2(np.maximum(sizes, 2).astype(float)) / 2), 1).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, left = places.astype(np.uint64), np.arange(len(places))
    while left.size:
        h, m, k = half[left], mask[left], keys[left]
        a, b = out[left] >> h, out[left] & m
        for turn in range(4):
            x = (b + k + TURNS[turn]) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            a, b = b, a ^ ((x ^ (x >> np.uint64(32))) & m)
        out[left] = (a << h) | b
        left = left[out[left] >= sizes[left].astype(np.uint64)]
    return out.astype(np.int64)


def _draws(spark: SparkSession, sources: DataFrame, seed: int) -> DataFrame:
    """(shard, rank, n): how many slots of each shard a multinomial draw gives each source.

    Sources are drawn in groups of bounded size: first the groups of all shards, from one number
    per group, then the sources of each group that a shard has slots of.
    """
    grouped = sources.filter("slots > 0").withColumn("team", F.floor(F.col("rank") / GROUP))
    members = F.array_sort(F.collect_list(F.struct("rank", "slots")))
    teams = staged(grouped.groupBy("team").agg(F.sum("slots").alias("slots"), members.alias("members")), "teams")
    # One number for every GROUP sources.
    known = sorted((r.team, r.slots) for r in teams.select("team", "slots").collect())
    total = sum(n for _, n in known)
    chances = np.array([n for _, n in known], float) / max(total, 1)
    numbers = np.array([team for team, _ in known], np.int64)

    def by_team(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                n = min(SHARD, total - shard * SHARD)
                found = np.random.default_rng([seed, shard]).multinomial(n, chances)
                some = np.flatnonzero(found)
                columns = [pa.array(np.full(len(some), shard)), pa.array(numbers[some]), pa.array(found[some])]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "team", "n"])

    def by_source(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, team, n, members in zip(*batch.to_pydict().values(), strict=True):
                slots = np.array([m["slots"] for m in members], float)
                found = np.random.default_rng([seed, shard, team]).multinomial(n, slots / slots.sum())
                some = np.flatnonzero(found)
                ranks = np.array([m["rank"] for m in members], np.int64)
                columns = [pa.array(np.full(len(some), shard)), pa.array(ranks[some]), pa.array(found[some])]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "rank", "n"])

    shards = spark.range(-(-total // SHARD)).withColumnRenamed("id", "shard")
    first = shards.mapInArrow(by_team, "shard long, team long, n long")
    second = salted_lookup(first, teams.select("team", "members"), ["team"], ["shard"])
    return second.select("shard", "team", "n", "members").mapInArrow(by_source, "shard long, rank long, n long")


def _fitted(draws: DataFrame, sources: DataFrame) -> DataFrame:
    """(shard, rank, first, n): runs of each source's slots by shard, exactly as many as it may have.

    Draws over all shards give a source somewhat more or less than its slots.  The last slots of
    those with too many go, one for one, to the sources with too few.
    """
    drawn = staged(draws.withColumn("span", F.floor(F.col("shard") / SPAN)), "draws")
    # Running counts: over spans of shards first, then inside each.
    spans = drawn.groupBy("rank", "span").agg(F.sum("n").alias("_n"))
    spans = spans.select("rank", "span", _sum_before("_n", Window.partitionBy("rank").orderBy("span")).alias("_before"))
    inside = _sum_before("n", Window.partitionBy("rank", "span").orderBy("shard"))
    runs = drawn.withColumn("_inside", inside).join(spans, ["rank", "span"])
    runs = runs.select("rank", "shard", "n", (F.col("_before") + F.col("_inside")).alias("first"))
    runs = salted_lookup(runs, sources.select("rank", "slots"), ["rank"], ["shard"])
    runs = staged(runs.withColumn("kept", F.expr("least(n, greatest(slots - first, 0L))")), "runs")
    over = runs.filter("n > kept").select("shard", "rank", F.explode(F.expr("sequence(first + kept, first + n - 1)")).alias("place"))
    had = runs.groupBy("rank").agg(F.sum("kept").alias("had"))
    short = sources.join(had, "rank", "left").withColumn("had", F.coalesce("had", F.lit(0))).filter("had < slots")
    free = short.select("rank", F.explode(F.expr("sequence(had, slots - 1)")).alias("first"))
    given = _numbered(over, "turn", F.col("shard"), F.col("rank"), F.col("place")).select("turn", "shard")
    filled = _numbered(free, "turn", F.col("rank"), F.col("first")).join(given, "turn")
    kept = runs.filter("kept > 0").select("shard", "rank", "first", F.col("kept").alias("n"))
    return kept.unionByName(filled.select("shard", "rank", "first", F.lit(1).cast("long").alias("n")))


def _slots(runs: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """(shard, rank, place, block): the block of every slot, by the source's permutation.

    A source's slots count through its blocks, pass after pass; each pass has a permutation.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, rank, first, n, blocks = (column.to_numpy() for column in batch.columns)
            cuts = np.searchsorted(np.cumsum(n), np.arange(HELD, n.sum(), HELD))
            for part in np.split(np.arange(len(n)), np.unique(cuts)):
                m = n[part]
                place = np.arange(m.sum()) + np.repeat(first[part] - (np.cumsum(m) - m), m)
                sizes, ranks = np.repeat(blocks[part], m), np.repeat(rank[part], m)
                passes = place // sizes
                keys = (ranks.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) ^ (passes.astype(np.uint64) << np.uint64(32)) ^ np.uint64(seed)
                block = permuted(place % sizes, sizes, keys)
                columns = [np.repeat(shard[part], m), ranks, place, block]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["shard", "rank", "place", "block"])

    known = salted_lookup(runs, sources.select("rank", "blocks"), ["rank"], ["shard"])
    return known.select("shard", "rank", "first", "n", "blocks").mapInArrow(deal, "shard long, rank long, place long, block long")


def _dealt(rows: DataFrame, block: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """The sources with their targets, and the mix over ``rows`` as :func:`sized` gives them."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = staged(targets(sizes), "targets")
    cuts, counts = lay_out(rows, sources, block)
    # As many slots as come nearest to the target with blocks of this source's mean length.
    slots = F.least(F.round(F.col("target") / F.col("source_size") * F.col("blocks")), F.col("blocks") * MOST).cast("long")
    counted = staged(sources.join(counts, "rank").withColumn("slots", slots), "slots")
    runs = _fitted(_draws(rows.sparkSession, counted, seed), counted)
    return sources, _slots(runs, counted, seed).join(cuts, ["rank", "block"])


def mix(docs: DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """The mixed corpus: (shard, place, source, block, doc_id, part, tokens), a row per piece of a document.

    Every source's documents are cut into blocks of ``block`` tokens.  Each output shard draws how
    many of its slots each source gets; a source's slots take its blocks in a pseudorandom order,
    pass after pass.  ``place`` orders the slots of a shard, ``part`` is where in its document a piece
    begins and the order of pieces in a block is by ``row``.  A rerun gives the same mix.
    """
    sources, dealt = _dealt(sized(docs), block, seed)
    named = salted_lookup(dealt, sources.select("rank", "source"), ["rank"], ["block", "shard"])
    return named.select("shard", F.xxhash64("shard", "rank", "place").alias("place"), "source", "block", "row", "doc_id", "part", "tokens")


def taken(docs: DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken.

    ``size`` counts tokens, ``target`` is the number the mix is to have from the row's source, and
    ``taken`` the number it has from the row, repeats counted; that is at most twice the size.
    Null texts have no tokens; a null source is a source, the last; null and shared ids are rows
    like any other.  Without any token all numbers are 0.  Other columns are not read.
    """
    rows = sized(docs, keep_text=False)
    sources, dealt = _dealt(rows, block, seed)
    used = dealt.groupBy("row").agg(F.sum("n_tokens").alias("taken"))
    counted = rows.select("row", "doc_id", "source", "size", "mix").join(used, "row", "left")
    full = salted_lookup(counted, sources.select("source", "source_size", "target"), ["source"], ["mix", "row"])
    return full.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
