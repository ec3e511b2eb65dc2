"""Hard negatives: exact windows of inner products over Hilbert-ordered blocks with zone maps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomlog.llm.common import staged

#: Whole components are ``floor(SCALE * x)``, held within ±LIMIT so that products stay exact.
SCALE, LIMIT = 256, 1 << 26
#: Rows of a block, blocks whose zone maps are kept together, anchors that are compared at a time.
BLOCK, ZONES, TEAM = 1024, 256, 256
#: Bits a dimension has in the Hilbert key.
BITS = 4
#: Positives of an anchor, negatives of each, and a negative's score in hundredths of the positive's.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
#: Below this bound sums of products are exact as doubles.
EXACT = float(1 << 53)


def whole(vector: str = "embedding") -> Column:
    """The components as whole numbers."""
    scaled = f"floor({SCALE} * cast(x AS DOUBLE))"
    return F.expr(f"transform({vector}, x -> cast(greatest(least({scaled}, {LIMIT}), -{LIMIT}) AS INT))")


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v) of the rows that take part: no null label, vector or component, all finite."""
    finite = "label IS NOT NULL AND embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND abs(cast(x AS DOUBLE)) < double('infinity'))"
    return vectors.filter(finite).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), whole().alias("v"))


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The place of every point (row of whole numbers below 2**bits) on the Hilbert curve, as bytes.

    The axes are turned into the curve's digits in place: from the highest bit on, each axis
    inverts or swaps the lower bits of the first, and a Gray code follows.
    """
    x = points.T.astype(np.int64).copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[n - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= turn
    digits = [((x >> bit) & 1).astype(np.uint8) for bit in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(digits).T, axis=1)


def _matrix(rows: pa.Array, width: int) -> np.ndarray:
    """List values as rows of ``width``; shorter ones end in zeros."""
    lengths = np.diff(rows.offsets.to_numpy())
    values = rows.flatten().to_numpy().astype(np.int64)
    out = np.zeros((len(rows), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = values
    return out


def _with_keys(rows: DataFrame, width: int, low: int, high: int) -> DataFrame:
    """Rows with ``key``: their place on the Hilbert curve over all ``width`` dimensions."""
    span = max(high - low + 1, 1)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = (_matrix(batch.column("v"), width) - low) * (1 << BITS) // span
            keys = hilbert_keys(points) if width else np.zeros((batch.num_rows, 0), np.uint8)
            found = pa.array([row.tobytes() for row in keys], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, "key"])

    return rows.mapInArrow(keyed, T.StructType([*rows.schema.fields, T.StructField("key", T.BinaryType())]))


BLOCK_SCHEMA = "block long, ids array<long>, labels array<long>, known array<boolean>, v binary, low binary, high binary"


def write_blocks(rows: DataFrame, block: int = BLOCK) -> tuple[DataFrame, int]:
    """Blocks of (vec_id, label, v) along the Hilbert curve as a Parquet table, and the dimensions.

    A row per block: ids, labels, ``known`` (false where the id is null), the components, and the
    zone map, the least and greatest value of each dimension.
    """
    ends = rows.agg(
        F.coalesce(F.max(F.size("v")), F.lit(0)), F.min(F.array_min("v")), F.max(F.array_max("v"))
    ).first()
    width = max(ends[0], 0)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], 0
        for batch in batches:
            part = batch.column("part")[0].as_py()
            held.append((batch.column("vec_id").to_pylist(), batch.column("label").to_pylist(), _matrix(batch.column("v"), width)))
            while sum(len(h[0]) for h in held) >= block:
                ids, labels, v = _joined(held)
                yield _block((part << 32) + at, ids[:block], labels[:block], v[:block])
                held, at = [(ids[block:], labels[block:], v[block:])], at + 1
        if held and held[0][0]:
            yield _block((part << 32) + at, *_joined(held))

    keyed = _with_keys(rows, width, ends[1] or 0, ends[2] or 0)
    ordered = keyed.repartitionByRange("key", "vec_id").sortWithinPartitions("key", "vec_id", "label")
    ordered = ordered.withColumn("part", F.spark_partition_id()).select("vec_id", "label", "v", "part")
    return staged(ordered.mapInArrow(packed, BLOCK_SCHEMA), "blocks"), width


def _joined(held: list[tuple]) -> tuple[list, list, np.ndarray]:
    return [i for h in held for i in h[0]], [i for h in held for i in h[1]], np.concatenate([h[2] for h in held])


def _block(number: int, ids: list, labels: list, v: np.ndarray) -> pa.RecordBatch:
    small = v.astype(np.int32)
    columns = [
        pa.array([number], pa.int64()),
        pa.array([[0 if i is None else i for i in ids]], pa.list_(pa.int64())),
        pa.array([labels], pa.list_(pa.int64())),
        pa.array([[i is not None for i in ids]], pa.list_(pa.bool_())),
        *[pa.array([m.tobytes()], pa.binary()) for m in (small, small.min(axis=0), small.max(axis=0))],
    ]
    return pa.RecordBatch.from_arrays(columns, ["block", "ids", "labels", "known", "v", "low", "high"])


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of ``a`` and ``b``, as 64-bit integers."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if float(abs(a).max()) * float(abs(b).max()) * a.shape[1] < EXACT:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    return a.astype(np.int64) @ b.T.astype(np.int64)


def bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score a row within ``low`` … ``high`` can have with each anchor (interval arithmetic)."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return products(up, low) + products(down, high), products(up, high) + products(down, low)


TEAM_SCHEMA = "team long, ids array<long>, labels array<long>, own array<long>, v binary"


def _teams(blocks: DataFrame, anchors: Column, width: int) -> DataFrame:
    """The anchors in teams of at most ``TEAM``: their ids, labels, own blocks and components.

    A team's anchors come from blocks that follow each other on the curve.
    """
    rows = blocks.select("block", F.posexplode(F.arrays_zip("ids", "labels", "known")).alias("at", "r"), "v")
    size = 4 * width
    cell = F.expr(f"substring(v, cast(at * {size} + 1 AS INT), {size})")
    own = rows.withColumn("vec_id", F.when(F.col("r.known"), F.col("r.ids"))).filter(anchors)
    own = own.select("block", "at", "vec_id", F.col("r.labels").alias("label"), cell.alias("v"))
    ordered = own.repartitionByRange("block", "at").sortWithinPartitions("block", "at").withColumn("part", F.spark_partition_id())

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], 0
        for batch in batches:
            columns = batch.to_pydict()
            part = columns["part"][0]
            held += zip(columns["vec_id"], columns["label"], columns["block"], columns["v"], strict=True)
            while len(held) >= TEAM:
                yield _team((part << 32) + at, held[:TEAM])
                held, at = held[TEAM:], at + 1
        if held:
            yield _team((part << 32) + at, held)

    return staged(ordered.select("block", "vec_id", "label", "v", "part").mapInArrow(packed, TEAM_SCHEMA), "teams")


def _team(number: int, members: list[tuple]) -> pa.RecordBatch:
    ids, labels, own, v = zip(*members, strict=True)
    lists = [pa.array([list(values)], pa.list_(pa.int64())) for values in (ids, labels, own)]
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *lists, pa.array([b"".join(v)], pa.binary())], ["team", "ids", "labels", "own", "v"])


def _vectors(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, np.int32).reshape(n, -1)


def _own_blocks(teams: DataFrame) -> DataFrame:
    """(team, block, members): every anchor with the block it lies in itself."""
    each = teams.select("team", F.posexplode("own").alias("member", "block"))
    return each.groupBy("team", "block").agg(F.array_sort(F.collect_list("member")).alias("members"))


def _wanted(asking: DataFrame, blocks: DataFrame, same: bool) -> DataFrame:
    """(team, block, members): the anchors of each team for which a block has still to be read.

    The anchors, team by team, meet the zone maps of all blocks, parcel by parcel.  A block is read
    for an anchor if it holds a row of the right label and its bounds reach one of the anchor's
    windows.  An anchor's own block has been read before.
    """
    count = max(-(-blocks.count() // ZONES), 1)
    zone = F.struct("block", F.array_distinct("labels").alias("labels"), "low", "high")
    parcel = F.pmod(F.xxhash64("block"), F.lit(count)).alias("parcel")
    parcels = blocks.select(parcel, zone.alias("zone")).groupBy("parcel").agg(F.collect_list("zone").alias("zones"))
    asked = asking.withColumn("parcel", F.explode(F.expr(f"sequence(0L, {count - 1}L)")))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                v, zones, labels = _vectors(row["v"], len(row["labels"])), row["zones"], np.array(row["labels"])
                low, high = (np.array([np.frombuffer(z[name], np.int32) for z in zones]) for name in ("low", "high"))
                least, most = bounds(v, low, high)
                for j, z in enumerate(zones):
                    own = np.array(row["own"]) == z["block"]
                    holds = np.isin(labels, z["labels"]) if same else (len(z["labels"]) > 1) | ~np.isin(labels, z["labels"])
                    for i in np.flatnonzero(holds & ~own):
                        if not any(most[i, j] >= floor and least[i, j] <= top for floor, top in zip(row["floors"][i], row["tops"][i], strict=True)):
                            holds[i] = False
                    some = np.flatnonzero(holds & ~own)
                    if some.size:
                        out.append((row["team"], z["block"], some.tolist()))
            if out:
                arrays = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), PAIR_TYPES, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, ["team", "block", "members"])

    met = asked.join(parcels, "parcel").drop("parcel", "ids")
    return met.mapInArrow(choose, "team long, block long, members array<int>")


PAIR_TYPES = (pa.int64(), pa.int64(), pa.list_(pa.int32()))
FOUND = "team long, member int, window int, vec_id long, score long"
FOUND_TYPES = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())


def _read(pairs: DataFrame, asking: DataFrame, blocks: DataFrame, same: bool, most: int) -> DataFrame:
    """(team, member, window, vec_id, score): the best ``most`` rows of every block read, per window.

    ``pairs`` say which blocks to read for which anchors; a row counts for a window if its label is
    (``same``) or is not the anchor's and its score lies in the window.  The anchor's id is left out
    of its own label.
    """

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in range(batch.num_rows):
                row = {name: batch.column(k)[r].as_py() for k, name in enumerate(batch.schema.names)}
                members = row["members"]
                ids, labels, known = (np.array(row[name]) for name in ("block_ids", "block_labels", "known"))
                scores = products(_vectors(row["v"], len(row["labels"]))[members], _vectors(row["block_v"], len(ids)))
                for i, s in zip(members, scores, strict=True):
                    own = labels == row["labels"][i]
                    fits = own & ~(known & (ids == row["ids"][i])) if same else ~own
                    for w, (floor, top) in enumerate(zip(row["floors"][i], row["tops"][i], strict=True)):
                        at = np.flatnonzero(fits & (s >= floor) & (s <= top))
                        if len(at) > most:
                            at = at[s[at] >= np.partition(s[at], -most)[-most]]
                        at = at[np.lexsort((ids[at], ~known[at], -s[at]))][:most]
                        out += [(row["team"], i, w, int(ids[k]) if known[k] else None, int(s[k])) for k in at]
            if out:
                arrays = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), FOUND_TYPES, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, ["team", "member", "window", "vec_id", "score"])

    theirs = blocks.select("block", F.col("ids").alias("block_ids"), F.col("labels").alias("block_labels"), "known", F.col("v").alias("block_v"))
    joined = pairs.join(asking.drop("own"), "team").join(theirs, "block").drop("block")
    return joined.mapInArrow(scored, FOUND)


def _best(found: DataFrame, most: int) -> DataFrame:
    """The first ``most`` rows of each anchor's window, with their ``rank`` from 1."""
    order = Window.partitionBy("team", "member", "window").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def _asking(teams: DataFrame, windows: DataFrame) -> DataFrame:
    """Teams with ``floors`` and ``tops``: the windows (team, member, window, floor, top) of each member."""
    each = windows.groupBy("team", "member").agg(F.array_sort(F.collect_list(F.struct("window", "floor", "top"))).alias("w"))
    edges = each.select("team", F.struct("member", F.col("w.floor").alias("floors"), F.col("w.top").alias("tops")).alias("m"))
    lists = edges.groupBy("team").agg(F.map_from_entries(F.collect_list(F.struct("m.member", "m"))).alias("known"))
    every = "transform(sequence(0, size(labels) - 1), i -> coalesce(known[i].{0}, cast(array() AS array<bigint>)))"
    picked = teams.join(lists, "team", "left")
    return staged(picked.withColumn("floors", F.expr(every.format("floors"))).withColumn("tops", F.expr(every.format("tops"))).drop("known"), "asking")


def _search(teams: DataFrame, blocks: DataFrame, windows: DataFrame, same: bool, most: int) -> DataFrame:
    """The best ``most`` rows in every window: own blocks first, whose finds raise the windows' floors."""
    asking = _asking(teams, windows)
    first = staged(_best(_read(_own_blocks(teams), asking, blocks, same, most), most), "first")
    keys = ["team", "member", "window"]
    full = first.filter(F.col("rank") == most).select(*keys, F.col("score").alias("reached"))
    raised = windows.join(full, keys, "left").withColumn("floor", F.greatest("floor", F.coalesce("reached", "floor"))).drop("reached")
    closer = _asking(teams, raised)
    pairs = staged(_wanted(closer, blocks, same), "pairs")
    rest = _read(pairs, closer, blocks, same, most)
    return staged(_best(first.drop("rank").unionByName(rest), most), "found")


def mine(vectors: DataFrame, anchors: str = "vec_id % 100 = 0", block: int = BLOCK) -> DataFrame:
    """Hard negatives: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` has vec_id, embedding and label.  Components become ``floor(256 * x)``, held within
    ±2^26, and a score is the inner product of two rows, shorter vectors ending in zeros.  An
    anchor's positives are the best ``POSITIVES`` rows of its label with another id; for each, the
    negatives are the best ``NEGATIVES`` rows of other labels whose score is 30 to 90 hundredths of
    the positive's.  Higher scores come first, then smaller ids, null ids last.

    The results are exact.  Rows lie in blocks along a Hilbert curve; a block is read for an anchor
    only if interval arithmetic on its least and greatest components says that one of its rows may
    lie in a window that the anchor's own block has not closed.  Rows with a null label, a null
    vector or a null or non-finite component take no part; equal rows are rows of their own.
    """
    rows = staged(usable(vectors), "vectors")
    blocks, width = write_blocks(rows, block)
    teams = _teams(blocks, F.expr(anchors), width)
    each = teams.select("team", F.posexplode("ids").alias("member", "anchor_id"))
    whole_line = each.select("team", "member", F.lit(0).alias("window"), F.lit(-(1 << 62)).alias("floor"), F.lit(1 << 62).alias("top"))
    positives = _search(teams, blocks, whole_line, True, POSITIVES)
    known = positives.select("team", "member", (F.col("rank") - 1).alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    edges = [F.expr(f"cast(-floor(-{LOW} * positive_score / 100) AS BIGINT)"), F.expr(f"cast(floor({HIGH} * positive_score / 100) AS BIGINT)")]
    windows = known.select("team", "member", "window", edges[0].alias("floor"), edges[1].alias("top"))
    negatives = _search(teams, blocks, staged(windows, "windows"), False, NEGATIVES)
    named = negatives.join(known, ["team", "member", "window"]).join(each, ["team", "member"])
    return named.select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )
