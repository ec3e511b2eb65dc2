"""Repeated byte strings by a distributed merge sort of suffixes that never re-compares known prefixes.

Not every suffix is sorted.  Each window of ``LENGTH`` bytes has an anchor, the place of its smallest
``GRAM``-byte hash; equal windows have their anchors at the same offset.  So it is enough to sort the
suffixes that start at anchors, and of these only those whose gram occurs again somewhere.  A suffix
is as long as the windows of its anchor reach, with the bytes to the left, reversed, behind it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.llm.common import discard, salted_lookup, staged, text_of

LENGTH, GRAM = 100, 32
#: Bytes of the anchor's hash, mixed once more, in front of each suffix: ranges are cut between
#: them.  Anchors are where hashes are smallest, so ranges of the plain hash would fill the first.
HEAD = 8
#: Bytes hashed at a time, bytes of suffixes in a sorted run, and in a range of the order.
PIECE, RUN_BYTES, RANGE_BYTES = 1 << 18, 8 << 20, 16 << 20
#: Suffixes of one gram whose windows are compared where they were sorted; more are shuffled on.
GROUP = 4000
#: Rows of a batch put out.
OUT_ROWS = 5000
NO_ID = (1 << 63) - 1


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes at each place as one number."""
    wide = data.astype(np.uint64)
    for size in (1, 2, 4):
        wide = wide[:-size] | wide[size:] << np.uint64(8 * size)
    return wide


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A mixed hash of the gram at each place."""
    word = _words(data)
    n = len(data) - GRAM + 1
    mixed = np.zeros(n, np.uint64)
    for at in range(0, GRAM, 8):
        mixed ^= word[at : at + n]
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    return mixed ^ mixed >> np.uint64(32)


def _heads(hashes: np.ndarray) -> np.ndarray:
    """The hashes of anchors as numbers spread evenly over 64 bits, one for one."""
    mixed = hashes * np.uint64(0x9E3779B97F4A7C15)
    return mixed ^ mixed >> np.uint64(32)


def anchors(data: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, ...]:
    """(anchor, first window, last window, hash) of texts laid end to end, which end at ``stops``.

    A run of windows with one anchor is one entry.  Long inputs are worked on piece by piece; a
    run cut at a seam is two entries, which changes no result.
    """
    found = []
    starts = np.r_[0, stops[:-1]]
    for at in range(0, max(len(data) - LENGTH + 1, 0), PIECE):
        piece = data[at : at + PIECE + LENGTH - 1]
        hashes = _gram_hashes(piece)
        low = hashes & np.uint64(0xFFFFFFFF00000000) | np.arange(len(hashes), dtype=np.uint64)
        span, width = low, 1
        reach = LENGTH - GRAM + 1
        while 2 * width <= reach:
            span, width = np.minimum(span[:-width], span[width:]), 2 * width
        n = len(piece) - LENGTH + 1
        place = np.minimum(span[:n], span[reach - width : reach - width + n]) & np.uint64(0xFFFFFFFF)
        # A window is valid if it ends in the text in which it starts.
        edge = np.zeros(n + 1, np.int32)
        first, last = np.clip(starts - at, 0, n), np.clip(stops - at - LENGTH + 1, 0, n)
        real = last > first
        np.add.at(edge, first[real], 1)
        np.add.at(edge, last[real], -1)
        window = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        if not len(window):
            continue
        place = place[window].astype(np.int64)
        change = np.flatnonzero((place[1:] != place[:-1]) | (np.diff(window) > 1))
        begin, end = np.r_[0, change + 1], np.r_[change, len(window) - 1]
        found.append((place[begin] + at, window[begin] + at, window[end] + at, hashes[place[begin]]))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(3)) + (np.zeros(0, np.uint64),)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows in slices of about ``PIECE`` bytes, their bytes end to end, and where each ends."""
    for batch in batches:
        texts, start, size = batch.column("text"), 0, 0
        sizes = [len(x.as_buffer()) for x in texts]
        for i in range(batch.num_rows):
            size += sizes[i]
            if size >= PIECE or i + 1 == batch.num_rows:
                rows = b"".join(x.as_buffer() for x in texts[start : i + 1])
                yield batch.slice(start, i + 1 - start), np.frombuffer(rows, np.uint8), np.cumsum(sizes[start : i + 1])
                start, size = i + 1, 0


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc, tid, text): the id, null last, and a mark that tells texts of one id apart."""
    text = text_of().cast("binary")
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    return docs.select(doc.alias("doc"), F.xxhash64(text).alias("tid"), text.alias("text"))


def _packed(keyed: DataFrame) -> DataFrame:
    """``keyed`` with its texts compressed one by one, for the shuffles that carry them."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 1)
        for batch in batches:
            sizes = [len(x.as_buffer()) for x in batch.column("text")]
            data = [codec.compress(x.as_buffer(), asbytes=True) for x in batch.column("text")]
            columns = [batch.column("doc"), batch.column("tid"), pa.array(sizes, pa.int64()), pa.array(data, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "tid", "size", "text"])

    return keyed.mapInArrow(rows, "doc long, tid long, size long, text binary")


def _unpacked(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch's rows in slices of about ``PIECE`` bytes with their texts as they were."""
    codec, sizes, start, size = pa.Codec("zstd", 1), batch.column("size").to_pylist(), 0, 0
    for i in range(batch.num_rows):
        size += sizes[i]
        if size >= PIECE or i + 1 == batch.num_rows:
            part = batch.slice(start, i + 1 - start)
            texts = [
                codec.decompress(x.as_buffer(), n, asbytes=True) if n else b""
                for x, n in zip(part.column("text"), sizes[start : i + 1], strict=True)
            ]
            at = part.schema.get_field_index("text")
            yield part.set_column(at, "text", pa.array(texts, pa.binary()))
            start, size = i + 1, 0


def repeated_grams(keyed: DataFrame) -> DataFrame:
    """(doc, tid, grams): hashes of the anchors whose gram may occur at another anchor too.

    A chunk of documents sends each hash once; what repeats inside it is known there already, and
    those rows are dealt out evenly.  So a gram of a third of all documents is one row a chunk.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, data, stops in _chunks(batches):
            place, _, _, hashes = anchors(data, stops)
            owner = np.searchsorted(stops, place, side="right")
            distinct, first, which, n = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
            again = np.ones(len(hashes), bool)
            again[first] = False
            route = np.where(again, hashes * np.uint64(31) + place.astype(np.uint64), hashes).view(np.int64)
            mark = np.where(again, 2, np.where(n[which] > 1, 1, 0)).astype(np.int32)
            docs, tids = chunk.column("doc").to_numpy()[owner], chunk.column("tid").to_numpy()[owner]
            columns = [pa.array(x) for x in (route, hashes.view(np.int64), docs, tids, mark)]
            yield pa.RecordBatch.from_arrays(columns, ["route", "gram", "doc", "tid", "mark"])

    def repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:  # sorted by gram: equal ones are neighbours, also across batches
            table = pa.Table.from_batches([*held, batch])
            gram = table["gram"].to_numpy()
            cut = len(gram) if not len(gram) else int(np.searchsorted(gram, gram[-1]))
            yield from _repeated(table.slice(0, cut))
            held = table.slice(cut).combine_chunks().to_batches()
        if held:
            yield from _repeated(pa.Table.from_batches(held))

    sent = keyed.mapInArrow(rows, "route long, gram long, doc long, tid long, mark int")
    dealt = sent.repartition("route").sortWithinPartitions("gram")
    found = dealt.mapInArrow(repeats, "doc long, tid long, gram long")
    return found.groupBy("doc", "tid").agg(F.collect_list("gram").alias("grams"))


def _repeated(table: pa.Table) -> Iterator[pa.RecordBatch]:
    gram, mark = table["gram"].to_numpy(), table["mark"].to_numpy()
    _, which, n = np.unique(gram, return_inverse=True, return_counts=True)
    asked = mark < 2
    known = np.bincount(which, mark == 1, len(n)) > 0
    several = np.bincount(which, asked, len(n)) > 1
    keep = ~asked | (known | several)[which]
    yield from table.filter(pa.array(keep)).select(["doc", "tid", "gram"]).to_batches()


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes are known to agree."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (differ.bit_length() + 7) // 8


Entry = tuple[bytes, int, int, int, int]  # suffix, bytes right of the anchor's start, doc, anchor, tid


def pack_run(entries: list[Entry]) -> bytes:
    """A sorted run, each suffix as the length it shares with the one before and the rest of it."""
    shared = [0] + [common_prefix(a[0], b[0]) for a, b in zip(entries, entries[1:], strict=False)]
    tails = [entry[0][n:] for entry, n in zip(entries, shared, strict=True)]
    numbers = np.array([e[1:] for e in entries], np.int64).reshape(-1, 4)
    lengths = np.array([shared, [len(t) for t in tails]], np.uint32)
    return np.array([len(entries)], np.int64).tobytes() + numbers.tobytes() + lengths.tobytes() + b"".join(tails)


def unpack_run(run: bytes) -> Iterator[tuple[int, Entry]]:
    """(shared length, entry) of a packed run, in order."""
    n = int(np.frombuffer(run, np.int64, 1)[0])
    numbers = np.frombuffer(run, np.int64, 4 * n, 8).reshape(n, 4).tolist()
    shared, sizes = np.frombuffer(run, np.uint32, 2 * n, 8 + 32 * n).reshape(2, n).tolist()
    at, key = 8 + 40 * n, b""
    for number, known, size in zip(numbers, shared, sizes, strict=True):
        key = key[:known] + run[at : at + size]
        at += size
        yield known, (key, *number)


def merge_runs(runs: list[bytes]) -> Iterator[tuple[int, Entry]]:
    """Merge packed runs with a loser tree: (length shared with the entry put out before, entry).

    Every waiting head knows how many bytes it shares with the last entry put out.  Of two heads
    the one that shares more is smaller, without a look at the bytes; only heads that share
    equally many are compared, from the first byte not known on, and the loser keeps the length it
    shares with the winner.
    """
    sources = [unpack_run(run) for run in runs]
    size = 1
    while size < max(len(sources), 1):
        size *= 2
    heads: list[tuple[int, Entry] | None] = [next(s, None) for s in sources] + [None] * (size - len(sources))
    shares = [0] * size
    losers = [-1] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser) of two sources."""
        if heads[a] is None or heads[b] is None:
            return (b, a) if heads[a] is None else (a, b)
        if shares[a] != shares[b]:
            return (a, b) if shares[a] > shares[b] else (b, a)
        x, y = heads[a][1], heads[b][1]
        known = common_prefix(x[0], y[0], shares[a])
        winner, loser = (a, b) if (x[0][known : known + 1], x[1:]) <= (y[0][known : known + 1], y[1:]) else (b, a)
        shares[loser] = known
        return winner, loser

    level = list(range(size))
    node = size
    while len(level) > 1:
        node //= 2
        pairs = [play(level[i], level[i + 1]) for i in range(0, len(level), 2)]
        level = [winner for winner, _ in pairs]
        losers[node : node + len(pairs)] = [loser for _, loser in pairs]
    winner = level[0]
    while heads[winner] is not None:
        yield shares[winner], heads[winner][1]
        heads[winner] = next(sources[winner], None)
        if heads[winner] is not None:
            shares[winner] = heads[winner][0]
        node = (winner + size) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2


SPANS = "kind int, doc long, tid long, start long, stop long, window binary"
SPAN_ARROW = pa.schema(
    [("kind", pa.int32()), ("doc", pa.int64()), ("tid", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("window", pa.binary())]
)


def _span(entry: Entry) -> dict:
    key, right, doc, place, tid = entry
    left = len(key) - HEAD - right
    return {"kind": 0, "doc": doc, "tid": tid, "start": place - left, "stop": place + right, "window": None}


def _earliest(equal: list[Entry], out: list[dict]) -> Entry:
    """The first of equal suffixes; the later ones are repeats over their whole length."""
    first = min(equal, key=lambda e: (e[2], e[3]))
    out += [_span(e) for e in equal if e[2:4] != first[2:4]]
    return first


def sorted_runs(docs: DataFrame, ranges: int) -> DataFrame:
    """Suffixes at the anchors of ``docs`` (doc, tid, text, grams) as packed runs, and spans.

    Of equal suffixes in a run only the first travels on; the others' spans are rows without a
    run, dealt out evenly over the parts.
    """

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries: list[Entry] = []
        size = 0
        whole = (part for batch in batches for part in _unpacked(batch))
        for chunk, data, stops in _chunks(whole):
            place, first, last, hashes = anchors(data, stops)
            owner = np.searchsorted(stops, place, side="right")
            grams = chunk.column("grams")
            wanted = np.unique(grams.flatten().to_numpy())
            keep = np.flatnonzero(np.isin(hashes.view(np.int64), wanted))
            raw, begins = data.tobytes(), np.r_[0, stops[:-1]]
            docs, tids = chunk.column("doc").to_pylist(), chunk.column("tid").to_pylist()
            rows = zip(place[keep].tolist(), first[keep].tolist(), last[keep].tolist(), owner[keep].tolist(), _heads(hashes[keep]).tolist(), strict=True)
            for at, low, high, doc, head in rows:
                right = raw[at : high + LENGTH]
                key = head.to_bytes(HEAD, "big") + right + raw[low:at][::-1]
                entries.append((key, len(right), docs[doc], at - int(begins[doc]), tids[doc]))
                size += len(key) + 32
            if size >= RUN_BYTES:
                yield _run_rows(entries, ranges)
                entries, size = [], 0
        if entries:
            yield _run_rows(entries, ranges)

    return docs.mapInArrow(runs, RUNS)


def _run_rows(entries: list[Entry], ranges: int) -> pa.RecordBatch:
    entries.sort()
    kept: list[Entry] = []
    spans: list[dict] = []
    i = 0
    while i < len(entries):
        j = i + 1
        while j < len(entries) and entries[j][:2] == entries[i][:2]:
            j += 1
        kept.append(_earliest(entries[i:j], spans))
        i = j
    parts: dict[int, list[Entry]] = {}
    for entry in kept:
        parts.setdefault(int.from_bytes(entry[0][:4], "big") * ranges >> 32, []).append(entry)
    codec = pa.Codec("zstd", 1)
    packed = [pack_run(held) for held in parts.values()]
    n = len(spans)
    columns = [
        pa.array([*parts, *[i % ranges for i in range(n)]], pa.int32()),
        pa.array([*[codec.compress(run, asbytes=True) for run in packed], *[None] * n], pa.binary()),
        pa.array([*map(len, packed), *[None] * n], pa.int64()),
        *[pa.array([*[None] * len(parts), *[s[k] for s in spans]], pa.int64()) for k in ("doc", "tid", "start", "stop")],
    ]
    return pa.RecordBatch.from_arrays(columns, ["part", "run", "size", "doc", "tid", "start", "stop"])


RUNS = "part int, run binary, size long, doc long, tid long, start long, stop long"


def merge_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The spans of the ranges in ``batches``, which come sorted by part, range by range."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        parts = batch.column("part").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
        for start, stop in zip(cuts, cuts[1:], strict=False):
            if held and stop > start and held[0].column("part")[0].as_py() != parts[start]:
                yield from merge_range(pa.Table.from_batches(held))
                held = []
            if stop > start:
                held.append(batch.slice(start, stop - start))
    if held:
        yield from merge_range(pa.Table.from_batches(held))


def merge_range(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """The spans of one range of the order: repeated suffixes, and repeated windows of unequal ones.

    Suffixes that share a gram follow each other.  Of equal ones the first stays; the windows of
    those that stay are compared with each other, here if they are few, else as rows of kind 1.
    Rows leave as they come, so that a gram with very many suffixes is never held as a whole.
    """
    spans = table.filter(table["run"].is_null()).select(["doc", "tid", "start", "stop"])
    if len(spans):
        kinds = pa.array(np.zeros(len(spans), np.int32))
        known = spans.add_column(0, "kind", kinds).append_column("window", pa.nulls(len(spans), pa.binary()))
        yield from known.cast(SPAN_ARROW).to_batches()
    codec, sent = pa.Codec("zstd", 1), table.filter(table["run"].is_valid())
    runs = [codec.decompress(r.as_buffer(), n.as_py(), asbytes=True) for r, n in zip(sent["run"], sent["size"], strict=True)]
    out: list[dict] = []
    for found in _merged_spans(runs):
        out.append(found)
        if len(out) == OUT_ROWS:
            yield pa.RecordBatch.from_pylist(out, SPAN_ARROW)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, SPAN_ARROW)


def _merged_spans(runs: list[bytes]) -> Iterator[dict]:
    equal: list[Entry] = []
    group: list[Entry] = []
    wide = False
    for shared, entry in _marked(merge_runs(runs)):
        same = entry and equal and shared == len(entry[0]) == len(equal[-1][0]) and entry[1] == equal[-1][1]
        if equal and not same:
            first = min(equal, key=lambda e: (e[2], e[3]))
            yield from (_span(e) for e in equal if e[2:4] != first[2:4])
            equal = []
            group.append(first)
            if len(group) > GROUP or wide:
                wide = True
                for one in group:
                    yield from _window_rows(one)
                group = []
        if shared < HEAD + GRAM:
            yield from _compare_windows(group)
            group, wide = [], False
        if entry:
            equal.append(entry)


def _marked(merged: Iterator[tuple[int, Entry]]) -> Iterator[tuple[int, Entry | None]]:
    """The merged entries and one mark that shares nothing, which closes the last group."""
    yield from merged
    yield 0, None


def _text(entry: Entry) -> tuple[bytes, int]:
    """The bytes an entry stands for, and where they start in the document."""
    key, right, _, place, _ = entry
    left = key[HEAD + right :][::-1]
    return left + key[HEAD : HEAD + right], place - len(left)


def _window_rows(entry: Entry) -> Iterator[dict]:
    text, start = _text(entry)
    for i in range(len(text) - LENGTH + 1):
        window = text[i : i + LENGTH]
        yield {"kind": 1, "doc": entry[2], "tid": entry[4], "start": start + i, "stop": start + i + LENGTH, "window": window}


def _compare_windows(group: list[Entry]) -> Iterator[dict]:
    if len(group) < 2:
        return
    first: dict[bytes, tuple[int, int]] = {}
    for entry in sorted(group, key=lambda e: (e[2], e[3])):
        text, start = _text(entry)
        span: dict | None = None
        for i in range(len(text) - LENGTH + 1):
            at = (entry[2], start + i)
            if first.setdefault(text[i : i + LENGTH], at) >= at:
                continue
            if span and span["stop"] >= start + i:
                span["stop"] = start + i + LENGTH
                continue
            if span:
                yield span
            span = {"kind": 0, "doc": entry[2], "tid": entry[4], "start": start + i, "stop": start + i + LENGTH, "window": None}
        if span:
            yield span


def repeated_spans(keyed: DataFrame) -> DataFrame:
    """(doc, tid, start, stop): bytes covered by strings that also start earlier; spans may overlap."""
    grams = staged(repeated_grams(keyed), "grams")
    total = grams.agg(F.coalesce(F.sum(F.size("grams")), F.lit(0))).first()[0]
    ranges = max(1, int(total * (LENGTH + 72) // RANGE_BYTES))
    runs = sorted_runs(_packed(keyed).join(grams, ["doc", "tid"]), ranges)
    in_order = runs.repartition("part").sortWithinPartitions("part")
    merged = staged(in_order.mapInArrow(merge_ranges, SPANS), "merged")
    discard(grams)
    windows = merged.filter("kind = 1").select("doc", "tid", "start", "stop", "window")
    firsts = windows.groupBy("window").agg(F.min(F.struct("doc", "start")).alias("first"))
    later = salted_lookup(windows, firsts, ["window"], ["doc", "start"]).filter(
        "struct(doc, start) > struct(first.doc, first.start)"
    )
    columns = ["doc", "tid", "start", "stop"]
    return merged.filter("kind = 0").select(*columns).union(later.select(*columns))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept (binary), kept_sha256.

    Removed is every byte covered by a string of ``LENGTH`` bytes that also starts earlier: in a
    row with a smaller doc_id, or in the same text before.  Null ids come last; rows of one id
    count as one place, so equal texts of one id are not earlier than each other.  Strings are
    judged on the input, overlaps count, and none crosses documents.  Null texts are empty.
    """
    keyed = _keyed(docs)
    spans = repeated_spans(keyed).groupBy("doc", "tid").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _unpacked(whole)):
            rows = []
            for doc, raw, spans in zip(*(batch.column(c).to_pylist() for c in ("doc", "text", "spans")), strict=True):
                kept, removed, n, at = [], 0, 0, 0
                for start, stop in _joined(spans or []):
                    kept.append(raw[at:start])
                    removed, n, at = removed + stop - start, n + 1, stop
                left = b"".join([*kept, raw[at:]])
                rows.append((None if doc == NO_ID else doc, len(raw), removed, n, left, hashlib.sha256(left).hexdigest()))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays(columns, names)

    marked = _packed(keyed).join(spans, ["doc", "tid"], "left")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"
    return marked.mapInArrow(cut, schema)


def _joined(spans: list[dict]) -> Iterator[tuple[int, int]]:
    """Spans in order, those that touch or overlap as one."""
    start = stop = None
    for span in sorted((s["start"], s["stop"]) for s in spans):
        if stop is not None and span[0] <= stop:
            stop = max(stop, span[1])
            continue
        if stop is not None:
            yield start, stop
        start, stop = span
    if stop is not None:
        yield start, stop
