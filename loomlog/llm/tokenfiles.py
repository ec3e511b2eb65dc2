"""Token ids as shards of a Re-Pair grammar, written in document order and decodable at random."""

from __future__ import annotations

import functools
import os
import string
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomlog.llm.common import distinct_runs, gathered, laid_out, text_of

#: Id appended to every document.
END_ID = 1
#: Ids a shard is meant to hold; a longer document has a shard of its own.
SHARD_IDS = 1 << 20
#: A pair becomes a rule if a shard has it this often; buckets pairs are counted in first.
LEAST_COUNT = 24
BUCKETS = 1 << 18
#: Word encodings a worker remembers, and text encoded at a time.
CACHE_WORDS = 1_200_000
CHUNK_BYTES = 1 << 22
MAGIC = b"RPG1"
SPACE = b" \t\n\v\f\r"
#: Marks that may end a run, and letters, two bytes each, that they are parted from as from plain ones.
STOPS = string.punctuation.encode()
LATIN = {chr(i).encode() for i in range(0xC0, 0x100) if chr(i).isalpha()}
#: Words the vocabulary's normalisation and pattern leave as they are: small letters that do not compose.
PLAIN = "\u0250"


class Encoder:
    """Ids of whole texts, each distinct run between white space encoded by the library once.

    The vocabulary lower-cases, drops white space and splits between letters and punctuation, so a
    text's ids are those of its runs in order, and a run of letters with punctuation behind it is
    two.  Texts with a mark that may begin a special token go to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        # The same vocabulary for small letters alone, without the steps that change nothing there.
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = None
        bytewise = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), bytewise])
        self.known: dict[bytes, bytes] = {}
        # Every word the vocabulary's pattern finds ends in a token that says so.
        self.closing = np.zeros(self.library.get_vocab_size() + 1, bool)
        self.closing[[i for token, i in self.library.get_vocab().items() if token.endswith("</w>")]] = True

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Per text its ids and the end id, four little-endian bytes each."""
        if len(self.known) > CACHE_WORDS:
            self.known = {}
        end = END_ID.to_bytes(4, "little")
        plain = [i for i, text in enumerate(texts) if b"<|" not in text]
        words, number, ends = distinct_runs([texts[i].lower() for i in plain], SPACE)
        out = [b""] * len(texts)
        for i, ids in zip(plain, laid_out(self._ids_of(words), number, ends, "<u4"), strict=True):
            out[i] = ids + end
        return [ids or self._whole(text.decode()) + end for text, ids in zip(texts, out, strict=True)]

    def _ids_of(self, runs: list[bytes]) -> list[bytes]:
        known = self.known
        found = list(map(known.get, runs))
        unseen = {run for run, ids in zip(runs, found, strict=True) if ids is None}
        if not unseen:
            return found
        # A run such as "word.," is that word and the stops behind it.
        split = {run: parts for run in unseen if run[-1] in STOPS and (parts := _parted(run))}
        self._learn(unseen.difference(split).union(*split.values()).difference(known))
        known.update((run, known[word] + known[stops]) for run, (word, stops) in split.items())
        return list(map(known.__getitem__, runs))

    def _whole(self, text: str) -> bytes:
        ids = self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return np.array(ids, "<u4").tobytes()

    def _learn(self, unseen: set[bytes]) -> None:
        """Words of letters only share a call, as each closes once; others have a call each."""
        plain, letters, others = [], [], []
        for run in unseen:
            text = run.decode()
            if not text.isalpha():
                others.append(run)
            elif run.isascii() or max(text) < PLAIN and text == text.lower():
                plain.append(run)
            else:
                letters.append(run)
        for library, words in ((self.plain, plain), (self.library, letters)):
            for at in range(0, len(words), 256):
                group = words[at : at + 256]
                joined = b"\n".join(group).decode()
                ids = np.array(library.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
                stops = np.flatnonzero(self.closing[ids]) + 1
                if len(stops) != len(group):
                    others += group
                    continue
                data, ends = ids.tobytes(), (4 * stops).tolist()
                self.known.update(zip(group, [data[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))
        for run in others:
            self.known[run] = self._whole(run.decode())


def _parted(run: bytes) -> tuple[bytes, bytes] | None:
    """A run that ends in punctuation behind a letter as what is before it and the punctuation."""
    word = run.rstrip(STOPS)
    letter = b"a" <= word[-1:] <= b"z" or word[-2:] in LATIN
    return (word, run[len(word) :]) if letter else None


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def compress(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(sequence, rules by round) of a Re-Pair grammar over ``ids``; ``ends`` marks last ids.

    Each round takes the frequent neighbouring pairs inside documents from the most frequent down,
    as long as no symbol is the right part of one and the left part of another, so that no two
    occurrences overlap.  Each taken pair gets the next free symbol, from the largest id on.  Rounds
    end when no pair is frequent any more.

    After the first round only places are counted at which a pair was frequent before or has a new
    symbol: a pair of old symbols never gets more places.
    """
    seq, last = ids.astype(np.uint32), ends.copy()
    live = ~last
    free = int(seq.max(initial=0)) + 1
    rounds: list[np.ndarray] = []
    while True:
        left, right = seq[:-1], seq[1:]
        at, which, pairs = _frequent(left, right, np.flatnonzero(live[:-1]))
        live = np.zeros(len(seq), bool)
        live[at] = True
        symbol = _choose(pairs, np.bincount(which, minlength=len(pairs)), free)
        new = symbol[which]
        taken = new >= 0
        at, new = at[taken], new[taken]
        if not len(at):
            break
        twin = left[at] == right[at]
        if twin.any():  # in a run of one id every second place counts
            fresh = np.r_[True, (np.diff(at) > 1) | (new[1:] != new[:-1])]
            first = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            keep = ~twin | ((np.arange(len(at)) - first) % 2 == 0)
            at, new = at[keep], new[keep]
        chosen = np.flatnonzero(symbol >= 0)
        rules = pairs[chosen[np.argsort(symbol[chosen])]]
        rounds.append(np.stack([rules >> np.uint64(32), rules & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32))
        free += len(rules)
        seq[at], last[at] = new, last[at + 1]
        live[at], live[at[at > 0] - 1] = True, True
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        stay = np.flatnonzero(stay)
        seq, last = seq[stay], last[stay]
        live = live[stay] & ~last
    return seq, rounds


def _frequent(left: np.ndarray, right: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, the pair's number at each place, pairs): every pair that occurs ``LEAST_COUNT`` times or more.

    Places are dealt to buckets by the hash of their pair; a bucket with fewer places holds no such
    pair.  Of every other bucket the last pair is counted at once, and what is left of it, if that is
    still enough, by sorting.
    """
    a, b = left[at], right[at]
    where = (a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77)) >> np.uint32(14)
    several = np.flatnonzero((np.bincount(where, minlength=BUCKETS) >= LEAST_COUNT)[where])
    at, where = at[several], where[several]
    keys = a[several].astype(np.uint64) << np.uint64(32) | b[several]
    pairs = np.zeros(BUCKETS, np.uint64)
    pairs[where] = keys
    same = pairs[where] == keys
    number = np.full(len(at), -1, np.int64)
    number[same] = where[same]
    rest = np.flatnonzero(~same)
    rest = rest[(np.bincount(where[rest], minlength=BUCKETS) >= LEAST_COUNT)[where[rest]]]
    others, number[rest] = np.unique(keys[rest], return_inverse=True)
    number[rest] += BUCKETS
    pairs = np.concatenate([pairs, others])
    enough = np.bincount(number[number >= 0], minlength=len(pairs)) >= LEAST_COUNT
    kept = np.flatnonzero((number >= 0) & enough[number])
    return at[kept], (np.cumsum(enough) - 1)[number[kept]], pairs[enough]


def _choose(pairs: np.ndarray, counts: np.ndarray, free: int) -> np.ndarray:
    """The symbol of each pair that becomes a rule, else -1."""
    symbol = np.full(len(pairs), -1, np.int64)
    lefts: set[int] = set()
    rights: set[int] = set()
    frequent = np.flatnonzero(counts >= LEAST_COUNT)
    for i in frequent[np.argsort(-counts[frequent], kind="stable")].tolist():
        a, b = int(pairs[i]) >> 32, int(pairs[i]) & 0xFFFFFFFF
        if a in rights or b in lefts or a == b and (a in lefts or b in rights):
            continue
        lefts.add(a)
        rights.add(b)
        symbol[i] = free
        free += 1
    return symbol


def pack(documents: list[bytes]) -> bytes:
    """A shard: counts, rules, expansion lengths, symbols per document, and the sequence."""
    lengths = np.array([len(x) // 4 for x in documents], np.int64)
    ids = np.frombuffer(b"".join(documents), "<u4")
    ends = np.zeros(len(ids), bool)
    ends[np.cumsum(lengths) - 1] = True
    seq, rounds = compress(ids, ends)
    base = int(ids.max(initial=0)) + 1
    sizes = np.ones(base + sum(map(len, rounds)), np.int64)
    at = base
    for rules in rounds:
        sizes[at : at + len(rules)] = sizes[rules[:, 0]] + sizes[rules[:, 1]]
        at += len(rules)
    starts = np.searchsorted(np.cumsum(sizes[seq]), np.cumsum(lengths) - lengths, side="right").astype(np.uint32)
    rules = np.concatenate([*rounds, np.zeros((0, 2), np.uint32)])
    head = struct.pack("<4sIIIQ", MAGIC, base, len(rounds), len(documents), len(seq))
    parts = [np.array([len(r) for r in rounds], np.uint32), rules, sizes[base:].astype(np.uint32), lengths.astype(np.uint32), starts, seq]
    return head + b"".join(np.ascontiguousarray(p, p.dtype.newbyteorder("<")).tobytes() for p in parts)


class Shard:
    """A shard read back; :meth:`document` expands one document, :meth:`all` every one."""

    def __init__(self, blob: bytes):
        magic, self.base, n_rounds, n_docs, n_seq = struct.unpack_from("<4sIIIQ", blob)
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        at = struct.calcsize("<4sIIIQ")

        def take(n: int) -> np.ndarray:
            nonlocal at
            part = np.frombuffer(blob, "<u4", n, at)
            at += 4 * n
            return part

        self.per_round = take(n_rounds).astype(np.int64)
        self.rules = take(2 * int(self.per_round.sum())).reshape(-1, 2)
        self.sizes = take(len(self.rules))
        self.lengths, self.starts, self.seq = take(n_docs).astype(np.int64), take(n_docs), take(n_seq)
        if at != len(blob):
            raise ValueError("shard is cut off or has bytes left over")

    @functools.cached_property
    def _table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, size): the expansions of all symbols end to end, built round by round."""
        size = np.concatenate([np.ones(self.base, np.int64), self.sizes.astype(np.int64)])
        start = np.cumsum(size) - size
        ids = np.arange(int(size.sum()), dtype=np.uint32)
        low = self.base
        for n in self.per_round.tolist():
            parts = self.rules[low - self.base : low - self.base + n].ravel()
            stop = int(start[low + n]) if low + n < len(start) else len(ids)
            ids[int(start[low]) : stop] = gathered(ids, start[parts], size[parts])
            low += n
        return ids, start, size

    def expand(self, seq: np.ndarray) -> np.ndarray:
        """The ids that symbols stand for."""
        ids, start, size = self._table
        return gathered(ids, start[seq], size[seq])

    def document(self, i: int) -> np.ndarray:
        stop = self.starts[i + 1] if i + 1 < len(self.starts) else len(self.seq)
        return self.expand(self.seq[self.starts[i] : stop])

    def all(self) -> list[np.ndarray]:
        return np.split(self.expand(self.seq), np.cumsum(self.lengths)[:-1])


def write_ids(docs: DataFrame, folder: str, tokenizer: str, shard_ids: int = SHARD_IDS) -> None:
    """Write the ids of ``docs`` (doc_id, text), each with the end id, in ascending doc_id order.

    Rows are ranged by doc_id (null last, ties by text) and each range is written in order as
    shards of whole documents: (part, seq, doc_ids, n_ids, shard).  A null text is an empty one.
    ``tokenizer`` is the path of a vocabulary file, the same on every machine.
    """

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, ids, held, n = TaskContext.get().partitionId(), 0, [], [], 0
        for doc_id, encoded in _encoded(batches, tokenizer):
            ids.append(doc_id)
            held.append(encoded)
            n += len(encoded) // 4
            if n >= shard_ids:
                yield _shard_row(part, seq, ids, held, n)
                seq, ids, held, n = seq + 1, [], [], 0
        if held:
            yield _shard_row(part, seq, ids, held, n)

    ordered = docs.select(F.col("doc_id").cast("long"), text_of().cast("binary").alias("text"))
    ranged = ordered.repartitionByRange(F.col("doc_id").asc_nulls_last())
    in_order = ranged.sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "text")
    in_order.mapInArrow(shards, "part int, seq int, doc_ids array<long>, n_ids long, shard binary").write.parquet(folder)


def _encoded(batches: Iterator[pa.RecordBatch], tokenizer: str) -> Iterator[tuple[int | None, bytes]]:
    known = encoder(tokenizer)
    for batch in batches:
        sizes = np.cumsum([len(x.as_buffer()) for x in batch.column(1)])
        cuts = np.searchsorted(sizes, np.arange(0, int(sizes[-1]) + 1 if len(sizes) else 0, CHUNK_BYTES), "right")
        edges = sorted({0, *cuts.tolist(), batch.num_rows})
        for start, stop in zip(edges, edges[1:], strict=False):
            rows = batch.slice(start, stop - start)
            yield from zip(rows.column(0).to_pylist(), known.encode(rows.column(1).to_pylist()), strict=True)


def _shard_row(part: int, seq: int, ids: list[int | None], held: list[bytes], n: int) -> pa.RecordBatch:
    columns = [
        pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([ids], pa.list_(pa.int64())),
        pa.array([n], pa.int64()), pa.array([pack(held)], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["part", "seq", "doc_ids", "n_ids", "shard"])


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Per document of the shards in ``folder``: doc_id, start, n_tokens, ids_crc32, in file order.

    ``start`` counts the ids of all documents before it.  The parts' totals, one row per task that
    wrote, are summed up on their own; a shard's place is a broadcast row, one for about a million
    ids, so that the shards themselves are decoded where they lie.
    """
    shards = spark.read.parquet(folder)
    sizes = shards.select("part", "seq", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # One row per writing task, which bounds both the single-partition sum and the broadcast.
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = Window.partitionBy("part").orderBy("seq")
    offsets = sizes.select("part", "seq", (F.sum("n_ids").over(inside) - F.col("n_ids")).alias("inside"))
    placed = offsets.join(F.broadcast(before), "part").select("part", "seq", (F.col("before") + F.col("inside")).alias("base"))
    located = shards.join(F.broadcast(placed), ["part", "seq"]).select("base", "doc_ids", "shard")
    return located.mapInArrow(_documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for base, doc_ids, blob in zip(*batch.columns, strict=True):
            shard = Shard(blob.as_buffer())
            crcs = [zlib.crc32(np.ascontiguousarray(ids, "<u4").data) for ids in shard.all()]
            starts = base.as_py() + np.cumsum(shard.lengths) - shard.lengths
            yield pa.RecordBatch.from_arrays(
                [doc_ids.values.cast(pa.int64()), pa.array(starts), pa.array(shard.lengths), pa.array(crcs, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )
