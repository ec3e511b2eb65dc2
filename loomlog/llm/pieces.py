"""SentencePiece encoding and decoding as shortest paths through a weighted transducer.

The transducer of a model has three layers.  The normaliser maps blanks to the mark U+2581 and puts
one in front.  The pieces are arcs over normalised text, and a character without a piece is an arc to
its UTF-8 byte pieces.  The states remember the last piece, and an arc may follow a piece at finite
weight only if the merge order of the model leaves the two side by side; all other continuations
weigh infinity in the tropical semiring.  A string then has exactly one path of finite weight, which
is the model's own segmentation, and so has each of its prefixes, so that a shortest-path step keeps
one state for each position.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterable, Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.llm.common import distinct_runs, laid_out, released, text_of

MARK = "▁"
#: Encoded words and piece pairs a worker remembers.
CACHE_WORDS, CACHE_PAIRS = 300_000, 250_000
#: Bytes of text encoded at a time.
CHUNK_BYTES = 1 << 21
SEGMENT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


class Ending:
    """How a piece may end: the piece that is just this, if there is one, and longer endings by the character before."""

    __slots__ = ("piece", "longer")

    def __init__(self):
        self.piece: str | None = None
        self.longer: dict[str, Ending] = {}


class Transducer:
    """Compiled from a model file with identity normalisation, merge scores and byte fallback."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece.sentencepiece_model_pb2 import ModelProto

        model = SentencePieceProcessor(model_file=path)
        spec = ModelProto.FromString(model.serialized_model_proto())
        rules = spec.normalizer_spec
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix:
            raise ValueError("only identity normalisation with a blank in front is compiled")
        if spec.trainer_spec.model_type != spec.trainer_spec.BPE or not spec.trainer_spec.byte_fallback:
            raise ValueError("a model of merges with byte fallback is needed")
        number = range(model.get_piece_size())
        plain = [i for i in number if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        self.score = {model.id_to_piece(i): model.get_score(i) for i in plain}
        self.codes = {model.id_to_piece(i): i.to_bytes(2, "little") for i in plain}
        self.endings = Ending()
        for piece in self.score:
            ending = self.endings
            for character in reversed(piece):
                ending = ending.longer.setdefault(character, Ending())
            ending.piece = piece
        bytes_at = {int(model.id_to_piece(i)[3:5], 16): i for i in number if model.is_byte(i)}
        self.byte_id = [bytes_at[value] for value in range(256)]
        self.output = [b""] * len(number)
        for i in plain:
            self.output[i] = model.id_to_piece(i).encode()
        for value, i in bytes_at.items():
            self.output[i] = bytes([value])
        # By the segment without its first mark, in UTF-8.
        self.known: dict[bytes, bytes] = {}
        self.beside: dict[tuple[str, str], bool] = {}

    def merged(self, text: str) -> list[str]:
        """The segmentation by merges: best score first, the leftmost of equals."""
        symbols, none, score = list(text), -np.inf, self.score.get
        scores = [score(a + b, none) for a, b in zip(symbols, symbols[1:], strict=False)]
        while scores and (best := max(scores)) > none:
            at = scores.index(best)
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            del scores[at]
            for i in range(max(at - 1, 0), min(at + 1, len(scores))):
                scores[i] = score(symbols[i] + symbols[i + 1], none)
        return symbols

    def finite(self, last: str, piece: str) -> bool:
        """Whether the arc of ``piece`` after ``last`` has finite weight."""
        pair = (last, piece)
        answer = self.beside.get(pair)
        if answer is None:
            if len(self.beside) > CACHE_PAIRS:
                self.beside.clear()
            answer = self.beside[pair] = not last and self.merged(piece) == [piece] or self.merged(last + piece) == [last, piece]
        return answer

    def path(self, text: str, states: list[str]) -> list[str]:
        """The last piece at each position of ``text``; ``states`` has those of a prefix already."""
        beside, finite, shortest = self.beside.get, self.finite, self.endings.longer
        for stop in range(len(states), len(text) + 1):
            start, longer = stop, shortest
            while start and (ending := longer.get(text[start - 1])):
                start -= 1
                piece = ending.piece
                if piece is not None:
                    last = states[start]
                    answer = beside((last, piece))
                    if answer or answer is None and finite(last, piece):
                        break
                longer = ending.longer
            else:
                piece = text[stop - 1 : stop]  # a character of no piece: its bytes
            states.append(piece)
        return states

    def ids_of(self, states: list[str]) -> bytes:
        """The path that ends in the last state, as little-endian 16-bit ids."""
        found: list[bytes] = []
        at, codes = len(states) - 1, self.codes
        while at > 0:
            piece = states[at]
            found.append(codes.get(piece) or self._spelled(piece))
            at -= len(piece)
        return b"".join(found[::-1])

    def _spelled(self, character: str) -> bytes:
        """The byte pieces of a character."""
        return b"".join(self.byte_id[b].to_bytes(2, "little") for b in character.encode())

    def learn(self, segments: Iterable[str]) -> None:
        """Shortest paths of new segments; in sorted order each goes on from the common prefix."""
        before, states, known = "", [""], self.known
        for segment in sorted(segments):
            shared = len(commonprefix((before, segment)))
            states = self.path(segment, states[: shared + 1])
            known[segment[1:].encode()] = self.ids_of(states)
            before = segment

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts.  No piece spans a mark but at its start, so words are paths of their own."""
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        out: list[bytes | None] = [None] * len(texts)
        plain: list[int] = []
        for i, text in enumerate(texts):
            if not text:
                out[i] = b""
            elif "  " in text or MARK in text or text[0] == " " or text[-1] == " ":
                out[i] = b"".join(self._codes_of([x[1:].encode() for x in SEGMENT.findall(MARK + text.replace(" ", MARK))]))
            else:
                plain.append(i)
        # One blank parts two words of the other texts, and nothing else does.
        words, number, ends = distinct_runs([texts[i].encode() for i in plain], b" ")
        for i, ids in zip(plain, laid_out(self._codes_of(words), number, ends, "<u2"), strict=True):
            out[i] = ids
        return out

    def _codes_of(self, words: list[bytes]) -> list[bytes]:
        """Ids of segments without their first mark."""
        codes = list(map(self.known.get, words))
        if None in codes:
            self.learn({MARK + word.decode() for word, ids in zip(words, codes, strict=True) if ids is None})
            codes = list(map(self.known.__getitem__, words))
        return codes

    def decode(self, ids: bytes) -> str:
        """The text of ids: pieces joined, marks as blanks, the blank in front dropped."""
        raw = b"".join(map(self.output.__getitem__, np.frombuffer(ids, "<u2").tolist()))
        return raw.decode("utf-8", "replace").replace(MARK, " ")[1:]


@functools.lru_cache(maxsize=1)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def encode(docs: DataFrame, model: str, keep_ids: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_pieces, ids, ids_crc32, decoded_sha256, round_trip.

    ``ids`` are those of the model's own encoding without control pieces; ``ids_crc32`` is taken
    over them as little-endian 16-bit integers; ``round_trip`` tells whether the decoded ids are
    the text again, which only a text with U+2581 in it, decoded as a blank, fails.  A null text
    is empty and has no ids.  ``model`` is a path valid on every machine.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(model)
        try:
            yield from encoded(machine, batches)
        finally:
            # Workers live on; what they remember of this task's words and pairs is of little use to the
            # next, and would stay beside the steps that follow.
            machine.known.clear()
            machine.beside.clear()

    def encoded(machine: Transducer, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum([len(x.as_buffer()) for x in batch.column(1)])
            cuts = np.searchsorted(sizes, np.arange(CHUNK_BYTES, int(sizes[-1]) if len(sizes) else 0, CHUNK_BYTES))
            edges = sorted({0, *cuts.tolist(), batch.num_rows})
            for start, stop in zip(edges, edges[1:], strict=False):
                part = batch.slice(start, stop - start)
                texts = part.column(1).to_pylist()
                ids = machine.encode(texts)
                decoded = [machine.decode(x) for x in ids]
                lengths = np.array([len(x) // 2 for x in ids])
                offsets = pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32))
                flat = pa.array(np.frombuffer(b"".join(ids), "<u2").astype(np.int32))
                columns = [
                    part.column(0), pa.array(lengths),
                    pa.ListArray.from_arrays(offsets, flat) if keep_ids else pa.nulls(len(ids), pa.list_(pa.int32())),
                    pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                    pa.array(decoded, pa.string()),
                    pa.array([a == b for a, b in zip(texts, decoded, strict=True)]),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "n_pieces", "ids", "ids_crc32", "decoded", "round_trip"]
    schema = "doc_id long, n_pieces long, ids array<int>, ids_crc32 long, decoded string, round_trip boolean"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return texts.mapInArrow(released(rows), schema).withColumn("decoded_sha256", _sha("decoded")).drop("decoded")


def _sha(column: str) -> Column:
    return F.sha2(column, 256)
