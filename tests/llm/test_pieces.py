import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
from sentencepiece import SentencePieceProcessor

from loomlog.llm import pieces

from .cases import empty, odd_docs

PATH = public_tokenizers.path("piece_bpe_32k.model")


def texts():
    rng = random.Random(4)
    library = SentencePieceProcessor(model_file=PATH)
    known = [library.id_to_piece(i).replace("▁", " ") for i in range(259, 32000)]
    alphabet = "abcdefgh etaoin  shrdlu\n\t.,-=_ABC123éüßñ日本😀▁"
    fixed = ["", " ", "  a  b ", "<s></s><0x0A>", "▁x ▁", " " * 40 + "x", "x" + " " * 33, "a" * 400, "\x00é"]
    return (
        fixed
        + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(50))) for _ in range(400)]
        + ["".join(rng.choice(known) for _ in range(rng.randrange(1, 10))) for _ in range(600)]
    )


def test_paths_are_the_library_segmentation():
    machine, library = pieces.transducer(PATH), SentencePieceProcessor(model_file=PATH)
    found = machine.encode(texts())
    for text, ids in zip(texts(), found, strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == library.encode(text), text
        assert machine.decode(ids) == library.decode(library.encode(text))


def test_only_one_path_has_finite_weight():
    machine = pieces.transducer(PATH)
    for word in ("▁the", "▁reading", "▁x.\n", "▁▁▁a"):
        for stop in range(1, len(word) + 1):
            last = [
                piece
                for start in range(stop)
                if (piece := word[start:stop]) in machine.score
                and machine.finite(machine.path(word[:start], [""])[-1], piece)
            ]
            assert len(last) == (word[stop - 1] in machine.score or len(last))


def test_odd_rows(spark):
    docs = odd_docs(spark, clashing=True)
    rows = pieces.encode(docs, PATH).collect()
    library = SentencePieceProcessor(model_file=PATH)
    assert len(rows) == 14
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    for row in docs.filter("doc_id IS NOT NULL").collect():
        text = row.text or ""
        assert by[row.doc_id].ids == library.encode(text)
        assert by[row.doc_id].round_trip == ("▁" not in text)
        assert by[row.doc_id].decoded_sha256 == hashlib.sha256(text.replace("▁", " ").encode()).hexdigest()
    assert pieces.encode(empty(spark), PATH).count() == 0


def test_workers_keep_nothing_of_a_task(spark):
    """What a worker remembers of words and pairs would take memory from the steps that follow."""
    docs = spark.createDataFrame([(i, text) for i, text in enumerate(texts())], "doc_id long, text string")
    assert pieces.encode(docs.repartition(8), PATH).count() == len(texts())

    def kept(batches):
        for batch in batches:
            machine = pieces.transducer(PATH)
            yield pa.RecordBatch.from_arrays([pa.array([len(machine.known) + len(machine.beside)] * batch.num_rows)], ["n"])

    found = spark.range(0, 32, 1, 8).mapInArrow(kept, "n long").collect()
    assert [row.n for row in found] == [0] * 32


class Asked(dict):
    """Counts what is looked up, found or not."""

    n = 0

    def get(self, key, default=None):
        self.n += 1
        return super().get(key, default)


def test_a_repeated_word_is_looked_up_once():
    machine = pieces.Transducer(PATH)
    machine.known = Asked()
    library = SentencePieceProcessor(model_file=PATH)
    repeated = ["the cat sat on the mat", "", "on the mat the cat sat", "the", "a", "mat\tcat\nthe é"] * 20
    found = machine.encode(repeated)
    assert [np.frombuffer(ids, "<u2").tolist() for ids in found] == library.encode(repeated)
    assert machine.known.n == len({word for text in repeated for word in text.split(" ") if word})
