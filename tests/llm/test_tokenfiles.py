import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from loomlog.llm import tokenfiles

from .cases import documents, empty, odd_docs, odd_texts

PATH = public_tokenizers.path("word_bpe_49k.json")


def expected(pairs):
    library, out, start = Tokenizer.from_file(PATH), [], 0
    for doc_id, text in sorted(pairs, key=lambda p: (p[0] is None, p[0] or 0, (p[1] or "").encode())):
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: r[1])


def test_files_hold_the_library_ids_in_order(spark, tmp_path):
    rng = random.Random(1)
    words = ["The", "the,", "idea.", "x.,", "don't", "12.5", "ÉTÉ", "naïve.", "İ", "a<|endoftext|>b", "é", "日本。", "..."]
    pairs = [(i * 3 % 101, " ".join(rng.choice(words) for _ in range(rng.randrange(40)))) for i in range(101)]
    tokenfiles.write_ids(documents(spark, pairs), str(tmp_path / "f"), PATH, shard_ids=200)
    assert ordered(tokenfiles.read_ids(spark, str(tmp_path / "f")).collect()) == expected(pairs)
    assert spark.read.parquet(str(tmp_path / "f")).count() > 4


def test_runs_are_encoded_as_the_library_does():
    """Letters and marks, alone and together, with few calls of the library: most runs share one."""
    rng = random.Random(4)
    alphabet = ["a", "e", "s", "t", "é", "ß", "É", "ñ", "×", "ÿ", "ŉ", "ª", "İ", "ſ", "Σ", "e\u0301", "ж", "日", "3", "<", "'", "'s", ".", ",", "!", "-", "_", "\u0338", "\u00a0", "\x00", "\x1f"]
    plain = alphabet[:4] * 6
    runs = ["".join(rng.choice(alphabet if i % 3 else plain) for _ in range(rng.randrange(1, 9))) for i in range(6000)]
    runs += [run + rng.choice(["!!", "$$$", "'", "'.", ".,", "...'", "~^`"]) for run in runs]
    texts = [" ".join(runs[i : i + 20]) for i in range(0, len(runs), 20)]
    library = Tokenizer.from_file(PATH)
    known = tokenfiles.Encoder(PATH)
    for at in range(0, len(texts), 100):
        got = known.encode([text.encode() for text in texts[at : at + 100]])
        for text, ids in zip(texts[at : at + 100], got, strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == [*library.encode(text, add_special_tokens=False).ids, 1], text


def test_punctuation_behind_a_letter_is_no_call_of_its_own(monkeypatch):
    known = tokenfiles.Encoder(PATH)
    alone = []
    monkeypatch.setattr(known, "_whole", lambda text: alone.append(text) or tokenfiles.Encoder._whole(known, text))
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdeé") for _ in range(6)) + mark for mark in ("!!", "$$$", ".", ".&&&", ",###") for _ in range(200)]
    known.encode([" ".join(words).encode()])
    assert len(alone) <= 5


def test_odd_rows(spark, tmp_path):
    tokenfiles.write_ids(odd_docs(spark, clashing=True), str(tmp_path / "f"), PATH)
    assert ordered(tokenfiles.read_ids(spark, str(tmp_path / "f")).collect()) == expected(odd_texts())
    tokenfiles.write_ids(empty(spark), str(tmp_path / "e"), PATH)
    assert tokenfiles.read_ids(spark, str(tmp_path / "e")).count() == 0


def test_grammar_gives_back_every_document_and_is_shorter():
    rng = random.Random(2)
    phrases = [[rng.randrange(40) for _ in range(rng.randrange(2, 9))] for _ in range(12)]
    docs = [[i for _ in range(rng.randrange(0, 60)) for i in rng.choice(phrases)] + [1] for _ in range(120)]
    docs += [[7] * 501 + [1], [1], [1, 1, 1, 1]]
    blob = tokenfiles.pack([np.array(d, "<u4").tobytes() for d in docs])
    shard = tokenfiles.Shard(blob)
    assert [d.tolist() for d in shard.all()] == docs
    assert [shard.document(i).tolist() for i in range(len(docs))] == docs
    assert len(shard.rules) and len(shard.seq) < 0.6 * sum(map(len, docs))
    assert all(len(shard.expand(np.array([shard.base + k], np.uint32))) == n for k, n in enumerate(shard.sizes.tolist()))


def test_rules_are_made_until_no_pair_is_frequent():
    """Pairs that share a bucket are all counted, and no number of rounds ends the work early."""
    a, b = (np.arange(40, dtype=np.uint32)[:, None] * np.ones(40_000, np.uint32)), np.arange(40_000, dtype=np.uint32)
    bucket = (a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77)) >> np.uint32(14)
    alike = np.argwhere(bucket == bucket[2, 3]).tolist()[:3]
    assert len(alike) == 3
    deep = [50_000 + n for n in range(300)]
    docs = [pair for pair in alike for _ in range(40)] + [[*deep, 1] for _ in range(30)]
    shard = tokenfiles.Shard(tokenfiles.pack([np.array(d, "<u4").tobytes() for d in docs]))
    assert [d.tolist() for d in shard.all()] == docs
    assert all(pair in shard.rules.tolist() for pair in alike)
    counts, ends = {}, np.zeros(len(shard.seq), bool)
    ends[shard.starts[1:].astype(int) - 1] = True
    for left, right, end in zip(shard.seq[:-1].tolist(), shard.seq[1:].tolist(), ends.tolist(), strict=False):
        if not end:
            counts[left, right] = counts.get((left, right), 0) + 1
    assert max(counts.values(), default=0) < tokenfiles.LEAST_COUNT


class Asked(dict):
    """Counts what is looked up, found or not."""

    n = 0

    def get(self, key, default=None):
        self.n += 1
        return super().get(key, default)


def test_a_repeated_run_is_looked_up_once():
    known = tokenfiles.Encoder(PATH)
    known.known = Asked()
    repeated = [b"The cat sat on the mat.", b"", b" on\tthe  mat\nthe cat ", b"the", "\u00e9t\u00e9 <|x|> the".encode(), b"\v"] * 20
    found = known.encode(repeated)
    whole = known.library.encode_batch([text.decode() for text in repeated], add_special_tokens=False)
    assert [np.frombuffer(ids, "<u4").tolist() for ids in found] == [[*x.ids, tokenfiles.END_ID] for x in whole]
    assert known.known.n == len({run for text in repeated if b"<|" not in text for run in text.lower().split()})
