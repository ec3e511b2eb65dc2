"""Each stage of the pipeline over the smallest tables, held against a plain version of its rule."""

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

import __spark_entry__ as entry
import corpus_pipeline
from loomlog.llm import decontaminate, simhash
from loomlog.llm.common import staged

from .cases import DOCS, empty, odd_docs
from .test_exact import brute as exact_brute
from .test_simhash import near, roots

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """(documents before, documents after) by stage."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        after = staged(stage(spark, docs, SF), "test-stage")
        out[name] = (docs, after)
        docs = after
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_stages_in_order_keep_the_columns(stages):
    assert list(stages) == ["toxicity", "exact dedup", "SimHash near-dedup", "benchmark decontamination", "SentencePiece"]
    for name, (before, after) in list(stages.items())[:-1]:
        assert after.columns == before.columns, name
        assert set(texts(after).items()) <= set(texts(before).items())


def test_toxic_documents_go_and_clean_ones_stay(spark, stages):
    before, after = (set(texts(df)) for df in stages["toxicity"])
    scored = {r.doc_id: r.predicted for r in entry.queries()["op9_toxicity"](spark, SF).collect()}
    assert before - after == {i for i, predicted in scored.items() if predicted}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    clean = [i for i in labels if labels[i] == 0]
    assert len([i for i in clean if i in after]) >= 0.9 * len(clean)


def test_exact_copies_go(stages):
    before, after = (texts(df) for df in stages["exact dedup"])
    assert set(after) == {keep for _, keep, _, kept, _ in exact_brute(before.items()) if kept}


def test_one_of_each_component_stays(stages):
    before, after = (texts(df) for df in stages["SimHash near-dedup"])
    fps = {i: int(np.uint64(simhash.fingerprint(t.encode())).astype(np.int64)) for i, t in before.items()}
    distinct = sorted(set(fps.values()))
    root, first = roots(distinct, near(distinct)), {}
    for i in sorted(fps):
        first.setdefault(root[fps[i]], i)
    assert set(after) == set(first.values())


def test_documents_with_benchmark_passages_go(spark, stages):
    before, after = (texts(df) for df in stages["benchmark decontamination"])
    items = [decontaminate.read_item(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    def leaked(text):
        words = decontaminate.words_of([text.encode()]).hashes.tolist()
        for item in items:
            n = len(item.words)
            for at in range(0, max(len(words) - n // 2, 1), 4):
                part = words[at : at + n + 8]
                if len(set(part) & set(item.words)) >= 0.6 * len(set(item.words)):
                    if decontaminate.common_subsequence(item.words, part) >= 0.8 * n:
                        return True
        return False

    assert set(before) - set(after) == {i for i, t in before.items() if leaked(t)}


def test_ids_are_the_library_ids(stages):
    before, after = stages["SentencePiece"]
    library = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in after.collect()}
    assert set(got) == set(texts(before))
    assert all(got[i].ids == library.encode(t) and got[i].round_trip for i, t in texts(before).items())


def test_odd_and_empty_documents(spark):
    for docs in (odd_docs(spark, clashing=True), empty(spark, DOCS)):
        for name, stage in corpus_pipeline.STAGES:
            after = staged(stage(spark, docs, SF), "test-stage")
            if name != "SentencePiece":
                assert after.columns == docs.columns
                docs = after
        assert after.count() == docs.count()


def test_registered():
    names = {name.split("_")[0] for name in entry.queries() if name.startswith("op")}
    assert names == {f"op{n}" for n in range(1, 14)} and "pipeline" in entry.queries()


def test_workers_hand_memory_back_at_the_end_of_a_task(monkeypatch):
    """What allocators keep after a task would stay beside the steps that follow."""
    from loomlog.llm import common

    calls = []
    monkeypatch.setattr(common, "_trim", lambda: calls.append("trim"))
    assert list(common.released(lambda batches: (x + 1 for x in batches))(iter([1, 2]))) == [2, 3]
    assert calls == ["trim"]
    stopped = common.released(lambda batches: iter(batches))(iter([1, 2]))
    next(stopped)
    stopped.close()
    assert calls == ["trim", "trim"]


def test_words_counted_in_parts_add_up(spark):
    """More words than are counted at a time come as several partial counts of the same sums."""
    from loomlog.llm import toxicity

    texts = [(i % 2, " ".join(f"w{i}x{k} again" for k in range(1000))) for i in range(20)]
    rows = spark.createDataFrame(texts, "toxic int, text string").coalesce(1)

    def counted(most):
        def part(batches):
            toxicity.COUNTED = most
            yield from batches

        found = toxicity.count_features(rows.mapInArrow(part, rows.schema))
        return sorted(map(tuple, found.collect()))

    few, many = counted(1500), counted(10**9)
    assert few == many and ("=again", 10, 10) in few
