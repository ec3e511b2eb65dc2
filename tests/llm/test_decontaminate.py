import random

from loomlog.llm import decontaminate

from .cases import documents, empty, odd_docs

ITEMS = "item_id BIGINT, text STRING"


def world(seed=8):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(3000)]

    def prose(n):
        return [words[min(int(rng.expovariate(0.004)), 2999)] for _ in range(n)]

    items = [(k, prose(rng.randrange(14, 60))) for k in range(30)]
    pairs, expected = [], {}
    for i in range(240):
        body = prose(rng.randrange(5, 400))
        if i % 4 == 0:
            k, passage = items[i % 30]
            copy = list(passage)
            if i % 8 == 0:  # a paraphrase: some words of the front part are others
                for at in rng.sample(range(len(copy) - 6), (len(copy) - 6) // 5):
                    copy[at] = "zz" + copy[at]
            at = rng.randrange(len(body) + 1)
            body[at:at] = copy
            expected[i] = k
        if i % 4 == 1:  # a short run of an item is no copy
            body[0:0] = items[i % 30][1][:5]
        pairs.append((i, " ".join(body)))
    return [(k, " ".join(w).capitalize() + ".") for k, w in items], pairs, expected


def test_planted_passages_are_found_and_clean_documents_left(spark):
    items, pairs, expected = world()
    benchmark = spark.createDataFrame(items, ITEMS)
    rows = {r.doc_id: r for r in decontaminate.find_contaminated(documents(spark, pairs), benchmark).collect()}
    assert {i for i, r in rows.items() if r.contaminated} == set(expected)
    assert all(k in rows[i]["items"] and rows[i].best_lcs >= 0.6 for i, k in expected.items())
    left = decontaminate.drop_contaminated(documents(spark, pairs), benchmark)
    assert {r.doc_id for r in left.collect()} == set(rows) - set(expected)


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    items, pairs, expected = world(9)
    monkeypatch.setattr(decontaminate, "ITEM_BLOCK", 11)
    rows = decontaminate.find_contaminated(documents(spark, pairs), spark.createDataFrame(items, ITEMS)).collect()
    assert {r.doc_id for r in rows if r.contaminated} == set(expected)


def test_words_and_common_subsequences():
    words = decontaminate.words_of([b"The CAT, sat.", b"", b"cat the"])
    assert words.first.tolist() == [0, 3, 3, 5]
    assert words.hashes[1] == words.hashes[3] and words.hashes[0] == words.hashes[4]
    rng = random.Random(1)
    for _ in range(50):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(1, 20))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            row = _next(row, x, b)
        assert decontaminate.common_subsequence(a, b) == row[-1]


def _next(row, x, b):
    out = [0]
    for j, y in enumerate(b):
        out.append(row[j] + 1 if x == y else max(row[j + 1], out[j]))
    return out


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    text = b" ".join(b"word%d" % (i % 977) for i in range(3000))
    whole = decontaminate.words_of([text]).hashes
    monkeypatch.setattr(decontaminate, "CHUNK_BYTES", 100)
    decontaminate._powers.cache_clear()
    assert (decontaminate.words_of([text]).hashes == whole).all()
    decontaminate._powers.cache_clear()


def test_odd_rows(spark):
    docs = odd_docs(spark, clashing=True)
    benchmark = spark.createDataFrame([(1, None), (2, ""), (3, " ... "), (None, "no id"), (4, "The quick brown fox jumps over the lazy dog")], ITEMS)
    rows = decontaminate.find_contaminated(docs, benchmark).collect()
    assert len(rows) == 14 and 11 in {r.doc_id for r in rows if r.contaminated}
    assert not any(r.contaminated for r in rows if r.doc_id in (1, 2, 3))
    left = decontaminate.drop_contaminated(docs, benchmark)
    assert left.columns == docs.columns
    assert decontaminate.find_contaminated(empty(spark), benchmark).count() == 0
    assert decontaminate.find_contaminated(docs, empty(spark, ITEMS)).filter("contaminated").count() == 0


def brute_matches(items, pairs):
    """Documents by the rule itself: a longest common subsequence at every word, no candidates."""
    out = set()
    for i, text in pairs:
        words = decontaminate.words_of([text.encode()]).hashes.tolist()
        for k, passage in items:
            item = decontaminate.read_item(k, passage)
            n = len(item.words)
            for at in range(max(len(words) - n, 0) + 1):
                part = words[at : at + n + 8]
                lcs = decontaminate.common_subsequence(item.words, part)
                if lcs >= 0.8 * n or lcs >= 0.6 * n and decontaminate.common_subsequence(item.answer, part) >= 0.6 * len(item.answer):
                    out.add(i)
    return out


def test_paraphrases_of_the_rarest_words_are_found(spark):
    rng, common = random.Random(12), [f"c{i}" for i in range(60)]
    items, pairs = [], []
    for k in range(12):
        passage = [f"rare{k}x{j}" if j % 5 < 2 else rng.choice(common) for j in range(40)]
        items.append((k, passage))
        for share in (0.2, 0.3, 0.4):
            copy, left = list(passage), int(share * 40)
            for j in [j for j in range(35) if j % 5 < 2][:left]:
                copy[j] = f"zz{k}x{j}"
            body = [rng.choice(common) + "y" for _ in range(30)]
            pairs.append((len(pairs), " ".join(body[:11] + copy + body[11:])))
    for k in range(200):
        pairs.append((len(pairs), " ".join(rng.choice(common) + rng.choice(["", "y"]) for _ in range(60))))
    items = [(k, " ".join(w)) for k, w in items]
    rows = decontaminate.find_contaminated(documents(spark, pairs), spark.createDataFrame(items, ITEMS)).collect()
    expected = brute_matches(items, pairs)
    assert len(expected) >= 36 and {r.doc_id for r in rows if r.contaminated} == expected
