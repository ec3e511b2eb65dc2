import hashlib
import random
import re
from collections import defaultdict

from loomlog.llm import exact

from .cases import documents, empty, odd_docs


def brute(pairs):
    groups = defaultdict(list)
    for doc_id, text in pairs:
        normal = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        groups[hashlib.sha256(normal.encode()).hexdigest()].append((doc_id, len(text or "")))
    out = set()
    for digest, rows in groups.items():
        keep = min(rows, key=lambda r: (-r[1], r[0] is None, r[0] or 0))
        out |= {(i, keep[0], len(rows), (i, n) == keep, digest) for i, n in rows}
    return out


def random_pairs(n, seed=1):
    rng = random.Random(seed)
    return [(i, "".join(rng.choice("ab \n") for _ in range(rng.randrange(6)))) for i in range(n)]


def test_groups_equal_brute_force(spark):
    pairs = random_pairs(400)
    got = exact.exact_groups(documents(spark, pairs)).collect()
    assert {tuple(r) for r in got} == brute(pairs)
    assert len(got) == len(pairs)


def test_a_filter_that_is_full_changes_nothing(spark):
    pairs = random_pairs(300, 2)
    got = exact.exact_groups(documents(spark, pairs), max_words=16).collect()
    assert {tuple(r) for r in got} == brute(pairs)


def test_no_repeat_is_missed_and_most_unique_rows_pass(spark):
    pairs = [(i, f"text {i // 2 if i < 100 else i}") for i in range(3000)]
    keys = exact._keys(documents(spark, pairs)).cache()
    repeated, words = exact.repeat_filter(keys, 3000)
    maybe, once = exact.split_repeats(keys, repeated, words)
    suspects = {r.doc_id for r in maybe.collect()}
    assert suspects >= set(range(100))
    assert len(suspects) < 400
    assert once.count() == 3000 - len(suspects)


def test_odd_rows(spark):
    rows = exact.exact_groups(odd_docs(spark, clashing=True)).collect()
    assert len(rows) == 14
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[1].keep_id == 3 and by[1].group_size == 3  # null, empty and blank are equal; most code points stay
    assert by[4].keep_id == 6 and not by[4].kept and by[6].kept
    assert by[8].keep_id == 7
    assert exact.exact_groups(empty(spark)).count() == 0


def test_drop_keeps_columns_and_one_row_a_group(spark):
    docs = odd_docs(spark, clashing=True)
    left = exact.drop_exact(docs)
    assert left.columns == docs.columns
    ids = [r.doc_id for r in left.collect()]
    assert sorted(ids, key=lambda i: (i is None, i or 0)) == [3, 6, 7, 9, 10, 11, None]
    assert exact.drop_exact(empty(spark)).count() == 0


def test_the_plan_has_no_python_and_no_hot_window(spark):
    plan = exact.exact_groups(documents(spark, random_pairs(50)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Window" not in plan
