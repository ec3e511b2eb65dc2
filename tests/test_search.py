"""The search is compared with the text index it stands in for, an in-memory FTS5 table."""

import json
import random
import sqlite3
import unicodedata

import pytest
from pyspark.sql import functions as F

from loomlog.functions.text import fold_table, query_tokens, tokens
from loomlog.operators.pages import search_rows
from loomlog.operators.tokens import (
    candidate_ids,
    search_by_tokens,
    token_table,
    write_token_table,
)
from loomlog.plans.textquery import SearchSyntaxError, parse_search, search_condition

BODIES = [
    '{"m":{"ms":7},"msg":"Connection refused: load-test Café user_id"}',
    '{"msg":"refused connection","ms":500}',
    '{"message":"payment timeout","orderId":"ord-17","note":"ÀÉÎ naïve ŝuper"}',
    '{"a":"one two three four five six seven eight nine ten eleven twelve"}',
    "refused yyy",
    "zzz",
    "not refused",
    "",
    "!!! ??? ...",
    "ends with conn",
    "connection connection refused refused",
    "Ünïcödé ΣΊΣΥΦΟΣ straße",
    "a b a b c",
    "x y x x z y",
]

QUERIES = [
    "CONNECTION", "ms", "user_id", "user id", '"load-test"', "cafe", "CAFÉ", "CONNECTION refused",
    '"connection refused"', '"refused connection"', '"ms 500"', "conn*", '"connection re"*',
    "refused OR zzz AND yyy", "(refused OR zzz) AND yyy", "not refused", "refused NOT connection",
    "one two NOT three", "one NOT two three", "one NOT thirteen", "zzz OR one NOT thirteen",
    "one + two + three", "one + tw*", "on* + two", "NEAR(one four, 2)", "NEAR(one four, 1)",
    "NEAR(four one, 2)", "NEAR(one twelve)", "NEAR(one eleven)", 'NEAR("one two" "four five", 1)',
    'NEAR("one two" "four five", 0)', "NEAR(one three five, 2)", "NEAR(one three five, 3)",
    "NEAR(a c, 0)", "NEAR(x y z, 1)", "NEAR(x z, 0)", 'NEAR("a b" "b a", 0)', "^connection",
    "^m", "^refused", "body : zzz", "body: (zzz OR one)", "- body : zzz", "{body} : one",
    '"!!!"', '"!!!" zzz', '"!!!" AND zzz', 'zzz NOT "!!!"', "naive", "super", "aei", "strasse",
    "straße", "σισυφοσ", "unicode", "ord 17", '"a ""b"""', "NEAR(one)", "five six OR ten AND zzz",
    "a AND b OR zzz NOT a",
]

BROKEN = ["load-test", "a.b", "x AND", "OR x", "(a", "a (b)", '"open', "foo(bar)", "a : b", "*", "+ a",
          "NEAR(a b, c)", "()", "a AND AND b", "title : x"]


@pytest.fixture(scope="module")
def index():
    db = sqlite3.connect(":memory:")
    db.execute("CREATE TABLE logs(id INTEGER PRIMARY KEY, body TEXT)")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(body, content='logs', content_rowid='id')")
    for i, body in enumerate(BODIES):
        db.execute("INSERT INTO logs VALUES (?, ?)", (i, body))
        db.execute("INSERT INTO t(rowid, body) VALUES (?, ?)", (i, body))
    return db


@pytest.fixture(scope="module")
def bodies(spark):
    return spark.createDataFrame(list(enumerate(BODIES)), "id BIGINT, body STRING").cache()


def expected(db, query):
    return {row[0] for row in db.execute("SELECT rowid FROM t WHERE t MATCH ?", (query,))}


def found(bodies, queries):
    flags = bodies.select(
        "id", *[search_condition(q, F.col("body")).alias(f"q{i}") for i, q in enumerate(queries)]
    ).collect()
    return {q: {row["id"] for row in flags if row[f"q{i}"]} for i, q in enumerate(queries)}


def test_matches_what_the_index_matches(index, bodies):
    got = found(bodies, QUERIES)
    wrong = {q: (got[q], expected(index, q)) for q in QUERIES if got[q] != expected(index, q)}
    assert not wrong


@pytest.mark.parametrize("query", BROKEN)
def test_refuses_what_the_index_refuses(index, query):
    with pytest.raises(sqlite3.OperationalError):
        expected(index, query)
    with pytest.raises(SearchSyntaxError):
        parse_search(query)


def test_length_and_emptiness():
    for query in ("", "   ", "x" * 1001):
        with pytest.raises(SearchSyntaxError):
            parse_search(query)
    parse_search("x" * 1000)
    with pytest.raises(SearchSyntaxError):
        parse_search("(" * 499 + "a" + ")" * 499)


def random_query(rng, depth=2):
    word = lambda: rng.choice("abcdef")
    kind = rng.randrange(9 if depth else 5)
    if kind == 0:
        return word()
    if kind == 1:
        return f"{word()} {word()}"
    if kind == 2:
        return f'"{word()} {word()}"'
    if kind == 3:
        return f"NEAR({word()} {word()}, {rng.randrange(4)})"
    if kind == 4:
        return f'NEAR({word()} "{word()} {word()}" {word()}, {rng.randrange(4)})'
    left, right = random_query(rng, depth - 1), random_query(rng, depth - 1)
    if kind == 8:
        return f"({left}) {rng.choice(['AND', 'OR', 'NOT'])} ({right})"
    return f"{left} {rng.choice(['AND', 'OR', 'NOT'])} {right}"


def test_random_searches_match_the_index(spark):
    rng = random.Random(7)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 12))) for _ in range(80)]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(body)")
    db.executemany("INSERT INTO t(rowid, body) VALUES (?, ?)", enumerate(texts))
    rows = spark.createDataFrame(list(enumerate(texts)), "id BIGINT, body STRING").cache()
    queries = sorted({random_query(rng) for _ in range(60)})
    got = {}
    for i in range(0, len(queries), 20):
        got |= found(rows, queries[i : i + 20])
    wrong = {q: (got[q], expected(db, q)) for q in queries if got[q] != expected(db, q)}
    assert not wrong


def test_accents_fold_as_in_the_index():
    """Every character of the folded ranges, alone between two letters."""
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(body)")
    db.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, instance)")
    codes = [c for c in (*range(0x20, 0x250), *range(0x300, 0x370), *range(0x1E00, 0x1F00))]
    db.executemany("INSERT INTO t(rowid, body) VALUES (?, ?)", [(c, f"q{chr(c)}w") for c in codes])
    terms = {}
    for term, doc, offset in db.execute("SELECT term, doc, offset FROM v ORDER BY doc, offset"):
        terms.setdefault(doc, []).append(term)
    wrong = {}
    for code in codes:
        ours = query_tokens(f"q{chr(code)}w")
        if ours != terms[code]:
            wrong[hex(code)] = (unicodedata.name(chr(code), "?"), ours, terms[code])
    assert not wrong


def test_spark_tokens_agree_with_query_tokens(spark):
    samples = BODIES + ["".join(fold_table()[0]), "éa ö ́x", "İstanbul ǅ ⅷ ２３ 中文 字"]
    rows = spark.createDataFrame([(s,) for s in samples], "body STRING")
    for row in rows.select("body", tokens(F.col("body")).alias("t")).collect():
        assert row["t"] == query_tokens(row["body"]), row["body"]


def test_search_filters(make_logs):
    rows = make_logs(
        ("2024-01-01T00:00:00", "a", "error", None, json.dumps({"m": "boom"})),
        ("2024-01-01T01:00:00", "b", "error", None, json.dumps({"deep": {"er": ["boom"]}})),
        ("2024-01-01T02:00:00", "a", "info", None, json.dumps({"m": "fine"})),
    )
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(search_rows(rows, "boom")) == [1, 2]
    assert ids(search_rows(rows, "boom", service="a")) == [1]
    assert ids(search_rows(rows, "boom", since="2024-01-01T00:30Z")) == [2]
    assert ids(search_rows(rows, "boom", until="2024-01-01T00:30Z")) == [1]
    assert ids(search_rows(rows, "boom", after_id=1)) == [2]
    assert ids(search_rows(rows, "absent")) == []


def test_token_table_gives_the_same_rows(spark, bodies, tmp_path):
    rows = bodies.withColumn("received_at", F.lit("2024-01-01").cast("timestamp")).withColumn(
        "dt", F.to_date("received_at")
    )
    path = str(tmp_path / "tokens")
    write_token_table(rows, path)
    stored = spark.read.parquet(path)
    assert stored.count() == token_table(rows).count()
    for query in ("connection refused", '"connection refused"', "conn* OR zzz", "one NOT two",
                  "NEAR(one four, 2)", "refused NOT connection", "absent", '"!!!"'):
        scanned = {r["id"] for r in search_rows(rows, query).collect()}
        looked_up = {r["id"] for r in search_by_tokens(rows, stored, query).collect()}
        assert looked_up == scanned, query
    plan = candidate_ids(stored, "connection refused")._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1]


def test_as_many_words_as_a_search_can_hold(make_logs):
    words = [f"{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rows = make_logs(("2024-01-01T00:00:00", None, None, None, " ".join(words)), ("2024-01-01T00:00:00", None, None, None, " ".join(words[1:])))
    for query, expected in ((" ".join(words), [1]), (" OR ".join(words[:160]), [1, 2]), (" ".join(["ab"] * 333), [1, 2])):
        assert [r["id"] for r in search_rows(rows, query).orderBy("id").collect()] == expected
