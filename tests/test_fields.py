"""Field comparisons are checked against the JSON functions of an embedded SQL store."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from loomlog.functions.jsonbody import (
    FIELD_OPS,
    compare_field,
    field_path,
    nested_defaults,
    parsed,
    put_fields,
    with_defaults,
)
from loomlog.operators.pages import query_field

VALUES = ["500", '"abc"', "true", "false", "1.5", "null", None, '"900"', '{"x":1,"a":2}', "[1]", '""',
          "-3", "9007199254740993", "9007199254740992", "1e3", '"500"']
BODIES = ['{"m":{"ms":%s}}' % v if v is not None else '{"m":{}}' for v in VALUES]


@pytest.mark.parametrize("value", [500, 1, 1.5, 0, 1000, 9007199254740992, "abc", "500", "", "[1]"])
def test_ranked_comparison_matches_the_store(spark, value):
    db = sqlite3.connect(":memory:")
    rows = spark.createDataFrame(list(enumerate(BODIES)), "id INT, body STRING")
    body = F.col("body")
    flags = rows.select(
        "id", *[compare_field(body, parsed(body), "m.ms", op, value).alias(op) for op in FIELD_OPS]
    ).collect()
    for op in FIELD_OPS:
        want = {
            i
            for i, text in enumerate(BODIES)
            if db.execute(f"SELECT json_extract(?, '$.m.ms') {op} ?", (text, value)).fetchone()[0]
        }
        assert {r["id"] for r in flags if r[op]} == want, (op, value)


def test_strict_comparison_stays_within_a_type(spark):
    rows = spark.createDataFrame(list(enumerate(BODIES)), "id INT, body STRING")
    body = F.col("body")

    def hits(op, value):
        condition = compare_field(body, parsed(body), "m.ms", op, value, "strict")
        return {VALUES[r["id"]] for r in rows.filter(condition).collect()}

    assert hits(">", 400) == {"500", "1e3", "9007199254740993", "9007199254740992"}
    assert hits("=", 1) == set()
    assert hits("!=", "abc") == {'"900"', '""', '"500"'}


def test_malformed_bodies_do_not_match(spark):
    rows = spark.createDataFrame([("nope",), (None,), ('{"a":',)], "body STRING")
    body = F.col("body")
    assert rows.filter(compare_field(body, parsed(body), "a", "!=", 1)).count() == 0


@pytest.mark.parametrize("field", ["", "a-b", "a b", "1a", "a..b", "a.", "a'; --", "a[0]", "é", "a\n"])
def test_unsafe_fields_are_refused(field):
    with pytest.raises(ValueError):
        field_path(field)


def test_arguments_are_checked(make_logs):
    rows = make_logs(("2024-01-01T00:00:00", "a", "info", None, '{"ms":1}'))
    for op in ("==", "LIKE", "; DROP"):
        with pytest.raises(ValueError):
            query_field(rows, "ms", op, 1)
    for value in (True, None, [1]):
        with pytest.raises(ValueError):
            query_field(rows, "ms", "=", value)
    with pytest.raises(ValueError):
        query_field(rows, "ms", "=", 1, types="loose")


def test_dotted_name_is_a_path_only(make_logs):
    rows = make_logs(
        ("2024-01-01T00:00:00", "a", "info", None, '{"trace.id":"x"}'),
        ("2024-01-01T00:00:00", "a", "info", None, '{"trace":{"id":"x"}}'),
    )
    assert [r["id"] for r in query_field(rows, "trace.id", "=", "x").collect()] == [2]


def test_filters_and_limit(make_logs):
    rows = make_logs(*[(f"2024-01-01T00:{i:02d}:00", "ab"[i % 2], "info", None, '{"ms":%d}' % i) for i in range(20)])
    page = query_field(rows, "ms", ">=", 10, service="a", limit=3).collect()
    assert [json.loads(r["body"])["ms"] for r in page] == [18, 16, 14]
    assert query_field(rows, "ms", ">", 0, since="2024-01-01T00:15Z").count() == 5


def test_put_fields(spark):
    cases = {
        '{"a": {"z": 1, "b": 1.0}, "level": "x"}': '{"a":{"b":1,"z":1},"level":"warn","n":2}',
        '{"a": {"z": 1, "b": 1.0}}': '{"a":{"z":1,"b":1.0},"level":"warn","n":2}',
        "{}": '{"level":"warn","n":2}',
        '{"level":"x"}': '{"level":"warn","n":2}',
        '{"deep":{"level":"kept"}}': '{"deep":{"level":"kept"},"level":"warn","n":2}',
        "[1]": None,
        "nope": None,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t STRING")
    fields = F.lit('{"level":"warn","n":2}')
    out = rows.select("t", put_fields(F.col("t"), fields, ("level", "n")).alias("o")).collect()
    assert {r["t"]: r["o"] for r in out} == cases


def test_defaults(spark):
    scopes = nested_defaults({"service": "api", "env": "dev"}, {"env": "prod", "tags": ["é", 1]})
    cases = {
        '{"env":"x","k":1}': {"service": "api", "tags": ["é", 1], "env": "x", "k": 1},
        "{}": {"service": "api", "env": "prod", "tags": ["é", 1]},
        '{"service":null}': {"env": "prod", "tags": ["é", 1], "service": None},
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t STRING")
    for row in rows.select("t", with_defaults(F.col("t"), scopes).alias("o")).collect():
        assert json.loads(row["o"]) == cases[row["t"]]
