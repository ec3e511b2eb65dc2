import pytest

from loomlog.operators.sqlsurface import SqlRefused, check_select, query_sql, refusal


@pytest.fixture
def rows(make_logs):
    return make_logs(*[("2024-01-01T00:00:00", "ab"[i % 2], "error", None, '{"ms":%d}' % i) for i in range(150)])


ALLOWED = [
    "SELECT count(*) FROM logs",
    "select service from LOGS group by service",
    "SELECT * FROM (SELECT id FROM logs WHERE id > 3) x",
    "SELECT a.id FROM logs a JOIN logs b ON a.id = b.id",
    "SELECT id FROM logs WHERE id IN (SELECT max(id) FROM logs)",
    "SELECT rowid FROM logs_fts",
    "SELECT 1",
    "SELECT a.id FROM logs a, logs b WHERE a.id = b.id AND a.id > 3",
    "SELECT a.id FROM logs a JOIN logs b USING (id)",
    "SELECT CASE WHEN level LIKE '%r%' THEN 1 ELSE 0 END AS x FROM logs ORDER BY x LIMIT 3",
]

REFUSED = [
    "DELETE FROM logs",
    "  drop table logs",
    "WITH x AS (SELECT 1) SELECT * FROM x",
    "SELECT 1; SELECT 2",
    "SELECT * FROM users",
    "SELECT * FROM logs, users",
    "SELECT * FROM `users`",
    "SELECT * FROM parquet.`/etc`",
    "SELECT * FROM logs WHERE id IN (SELECT id FROM users)",
    "SELECT (SELECT max(x) FROM users) FROM logs",
    "SELECT * FROM other.logs",
    "SELECT * FROM range(10)",
    "SELECT reflect('java.lang.System', 'exit', 1) FROM logs",
    "SELECT `java_method`('java.util.UUID', 'randomUUID') FROM logs",
    "SELECT id FROM logs UNION SELECT id FROM users",
    "SELECT EXISTS (SELECT 1 FROM users) FROM logs",
    "SELECT * FROM IDENTIFIER('secret')",
    "SELECT * FROM (SELECT * FROM IDENTIFIER('sec' || 'ret')) x",
    "SELECT * FROM IDENTIFIER/**/('logs')",
    "SELECT IDENTIFIER('java_method')('java.util.UUID', 'randomUUID') FROM logs",
    "SELECT TRANSFORM(id) USING 'cat' AS (x STRING) FROM logs",
    "SELECT * FROM (SELECT TRANSFORM(id) USING 'cat' AS (x STRING) FROM logs) y",
    "SELECT reflect/**/('java.lang.System', 'getProperty', 'user.home') FROM logs",
    "SELECT ReFlect /* a */ ('java.lang.System', 'getProperty', 'user.home') FROM logs",
    "SELECT id FROM logs WHERE try_reflect('a', 'b') IS NULL",
    "SELECT (SELECT max(java_method('java.util.UUID', 'randomUUID')) FROM logs) FROM logs",
    "SELECT system.builtin.reflect('a', 'b') FROM logs",
    "SELECT * FROM logs LATERAL VIEW explode(array(1, 2)) t AS x",
    "SELECT * FROM VALUES (1) AS t(x)",
    "SELECT * FROM logs a, logs b",
    "SELECT * FROM logs a JOIN logs b ON 1 = 1",
    "SELECT * FROM logs a CROSS JOIN logs b",
    "SELECT input_file_name() FROM logs",
    "SELECT * FROM (WITH logs AS (SELECT * FROM users) SELECT * FROM logs) x",
]


@pytest.mark.parametrize("sql", ALLOWED)
def test_allowed(rows, sql):
    query_sql(rows, sql).collect()


@pytest.mark.parametrize("sql", REFUSED)
def test_refused(spark, sql):
    with pytest.raises(SqlRefused):
        check_select(spark, sql)


def test_caps_and_order(rows):
    assert query_sql(rows, "SELECT id FROM logs").count() == 100
    assert query_sql(rows, "SELECT id FROM logs", limit=7).count() == 7
    ordered = query_sql(rows, "SELECT id FROM logs ORDER BY id DESC", limit=3)
    assert [r["id"] for r in ordered.collect()] == [150, 149, 148]


def test_functions_and_clean_up(spark, rows):
    first = query_sql(
        rows,
        "SELECT service, count(*) AS n, max(json_number(body, '$.ms')) AS top, "
        "strftime('%Y-%m-%dT%H:00:00Z', max(received_at)) AS hour FROM logs "
        "WHERE json_extract(body, '$.ms') IS NOT NULL GROUP BY service ORDER BY service",
    ).first()
    assert tuple(first) == ("a", 75, 148.0, "2024-01-01T00:00:00Z")
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("_logs_")]


@pytest.fixture
def mixed(make_logs):
    bodies = ['{"ms":99}', '{"ms":1500,"message":"slow"}', '{"ms":600.5}', '{"ms":"abc"}', '{"ms":null}', '{"x":1}', '{"ms":true}']
    return make_logs(*[(f"2024-01-01T0{i}:10:00", "ab"[i % 2], "error", "abc123", b) for i, b in enumerate(bodies)])


def test_documented_statements_word_for_word(mixed):
    slow = query_sql(
        mixed,
        """SELECT service, json_extract(body, '$.ms') AS ms, received_at
FROM logs WHERE json_extract(body, '$.ms') > 500
ORDER BY ms DESC""",
    )
    assert [r.ms for r in slow.collect()] == ["abc", "1500", "600.5"]
    latency = query_sql(
        mixed,
        """SELECT service,
       COUNT(*) AS requests,
       MAX(json_extract(body, '$.ms')) AS max_ms
FROM logs WHERE json_extract(body, '$.ms') IS NOT NULL
GROUP BY service ORDER BY max_ms DESC""",
    )
    assert [tuple(r) for r in latency.collect()] == [("b", 2, "abc"), ("a", 3, "600.5")]
    hours = query_sql(
        mixed,
        """SELECT service,
       strftime('%Y-%m-%dT%H:00:00Z', received_at) AS hour,
       COUNT(*) AS errors
FROM logs WHERE level = 'error'
GROUP BY service, hour ORDER BY hour DESC""",
    )
    assert hours.first().hour == "2024-01-01T06:00:00Z"
    assert query_sql(mixed, "SELECT DISTINCT service FROM logs WHERE trace_id = 'abc123'").count() == 2
    top = query_sql(
        mixed,
        """SELECT json_extract(body, '$.message') AS msg, COUNT(*) AS n
FROM logs WHERE level = 'error'
GROUP BY msg ORDER BY n DESC LIMIT 10""",
    )
    assert [tuple(r) for r in top.collect()] == [(None, 6), ("slow", 1)]


def test_json_values_compare_by_type(mixed):
    def ids(condition):
        return [r.id for r in query_sql(mixed, f"SELECT id FROM logs WHERE {condition} ORDER BY id").collect()]

    ms = "json_extract(body, '$.ms')"
    assert ids(f"{ms} < 100") == [1, 7]
    assert ids(f"{ms} BETWEEN 99 AND 601") == [1, 3]
    assert ids(f"{ms} IN (99, 'abc')") == [1, 4]
    assert ids(f"{ms} = 'abc'") == [4]
    assert ids(f"{ms} > -5 AND {ms} LIKE '%5%'") == [2, 3]
    assert query_sql(mixed, f"SELECT min({ms}) AS low, sum({ms}) AS total FROM logs").first() == ("1", 2200.5)
    assert ids(f"{ms} > id") == [1, 2, 3, 4]
    assert ids(f"{ms} < service") == [1, 2, 3, 4, 7]


def test_json_values_keep_their_type_through_expressions(mixed):
    def first(select, rest=""):
        return tuple(query_sql(mixed, f"SELECT {select} FROM logs {rest}").first())

    def column(expression):
        return [r[0] for r in query_sql(mixed, f"SELECT {expression} AS v, id FROM logs ORDER BY id").collect()]

    ms = "json_extract(body, '$.ms')"
    assert column(f"COALESCE({ms}, 0)") == ["99", "1500", "600.5", "abc", "0", "0", "1"]
    assert column(f"CAST({ms} AS INTEGER)") == [99, 1500, 600, 0, None, None, 1]
    assert column(f"CAST({ms} AS DOUBLE)") == [99.0, 1500.0, 600.5, 0.0, None, None, 1.0]
    assert column(f"CAST({ms} AS STRING)") == ["99", "1500", "600.5", "abc", None, None, "1"]
    assert column(f"CASE WHEN {ms} > 500 THEN {ms} ELSE -1 END") == ["-1", "1500", "600.5", "abc", "-1", "-1", "-1"]
    assert column(f"CASE WHEN {ms} > 500 THEN {ms} END + 1") == [None, 1501.0, 601.5, 1.0, None, None, None]
    assert column(f"upper(COALESCE({ms}, 'none'))") == ["99", "1500", "600.5", "ABC", "NONE", "NONE", "1"]
    assert column(f"NULLIF({ms}, 99)") == [None, "1500", "600.5", "abc", None, None, "1"]
    numbers = f"WHERE {ms} < 10000"
    assert first(f"MAX({ms}) - MIN({ms})", numbers) == (1499.0,)
    assert first(f"MAX({ms}) > 600, MIN(COALESCE({ms}, 7)) < 5", numbers) == (True, True)
    top = query_sql(mixed, f"SELECT id FROM logs WHERE {ms} = (SELECT MAX({ms}) FROM logs {numbers})").collect()
    assert [r.id for r in top] == [2]
    assert [r.id for r in query_sql(mixed, f"SELECT id FROM logs WHERE {ms} > (SELECT avg(id) FROM logs) AND {ms} < 700 ORDER BY id").collect()] == [1, 3]
    assert first("TOTAL(id), TOTAL(id * 0.5)", "WHERE id < 0") == (0.0, 0.0)
    assert first(f"TOTAL({ms})", numbers) == (2200.5,)
    assert set(first("GROUP_CONCAT(service)")[0].split(",")) == {"a", "b"}
    assert sorted(first("GROUP_CONCAT(DISTINCT service, ' / ')")[0].split(" / ")) == ["a", "b"]
    assert sorted(first(f"GROUP_CONCAT({ms}, '|')")[0].split("|")) == ["1", "1500", "600.5", "99", "abc"]


SELF = "SELECT count(*) FROM logs a JOIN logs b ON "


@pytest.mark.parametrize(
    "sql",
    [
        SELF + "a.id = a.id",
        SELF + "a.id + b.id = b.id + a.id",
        SELF + "a.id = 3 AND b.id = a.id - a.id + b.id",
        SELF + "a.id = b.id OR a.service = b.service",
        SELF + "a.id < b.id",
        "SELECT count(*) FROM logs a, logs b WHERE a.id = a.id AND b.id = b.id",
        "SELECT count(*) FROM logs a JOIN (SELECT x.id FROM logs x JOIN logs y ON x.id = x.id) b ON a.id = b.id",
        "SELECT id FROM logs WHERE id IN (SELECT a.id FROM logs a JOIN logs b ON a.id = a.id)",
        "SELECT count(*) FROM logs a LEFT JOIN logs b ON a.id = a.id",
    ],
)
def test_joins_without_an_equality_between_the_sides_are_refused(rows, sql):
    with pytest.raises(SqlRefused):
        query_sql(rows, sql)
    assert "equality" in refusal(rows.sparkSession, sql)


@pytest.mark.parametrize(
    "sql",
    [
        SELF + "a.id = b.id",
        SELF + "b.id = a.id + 1 AND a.service = 'a'",
        SELF + "a.id % 10 = b.id % 10 AND a.id < b.id",
        "SELECT count(*) FROM logs a JOIN logs b ON a.id = b.id JOIN logs c ON c.id = b.id",
        "SELECT count(*) FROM logs a LEFT JOIN logs b ON a.trace_id = b.trace_id",
        "SELECT count(*) FROM logs a JOIN logs_fts f ON f.rowid = a.id",
        "SELECT id FROM logs a WHERE EXISTS (SELECT 1 FROM logs b WHERE b.id = a.id + 1)",
        "SELECT json_extract(a.body, '$.ms') FROM logs a JOIN logs b ON a.id = b.id AND json_extract(a.body, '$.ms') = json_extract(b.body, '$.ms')",
    ],
)
def test_joins_with_one_pass(rows, sql):
    query_sql(rows, sql).collect()
    assert refusal(rows.sparkSession, sql) is None


def test_time_functions(mixed):
    shown = query_sql(
        mixed,
        "SELECT strftime('%H:%M Uhr', received_at) AS a, strftime('%Y-%j', received_at) AS b, "
        "strftime('100%% %d.%m.', received_at) AS c, datetime(0, 'unixepoch') AS d, "
        "strftime('%s', received_at) AS e, datetime(received_at) AS f, strftime('%w', received_at) AS g "
        "FROM logs ORDER BY id",
    ).first()
    assert tuple(shown) == ("00:10 Uhr", "2024-001", "100% 01.01.", "1970-01-01 00:00:00", "1704067800", "2024-01-01 00:10:00", "1")
    with pytest.raises(SqlRefused):
        query_sql(mixed, "SELECT strftime('%Q', received_at) FROM logs")


def test_nothing_stays_in_the_session(spark, mixed):
    query_sql(mixed, "SELECT json_extract(body, '$.ms') FROM logs").collect()
    assert spark.sql("SHOW USER FUNCTIONS").count() == 0
