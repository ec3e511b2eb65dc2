"""Text search over the documents table, by scan and by token table."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomlog.operators import pages
from loomlog.operators.aggregates import count_search
from loomlog.operators.tokens import search_by_tokens, token_table
from suite import check
from suite.views import DOCS_SQL, ROW_SQL, docs

WITH = f"WITH {DOCS_SQL}"


def has(words: str) -> str:
    return f"contains(joined, ' {words} ')"


def starts(words: str) -> str:
    return f"contains(joined, ' {words}')"


SEARCHES = {
    # name: (search, oracle condition)
    "term": ("TION", has("tion")),
    "term_accent": ("éau OR Là", f"{has('eau')} OR {has('la')}"),
    "two_terms": ("thor anea", f"{has('thor')} AND {has('anea')}"),
    "phrase": ('"of the"', has("of the")),
    "phrase_joined": ("is_that", has("is that")),
    "phrase_plus": ("in + the + and", has("in the and")),
    "boolean": (
        "thor OR ther AND tion NOT des",
        f"{has('thor')} OR ({has('ther')} AND ({has('tion')} AND NOT {has('des')}))",
    ),
    "parentheses": (
        "(thor OR ther) AND tion",
        f"({has('thor')} OR {has('ther')}) AND {has('tion')}",
    ),
    "not_rare": ("the NOT (a OR en)", f"{has('the')} AND NOT ({has('a')} OR {has('en')})"),
    "prefix": ("thor*", starts("thor")),
    "phrase_prefix": ('"of the" + th*', starts("of the th")),
    "first": ("^is", "starts_with(joined, ' is ')"),
    "column": ("body : thor", has("thor")),
}


def _search(name: str, query: str, condition: str) -> None:
    @check(f"search_{name}", f"{WITH} SELECT id, service FROM spaced WHERE {condition}")
    def run(spark, d):
        return pages.search_rows(docs(spark, d), query).select("id", "service")


for _name, (_query, _condition) in SEARCHES.items():
    _search(_name, _query, _condition)


@check(
    "search_near",
    f"""{WITH}, words AS (SELECT id, unnest(toks) AS tok, generate_subscripts(toks, 1) AS p FROM docs)
        SELECT DISTINCT a.id FROM words a JOIN words b ON a.id = b.id AND abs(a.p - b.p) <= 3
        WHERE a.tok = 'thor' AND b.tok = 'the'""",
)
def search_near(spark, d):
    return pages.search_rows(docs(spark, d), "NEAR(thor the, 2)").select("id")


@check(
    "search_page",
    f"""{WITH} SELECT {ROW_SQL} FROM spaced WHERE {has('the')} AND service = 'src3'
          AND received_at >= TIMESTAMP '2024-01-01 01:00:00'
        ORDER BY received_at DESC, id DESC LIMIT 500""",
)
def search_page(spark, d):
    return pages.search_logs(docs(spark, d), "the", service="src3", since="2024-01-01T01:00Z")


@check(
    "search_after_cursor",
    f"{WITH} SELECT {ROW_SQL} FROM spaced WHERE {has('the')} AND id > 40 ORDER BY id LIMIT 50",
)
def search_after_cursor(spark, d):
    return pages.tail_logs(docs(spark, d), 40, query="the", level="ignored")


@check("search_count", f"{WITH} SELECT count(*) AS count FROM spaced WHERE {has('on the')}")
def search_count(spark, d):
    return count_search(docs(spark, d), '"on the"')


@check(
    "search_index_join",
    f"{WITH} SELECT id, service FROM spaced WHERE {has('of the')} AND NOT {has('des')} OR {starts('thor')}",
)
def search_index_join(spark, d):
    rows = docs(spark, d)
    return search_by_tokens(rows, token_table(rows), '("of the" NOT des) OR thor*').select(
        "id", "service"
    )


@check(
    "token_table",
    f"""{WITH} SELECT token, count(*) AS bodies, max(id) AS last_id FROM
          (SELECT DISTINCT id, unnest(toks) AS token FROM docs) GROUP BY token""",
)
def tokens_of_documents(spark, d):
    return (
        token_table(docs(spark, d))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("bodies"), F.max("id").alias("last_id"))
    )
