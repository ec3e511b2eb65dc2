"""Token tables: one of any rows, and the index of a store; searches that start from them."""

from __future__ import annotations

from datetime import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.functions.args import page_limit
from loomlog.functions.instants import When, to_instant
from loomlog.functions.text import tokens
from loomlog.operators.pages import newest, oldest_by_id, search_rows
from loomlog.plans.predicates import all_of, day_bounds, log_filter
from loomlog.plans.textquery import any_token, candidate_flags, combine_flags, presence, presence_flags
from loomlog.sources.postings import is_covered, read_postings
from loomlog.sources.store import day_parts, read_logs, read_parts

#: Hash buckets of the token table; a lookup reads only those of its words.
TOKEN_BUCKETS = 256


def token_bucket(token):
    return F.pmod(F.xxhash64(token), F.lit(TOKEN_BUCKETS)).cast("int")


def token_table(logs: DataFrame) -> DataFrame:
    """One row per distinct token of each body."""
    day = F.col("dt") if "dt" in logs.columns else F.to_date("received_at")
    return logs.select(
        F.explode(F.array_distinct(tokens(F.col("body")))).alias("token"), "id", day.alias("dt")
    ).withColumn("bucket", token_bucket(F.col("token")))


def write_token_table(logs: DataFrame, path: str, mode: str = "append") -> None:
    """Write the token table by day and bucket.

    The rebalance splits the bucket of a word that is in every body over several files.
    """
    (
        token_table(logs)
        .hint("rebalance", "dt", "bucket")
        .sortWithinPartitions("dt", "bucket", "token")
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("dt", "bucket")
        .parquet(path)
    )


def candidate_ids(
    token_rows: DataFrame, query: str, since: When | None = None, until: When | None = None
) -> DataFrame:
    """Ids that hold the tokens a match needs; one map-side combined group per id."""
    wanted, tree = candidate_flags(query)
    if not wanted:
        return token_rows.select("id").limit(0)
    days = day_bounds(since, until)
    exact_only = not any(is_prefix for _, is_prefix in wanted)
    if exact_only and "bucket" in token_rows.columns:
        # Constants fold to numbers, so whole buckets are pruned.
        days.append(F.col("bucket").isin(*_buckets(token_rows, [word for word, _ in wanted])))
    hits = token_rows.filter(all_of([*days, any_token(wanted, F.col("token"))]))
    names = {part: f"_t{i}" for i, part in enumerate(wanted)}
    flags = hits.groupBy("id").agg(
        *[F.bool_or(any_token([part], F.col("token"))).alias(name) for part, name in names.items()]
    )
    return flags.filter(combine_flags(tree, lambda part: F.col(names[part]))).select("id")


def _buckets(token_rows: DataFrame, words: list[str]) -> list[int]:
    """Bucket numbers of a search's few words, computed by Spark's own hash."""
    spark = token_rows.sparkSession
    row = spark.range(1).select(*[token_bucket(F.lit(word)) for word in words]).first()
    return sorted(set(row))


def search_by_tokens(
    logs: DataFrame,
    token_rows: DataFrame,
    query: str,
    *,
    service: str | None = None,
    since: When | None = None,
    until: When | None = None,
    after_id: int | None = None,
) -> DataFrame:
    """Same rows as ``search_rows``: bodies are read and checked only for candidate ids."""
    ids = candidate_ids(token_rows, query, since, until)
    candidates = logs.join(ids, "id", "left_semi")
    return search_rows(
        candidates, query, service=service, since=since, until=until, after_id=after_id
    )


#: Candidate rows up to which a search of a store starts from the index; they are broadcast, 16 bytes each.
MAX_CANDIDATES = 500_000


def _flagged(hits: DataFrame, wanted: list[tuple[str, bool]], condition) -> DataFrame:
    """(dt, id) of the rows whose tokens meet ``condition``, which gets a flag per wanted token.

    A row holds a word once, so the postings of one word need no grouping.
    """
    if len(wanted) == 1 and not wanted[0][1]:
        return hits.filter(condition(lambda part: F.lit(True))).select("dt", "id")
    names = {part: f"_t{i}" for i, part in enumerate(wanted)}
    flags = [F.bool_or(any_token([part], F.col("token"))).alias(name) for part, name in names.items()]
    return hits.groupBy("dt", "id").agg(*flags).filter(condition(lambda part: F.col(names[part]))).select("dt", "id")


def _whole_days(since: When | None, until: When | None) -> bool:
    """Whether time bounds say no more than days do."""
    return not until and (not since or to_instant(since).time() == time.min)


def search_stored(
    spark: SparkSession,
    root: str,
    query: str,
    *,
    service: str | None = None,
    since: When | None = None,
    until: When | None = None,
    after_id: int | None = None,
) -> DataFrame:
    """Every stored row that matches, found through the store's index where that saves reading.

    Of the postings only the heads of the search's words are read.  The rows they name are few
    as a rule; their days and ids are then handed to every task, and bodies are read on these days
    and checked for these rows alone.  A search whose words are in more than ``MAX_CANDIDATES`` rows,
    or of a store without an index, reads the bodies, as :func:`search_rows` does.
    """
    filters = {"service": service, "since": since, "until": until, "after_id": after_id}
    wanted, tree = candidate_flags(query)
    if not wanted or not is_covered(spark, root):
        return search_rows(read_logs(spark, root, since, until), query, **filters)
    days = day_parts(spark, root, since, until)
    rows = read_parts(spark, root, days)
    hits = read_postings(spark, root, wanted, days, since, until).filter(any_token(wanted, F.col("token")))
    if after_id is not None:
        hits = hits.filter(F.col("id") > after_id)
    named = _flagged(hits, wanted, lambda flag_of: combine_flags(tree, flag_of))
    if named.limit(MAX_CANDIDATES + 1).count() <= MAX_CANDIDATES:
        rows = rows.join(F.broadcast(named), ["dt", "id"], "left_semi")
    return search_rows(rows, query, **filters)


def search_page_stored(
    spark: SparkSession, root: str, query: str, *, after_id: int | None = None, limit: int | str | None = None, **filters
) -> DataFrame:
    """A page of :func:`search_stored`, in the two orders of ``query_logs``."""
    found = search_stored(spark, root, query, after_id=after_id, **filters)
    size = page_limit(limit, 500)
    return newest(found, size) if after_id is None else oldest_by_id(found, size)


def count_search_stored(
    spark: SparkSession,
    root: str,
    query: str,
    *,
    service: str | None = None,
    since: When | None = None,
    until: When | None = None,
    after_id: int | None = None,
) -> DataFrame:
    """Exact number of stored rows that match (one row, ``count``).

    Words and prefixes joined by AND, OR and NOT are counted from the postings alone; a service or a
    time within a day is looked up in the rows, still without their bodies.
    """
    filters = {"service": service, "since": since, "until": until, "after_id": after_id}
    decided = presence_flags(query)
    count = F.count(F.lit(1)).alias("count")
    if decided is None or not decided[0] or not is_covered(spark, root):
        return search_stored(spark, root, query, **filters).agg(count)
    wanted, tree = decided
    days = day_parts(spark, root, since, until)
    hits = read_postings(spark, root, wanted, days, since, until).filter(any_token(wanted, F.col("token")))
    if after_id is not None:
        hits = hits.filter(F.col("id") > after_id)
    found = _flagged(hits, wanted, lambda flag_of: presence(tree, flag_of))
    if not service and _whole_days(since, until):
        return found.agg(count)
    rows = log_filter(read_parts(spark, root, days), **filters).select("dt", "id")
    return rows.join(found, ["dt", "id"], "left_semi").agg(count)
