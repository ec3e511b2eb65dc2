"""The text index of a store: which rows hold which token.

Postings lie under ``tokens/part=/head=``.  A part is what one write made: ``b`` and the number of a
write batch, or ``g`` and the number of a generation.  A head is a range of leading characters, so a
word lies under one head and a prefix under few.  Rows of a part are sorted by token.  A posting
counts where the row's own folder does, which the store's day folders tell.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.functions.instants import When, to_instant
from loomlog.plans.predicates import all_of
from loomlog.schema import ID_BITS, POSTINGS
from loomlog.sources.store import TOKENS_DIR, DayParts, path_exists

#: The first characters of every head but the lowest; they part English words and numbers about evenly.
HEAD_STARTS = "13acdefilmnprstu"
#: Notes of an index: that it is kept, and that it covers everything stored.
KEPT_NOTE, READY_NOTE = f"{TOKENS_DIR}_state/kept.json", f"{TOKENS_DIR}_state/ready.json"


def head_of(token: Column) -> Column:
    """The number of a token's head: how many of ``HEAD_STARTS`` its first character reaches."""
    first = F.ascii(token)
    return sum(((first >= ord(start)).cast("int") for start in HEAD_STARTS), F.lit(0))


def heads_of(words: list[tuple[str, bool]]) -> list[int]:
    """The heads that hold some words or prefixes; both have at least one character."""
    return sorted({bisect_right(HEAD_STARTS, word[0]) for word, _ in words})


def is_indexed(spark: SparkSession, root: str) -> bool:
    """Whether writers of this store keep an index."""
    return path_exists(spark, f"{root}/{KEPT_NOTE}")


def is_covered(spark: SparkSession, root: str) -> bool:
    """Whether the index covers every stored row."""
    return path_exists(spark, f"{root}/{READY_NOTE}")


def live(days: dict[str, DayParts | None]) -> Column:
    """Postings of folders that count: all batches of untouched days, the listed folders of others."""
    touched = {day: parts for day, parts in days.items() if parts is not None}
    of_batch = F.col("part").startswith("b")
    if not touched:
        return of_batch
    day, batch = F.col("dt").cast("string"), F.shiftright(F.col("id"), ID_BITS).cast("string")
    batches = [f"{d}@{b}" for d, parts in touched.items() for b in parts["batches"]]
    kept = [f"{d}@g{g}" for d, parts in touched.items() for g in parts["kept"]]
    untouched = ~day.isin(list(touched))
    return (of_batch & (untouched | F.concat(day, F.lit("@"), batch).isin(batches))) | F.concat(day, F.lit("@"), "part").isin(kept)


def read_postings(
    spark: SparkSession,
    root: str,
    words: list[tuple[str, bool]],
    days: dict[str, DayParts | None],
    since: When | None = None,
    until: When | None = None,
) -> DataFrame:
    """Postings under the heads of some words, of rows that count and lie on days within the bounds."""
    path = f"{root}/{TOKENS_DIR}"
    if not path_exists(spark, path):
        return spark.createDataFrame([], POSTINGS)
    bounds = [F.col("head").isin(heads_of(words)), live(days)]
    if since:
        bounds.append(F.col("dt") >= F.lit(to_instant(since).date()))
    if until:
        bounds.append(F.col("dt") <= F.lit(to_instant(until).date()))
    return spark.read.schema(POSTINGS).parquet(path).filter(all_of(bounds))
