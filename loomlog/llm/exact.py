"""Exact duplicates: two passes over Bloom filters leave only possible repeats to shuffle."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.llm.common import ASCII_SPACE, null_safe_join, salt_of, staged, text_of

#: Bound of a filter: this many 64-bit words, whatever the table's size (8 MB of bits).
MAX_WORDS = 1 << 20
#: Rows a word is meant for while the table is small enough: 16 bits each.
ROWS_PER_WORD = 4


def normal_digest(text: str = "text") -> Column:
    """SHA-256 (binary) of the text without ASCII white space; null counts as empty."""
    return F.unhex(F.sha2(F.regexp_replace(text_of(text), ASCII_SPACE, ""), 256))


def _cell(words: int) -> dict[str, Column]:
    """A digest's word in the filter and its four bits there."""
    h = "xxhash64(_digest)"
    bits = " | ".join(f"shiftleft(1L, cast(shiftrightunsigned({h}, {at}) & 63 AS INT))" for at in (24, 30, 36, 42))
    return {"_word": F.expr(f"{h} & {words - 1}L"), "_mask": F.expr(f"({bits})")}


def repeat_filter(digests: DataFrame, rows: int, max_words: int = MAX_WORDS) -> tuple[DataFrame, int]:
    """First pass: (word, repeated) of the filter of digests that may occur more than once.

    Each 64-bit word is a small Bloom filter of its own.  Within a word, rows with the same bits
    are counted map-side, then the bit patterns are put in one by one: a pattern that occurred
    twice, or whose bits were all set already, goes into the second filter, ``repeated``.  Equal
    digests always have equal patterns, so no repeat is missed.  There are at most ``max_words``
    words, however large the table; beyond about four rows a word more unique rows are shuffled,
    and the result stays the same.
    """
    words = 1 << min(max(math.ceil(math.log2(max(rows, 1) / ROWS_PER_WORD)), 4), max_words.bit_length() - 1)
    patterns = digests.select(*[c.alias(k) for k, c in _cell(words).items()])
    counted = patterns.groupBy("_word", "_mask").agg(F.count(F.lit(1)).alias("n"))
    put = """aggregate(array_sort(collect_list(struct(_mask, n))),
        named_struct('seen', 0L, 'repeated', 0L),
        (f, x) -> named_struct(
            'seen', f.seen | x._mask,
            'repeated', if(x.n > 1 OR (f.seen & x._mask) = x._mask, f.repeated | x._mask, f.repeated)),
        f -> f.repeated)"""
    filled = counted.groupBy("_word").agg(F.expr(put).alias("_repeated"))
    return filled.filter("_repeated <> 0"), words


def split_repeats(rows: DataFrame, repeated: DataFrame, words: int) -> tuple[DataFrame, DataFrame]:
    """Second pass: (rows that may repeat, rows that cannot); the filter is of bounded size."""
    looked = rows.withColumns(_cell(words)).join(F.broadcast(repeated), "_word", "left")
    maybe = F.expr("coalesce((_mask & _repeated) = _mask, false)")
    extra = ("_word", "_mask", "_repeated")
    return looked.filter(maybe).drop(*extra), looked.filter(~maybe).drop(*extra)


def _rank() -> Column:
    """Largest for the row that stays: most code points, then smallest id, null ids last."""
    return F.struct(F.col("_length"), F.col("doc_id").isNotNull(), F.expr("~doc_id").alias("flipped"))


def _keys(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.length(text_of()).alias("_length"),
        normal_digest().alias("_digest"),
    )


def exact_groups(docs: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical without ASCII white space.  Of a group the row with
    the longest original text stays, then the smallest doc_id.  Null texts are empty texts; a
    null doc_id counts as the largest; rows that repeat both id and text share their mark.  Other
    columns are not read.  Rows that cannot repeat are never shuffled.
    """
    keys = staged(_keys(docs), "digests")
    repeated, words = repeat_filter(keys, keys.count(), max_words)
    maybe, once = split_repeats(keys, staged(repeated, "repeats"), words)
    maybe = maybe.withColumn("_salt", salt_of("doc_id", "_length"))
    parts = maybe.groupBy("_digest", "_salt").agg(F.count(F.lit(1)).alias("n"), F.max(_rank()).alias("best"))
    groups = parts.groupBy("_digest").agg(
        F.sum("n").alias("group_size"), F.max("best").alias("best"), F.collect_list("_salt").alias("salts")
    )
    handed = groups.withColumn("_salt", F.explode("salts")).drop("salts")
    grouped = maybe.join(handed, ["_digest", "_salt"]).withColumn("keep_id", F.expr("~best.flipped"))
    single = once.withColumns({"keep_id": F.col("doc_id"), "group_size": F.lit(1).cast("long"), "best": _rank()})
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    return (
        grouped.select(*single.columns)
        .unionByName(single)
        .withColumns(
            {
                "kept": F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_length") == F.col("best._length")),
                "text_sha256": F.lower(F.hex("_digest")),
            }
        )
        .select(*columns)
    )


def drop_exact(docs: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group of equal texts, with all columns.

    The same rule as in :func:`exact_groups`; of rows that repeat id and text, one stays.
    """
    keys = staged(_keys(docs), "digests")
    repeated, words = repeat_filter(keys, keys.count(), max_words)
    repeated = staged(repeated, "repeats")
    suspects, _ = split_repeats(keys, repeated, words)
    best = suspects.groupBy("_digest").agg(F.max(_rank()).alias("best"))
    winners = best.select("_digest", F.expr("~best.flipped").alias("doc_id"))
    # The row is carried whole, so its own column names cannot clash with the ones used here.
    full = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), normal_digest().alias("_digest"))
    maybe, once = split_repeats(full, repeated, words)
    stay = null_safe_join(maybe, winners, ["_digest", "doc_id"], "left_semi")
    return stay.dropDuplicates(["_digest"]).unionByName(once).select("_row.*")
