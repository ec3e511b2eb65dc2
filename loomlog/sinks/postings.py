"""Keeping the text index of a store beside its rows."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.functions.text import tokens
from loomlog.sources.postings import KEPT_NOTE, READY_NOTE, head_of, is_covered, is_indexed
from loomlog.sources.store import (
    GENERATIONS_DIR,
    KEPT_DIR,
    LOGS_DIR,
    TOKENS_DIR,
    commit_path,
    folders,
    path_exists,
    read_folders,
    read_note,
    remove,
    write_note,
)


def postings(rows: DataFrame) -> DataFrame:
    """One row per distinct token of each body: token, dt, id, head."""
    token = F.explode(F.array_distinct(tokens(F.col("body")))).alias("token")
    return rows.select(token, "dt", "id").withColumn("head", head_of(F.col("token")))


def write_postings(rows: DataFrame, root: str, part: str) -> None:
    """Write the postings of a part's rows; repeating it replaces the part.

    The rebalance splits a head that holds most of the tokens over several files, each in token
    order, so that row groups can be skipped by their least and greatest token.
    """
    (
        postings(rows)
        .hint("rebalance", "head")
        .sortWithinPartitions("head", "token", "dt", "id")
        .write.mode("overwrite")
        .partitionBy("head")
        .parquet(f"{root}/{TOKENS_DIR}/part={part}")
    )


def index_store(spark: SparkSession, root: str) -> None:
    """Keep an index of a store from now on, and write that of what it holds already.

    The first note makes writers keep their postings; then every folder without them is
    indexed, and the second note says that searches may rely on the index.  A run that breaks
    off is taken up by the next.  No upkeep may run meanwhile; batches may be appended.
    """
    if is_covered(spark, root):
        return
    if not is_indexed(spark, root):
        write_note(spark, f"{root}/{KEPT_NOTE}", {"indexed": True})
    done = set(folders(spark, f"{root}/{TOKENS_DIR}"))
    sources: dict[str, list[str]] = {}
    for name in folders(spark, f"{root}/{LOGS_DIR}"):
        for batch in folders(spark, f"{root}/{LOGS_DIR}/{name}"):
            sources.setdefault(f"b{batch[6:]}", []).append(f"{root}/{LOGS_DIR}/{name}/{batch}")
    for gen in folders(spark, f"{root}/{KEPT_DIR}"):
        if path_exists(spark, f"{root}/{GENERATIONS_DIR}"):
            sources[f"g{gen[4:]}"] = [f"{root}/{KEPT_DIR}/{gen}/{day}" for day in folders(spark, f"{root}/{KEPT_DIR}/{gen}")]
    for part, paths in sources.items():
        # A folder whose writing broke off has no _SUCCESS file.
        if f"part={part}" not in done or not path_exists(spark, f"{root}/{TOKENS_DIR}/part={part}/_SUCCESS"):
            base = f"{root}/{LOGS_DIR if part[0] == 'b' else KEPT_DIR}"
            write_postings(read_folders(spark, base, paths), root, part)
    write_note(spark, f"{root}/{READY_NOTE}", {"covered": True})


def drop_dead_postings(spark: SparkSession, root: str, batches: set[int], gens: set[int]) -> None:
    """Remove the postings of batches and generations none of whose day folders is left."""
    if not is_indexed(spark, root):
        return
    for batch in batches:
        note = read_note(spark, commit_path(root, batch))
        if note is None:
            continue
        first, last = (date.fromisoformat(note[name][:10]) for name in ("first", "last"))
        days = (first + timedelta(days=n) for n in range((last - first).days + 1))
        if not any(path_exists(spark, f"{root}/{LOGS_DIR}/dt={day}/batch={batch}") for day in days):
            remove(spark, f"{root}/{TOKENS_DIR}/part=b{batch}")
    for gen in gens:
        if not any(name.startswith("dt=") for name in folders(spark, f"{root}/{KEPT_DIR}/gen={gen}")):
            remove(spark, f"{root}/{TOKENS_DIR}/part=g{gen}")
