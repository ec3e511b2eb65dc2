"""Helpers shared by the corpus operators: staging, skew-safe lookups, components, splits."""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.session import shared_dir

#: The six ASCII white-space characters: blank and tab to carriage return.
ASCII_SPACE = r"[\x20\x09-\x0D]+"

#: Into how many parts the rows of one key may be split.
SALTS = 256


def staging_path(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read back, which cuts its lineage."""
    path = staging_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove a staged table that nothing reads any more."""
    spark = df.sparkSession
    for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_of(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column), F.lit(""))


def salt_of(*spread: str, salts: int = SALTS) -> Column:
    return F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")


def salted_lookup(
    facts: DataFrame, lookup: DataFrame, keys: list[str], spread: list[str], how: str = "inner"
) -> DataFrame:
    """Join ``facts`` to ``lookup``, one row per key, without gathering a hot key in one task.

    The rows of a key are split into ``SALTS`` parts by ``spread``.  Only (key, part) pairs that
    occur get a copy of the lookup row, so there are never more copies than rows, and never more
    than ``SALTS`` per key.  Null keys match each other.
    """
    facts = facts.withColumn("_salt", salt_of(*spread))
    parts = facts.select(*keys, "_salt").distinct()
    copies = null_safe_join(parts, lookup, keys)
    return null_safe_join(facts, copies, [*keys, "_salt"], how).drop("_salt")


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equality join in which null equals null; the left side's keys stay."""
    renamed = right.withColumnsRenamed({key: f"_r_{key}" for key in keys})
    on = [left[key].eqNullSafe(renamed[f"_r_{key}"]) for key in keys]
    return left.join(renamed, on, how).drop(*[f"_r_{key}" for key in keys])


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``links``; root is the smallest node of its component.

    Alternates two steps until the edges stop changing: every node hands its larger neighbours to
    the smallest node it knows, then its smaller ones.  Both need one minimum per node, combined
    before the shuffle and handed back part by part, so a star with very many leaves is no hot
    task.  The edges of each round are a table in the shared folder: a lost executor costs tasks
    of one round only.
    """
    edges = staged(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .filter("u <> v")
        .distinct(),
        "edges",
    )
    before = None
    while True:
        state = edges.agg(F.count("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_minimum(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = staged(large.filter("u <> v").distinct(), "large")
        small = _with_minimum(large)
        moved = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", "m"))
        following = staged(moved.filter("u <> v").distinct(), "edges")
        discard(large)
        discard(edges)
        edges = following
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select("root", "root").distinct())


def _with_minimum(edges: DataFrame) -> DataFrame:
    """Each edge (u, v) with m, the smallest of u and its neighbours."""
    smallest = edges.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return salted_lookup(edges, smallest, ["u"], ["v"])


def released(rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``rows``, a function for ``mapInArrow``, with memory that a task no longer uses handed back at its end.

    Workers live on between tasks; what their allocators keep would stay beside the steps that follow.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from rows(batches)
        finally:
            pa.default_memory_pool().release_unused()
            _trim()

    return task


@functools.cache
def _trimmer() -> Callable[[int], int]:
    # Only glibc has it; other libraries hand memory back by themselves.
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def _trim() -> None:
    _trimmer()(0)


def distinct_runs(texts: list[bytes], blanks: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The runs between blanks in all texts, in order: (distinct runs, each run's number among them,
    the runs up to the end of each text).

    ``blanks`` are single bytes, and one of them parts the texts.
    """
    data = np.frombuffer(blanks[:1].join([*texts, b""]), np.uint8)
    inside = np.ones(256, bool)
    inside[list(blanks)] = False
    inside = inside[data]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, stops = edge[::2], edge[1::2]
    offsets = np.r_[0, np.cumsum(stops - starts)]
    small = len(data) < 1 << 31
    kind, width = (pa.binary(), np.int32) if small else (pa.large_binary(), np.int64)
    buffers = [None, pa.py_buffer(offsets.astype(width)), pa.py_buffer(data[inside])]
    found = pa.Array.from_buffers(kind, len(starts), buffers).dictionary_encode()
    ends = np.searchsorted(starts, np.cumsum([len(text) + 1 for text in texts]))
    return found.dictionary.to_numpy(zero_copy_only=False).tolist(), found.indices.to_numpy(), ends


def laid_out(codes: list[bytes], number: np.ndarray, ends: np.ndarray, unit: str) -> list[bytes]:
    """For each text of :func:`distinct_runs` the codes of its runs end to end; ``codes`` are those of
    the distinct runs, of whole numbers of type ``unit``.
    """
    units = np.frombuffer(b"".join(codes), unit)
    size = np.fromiter(map(len, codes), np.int64, len(codes)) // units.itemsize
    data = gathered(units, (np.cumsum(size) - size)[number], size[number])
    stops = (units.itemsize * np.r_[0, np.cumsum(size[number])][ends]).tolist()
    whole = data.tobytes()
    return [whole[a:b] for a, b in zip([0, *stops], stops, strict=False)]


def gathered(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The slices of ``values`` from each start on, end to end."""
    stop = np.cumsum(size)
    return values[np.repeat(start - stop + size, size) + np.arange(int(size.sum()))]
