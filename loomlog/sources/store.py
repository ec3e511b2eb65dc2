"""The stored log table: Parquet partitioned by day and write batch.

A batch is written once, under ``logs/dt=/batch=``, and its file in ``commits`` is the last thing
written.  Upkeep never touches a batch's files in place: the rows of a day that stay are written
under ``logs_kept/gen=/dt=`` and count from the moment the generation's file lies in
``generations``; that file names the folders it replaces, and readers skip those from then on.
"""

from __future__ import annotations

import json
import re
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomlog.functions.instants import When, to_instant
from loomlog.plans.predicates import all_of, time_bounds
from loomlog.schema import COUNT_DELTAS, FIELDS, STORED_LOGS

LOGS_DIR = "logs"
COUNTS_DIR = "counts"
FOLDED_DIR = "counts_folded"
QUARANTINE_DIR = "quarantine"
TOKENS_DIR = "tokens"
COMMITS_DIR = "commits"
KEPT_DIR = "logs_kept"
GENERATIONS_DIR = "generations"
#: How the name of a snapshot of several generations' notes begins; the number of the last follows.
SNAPSHOT = "folded-"
#: Notes of a store that keeps its bodies as shredded VARIANTs too: from when on, and for all rows.
FIELDS_KEPT, FIELDS_READY = "fields_state/kept.json", "fields_state/ready.json"

#: Folders of one day: the write batches, and the generations that hold rows of it.
DayParts = dict[str, list[int]]


def project_root(root: str, project_id: str | None) -> str:
    """Folder of one project's tables.  A missing project is an error, never all data."""
    if not project_id or not re.fullmatch(r"[A-Za-z0-9_-]+", project_id):
        raise ValueError("a project id of letters, digits, '_' and '-' is required")
    return f"{root}/project_id={project_id}"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder exists on the file system its path names."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders directly under a path; only this one level is listed."""
    if not path_exists(spark, path):
        return []
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(hadoop)
    return sorted(entry.getPath().getName() for entry in found if entry.isDirectory())


def day_folders(
    spark: SparkSession, root: str, since: When | None = None, until: When | None = None
) -> list[str]:
    """Paths of the stored days within the bounds."""
    first = f"dt={to_instant(since).date()}" if since else "dt="
    last = f"dt={to_instant(until).date()}" if until else "dt=9999-12-31"
    path = f"{root}/{LOGS_DIR}"
    return [f"{path}/{name}" for name in folders(spark, path) if first <= name <= last]


def file_system(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def remove(spark: SparkSession, path: str) -> None:
    """Remove a file or a folder with all that is in it."""
    files, hadoop = file_system(spark, path)
    files.delete(hadoop, True)


def write_note(spark: SparkSession, path: str, note: dict) -> None:
    """Put a small JSON file in place in one step."""
    folder, _, name = path.rpartition("/")
    files, hidden = file_system(spark, f"{folder}/_{uuid.uuid4().hex}")
    files.mkdirs(hidden.getParent())
    stream = files.create(hidden)
    stream.write(bytearray(json.dumps(note).encode()))
    stream.close()
    if not files.rename(hidden, file_system(spark, path)[1]):
        files.delete(hidden, False)
        raise FileExistsError(path)


def read_note(spark: SparkSession, path: str) -> dict | None:
    """A small JSON file, or None where there is none."""
    if not path_exists(spark, path):
        return None
    files, hadoop = file_system(spark, path)
    stream = files.open(hadoop)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def commit_path(root: str, batch_id: int) -> str:
    return f"{root}/{COMMITS_DIR}/{batch_id:020d}.json"


def commits_from(spark: SparkSession, root: str, batch_id: int) -> list[int]:
    """Numbers of the committed batches from one on; the names of earlier ones do not leave the file system."""
    digits = f"{batch_id:020d}"
    larger = [f"{digits[:i]}[{int(d) + 1}-9]{'?' * (19 - i)}" for i, d in enumerate(digits) if d != "9"]
    files, pattern = file_system(spark, f"{root}/{COMMITS_DIR}/{{{','.join([digits, *larger])}}}.json")
    found = files.globStatus(pattern)
    return sorted(int(entry.getPath().getName()[:20]) for entry in found or [])


def note_names(spark: SparkSession, root: str) -> tuple[list[str], list[str]]:
    """File names of the generations' notes that count, in order, and of those a later snapshot covers."""
    path = f"{root}/{GENERATIONS_DIR}"
    if not path_exists(spark, path):
        return [], []
    files, hadoop = file_system(spark, path)
    names = sorted(e.getPath().getName() for e in files.listStatus(hadoop))
    snapshots = [name for name in names if name.startswith(SNAPSHOT) and name.endswith(".json")]
    notes = [name for name in names if name[0].isdigit() and name.endswith(".json")]
    covered = [name for name in notes if snapshots and name <= snapshots[-1].removeprefix(SNAPSHOT)]
    return snapshots[-1:] + [name for name in notes if name not in set(covered)], snapshots[:-1] + covered


def generations(spark: SparkSession, root: str) -> list[dict]:
    """Notes of the committed generations, one for each run of upkeep that changed days.

    Older ones come as one snapshot, whose ``kept`` names the generation of each day.
    """
    while True:
        notes = [read_note(spark, f"{root}/{GENERATIONS_DIR}/{name}") for name in note_names(spark, root)[0]]
        # A note that went since it was listed lies in a snapshot by now.
        if None not in notes:
            return notes


def kept_by(note: dict, day: str) -> int | None:
    """The generation that holds a day's rows by a note, None where none are left."""
    gen = note["kept"].get(day)
    return note["gen"] if gen is True else gen or None


def day_parts(
    spark: SparkSession, root: str, since: When | None = None, until: When | None = None
) -> dict[str, DayParts | None]:
    """By day within the bounds, the folders that count; None where all batches do and nothing else."""
    first = str(to_instant(since).date()) if since else ""
    last = str(to_instant(until).date()) if until else "9999-12-31"
    days: dict[str, DayParts | None] = {
        name[3:]: None for name in folders(spark, f"{root}/{LOGS_DIR}") if first <= name[3:] <= last
    }
    replaced: dict[str, set[int]] = {}
    kept: dict[str, list[int]] = {}
    for note in generations(spark, root):
        for day, parts in note["days"].items():
            if first <= day <= last:
                replaced.setdefault(day, set()).update(parts["batches"])
                kept[day] = [gen] if (gen := kept_by(note, day)) else []
    for day, gone in replaced.items():
        names = folders(spark, f"{root}/{LOGS_DIR}/dt={day}") if day in days else []
        batches = {int(name[6:]) for name in names if name.startswith("batch=")}
        days[day] = {"batches": sorted(batches - gone), "kept": kept[day]}
    return dict(sorted(days.items()))


def read_parts(spark: SparkSession, root: str, days: dict[str, DayParts | None], fields: bool = False) -> DataFrame:
    """The rows of the given folders, with ``fields`` as a last column if asked for."""
    logs, kept = f"{root}/{LOGS_DIR}", f"{root}/{KEPT_DIR}"
    whole = [f"{logs}/dt={day}" for day, parts in days.items() if parts is None]
    some = [f"{logs}/dt={day}/batch={b}" for day, parts in days.items() if parts for b in parts["batches"]]
    later = [f"{kept}/gen={g}/dt={day}" for day, parts in days.items() if parts for g in parts["kept"]]
    schema = T.StructType([*STORED_LOGS.fields, FIELDS]) if fields else STORED_LOGS
    found = [read_folders(spark, base, paths, schema) for base, paths in ((logs, [*whole, *some]), (kept, later)) if paths]
    return reduce(DataFrame.unionByName, found) if found else read_folders(spark, logs, [], schema)


def read_folders(spark: SparkSession, base: str, paths: list[str], schema: T.StructType = STORED_LOGS) -> DataFrame:
    """The rows of some folders under ``base``."""
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", base).parquet(*paths).select(*schema.names)


def read_logs(
    spark: SparkSession, root: str, since: When | None = None, until: When | None = None
) -> DataFrame:
    """Stored rows within inclusive time bounds; days outside them are neither listed nor read."""
    return _within(read_parts(spark, root, day_parts(spark, root, since, until)), since, until)


def _within(df: DataFrame, since: When | None, until: When | None) -> DataFrame:
    bounds = time_bounds(df, since, until)
    return df.filter(all_of(bounds)) if bounds else df


def read_fields(
    spark: SparkSession, root: str, since: When | None = None, until: When | None = None
) -> DataFrame:
    """``read_logs`` with the column ``fields``, from which field tests read single members.

    A test of ``fields`` reaches the scan: only the members it names are read, as Parquet columns of
    their own where most bodies have them.  Only stores that keep fields for all rows have it; of
    others the rows come without it, and field tests parse their bodies.
    """
    fields = path_exists(spark, f"{root}/{FIELDS_READY}")
    return _within(read_parts(spark, root, day_parts(spark, root, since, until), fields), since, until)


def read_days(spark: SparkSession, root: str, first: When, last: When) -> DataFrame:
    """All rows of the stored days from ``first`` to ``last``."""
    return read_parts(spark, root, day_parts(spark, root, first, last))


def read_batch(
    spark: SparkSession, root: str, batch_id: int, since: When | None = None, until: When | None = None
) -> DataFrame:
    """Rows of one write batch, looked for only in the days within the bounds."""
    paths = [f"{day}/batch={batch_id}" for day in day_folders(spark, root, since, until)]
    logs = f"{root}/{LOGS_DIR}"
    return read_folders(spark, logs, [path for path in paths if path_exists(spark, path)])


def read_counts(spark: SparkSession, root: str) -> DataFrame:
    """Counter deltas: the latest folded sum, and the batches after it."""
    path, folded_path = f"{root}/{COUNTS_DIR}", f"{root}/{FOLDED_DIR}"
    if not path_exists(spark, path):
        return spark.createDataFrame([], COUNT_DELTAS)
    deltas = spark.read.schema(COUNT_DELTAS).parquet(path)
    if not path_exists(spark, folded_path):
        return deltas
    folded = spark.read.schema(COUNT_DELTAS).parquet(folded_path)
    latest = folded.agg(F.max("batch")).scalar()
    return deltas.filter(F.col("batch") > latest).unionByName(
        folded.filter(F.col("batch") == latest)
    )
