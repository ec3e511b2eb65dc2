"""Session settings the operators rely on."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

#: Results depend on these, so they are set on any session handed to the library.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    # A JSON object with a repeated key keeps the last value.
    "spark.sql.variant.allowDuplicateKeys": "true",
}

#: Execution settings; a cluster's own values win because these are only used by build_session.
TUNING_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def build_session(
    app: str = "loomlog",
    master: str | None = None,
    conf: dict[str, str] | None = None,
) -> SparkSession:
    """Return a session with the settings above; ``conf`` overrides the tuning part."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**TUNING_CONF, **(conf or {}), **REQUIRED_CONF}.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the settings results depend on; safe to call repeatedly."""
    for key, value in REQUIRED_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and staged rewrites, shared by all executors.

    A cluster names it in ``spark.checkpoint.dir``.  Only where that is unset in a local run, as
    in tests, a fresh temporary folder is used and remembered on the session.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("a cluster must name a shared folder in spark.checkpoint.dir")
    local = tempfile.mkdtemp(prefix="loomlog-")
    spark.conf.set("spark.checkpoint.dir", local)
    return local
