"""Session helpers: one place for the configuration every job relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings the library's plans are designed around. AQE re-plans joins and
# coalesces shuffle partitions at run time, and splits skewed join partitions;
# the session zone is pinned so calendar functions agree with the oracle.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Compiled whole-stage code is cached by its text; a serving session runs
    # the same few hundred stage shapes again and again (default cache: 100).
    "spark.sql.codegen.cache.maxEntries": "2000",
    "spark.ui.enabled": "false",
}


def build_session(
    master: str | None = None,
    app_name: str = "cubewise",
    shuffle_partitions: int | None = None,
    conf: dict[str, str] | None = None,
) -> SparkSession:
    """Create (or reuse) a session with the library defaults applied.

    On a cluster leave ``master`` unset so the launcher decides; locally pass
    ``local[N]`` and a shuffle partition count near the core count.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = dict(DEFAULT_CONF)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf or {})
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Return the shared folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names storage every executor can reach and is
    the only place scratch tables go. It is set here only when the session
    has none: then ``fallback`` is used and registered with the context, or,
    with a local master only, a fresh local folder. On a cluster an unset
    folder is an error: a driver's own disk is no shared folder.
    """
    current = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not fallback and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = fallback or tempfile.mkdtemp(prefix="cubewise-ckpt-")
    os.makedirs(path, exist_ok=True)
    spark.sparkContext.setCheckpointDir(path)
    spark.conf.set("spark.checkpoint.dir", path)
    return spark.sparkContext.getCheckpointDir() or path
