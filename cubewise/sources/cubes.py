"""Cube storage: write, read and reshape cube collections.

A cube is stored flat (one column per key field plus the measure) and
partitioned by its coarse time keys, so a query's ``year == Y`` (or day)
predicate becomes a partition filter. The document layout, with the key
fields nested in an ``_id`` struct, is supported on read and can be produced
for a document-store writer with :func:`nest_id`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HISTORIC_PARTITIONS = ("year",)
LIVE_PARTITIONS = ("year", "month", "day")


def flatten_id(df: DataFrame) -> DataFrame:
    """Lift the fields of an ``_id`` struct to top-level columns (read flattening)."""
    if "_id" not in df.columns or not df.schema["_id"].dataType.typeName() == "struct":
        return df
    rest = [c for c in df.columns if c != "_id"]
    return df.select("_id.*", *rest)


def nest_id(df: DataFrame, keys: list[str] | tuple[str, ...]) -> DataFrame:
    """Move the key columns into an ``_id`` struct: the document layout of a cube."""
    rest = [c for c in df.columns if c not in keys]
    return df.select(F.struct(*keys).alias("_id"), *rest)


def write_cube(df: DataFrame, path: str, partition_by: tuple[str, ...] = HISTORIC_PARTITIONS, mode: str = "overwrite",
               dynamic: bool = True) -> None:
    """Write a flat cube as Parquet, partitioned for pruning.

    The ``rebalance`` hint clusters rows by the partition columns (few files
    per partition) and lets AQE split an oversized partition, such as a hot
    year or day, over several tasks and merge small ones. With dynamic
    partition overwrite (``dynamic``) a rebuild of some periods replaces only
    those partitions; a static overwrite replaces the whole cube. Each task
    writes its own files and commits through the output committer, so a lost
    executor only re-runs its tasks.
    """
    (df.hint("rebalance", *partition_by)
       .write.mode(mode)
       .option("partitionOverwriteMode", "dynamic" if dynamic else "static")
       .partitionBy(*partition_by)
       .parquet(path))


def read_cube(spark: SparkSession, path: str) -> DataFrame:
    """Read a stored cube (flat or ``_id``-nested) as a flat frame."""
    return flatten_id(spark.read.parquet(path))


def known_keys(cube: DataFrame, keys: list[str] | tuple[str, ...], on_null: str = "error") -> DataFrame:
    """``cube`` without null keys: a row that has one is an error when it is
    read (``on_null="error"``) or left out (``"drop"``); ``"keep"`` leaves the
    cube as it is. Count such rows beforehand with :func:`null_key_rows`."""
    if on_null not in ("error", "drop", "keep"):
        raise ValueError("on_null must be 'error', 'drop' or 'keep'")
    if on_null == "keep" or not keys:
        return cube
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    if on_null == "error":
        known = F.when(known, F.lit(True)).otherwise(F.raise_error(F.lit(f"null key among {', '.join(keys)}")).cast("boolean"))
    return cube.where(known)


def null_key_rows(cube: DataFrame, keys: list[str] | tuple[str, ...]) -> int:
    """How many rows have a null key."""
    return cube.count() - known_keys(cube, keys, "drop").count()


def duplicate_keys(cube: DataFrame, keys: list[str] | tuple[str, ...]) -> DataFrame:
    """Key combinations present more than once.

    Value-per-period routes keep one value per key; cubes built here are
    unique by construction, and a stored cube from elsewhere can be checked
    with this before it is served.
    """
    return cube.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def assert_unique(cube: DataFrame, keys: list[str] | tuple[str, ...]) -> None:
    dup = duplicate_keys(cube, keys).limit(1).collect()
    if dup:
        raise ValueError(f"cube key {tuple(keys)} is not unique, e.g. {dup[0].asDict()}")
