"""Hourly live cubes as Structured Streaming jobs.

The stream groups posts by a 1-hour event-time window (plus party, and the
item for item cubes) under a watermark, in update mode: every micro-batch
emits the hours whose value changed, each with its value over all data seen
so far (an absolute value, not a delta). State for an hour is dropped once
the watermark passes its end; a post older than the watermark is late and is
not counted (the watermark delay is the late-data rule, chosen by the caller).

Sink: an upsert into the cube itself, stored partitioned by (year, month,
day) like the batch cube. ``foreachBatch`` reads only the days between the
batch's first and last day (a partition filter), keeps the rows of touched
days that the batch does not update, and adds the batch's rows. The result is
written to a staging folder inside the stream's checkpoint location, marked
there with the batch's number, and then published: a dynamic overwrite of the
touched day partitions. The cube is never read and replaced by one job. A
batch that is retried after its staging was marked publishes the staged rows
again and does not look at the cube, which a crash may have left with days
missing; before the mark, the cube is as the previous batch left it. So one
staging folder is enough, and storage stays the size of the cube and a batch.

Adaptive execution is off inside a stream's batches, so the layout of the
write is explicit: one task for each touched day, and several for a day of
more than ``ROWS_PER_FILE`` rows.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.cubes import one_row_per_item
from ..session import checkpoint_dir
from ..sources.cubes import LIVE_PARTITIONS, read_cube
from ..sources.tables import SCHEMAS

HOUR_KEYS = ("party", "year", "month", "day", "hour")
EVENT_SCHEMA = SCHEMAS["events"]
#: Rows of one task and file of a published day.
ROWS_PER_FILE = 2_000_000


def as_event_time(posts: DataFrame, ts: str = "ts") -> DataFrame:
    """Watermarks need ``timestamp`` (not ``timestamp_ntz``); with the session
    zone at UTC the cast keeps the wall-clock values."""
    if posts.schema[ts].dataType.typeName() == "timestamp_ntz":
        posts = posts.withColumn(ts, F.col(ts).cast("timestamp"))
    return posts


def hourly_updates(posts: DataFrame, measure: Column, name: str = "count", item: Column | None = None,
                   item_name: str | None = None, watermark: str = "1 hour") -> DataFrame:
    """Streaming hourly cube rows: ``party, year, month, day, hour[, item], <name>``."""
    posts = as_event_time(posts).withWatermark("ts", watermark)
    if item is not None:
        posts, item = one_row_per_item(posts, item)
    keys = [F.window("ts", "1 hour").alias("w"), F.col("party")]
    if item is not None:
        keys.append(item.cast("string").alias(item_name))
    agg = posts.groupBy(*keys).agg(measure.cast("double").alias(name))
    start = F.col("w.start")
    out = [F.col("party"), F.year(start).cast("long").alias("year"), F.month(start).cast("long").alias("month"),
           F.dayofmonth(start).cast("long").alias("day"), F.hour(start).cast("long").alias("hour")]
    if item is not None:
        out.append(F.col(item_name))
    return agg.select(*out, F.col(name))


def upsert_hours(batch: DataFrame, path: str, keys: list[str], staging: str | None = None, batch_id: int = 0) -> None:
    """Merge ``batch`` (absolute values per key) into the cube at ``path``.

    ``staging`` belongs to one stream, whose batches ``batch_id`` numbers. A
    call of its own, outside a stream, is staged in a new folder.
    """
    spark = batch.sparkSession
    staging = staging or f"{checkpoint_dir(spark).rstrip('/')}/upsert-{uuid.uuid4().hex}"
    if _marked(spark, staging) != batch_id:
        merged = merge_hours(batch, path, keys)
        if merged is None:
            return
        merged.write.mode("overwrite").parquet(f"{staging}/rows")
        spark.createDataFrame([(batch_id,)], "batch_id long").write.mode("overwrite").parquet(f"{staging}/marked")
    publish_days(spark.read.schema(batch.schema).parquet(f"{staging}/rows"), path)


def _marked(spark: SparkSession, staging: str) -> int | None:
    """Number of the batch whose rows lie in ``staging`` as a whole."""
    try:
        row = spark.read.schema("batch_id long").parquet(f"{staging}/marked").first()
    except AnalysisException:
        return None
    return row and row["batch_id"]


def merge_hours(batch: DataFrame, path: str, keys: list[str]) -> DataFrame | None:
    """All rows of the days that ``batch`` touches, after it; None if it is empty."""
    day = F.make_date(*[F.col(c).cast("int") for c in LIVE_PARTITIONS])
    first, last = batch.agg(F.min(day), F.max(day)).first()
    if first is None:
        return None
    try:
        current = read_cube(batch.sparkSession, path).where(day.between(F.lit(first), F.lit(last)))
    except AnalysisException:
        return batch
    kept = touched_days(current, batch).join(batch.select(*keys), keys, "left_anti")
    return kept.select(*[F.col(c).cast(batch.schema[c].dataType) for c in batch.columns]).unionByName(batch)


def publish_days(rows: DataFrame, path: str) -> None:
    """Replace the day partitions of ``rows`` in the cube at ``path``."""
    largest = rows.groupBy(*LIVE_PARTITIONS).count().agg(F.max("count")).first()[0] or 1
    salt = F.pmod(F.xxhash64(*[c for c in rows.columns if c not in LIVE_PARTITIONS]), F.lit(-(-largest // ROWS_PER_FILE)))
    (rows.repartition(*LIVE_PARTITIONS, salt).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(*LIVE_PARTITIONS).parquet(path))


def touched_days(current: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows of the stored cube in the day partitions ``batch`` touches: a semi
    join on the partition columns."""
    days = batch.select(*LIVE_PARTITIONS).distinct()
    return current.join(days, list(LIVE_PARTITIONS), "left_semi")


def start_hourly_cube(updates: DataFrame, path: str, checkpoint: str, trigger: dict | None = None,
                      query_name: str | None = None) -> StreamingQuery:
    """Run ``updates`` (from :func:`hourly_updates`) into the cube at ``path``."""
    base, staging = path.rstrip("/"), f"{checkpoint.rstrip('/')}/staged"
    keys = [c for c in updates.columns if c not in ("count", "sentiment")]

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            batch.count()  # moves the stream's state on, also where rows staged before are published again
            upsert_hours(batch, base, keys, staging, batch_id)
        finally:
            batch.unpersist()

    writer = (updates.writeStream.outputMode("update").foreachBatch(write_batch)
              .option("checkpointLocation", checkpoint))
    if query_name:
        writer = writer.queryName(query_name)
    writer = writer.trigger(**(trigger or {"processingTime": "1 minute"}))
    return writer.start()


def read_event_stream(spark: SparkSession, folder: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Event posts arriving as Parquet files in ``folder``: ``party`` = event type."""
    reader = spark.readStream.schema(EVENT_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(folder).withColumnRenamed("event_type", "party")


def live_updates(posts: DataFrame, collection: str, watermark: str = "1 hour") -> DataFrame:
    """Streaming rows of the hourly cube ``collection`` (same definition as the batch cube)."""
    from ..plans.bindings import live_definition

    measure, name, item, item_name = live_definition(collection)
    return hourly_updates(posts, measure, name, item, item_name, watermark)
