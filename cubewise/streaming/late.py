"""Posts behind the watermark: a table of them, and a job that corrects their hours.

The hourly stream drops a post whose hour its watermark has closed. A second
stream over the same posts keeps those aside. It cannot know the other's
batches, so it takes every post whose hour ended before the newest time seen
so far, its own batch included, less the delay: all that were dropped, and
possibly some that were not. That does no harm, as the correction counts the
hours of those posts anew, from all raw posts of the hour, and upserts them as
the stream does: absolute values, whole days published, safe to run again.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.calendar import day_windows
from ..plans.bindings import TableCubes, live_cube
from ..plans.cubes import hour_keys
from .hourly import HOUR_KEYS, as_event_time, upsert_hours

SLOTS = 2


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def start_late_posts(posts: DataFrame, path: str, checkpoint: str, delay: str = "1 hour", trigger: dict | None = None) -> StreamingQuery:
    """Keep posts behind the watermark of ``delay`` under ``path/late``, a
    folder for each batch, which a retried batch writes again."""
    base = path.rstrip("/")

    def keep(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            seen = _read(spark, f"{base}/seen/slot={(batch_id - 1) % SLOTS}")
            times = batch.select("ts")
            if seen is not None:
                times = times.unionByName(seen.where(F.col("batch_id") < batch_id).select("ts"))
            newest = times.agg(F.max("ts")).first()[0]
            if newest is not None:
                closed = F.lit(newest) - F.expr(f"INTERVAL {delay}")
                late = batch.where(F.date_trunc("hour", "ts") + F.expr("INTERVAL 1 hour") <= closed)
                late.write.mode("overwrite").parquet(f"{base}/late/batch={batch_id}")
            spark.createDataFrame([(batch_id, newest)], "batch_id long, ts timestamp").write.mode("overwrite").parquet(f"{base}/seen/slot={batch_id % SLOTS}")
        finally:
            batch.unpersist()

    writer = as_event_time(posts).writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "1 minute"})).start()


def pending(spark: SparkSession, path: str, collection: str) -> tuple[int, DataFrame] | None:
    """Late posts that ``collection`` was not corrected for, and the newest batch of them."""
    late = _read(spark, f"{path.rstrip('/')}/late")
    if late is None:
        return None
    done = _read(spark, f"{path.rstrip('/')}/corrected/{collection}")
    last = done.agg(F.max("batch")).first()[0] if done is not None else None
    rows = late if last is None else late.where(F.col("batch") > last)
    newest = rows.agg(F.max("batch")).first()[0]
    return None if newest is None else (newest, rows)


def correct_hours(raw: TableCubes, path: str, cube_path: str, collection: str) -> int:
    """Count the hours of late posts anew from ``raw``, which holds all posts,
    and upsert them into the hourly cube at ``cube_path``; the number of hours.

    Raw posts of the late posts' days only are read (a time filter), of these
    the late hours. The days are collected, as many as the calendar has. The
    cube has one writer at a time: run this while its stream does not write.
    """
    spark = raw.spark
    found = pending(spark, path, collection)
    if found is None:
        return 0
    newest, late = found
    hours = late.select(*hour_keys()).distinct()
    days = [r[0] for r in late.select(F.to_date("ts")).distinct().collect()]
    posts = raw.events(day_windows(days))
    own = [c.alias(f"_{n}") for c, n in zip(hour_keys(), ("year", "month", "day", "hour"))]
    of_hours = posts.select("*", *own).join(hours, [F.col(f"_{n}") == hours[n] for n in ("year", "month", "day", "hour")], "left_semi").select(posts.columns)
    cube = live_cube(of_hours, collection)
    keys = [c for c in cube.columns if c not in ("count", "sentiment")]
    upsert_hours(cube, cube_path.rstrip("/"), keys)
    spark.createDataFrame([(int(newest),)], "batch long").write.mode("overwrite").parquet(f"{path.rstrip('/')}/corrected/{collection}")
    return cube.select(*HOUR_KEYS[1:]).distinct().count()
