"""Latest-items lists as a Structured Streaming job.

State is the newest ``n`` posts per key (each party and ``combined``), kept
as rows ``key, ts, oid, batch_id``. Each micro-batch reduces its own posts to
the newest ``n`` per key (a partial group limit, and a global top-n for
``combined``), unions them with the previous state and keeps the newest ``n``
per key again.

State lives in two slots, ``<path>/slot=0`` and ``<path>/slot=1``: batch
``i`` reads the newest state older than ``i`` from either slot and writes
slot ``i % 2`` with overwrite. A failed or retried batch can only damage the
slot it writes, never the one holding its input, so a retry rebuilds the
same state. Storage and reads stay at two small versions however long the
stream runs.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..catalog import LATEST_LIST_LENGTH
from ..plans.cubes import keep_newest, lists_from_rows, newest_rows

SLOTS = 2


def _state(spark: SparkSession, base: str, before: int | None = None) -> DataFrame | None:
    """The newest complete state version (older than ``before`` if given)."""
    try:
        versions = spark.read.parquet(base)
    except AnalysisException:
        return None
    if before is not None:
        versions = versions.where(F.col("batch_id") < before)
    last = Window.partitionBy("key").orderBy(F.col("batch_id").desc())
    return (versions.withColumn("_v", F.dense_rank().over(last)).where(F.col("_v") == 1)
            .select("key", "ts", "oid"))


def start_latest_lists(posts: DataFrame, path: str, checkpoint: str, post_id: str = "event_id",
                       n: int = LATEST_LIST_LENGTH, trigger: dict | None = None) -> StreamingQuery:
    base = path.rstrip("/")

    def merge_batch(batch: DataFrame, batch_id: int) -> None:
        fresh = newest_rows(batch, post_id, n)
        prev = _state(batch.sparkSession, base, before=batch_id)
        merged = fresh if prev is None else keep_newest(prev.unionByName(fresh), n)
        (merged.withColumn("batch_id", F.lit(batch_id).cast("long"))
         .write.mode("overwrite").parquet(f"{base}/slot={batch_id % SLOTS}"))

    writer = posts.writeStream.foreachBatch(merge_batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "10 seconds"})).start()


def read_latest_lists(spark: SparkSession, path: str) -> DataFrame:
    """``key, tweetIds`` (oldest first) from the newest state version."""
    state = _state(spark, path.rstrip("/"))
    if state is None:
        raise FileNotFoundError(f"no latest-list state under {path}")
    return lists_from_rows(state)
