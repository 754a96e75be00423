"""Latest lists over posts that move and go, with keyed state.

The stream carries changes of posts: a new post, a new party or time of a known
one, or its deletion. A list must then lose a post that it shows and take the
next one in, so the state holds all posts, in ``shards`` by a hash of the id
(``transformWithState``; no list, and not the one of all posts, is one key).
Beside its posts each shard keeps, for every key, the newest ``n`` of them and
whether there are more. A retraction from a list that has more refills it from
the shard's own posts; everything else touches only the posts that changed.

Shards emit the lists that changed, in update mode. The sink keeps the lists of
all shards (``shards`` times ``n`` rows of a key at most) in two slots, as
:mod:`cubewise.streaming.latest` does, so a retried batch writes the same; a
reader merges the shards' lists of a key.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..catalog import COMBINED_KEY, LATEST_LIST_LENGTH
from ..plans.cubes import keep_newest, lists_from_rows

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SHARDS = 64
SLOTS = 2
#: Times are microseconds inside the state: workers compare plain numbers.
EMITTED = "shard int, key string, micros long, oid long"


class Posts(StatefulProcessor):
    """The posts of one shard, and its newest ``n`` for each key."""

    def __init__(self, n: int = LATEST_LIST_LENGTH, combined: str = COMBINED_KEY):
        self.n, self.combined = n, combined

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.posts = handle.getMapState("posts", "oid long", "party string, micros long, seq long, deleted boolean")
        self.lists = handle.getMapState("lists", "key string", "micros array<long>, oid array<long>, more boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        shown: dict[str, list] = {}  # key: [newest posts as (micros, oid), more]
        short: set[str] = set()
        for change in sorted(rows, key=lambda r: (r.seq, r.oid)):
            had = self.posts.getValue((change.oid,)) if self.posts.containsKey((change.oid,)) else None
            if had is not None and had[2] >= change.seq:
                continue  # an older change of a post that came late, or the same one again
            self.posts.updateValue((change.oid,), (change.party, change.micros, change.seq, bool(change.deleted)))
            if had is not None and not had[3]:
                for k in (had[0], self.combined):
                    self._take_out(shown, short, k, (had[1], change.oid))
            if not change.deleted:
                for k in (change.party, self.combined):
                    self._put_in(shown, k, (change.micros, change.oid))
        if short:
            self._refill(shown, short)
        (shard,) = key
        for k, (newest, more) in shown.items():
            self.lists.updateValue((k,), ([micros for micros, _ in newest], [oid for _, oid in newest], more))
            for micros, oid in newest or [(None, None)]:  # a list without posts is told too
                yield Row(shard=shard, key=k, micros=micros, oid=oid)

    def _list(self, shown: dict[str, list], key: str) -> list:
        if key not in shown:
            had = self.lists.getValue((key,)) if self.lists.containsKey((key,)) else None
            shown[key] = [list(zip(had[0], had[1])), had[2]] if had is not None else [[], False]
        return shown[key]

    def _put_in(self, shown: dict[str, list], key: str, post: tuple) -> None:
        held = self._list(shown, key)
        held[0] = sorted([*held[0], post], reverse=True)
        if len(held[0]) > self.n:
            held[0], held[1] = held[0][:self.n], True

    def _take_out(self, shown: dict[str, list], short: set[str], key: str, post: tuple) -> None:
        held = self._list(shown, key)
        if post in held[0]:
            held[0].remove(post)
            if held[1]:
                short.add(key)

    def _refill(self, shown: dict[str, list], short: set[str]) -> None:
        """One pass over the shard's posts for all lists that lost a post and have more."""
        found: dict[str, list] = {k: [] for k in short}
        counts = dict.fromkeys(short, 0)
        for (oid,), (party, micros, _, deleted) in self.posts.iterator():
            if deleted:
                continue
            for k in {party, self.combined} & short:
                counts[k] += 1
                push = heapq.heappush if len(found[k]) < self.n else heapq.heappushpop
                push(found[k], (micros, oid))
        for k in short:
            shown[k] = [sorted(found[k], reverse=True), counts[k] > self.n]

    def close(self) -> None:
        pass


def latest_changes(changes: DataFrame, post_id: str = "event_id", n: int = LATEST_LIST_LENGTH, shards: int = SHARDS) -> DataFrame:
    """Streaming rows ``shard, key, ts, oid`` of the lists that changed, from
    ``changes(<post_id>, party, ts, seq, deleted)``. Of two changes of a post
    the one with the larger ``seq`` holds, in whatever order they come. Rows
    without an id, or new ones without party or time, are left out."""
    deleted = F.coalesce("deleted", F.lit(False))
    rows = changes.select(F.col(post_id).cast("long").alias("oid"), "party", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), F.col("seq").cast("long").alias("seq"),
                          deleted.alias("deleted")).where("oid is not null and seq is not null and (deleted or (party is not null and micros is not null))")
    sharded = rows.withColumn("shard", F.pmod(F.xxhash64("oid"), F.lit(shards)).cast("int"))
    lists = sharded.groupBy("shard").transformWithState(statefulProcessor=Posts(n), outputStructType=EMITTED, outputMode="Update", timeMode="None")
    return lists.select("shard", "key", F.timestamp_micros("micros").alias("ts"), "oid")


def _slot(spark: SparkSession, base: str, number: int) -> tuple[int, DataFrame] | None:
    """The batch whose lists a slot holds, and their rows."""
    try:
        rows = spark.read.parquet(f"{base}/slot={number}")
    except AnalysisException:
        return None
    newest = rows.agg(F.max("batch_id")).first()[0]
    return None if newest is None else (newest, rows.where("oid is not null").select("shard", "key", "ts", "oid"))


def start_changing_lists(changes: DataFrame, path: str, checkpoint: str, post_id: str = "event_id", n: int = LATEST_LIST_LENGTH,
                         shards: int = SHARDS, trigger: dict | None = None) -> StreamingQuery:
    """Keep the lists at ``path`` up with a stream of ``changes`` (see
    :func:`latest_changes`). The state store must be RocksDB; it is set for
    this query where the session has Spark's default."""
    base, spark = path.rstrip("/"), changes.sparkSession

    def put(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            before = _slot(batch.sparkSession, base, (batch_id - 1) % SLOTS)  # never the slot that is written
            rows = batch.where("oid is not null")
            if before is not None and before[0] < batch_id:
                rows = rows.unionByName(before[1].join(batch.select("shard", "key").distinct(), ["shard", "key"], "left_anti"))
            # a row without a post shows the batch's number, also where no list has posts
            mark = batch.sparkSession.range(1).selectExpr("-1 AS shard", "CAST(null AS string) AS key", "CAST(null AS timestamp) AS ts", "CAST(null AS long) AS oid")
            (rows.unionByName(mark).withColumn("batch_id", F.lit(batch_id).cast("long"))
             .write.mode("overwrite").parquet(f"{base}/slot={batch_id % SLOTS}"))
        finally:
            batch.unpersist()

    had = spark.conf.get(PROVIDER)
    if not had.endswith("RocksDBStateStoreProvider"):
        spark.conf.set(PROVIDER, ROCKSDB)
    try:
        writer = latest_changes(changes, post_id, n, shards).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"processingTime": "10 seconds"})).start()
    finally:
        spark.conf.set(PROVIDER, had)


def read_changing_lists(spark: SparkSession, path: str, n: int = LATEST_LIST_LENGTH) -> DataFrame:
    """``key, tweetIds`` (oldest first) of the newest batch: the shards' lists of each key, merged and cut."""
    slots = [s for s in (_slot(spark, path.rstrip("/"), k) for k in range(SLOTS)) if s is not None]
    if not slots:
        raise FileNotFoundError(f"no lists under {path}")
    rows = max(slots, key=lambda s: s[0])[1]
    return lists_from_rows(keep_newest(rows.select("key", "ts", "oid"), n))
