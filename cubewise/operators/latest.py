"""Latest-items lists: one stored list per key (a party or ``combined``),
oldest first; served newest first, numbered from 1."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_items(lists: DataFrame, key: str, ids: str = "tweetIds") -> DataFrame:
    """``key, n, tweet_id`` for the list stored under ``key``; ``n = 1`` is the newest.

    The key filter is applied before the list is expanded; an absent key
    gives zero rows.
    """
    chosen = lists.where(F.col("key") == F.lit(key))
    exploded = chosen.select("key", F.posexplode(F.reverse(F.col(ids))).alias("pos", "tweet_id"))
    return exploded.select("key", (F.col("pos") + 1).cast("long").alias("n"), "tweet_id")
