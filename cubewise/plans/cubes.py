"""Batch cube builders (the feed jobs behind the served collections).

Input is a "posts" frame: ``party`` (string), ``ts`` (timestamp) and any
per-post columns. Every builder is one ``groupBy().agg()``: Spark computes a
partial aggregate in each map task and shuffles only partial rows, so a party
holding a third of all posts is pre-reduced before the exchange.

Key types: periods are ``bigint`` (calendar year; ISO week of the calendar
year, so late-December days can fall in week 1 and early-January days in week
52/53 of the same year; with ISO week-years, both from that calendar), items
are ``string``, measures ``double``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..catalog import COMBINED_KEY, LATEST_LIST_LENGTH


#: Grain of weeks that belong to ISO week-years: 30 December 1997 is in week 1 of 1998.
ISO_WEEK = "isoweek"
#: Whether a week belongs to the calendar year of its days, or whole to its ISO week-year.
CALENDAR, ISO = "calendar", "iso"


def week_grain(grain: str | None, weeks: str) -> str | None:
    """The grain that a cube source with such weeks groups by."""
    if weeks not in (CALENDAR, ISO):
        raise ValueError(f"weeks must be {CALENDAR!r} or {ISO!r}")
    return ISO_WEEK if grain == "week" and weeks == ISO else grain


def period_keys(grain: str, ts: str = "ts") -> list[Column]:
    if grain == ISO_WEEK:
        return [F.extract(F.lit("YEAROFWEEK"), F.col(ts)).cast("long").alias("year"), F.weekofyear(ts).cast("long").alias("week")]
    keys = [F.year(ts).cast("long").alias("year")]
    if grain == "month":
        keys.append(F.month(ts).cast("long").alias("month"))
    elif grain == "week":
        keys.append(F.weekofyear(ts).cast("long").alias("week"))
    elif grain != "year":
        raise ValueError(f"unknown grain {grain!r}")
    return keys


def hour_keys(ts: str = "ts") -> list[Column]:
    return [F.year(ts).cast("long").alias("year"), F.month(ts).cast("long").alias("month"),
            F.dayofmonth(ts).cast("long").alias("day"), F.hour(ts).cast("long").alias("hour")]


def measure_cube(posts: DataFrame, grain: str, measure: Column, name: str = "count") -> DataFrame:
    """One value per (party, period): ``measure`` is any aggregate expression."""
    return posts.groupBy(F.col("party"), *period_keys(grain)).agg(measure.cast("double").alias(name))


def one_row_per_item(posts: DataFrame, item: Column) -> tuple[DataFrame, Column]:
    """``posts`` and ``item`` as they are, or, where ``item`` is an array (a
    post's hashtags, say), one row for each entry. Null and empty arrays have
    no row; an entry that a post repeats counts each time."""
    if isinstance(posts.select(item.alias("item")).schema["item"].dataType, ArrayType):
        return posts.withColumn("_item", F.explode(item)), F.col("_item")
    return posts, item


def item_cube(posts: DataFrame, grain: str, item: Column, item_name: str, weight: Column | None = None) -> DataFrame:
    """Post count (or summed ``weight``) per (party, period, item); ``item``
    may be an array of items."""
    posts, item = one_row_per_item(posts, item)
    agg = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return (posts.groupBy(F.col("party"), *period_keys(grain), item.cast("string").alias(item_name))
            .agg(agg.cast("double").alias("count")))


def hourly_cube(posts: DataFrame, measure: Column, name: str = "count") -> DataFrame:
    """One value per (party, year, month, day, hour)."""
    return posts.groupBy(F.col("party"), *hour_keys()).agg(measure.cast("double").alias(name))


def hourly_item_cube(posts: DataFrame, item: Column, item_name: str) -> DataFrame:
    """Post count per (party, year, month, day, hour, item); ``item`` may be an array."""
    posts, item = one_row_per_item(posts, item)
    return (posts.groupBy(F.col("party"), *hour_keys(), item.cast("string").alias(item_name))
            .agg(F.count(F.lit(1)).cast("double").alias("count")))


def newest_rows(posts: DataFrame, post_id: str, n: int = LATEST_LIST_LENGTH,
                combined: str = COMBINED_KEY) -> DataFrame:
    """``key, ts, oid``: the newest ``n`` posts per party and over all parties.

    Per party this is a ``row_number() <= n`` window (partial group limit
    before the shuffle); the combined list is a global top-n
    (``orderBy().limit()``, planned as a per-partition top-n plus a merge of n
    rows per partition), so the key holding every post never becomes one group.
    """
    rows = posts.select(F.col("party").alias("key"), F.col("ts"), F.col(post_id).alias("oid"))
    overall = rows.orderBy(F.col("ts").desc(), F.col("oid").desc()).limit(n).withColumn("key", F.lit(combined))
    return keep_newest(rows, n).unionByName(overall)


def keep_newest(rows: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` of ``key, ts, oid`` rows per key."""
    w = Window.partitionBy("key").orderBy(F.col("ts").desc(), F.col("oid").desc())
    return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def lists_from_rows(rows: DataFrame) -> DataFrame:
    """``key, tweetIds`` with ids oldest first; at most n rows per key are gathered."""
    oldest_first = F.sort_array(F.collect_list(F.struct("ts", "oid")))
    return rows.groupBy("key").agg(F.transform(oldest_first, lambda e: e["oid"].cast("string")).alias("tweetIds"))


def latest_lists(posts: DataFrame, post_id: str, n: int = LATEST_LIST_LENGTH,
                 combined: str = COMBINED_KEY) -> DataFrame:
    """The ``n`` newest post ids per party and over all parties (key ``combined``):
    ``key, tweetIds``, oldest first."""
    return lists_from_rows(newest_rows(posts, post_id, n, combined))
