"""Connected components of a links table, as DataFrame joins.

Alternating large-star and small-star rounds (Kiveris et al., 2014): every
node's links are rewired to the smallest id it can see until they are stars.
Each round is two grouped minima (combined before the shuffle) and two joins;
no neighbour list is gathered, and rounds are cut by written tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v")


def connected_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``(id, comp)`` for every id in ``links(u long, v long)``: the smallest
    id reachable from it. Links to oneself and repeated links change nothing;
    rows with a null id are ignored; no links give no rows."""
    edges = scratch.save(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                         .where("u <> v").distinct())
    state = _fingerprint(edges)
    while True:
        moved = scratch.save(_small_star(_large_star(edges)).distinct())
        after = _fingerprint(moved)
        scratch.drop(edges)
        edges = moved
        if after == state:
            break
        state = after
    out = edges.select(F.col("u").alias("id"), F.col("v").alias("comp"))
    return out.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct())


def _fingerprint(edges: DataFrame) -> tuple:
    """Count and an order-free sum over all links: equal only if the round changed nothing."""
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]
