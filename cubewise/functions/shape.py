"""Output shaping: long results to nested maps and JSON documents.

Query results are long frames (one row per key combination). Callers that
want the nested document shape use :func:`to_nested_json`, which folds the
key columns into maps level by level with Spark aggregates and yields one
JSON document per top-level key. Every inner map is bounded by the query
(N items, at most 31 days, 53 weeks, 12 months or the years present), so no
level gathers an unbounded group; the top level stays one row per key and is
written out in parallel (``df.write.text``), never through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pad2(c: str | Column) -> Column:
    """Two-digit zero padding of a month or week number ("03", "11")."""
    col = F.col(c) if isinstance(c, str) else c
    return F.lpad(col.cast("string"), 2, "0")


def nest_maps(df: DataFrame, keys: list[str], value: str | Column, pad: tuple[str, ...] = ()) -> DataFrame:
    """Fold ``keys[1:]`` into nested maps around ``value``: one row per
    ``keys[0]`` with the nested map in column ``_v``. Keys listed in ``pad``
    are written with two digits. A row whose innermost key and value are both
    null (an empty-filled day) gives an empty map at that level; a null key
    that has a value is an error (``NULL_MAP_KEY``), never left out: see
    ``sources.cubes.known_keys`` for dropping such rows on purpose."""
    val = F.col(value) if isinstance(value, str) else value
    key_cols = {k: (pad2(k) if k in pad else F.col(k).cast("string")) for k in keys}
    cur = df.select(*[key_cols[k].alias(k) for k in keys], val.alias("_v"))
    for i in range(len(keys) - 1, 0, -1):
        outer, inner = keys[:i], keys[i]
        entry = F.when(F.col(inner).isNotNull() | F.col("_v").isNotNull(), F.struct(F.col(inner), F.col("_v")))
        cur = cur.groupBy(*outer).agg(
            F.map_from_entries(F.filter(F.collect_list(entry), lambda e: e.isNotNull())).alias("_v"))
    return cur


def to_nested_json(df: DataFrame, keys: list[str], value: str | Column, pad: tuple[str, ...] = (),
                   wrap: bool = True) -> DataFrame:
    """Nested JSON documents, one row ``(key, json)`` per value of ``keys[0]``.

    With ``wrap`` the document is ``{"<key>": {...}}``; without it, just the
    inner object (for results already restricted to one key).
    """
    if not keys:
        raise ValueError("need at least one key")
    top = keys[0]
    cur = nest_maps(df, keys, value, pad)
    doc = F.create_map(F.col(top), F.col("_v")) if wrap else F.col("_v")
    return cur.select(F.col(top).alias("key"), F.to_json(doc).alias("json"))


def to_ordered_pairs_json(df: DataFrame, keys: list[str], value: str | Column) -> DataFrame:
    """``[{"<k1>": {...}}, ...]`` per value of ``keys[0]``: the entries of the
    second key as single-key objects in ascending numeric order (a list of
    pairs rather than one object). The list is bounded by the number of
    periods."""
    if len(keys) < 2:
        raise ValueError("need a top key and a listed key")
    top = keys[0]
    cur = nest_maps(df, keys, value)
    numbered = F.transform(F.map_keys("_v"), lambda k: F.struct(k.cast("long").alias("n"), k.alias("k")))
    pairs = F.transform(F.sort_array(numbered), lambda e: F.create_map(e["k"], F.col("_v")[e["k"]]))
    return cur.select(F.col(top).alias("key"), F.to_json(pairs).alias("json"))


def entries_json(df: DataFrame, key: str, value: str | Column) -> DataFrame:
    """A one-level object ``{key: value}`` per row, e.g. ``{"CDU": 12.0}``."""
    val = F.col(value) if isinstance(value, str) else value
    return df.select(F.col(key).cast("string").alias("key"),
                     F.to_json(F.create_map(F.col(key).cast("string"), val)).alias("json"))
