"""Route answers as the nested JSON documents the original service returns.

``route_json`` shapes the long answer of a route. An all-party answer is a
list with one object per party; it is returned as one row per party
(``key``, ``json``), ordered by ``key`` when sorted, so the list is written
in parallel (for example ``df.write.text``) rather than assembled in one
place. A one-party answer is a single row.

Shape rules kept from the original: months and weeks are two-digit keys in
value-per-period answers and plain numbers in item answers; ranked items are
``rank -> {item: total}``; one-party item answers are an ordered list of
``{period: ...}`` objects; empty-filled days are ``{}``; latest lists are
``n -> id``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import COUNT, LATEST, LIVE_ITEMS, LIVE_MEAN, LIVE_SUM, RANKED, UNRANKED, family
from ..functions.shape import entries_json, to_nested_json, to_ordered_pairs_json
from .bindings import CubeSource
from .routes import answer, historic_shape


def shape_json(df: DataFrame, family_name: str, shape: str, party: str | None = None) -> DataFrame:
    fam = family(family_name)
    one = shape.endswith("party")
    if one:
        df = df.withColumn("party", F.lit(party))
    if fam.group == LATEST:
        return to_nested_json(df, ["key", "n"], "tweet_id")
    if fam.group in (LIVE_SUM, LIVE_MEAN, LIVE_ITEMS):
        value = {LIVE_SUM: "total", LIVE_MEAN: "mean", LIVE_ITEMS: fam.item}[fam.group]
        if shape.startswith("day"):
            return entries_json(df, "party", value)
        if fam.group == LIVE_ITEMS:
            return to_nested_json(df, ["party", "day", fam.item], "total", wrap=not one)
        return to_nested_json(df, ["party", "day"], value, wrap=not one)
    grain, _, _ = historic_shape(shape)
    if fam.group == COUNT:
        return to_nested_json(df, ["party", grain], "value", pad=(grain,) if grain != "year" else (), wrap=not one)
    item_value = F.create_map(fam.item, "total")
    if shape == "legislatur":
        return to_nested_json(df, ["party", fam.item], "total")
    if fam.group == RANKED:
        keys, value = ["party", grain, "rank"], item_value
    else:
        keys, value = ["party", grain, fam.item], F.col("total")
    if one:
        return to_ordered_pairs_json(df, keys, value)
    return to_nested_json(df, keys, value)


def route_json(cubes: CubeSource, family_name: str, shape: str, *, year: int | None = None, party: str | None = None,
               as_of: dt.date | str | None = None, ordered: bool = False,
               allowed_parties: tuple[str, ...] | None = None, digits: int | None = None) -> DataFrame:
    """``(key, json)`` rows of one route, in the original service's document
    shape; ``ordered`` sorts the documents by key (parties as strings).
    ``allowed_parties`` restricts one-party routes to a list; values are
    written as they are unless ``digits`` rounds them."""
    df = answer(cubes, family_name, shape, year=year, party=party, as_of=as_of, allowed_parties=allowed_parties,
                digits=digits)
    docs = shape_json(df, family_name, shape, party)
    return docs.orderBy("key") if ordered else docs


def document_keys(family_name: str, shape: str) -> list[str]:
    """The key columns of a route's documents, outermost first."""
    fam = family(family_name)
    top = [] if shape.endswith("party") else ["party"]
    if fam.group == LATEST:
        return ["key", "n"]
    if shape == "legislatur":
        return ["party", fam.item]
    if fam.group in (LIVE_SUM, LIVE_MEAN, LIVE_ITEMS):
        if shape.startswith("day"):
            return ["party"]
        return [*top, "day", *([fam.item] if fam.group == LIVE_ITEMS else [])]
    grain, _, _ = historic_shape(shape)
    inner = {COUNT: [], RANKED: ["rank", fam.item]}.get(fam.group, [fam.item])
    return [*top, grain, *inner]


def document_rows(docs: DataFrame, family_name: str, shape: str) -> DataFrame:
    """The content of a route's JSON documents, parsed back: one row for each
    innermost entry, its keys from the outside in (``k1``, ``k2``, ...; text)
    and its ``value`` (text for ids and leading items, else a number). An
    empty object gives one row without the inner keys."""
    fam = family(family_name)
    depth = len(document_keys(family_name, shape))
    text = fam.group == LATEST or (fam.group == LIVE_ITEMS and shape.startswith("day"))
    kind = "string" if text else "double"
    for _ in range(depth):
        kind = f"map<string,{kind}>"
    listed = shape.endswith("party") and fam.group in (RANKED, UNRANKED)
    if listed:
        cur = docs.select(F.explode(F.from_json("json", f"array<{kind}>")).alias("_m"))
    else:
        cur = docs.select(F.from_json("json", kind).alias("_m"))
    names: list[str] = []
    for level in range(1, depth + 1):
        cur = cur.select(*names, F.explode_outer("_m").alias(f"k{level}", "_m"))
        names.append(f"k{level}")
    return cur.withColumnRenamed("_m", "value")
