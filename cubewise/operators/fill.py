"""Calendar gap filling for the live month routes.

Both fills cover days 1..last day of the ``as_of`` month for every party that
has at least one row that month; parties without rows are not added.

The spine is generated per party with ``explode(sequence(...))`` (no cross
join, no broadcast of anything that grows with the data). Per party, the
state gathered is at most one entry per day of one month (<= 31), a bound set
by the month filter, not by the data volume.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import day_spine


def zero_fill_days(daily: DataFrame, value: str, as_of: dt.date | str, fill: float = 0.0, party: str = "party",
                   flag: bool = False) -> DataFrame:
    """``daily`` has one row per (party, day) of one month; return one row per
    party and day of the month, with ``fill`` where a day has no row (and, with
    ``flag``, a boolean ``filled`` telling such days apart)."""
    per_party = daily.groupBy(party).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("day").cast("long"), F.col(value)))).alias("_by_day"))
    spine = per_party.select(party, "_by_day", F.explode(day_spine(as_of)).alias("day"))
    found = F.col("_by_day")[F.col("day")]
    cols = [party, "day", F.coalesce(found, F.lit(fill).cast("double")).alias(value)]
    if flag:
        cols.append((~F.map_contains_key(F.col("_by_day"), F.col("day"))).alias("filled"))
    return spine.select(*cols)


def empty_fill_days(rows: DataFrame, item: str, value: str, as_of: dt.date | str, party: str = "party") -> DataFrame:
    """``rows`` has any number of (party, day, item, value) rows; add one row
    with null item and value for each day of the month a party has no row.

    One pass, no second branch over ``rows``: a window over the party gives
    every row its party's set of days (the rows of one party are at most the
    per-day top-N times 31 days), and the party's first row also emits the
    missing days through the same ``explode``."""
    day = F.col("day").cast("long")
    tagged = rows.select(
        party, day.alias("day"), item, value,
        F.collect_set(day).over(Window.partitionBy(party)).alias("_days"),
        F.row_number().over(Window.partitionBy(party).orderBy(day, F.col(item))).alias("_first"))
    own = F.array(F.struct(F.col("day"), F.col(item), F.col(value)))
    missing = F.transform(
        F.filter(day_spine(as_of), lambda d: ~F.array_contains(F.col("_days"), d)),
        lambda d: F.struct(d.alias("day"), F.lit(None).cast("string").alias(item),
                           F.lit(None).cast("double").alias(value)))
    entries = F.when(F.col("_first") == 1, F.concat(own, missing)).otherwise(own)
    return tagged.select(party, F.explode(entries).alias("_r")).select(
        party, F.col("_r.day").alias("day"), F.col(f"_r.{item}").alias(item), F.col(f"_r.{value}").alias(value))
