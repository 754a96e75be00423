"""Live routes over hourly cubes: today's totals, means and leaders, and
calendar-filled daily series for the current month.

Inputs are flat hourly cubes ``party, year, month, day[, hour][, <item>],
<measure>``. "Today" and "this month" come from one ``as_of`` date per
query; the predicates are plain equalities on the cube's key columns, so a
cube stored partitioned by (year, month, day) prunes to the files of the day
or month.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import month_parts, today_parts
from ..functions.numbers import stable_round
from .fill import empty_fill_days, zero_fill_days
from .history import item_totals
from .topn import leader, top_n


def _where(cube: DataFrame, cond, party: str | None) -> DataFrame:
    return cube.where(cond if party is None else cond & (F.col("party") == F.lit(party)))


def on_day(cube: DataFrame, as_of: dt.date | str | None, party: str | None = None) -> DataFrame:
    """Rows of the ``as_of`` day (of one party if given)."""
    y, m, d = today_parts(as_of)
    return _where(cube, (F.col("year") == y) & (F.col("month") == m) & (F.col("day") == d), party)


def in_month(cube: DataFrame, as_of: dt.date | str | None, party: str | None = None) -> DataFrame:
    """Rows of the ``as_of`` month (of one party if given)."""
    y, m = month_parts(as_of)
    return _where(cube, (F.col("year") == y) & (F.col("month") == m), party)


def _round(c, digits: int | None):
    return c if digits is None else stable_round(c, digits)


def day_total(cube: DataFrame, as_of: dt.date | str | None, measure: str = "count",
              party: str | None = None) -> DataFrame:
    """Sum of the measure over today's hours, per party: ``party, total``.

    Summing hour totals and then the hours equals one sum (associativity), so
    a single partial + final aggregate does it.
    """
    today = on_day(cube, as_of, party)
    return today.groupBy("party").agg(F.sum(F.col(measure).cast("double")).alias("total"))


def day_mean(cube: DataFrame, as_of: dt.date | str | None, measure: str = "sentiment",
             party: str | None = None, digits: int | None = None) -> DataFrame:
    """Unweighted mean of today's cube rows, per party: ``party, mean``."""
    today = on_day(cube, as_of, party)
    return today.groupBy("party").agg(_round(F.avg(F.col(measure).cast("double")), digits).alias("mean"))


def month_by_day(cube: DataFrame, as_of: dt.date | str | None, measure: str = "count", how: str = "sum",
                 party: str | None = None, digits: int | None = None, flag_filled: bool = False) -> DataFrame:
    """Daily sums (``how="sum"``, column ``total``) or unweighted daily means of
    the cube rows (``how="mean"``, column ``mean``) for every day of the month,
    0.0 where a day has no row: ``[party,] day, total|mean``. With
    ``flag_filled`` a boolean ``filled`` column marks those days (a filled 0.0
    mean is otherwise indistinguishable from a neutral one)."""
    if how not in ("sum", "mean"):
        raise ValueError("how must be 'sum' or 'mean'")
    name = "total" if how == "sum" else "mean"
    agg = F.sum if how == "sum" else F.avg
    month = in_month(cube, as_of, party)
    daily = month.groupBy("party", "day").agg(agg(F.col(measure).cast("double")).alias(name))
    filled = zero_fill_days(daily, name, as_of, flag=flag_filled)
    value = _round(F.col(name), digits) if how == "mean" else F.col(name)
    cols = [] if party is not None else [F.col("party")]
    return filled.select(*cols, "day", value.alias(name), *(["filled"] if flag_filled else []))


def day_leader(cube: DataFrame, item: str, as_of: dt.date | str | None, party: str | None = None,
               measure: str = "count") -> DataFrame:
    """Today's item with the largest summed measure, per party: ``party, <item>``."""
    today = on_day(cube, as_of, party)
    return leader(item_totals(today, item, ["party"], measure), ["party"], item, "total")


def month_top_items(cube: DataFrame, item: str, as_of: dt.date | str | None, n: int = 10,
                    party: str | None = None, measure: str = "count") -> DataFrame:
    """Top ``n`` items per (party, day) this month; a day without rows gets one
    row with null item and total: ``[party,] day, <item>, total``."""
    month = in_month(cube, as_of, party)
    totals = item_totals(month, item, ["party", "day"], measure)
    best = top_n(totals, ["party", "day"], "total", item, n).drop("rank")
    filled = empty_fill_days(best, item, "total", as_of)
    cols = [] if party is not None else [F.col("party")]
    return filled.select(*cols, "day", item, "total")
