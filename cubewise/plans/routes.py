"""Routes as function calls: ``answer(cubes, family, shape, ...)``.

A route of the original service is a family (which cube, which answer
group) plus a shape (which parameters). This module picks the cube and the
operator; the returned frame is lazy and nothing is collected.

Shapes: ``all``, ``party``, ``year_month``, ``year_week``,
``year_month_party``, ``year_week_party``, ``legislatur`` (historic);
``day``, ``day_party``, ``month``, ``month_party`` (live); ``all``,
``party`` (latest lists).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import (COMBINED_KEY, COUNT, LATEST, LIVE_ITEMS, LIVE_MEAN, LIVE_MONTH_TOP_N, LIVE_SUM, RANKED,
                       UNRANKED, check_party, family)
from ..functions.calendar import day_window, iso_year_window, month_window, year_window
from ..operators.history import all_time_top_items, period_values, top_items
from ..operators.latest import latest_items
from ..operators.live import day_leader, day_mean, day_total, month_by_day, month_top_items
from .bindings import CubeSource
from .cubes import CALENDAR, ISO


def historic_shape(shape: str) -> tuple[str, bool, bool]:
    """(grain, needs a year, needs a party) of a historic shape."""
    table = {
        "all": ("year", False, False),
        "party": ("year", False, True),
        "year_month": ("month", True, False),
        "year_week": ("week", True, False),
        "year_month_party": ("month", True, True),
        "year_week_party": ("week", True, True),
        "legislatur": ("year", False, False),
    }
    return table[shape]


ORDER_KEYS = ("party", "key", "year", "month", "week", "day", "rank", "n")


def in_route_order(df: DataFrame) -> DataFrame:
    """Sort a long answer the way the original service lists it: party as a
    string, then periods and ranks as numbers (so month 2 precedes 10), then
    items by descending total."""
    cols = [F.col(c).asc() for c in ORDER_KEYS if c in df.columns]
    for value in ("total", "value", "mean"):
        if value in df.columns:
            cols.append(F.col(value).desc())
    cols += [F.col(c).asc() for c in df.columns if c not in ORDER_KEYS and c not in ("total", "value", "mean")]
    return df.orderBy(*cols)


def answer(cubes: CubeSource, family_name: str, shape: str, *, year: int | None = None, party: str | None = None,
           as_of: dt.date | str | None = None, allowed_parties: tuple[str, ...] | None = None,
           ordered: bool = False, digits: int | None = None) -> DataFrame:
    """The long-format answer of one route over ``cubes`` (TableCubes or StoredCubes).

    ``ordered`` sorts the (small) answer with :func:`in_route_order`; leave it
    off when the consumer does not need an order, as a sort adds a range
    exchange. ``allowed_parties`` restricts one-party routes to a list (for
    the original data set, ``catalog.PARTIES``). Values and means are given
    as they are; ``digits`` rounds them, for comparing engines.
    """
    df = _answer(cubes, family_name, shape, year=year, party=party, as_of=as_of,
                 allowed_parties=allowed_parties, digits=digits)
    return in_route_order(df) if ordered else df


def _days(cubes: CubeSource, collection: str) -> DataFrame | None:
    """Day rows of an hourly cube, where the source keeps them: month routes
    sum by day, so they need no hours. (Live means weigh each hour alike.)"""
    by_day = getattr(cubes, "by_day", None)
    return by_day(collection) if by_day else None


def _answer(cubes: CubeSource, family_name: str, shape: str, *, year: int | None, party: str | None,
            as_of: dt.date | str | None, allowed_parties: tuple[str, ...] | None, digits: int | None) -> DataFrame:
    fam = family(family_name)
    if shape not in fam.shapes:
        raise ValueError(f"{family_name} has shapes {fam.shapes}, not {shape!r}")
    one_party = shape.endswith("party")
    if one_party:
        if party is None:
            raise ValueError(f"shape {shape!r} needs a party")
        check_party(party, allowed_parties)
    who = party if one_party else None

    if fam.group in (COUNT, RANKED, UNRANKED):
        grain, needs_year, _ = historic_shape(shape)
        if needs_year and year is None:
            raise ValueError(f"shape {shape!r} needs a year")
        when = year if needs_year else None
        iso = grain == "week" and getattr(cubes, "weeks", CALENDAR) == ISO
        window = (iso_year_window(year) if iso else year_window(year)) if needs_year else None
        cube = cubes.cube(fam.cube, grain, window)
        if fam.group == COUNT:
            return period_values(cube, grain, when, who, measure=fam.measure, digits=digits)
        if shape == "legislatur":
            return all_time_top_items(cube, fam.item, fam.n, measure=fam.measure)
        return top_items(cube, fam.item, grain, fam.n, when, who, ranked=fam.group == RANKED,
                         measure=fam.measure)

    if fam.group in (LIVE_SUM, LIVE_MEAN, LIVE_ITEMS):
        by_day = shape.startswith("day")
        cube = None if by_day or fam.group == LIVE_MEAN else _days(cubes, fam.cube)
        if cube is None:
            cube = cubes.cube(fam.cube, None, day_window(as_of) if by_day else month_window(as_of))
        if fam.group == LIVE_SUM:
            return day_total(cube, as_of, fam.measure, who) if by_day else \
                month_by_day(cube, as_of, fam.measure, "sum", who)
        if fam.group == LIVE_MEAN:
            return day_mean(cube, as_of, fam.measure, who, digits) if by_day else \
                month_by_day(cube, as_of, fam.measure, "mean", who, digits)
        return day_leader(cube, fam.item, as_of, who) if by_day else \
            month_top_items(cube, fam.item, as_of, LIVE_MONTH_TOP_N, who)

    if fam.group == LATEST:
        lists = cubes.cube(fam.cube)
        if "_id" in lists.columns:
            lists = lists.withColumnRenamed("_id", "key")
        return latest_items(lists, who if one_party else COMBINED_KEY, ids=fam.measure)

    raise AssertionError(fam.group)
