"""Calendar helpers: the "today" and "this month" of live routes, time windows
for scan pruning, and the day spine used by gap filling.

"Now" is an explicit ``as_of`` date argument, taken once per query, instead of
a wall-clock read per row.
"""

from __future__ import annotations

import calendar as _cal
import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

Window = tuple[dt.datetime, dt.datetime]


def as_date(as_of: dt.date | str | None) -> dt.date:
    """``as_of`` as a date; None is today in UTC, the zone that the session
    defaults pin, whatever the driver's own zone is."""
    if as_of is None:
        return dt.datetime.now(dt.timezone.utc).date()
    if isinstance(as_of, dt.datetime):
        return as_of.date()
    if isinstance(as_of, dt.date):
        return as_of
    return dt.date.fromisoformat(str(as_of))


def today_parts(as_of: dt.date | str | None) -> tuple[int, int, int]:
    d = as_date(as_of)
    return d.year, d.month, d.day


def month_parts(as_of: dt.date | str | None) -> tuple[int, int]:
    d = as_date(as_of)
    return d.year, d.month


def days_in_month(as_of: dt.date | str | None) -> int:
    d = as_date(as_of)
    return _cal.monthrange(d.year, d.month)[1]


def days_in_month_col(as_of: dt.date | str | None) -> Column:
    """Spark-side day count of the ``as_of`` month: ``dayofmonth(last_day(d))``."""
    return F.dayofmonth(F.last_day(F.lit(as_date(as_of))))


def day_spine(as_of: dt.date | str | None) -> Column:
    """Array of day numbers 1..last day of the ``as_of`` month (a generator input)."""
    return F.sequence(F.lit(1).cast("long"), days_in_month_col(as_of).cast("long"))


def year_window(year: int) -> Window:
    return dt.datetime(year, 1, 1), dt.datetime(year + 1, 1, 1)


def iso_year_window(year: int) -> Window:
    """From the Monday of week 1 to the one of the next year's: an ISO week-year
    begins and ends up to three days off the calendar year."""
    first = dt.datetime.fromisocalendar(year, 1, 1)
    return first, dt.datetime.fromisocalendar(year + 1, 1, 1)


def day_window(as_of: dt.date | str | None) -> Window:
    d = as_date(as_of)
    start = dt.datetime(d.year, d.month, d.day)
    return start, start + dt.timedelta(days=1)


def month_window(as_of: dt.date | str | None) -> Window:
    d = as_date(as_of)
    start = dt.datetime(d.year, d.month, 1)
    end = dt.datetime(d.year + (d.month == 12), d.month % 12 + 1, 1)
    return start, end


def day_windows(days: list[dt.date]) -> tuple[Window, ...]:
    """Days as half-open windows, days in a row as one."""
    out: list[Window] = []
    for d in sorted(set(days)):
        start = dt.datetime(d.year, d.month, d.day)
        if out and out[-1][1] == start:
            out[-1] = out[-1][0], start + dt.timedelta(days=1)
        else:
            out.append((start, start + dt.timedelta(days=1)))
    return tuple(out)


def each_window(window: Window | tuple[Window, ...]) -> tuple[Window, ...]:
    """One window, or several, as several."""
    return (window,) if isinstance(window[0], dt.datetime) else window


def in_window(ts: str | Column, window: Window | tuple[Window, ...] | None, ts_type: str = "timestamp_ntz") -> Column | None:
    """Half-open range predicate on a timestamp column (of any of several
    windows), in a form Parquet row group statistics can use (plain
    comparisons against literals).

    The bounds are wall-clock strings cast to ``ts_type``: for a
    ``timestamp_ntz`` column no time zone takes part, whatever the session or
    process zone is (a Python ``datetime`` literal would go through both)."""
    if window is None:
        return None
    c = F.col(ts) if isinstance(ts, str) else ts
    found = F.lit(False) if not window else None
    for one in each_window(window) if window else ():
        lo, hi = (F.lit(w.isoformat(sep=" ")).cast(ts_type) for w in one)
        inside = (c >= lo) & (c < hi)
        found = inside if found is None else found | inside
    return found
