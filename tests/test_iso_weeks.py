"""Weeks that belong to ISO week-years."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from cubewise.functions.calendar import iso_year_window
from cubewise.plans.bindings import StoredCubes, TableCubes, build_all
from cubewise.plans.registry import route_specs
from tests.conftest import SF_SMALL, rows
from tests.test_facts_and_versions import moved_and_removed, rounded, tables

WEEKS = [s for s in route_specs() if "week" in s.shape]


def test_the_last_days_of_december_are_in_week_1_of_the_next_year(spark):
    assert dt.date(1997, 12, 30).isocalendar()[:2] == (1998, 1)
    assert iso_year_window(1998) == (dt.datetime(1997, 12, 29), dt.datetime(1999, 1, 4))
    iso = TableCubes(spark, SF_SMALL, weeks="iso")
    days = iso.orders(None).groupBy(F.to_date("ts").alias("date"), "party").count().collect()
    want = {}
    for r in days:
        y, w, _ = r.date.isocalendar()
        want[r.party, y, w] = want.get((r.party, y, w), 0.0) + r["count"]
    assert any(r.date.year != r.date.isocalendar().year for r in days)
    assert {(r.party, r.year, r.week): r["count"] for r in iso.cube("countTotal", "week").collect()} == want
    # one year's route reads the days of that week-year, from both calendar years
    spec = next(s for s in WEEKS if s.key == "countTweetByMonth__year_week")
    assert sum(r.value for r in spec.run(iso).collect()) == sum(n for (_, y, _), n in want.items() if y == 1997)
    p = spec.run(iso)._jdf.queryExecution().executedPlan().toString()
    assert "1996-12-30" in p and "1997-12-29" in p
    with pytest.raises(ValueError):
        TableCubes(spark, SF_SMALL, weeks="other")


def test_stored_iso_weeks_follow_changes(spark, scratch):
    """Published cubes, a build since a day and one of changed days: as derived from the raw tables."""
    raw = TableCubes(spark, SF_SMALL, weeks="iso")
    root = os.path.join(scratch, "cubes")
    build_all(raw, root)
    stored = StoredCubes(spark, root)
    for spec in WEEKS:
        assert rounded(spec.run(stored)) == rounded(spec.run(raw)), spec.key
    with pytest.raises(ValueError, match="weeks"):
        build_all(TableCubes(spark, SF_SMALL), root, since=dt.date(1998, 1, 1))
    after_orders, after_lines, *_ = moved_and_removed()
    changed = TableCubes(spark, tables(os.path.join(scratch, "changed"), orders=after_orders, lineitem=after_lines), weeks="iso")
    days = [r[0] for one in (raw, changed) for r in one.orders(None).where("year(ts) in (1996, 1998)").select(F.to_date("ts")).distinct().collect()]
    build_all(changed, root, days=days)
    want = {s.key: rounded(s.run(changed)) for s in WEEKS}
    assert {s.key: rounded(s.run(stored)) for s in WEEKS} == want
    assert rows(stored.cube("countTotal", "week")) == rows(changed.cube("countTotal", "week"))
    again = os.path.join(scratch, "since")
    build_all(raw, again)
    build_all(changed, again, since=dt.date(1996, 6, 1))
    assert rows(StoredCubes(spark, again).cube("countTotal", "week")) == rows(changed.cube("countTotal", "week"))
    assert rounded(StoredCubes(spark, again).cube("avgLikes", "week")) == rounded(changed.cube("avgLikes", "week"))
