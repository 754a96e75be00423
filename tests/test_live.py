"""Live routes on small literal hourly cubes."""

import datetime as dt

import pytest

from cubewise.operators.live import day_leader, day_mean, day_total, month_by_day, month_top_items
from tests.conftest import rows

HOURLY = "party string, year bigint, month bigint, day bigint, hour bigint, count double"
MEAN = "party string, year bigint, month bigint, day bigint, hour bigint, sentiment double"
ITEMS = "party string, year bigint, month bigint, day bigint, hour bigint, source string, count double"


def test_day_total_sums_all_hours_of_today_only(spark):
    cube = spark.createDataFrame(
        [("CDU", 2024, 1, 15, 0, 2.0), ("CDU", 2024, 1, 15, 5, 3.0), ("CDU", 2024, 1, 14, 5, 100.0),
         ("SPD", 2024, 1, 15, 1, 1.0)], HOURLY)
    assert rows(day_total(cube, dt.date(2024, 1, 15))) == [("CDU", 5.0), ("SPD", 1.0)]
    one = day_total(cube, "2024-01-15", party="SPD")
    assert one.columns == ["party", "total"] and rows(one) == [("SPD", 1.0)]


def test_missing_party_gives_zero_rows(spark):
    cube = spark.createDataFrame([("CDU", 2024, 1, 15, 0, 2.0)], HOURLY)
    assert day_total(cube, "2024-01-15", party="SPD").count() == 0
    assert month_by_day(cube, "2024-01-15", party="SPD").count() == 0


@pytest.mark.parametrize("as_of,days", [("2023-02-10", 28), ("2024-02-10", 29), ("2024-04-30", 30),
                                        ("2024-01-01", 31)])
def test_zero_fill_covers_the_whole_month(spark, as_of, days):
    d = dt.date.fromisoformat(as_of)
    cube = spark.createDataFrame([("CDU", d.year, d.month, 1, 0, 4.0), ("CDU", d.year, d.month, 1, 1, 1.0)], HOURLY)
    out = month_by_day(cube, as_of)
    got = rows(out)
    assert len(got) == days
    assert got[0] == ("CDU", 1, 5.0)
    assert all(v == 0.0 for _, _, v in got[1:])
    assert [r.day for r in out.orderBy("day").collect()] == list(range(1, days + 1))


def test_month_fill_adds_no_party_without_rows(spark):
    cube = spark.createDataFrame([("CDU", 2024, 1, 3, 0, 1.0), ("SPD", 2023, 12, 3, 0, 1.0)], HOURLY)
    out = month_by_day(cube, "2024-01-20")
    assert {r.party for r in out.collect()} == {"CDU"}


def test_means_are_unweighted_over_cube_rows(spark):
    # hour 0 is the mean of many posts, hour 1 of one; the day mean ignores that
    cube = spark.createDataFrame(
        [("CDU", 2024, 1, 15, 0, 1.0), ("CDU", 2024, 1, 15, 1, 0.0), ("CDU", 2024, 1, 16, 0, 0.5)], MEAN)
    assert rows(day_mean(cube, "2024-01-15")) == [("CDU", 0.5)]
    month = month_by_day(cube, "2024-01-15", measure="sentiment", how="mean", party="CDU")
    assert month.columns == ["day", "mean"]
    got = dict(rows(month))
    assert got[15] == 0.5 and got[16] == 0.5 and got[1] == 0.0 and len(got) == 31


def test_day_leader_takes_largest_total_then_smallest_item(spark):
    cube = spark.createDataFrame(
        [("CDU", 2024, 1, 15, 0, "web", 2.0), ("CDU", 2024, 1, 15, 1, "app", 1.0),
         ("CDU", 2024, 1, 15, 2, "app", 1.0), ("SPD", 2024, 1, 15, 0, "z", 3.0), ("SPD", 2024, 1, 15, 1, "y", 3.0)],
        ITEMS)
    assert rows(day_leader(cube, "source", "2024-01-15")) == [("CDU", "app"), ("SPD", "y")]


def test_month_top_items_limits_and_empty_fills(spark):
    data = [("CDU", 2024, 1, 2, h, f"s{h}", float(h)) for h in range(12)]
    cube = spark.createDataFrame(data, ITEMS)
    out = month_top_items(cube, "source", "2024-01-31", n=10)
    assert out.columns == ["party", "day", "source", "total"]
    got = rows(out.where("day = 2"), "source", "total")
    assert len(got) == 10 and ("s0", 0.0) not in got and ("s11", 11.0) in got
    empty = out.where("day != 2").collect()
    assert len(empty) == 30 and all(r.source is None and r.total is None for r in empty)
    one = month_top_items(cube, "source", "2024-01-31", n=3, party="CDU")
    assert one.columns == ["day", "source", "total"] and one.count() == 3 + 30


def test_filled_days_can_be_flagged(spark):
    cube = spark.createDataFrame([("CDU", 2024, 1, 3, 0, 0.0), ("CDU", 2024, 1, 4, 0, 0.5)], MEAN)
    out = month_by_day(cube, "2024-01-15", measure="sentiment", how="mean", flag_filled=True)
    assert out.columns == ["party", "day", "mean", "filled"]
    got = {r.day: (r.mean, r.filled) for r in out.collect()}
    assert got[3] == (0.0, False) and got[4] == (0.5, False) and got[5] == (0.0, True) and len(got) == 31
    assert month_by_day(cube, "2024-01-15", measure="sentiment", how="mean").columns == ["party", "day", "mean"]
