"""Calendar helpers: windows, month lengths, spines."""

import datetime as dt

from cubewise.functions.calendar import (day_spine, day_window, days_in_month, in_window, month_window,
                                         today_parts, year_window)


def test_windows_are_half_open_and_cross_boundaries():
    assert year_window(1997) == (dt.datetime(1997, 1, 1), dt.datetime(1998, 1, 1))
    assert month_window("2023-12-31") == (dt.datetime(2023, 12, 1), dt.datetime(2024, 1, 1))
    assert month_window(dt.date(2024, 2, 10)) == (dt.datetime(2024, 2, 1), dt.datetime(2024, 3, 1))
    assert day_window("2024-02-29") == (dt.datetime(2024, 2, 29), dt.datetime(2024, 3, 1))
    assert today_parts("2024-01-15") == (2024, 1, 15)


def test_month_lengths():
    assert [days_in_month(f"2024-{m:02d}-01") for m in (1, 2, 4, 12)] == [31, 29, 30, 31]
    assert days_in_month("2023-02-01") == 28


def test_spine_and_window_predicate_in_spark(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 2, 29, 23, 59),), (dt.datetime(2024, 3, 1, 0, 0),)], "ts timestamp_ntz")
    assert df.where(in_window("ts", day_window("2024-02-29"))).count() == 1
    spine = spark.range(1).select(day_spine("2024-02-10").alias("d")).first().d
    assert spine == list(range(1, 30))
