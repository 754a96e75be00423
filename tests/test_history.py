"""Historic routes on small literal cubes."""

import pytest

from cubewise.operators.history import all_time_top_items, period_values, top_items
from cubewise.sources.cubes import assert_unique, duplicate_keys, flatten_id, nest_id
from tests.conftest import rows

COUNT_MONTH = "party string, year bigint, month bigint, count double"
ITEM_MONTH = "party string, year bigint, month bigint, hashtag string, count double"
ITEM_YEAR = "party string, year bigint, hashtag string, count double"


def test_period_values_filters_and_drops_party(spark):
    cube = spark.createDataFrame(
        [("CDU", 2021, 2, 10.0), ("CDU", 2021, 10, 12.0), ("SPD", 2021, 2, 5.0), ("CDU", 2020, 2, 99.0)],
        COUNT_MONTH)
    all_parties = period_values(cube, "month", year=2021)
    assert all_parties.columns == ["party", "month", "value"]
    assert rows(all_parties) == [("CDU", 2, 10.0), ("CDU", 10, 12.0), ("SPD", 2, 5.0)]
    one = period_values(cube, "month", year=2021, party="CDU")
    assert one.columns == ["month", "value"]
    # months sort as numbers: 2 before 10
    assert [r.month for r in one.orderBy("month").collect()] == [2, 10]


def test_period_values_rounds_means(spark):
    cube = spark.createDataFrame([("CDU", 2021, 1, 1 / 3)], COUNT_MONTH)
    assert period_values(cube, "month", year=2021, digits=6).first().value == 0.333333
    assert period_values(cube, "month", year=2021).first().value == 1 / 3  # as stored by default


def test_duplicate_cube_keys_are_reported(spark):
    cube = spark.createDataFrame([("CDU", 2021, 1, 1.0), ("CDU", 2021, 1, 2.0), ("SPD", 2021, 1, 3.0)],
                                 COUNT_MONTH)
    dup = duplicate_keys(cube, ["party", "year", "month"]).collect()
    assert [(r.party, r.copies) for r in dup] == [("CDU", 2)]
    with pytest.raises(ValueError):
        assert_unique(cube, ["party", "year", "month"])
    assert_unique(cube.where("count > 1"), ["party", "year", "month"])


def test_id_struct_round_trip(spark):
    cube = spark.createDataFrame([("CDU", 2021, 1, 1.0)], COUNT_MONTH)
    nested = nest_id(cube, ["party", "year", "month"])
    assert nested.columns == ["_id", "count"]
    assert rows(flatten_id(nested)) == rows(cube)


def test_top_items_ties_break_by_item_and_ranks_are_row_numbers(spark):
    cube = spark.createDataFrame(
        [("CDU", 2021, 3, "b", 5.0), ("CDU", 2021, 3, "a", 5.0), ("CDU", 2021, 3, "c", 5.0),
         ("CDU", 2021, 3, "d", 9.0), ("CDU", 2021, 3, "a", 1.0)], ITEM_MONTH)
    out = top_items(cube, "hashtag", "month", 3, year=2021)
    assert out.columns == ["party", "month", "rank", "hashtag", "total"]
    assert rows(out) == [("CDU", 3, 1, "d", 9.0), ("CDU", 3, 2, "a", 6.0), ("CDU", 3, 3, "b", 5.0)]


def test_top_items_fewer_than_n_and_one_party(spark):
    cube = spark.createDataFrame(
        [("CDU", 2021, 3, "x", 2.0), ("CDU", 2021, 4, "y", 1.0), ("SPD", 2021, 3, "z", 7.0)], ITEM_MONTH)
    one = top_items(cube, "hashtag", "month", 10, year=2021, party="CDU")
    assert one.columns == ["month", "rank", "hashtag", "total"]
    assert rows(one) == [(3, 1, "x", 2.0), (4, 1, "y", 1.0)]
    unranked = top_items(cube, "hashtag", "month", 10, year=2021, party="CDU", ranked=False)
    assert unranked.columns == ["month", "hashtag", "total"]


def test_top_items_without_year_keeps_years_apart(spark):
    cube = spark.createDataFrame([("CDU", 2020, 1, "x", 2.0), ("CDU", 2021, 1, "x", 3.0)], ITEM_MONTH)
    out = top_items(cube, "hashtag", "month", 5)
    assert out.columns == ["party", "year", "month", "rank", "hashtag", "total"]
    assert rows(out, "year", "total") == [(2020, 2.0), (2021, 3.0)]


def test_all_time_top_items_sums_over_years(spark):
    cube = spark.createDataFrame(
        [("CDU", 2020, "x", 2.0), ("CDU", 2021, "x", 3.0), ("CDU", 2021, "y", 4.0), ("SPD", 2021, "y", 1.0)],
        ITEM_YEAR)
    out = all_time_top_items(cube, "hashtag", 1)
    assert out.columns == ["party", "hashtag", "total"]
    assert rows(out) == [("CDU", "x", 5.0), ("SPD", "y", 1.0)]


def test_bad_grain_is_rejected(spark):
    cube = spark.createDataFrame([("CDU", 2021, 1, 1.0)], COUNT_MONTH)
    with pytest.raises(ValueError):
        period_values(cube, "day")
