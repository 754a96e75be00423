"""Properties that must hold for any data (checked on the sf0.001 tables)."""

from pyspark.sql import functions as F

from cubewise.plans.bindings import TableCubes
from cubewise.plans.registry import AS_OF, ORACLE_DIGITS, route_specs
from cubewise.plans.routes import answer
from tests.conftest import SF_SMALL, rows


def _raw(spark):
    return TableCubes(spark, SF_SMALL)


def test_zero_filled_sum_equals_unfilled_sum(spark):
    raw = _raw(spark)
    filled = answer(raw, "countTotalRunning", "month", as_of=AS_OF)
    cube = raw.cube("metricsByHourAndParty").where("year = 2024 AND month = 1")
    a = rows(filled.groupBy("party").agg(F.sum("total").alias("t")))
    b = rows(cube.groupBy("party").agg(F.sum("count").alias("t")))
    assert a == b


def test_ranks_are_one_to_k_without_gaps(spark):
    raw = _raw(spark)
    for name in ("mostActiveUser", "mostUsedUrls"):
        out = answer(raw, name, "year_week", year=1997)
        stats = out.groupBy("party", "week").agg(F.count("*").alias("k"), F.min("rank").alias("lo"),
                                                 F.max("rank").alias("hi"),
                                                 F.countDistinct("rank").alias("d")).collect()
        assert stats and all(r.lo == 1 and r.hi == r.k == r.d and r.k <= 10 for r in stats)


def test_totals_descend_with_rank(spark):
    out = answer(_raw(spark), "mostTaggedUser", "year_month", year=1997)
    bad = out.alias("a").join(out.alias("b"), ["party", "month"]).where(
        (F.col("a.rank") < F.col("b.rank")) & (F.col("a.total") < F.col("b.total")))
    assert bad.count() == 0


def test_one_party_shape_equals_all_party_shape_filtered(spark):
    raw = _raw(spark)
    for spec in route_specs():
        if not spec.shape.endswith("party") or spec.family.group == "latest":
            continue
        all_shape = spec.shape[: -len("_party")] if spec.shape != "party" else "all"
        params = {k: v for k, v in spec.params.items() if k != "party"}
        whole = answer(raw, spec.family.name, all_shape, digits=ORACLE_DIGITS, **params).where(F.col("party") == spec.params["party"])
        one = spec.run(raw)
        cols = [c for c in one.columns if c != "party"]
        assert rows(whole.select(*cols)) == rows(one.select(*cols)), spec.key


def test_ranked_and_unranked_hold_the_same_items(spark):
    raw = _raw(spark)
    ranked = answer(raw, "mostUsedHashtags", "year_month", year=1997).drop("rank")
    # the cloud family reads the same cube with N = 100 >= 10: its top 10 must agree
    cloud = answer(raw, "mostUsedHashtagsCloud", "year_month", year=1997)
    from pyspark.sql import Window

    w = Window.partitionBy("party", "month").orderBy(F.desc("total"), "hashtag")
    cloud10 = cloud.withColumn("r", F.row_number().over(w)).where("r <= 10").drop("r")
    assert rows(ranked) == rows(cloud10)


def test_day_routes_agree_with_month_routes(spark):
    raw = _raw(spark)
    day = dict(rows(answer(raw, "liveMediaUsage", "day", as_of=AS_OF)))
    month = answer(raw, "liveMediaUsage", "month", as_of=AS_OF).where(F.col("day") == AS_OF.day)
    assert day == dict(rows(month.select("party", "total")))


def test_ordered_answers_follow_route_order(spark):
    raw = _raw(spark)
    out = answer(raw, "mostUsedHashtags", "year_month", year=1997, ordered=True).collect()
    keys = [(r.party, r.month, r.rank) for r in out]
    assert keys == sorted(keys)
    months = [r.month for r in answer(raw, "countTweetByMonth", "year_month_party", year=1997,
                                      party="1-URGENT", ordered=True).collect()]
    assert months == sorted(months) and 10 in months and months.index(2) < months.index(10)


def test_party_allow_list(spark):
    import pytest

    from cubewise.catalog import PARTIES

    raw = _raw(spark)
    with pytest.raises(ValueError):
        answer(raw, "countTotalRunning", "day_party", party="click", as_of=AS_OF, allowed_parties=PARTIES)
    assert answer(raw, "countTotalRunning", "day_party", party="click", as_of=AS_OF).count() == 1
    with pytest.raises(ValueError):
        answer(raw, "countTotalRunning", "day_party", as_of=AS_OF)
    with pytest.raises(ValueError):
        answer(raw, "countTweetByMonth", "year_month", party="x")
