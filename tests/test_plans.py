"""Physical plan properties that matter at scale."""

import pytest

from cubewise.plans.bindings import TableCubes
from cubewise.plans.registry import route_specs
from tests.conftest import SF_SMALL

SPECS = {s.key: s for s in route_specs()}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def raw(spark):
    return TableCubes(spark, SF_SMALL)


@pytest.mark.parametrize("key", sorted(SPECS))
def test_no_cartesian_no_python_no_nested_loop(raw, key):
    p = plan(SPECS[key].run(raw))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
                "FlatMapGroupsInPandas", "MapInPandas"):
        assert bad not in p, f"{key}: {bad}"


def test_year_window_reaches_the_parquet_scan(raw):
    p = plan(SPECS["mostUsedHashtags__year_month_party"].run(raw))
    assert "GreaterThanOrEqual(o_orderdate,1997-01-01T00:00)" in p
    assert "LessThan(o_orderdate,1998-01-01T00:00)" in p


def test_live_day_window_reaches_the_parquet_scan(raw):
    p = plan(SPECS["countTotalRunning__day"].run(raw))
    assert "GreaterThanOrEqual(ts,2024-01-15T00:00)" in p and "LessThan(ts,2024-01-16T00:00)" in p


def test_scans_read_only_needed_columns(raw):
    p = plan(SPECS["mostActiveUser__year_month"].run(raw))
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderdate:timestamp_ntz,o_orderpriority:string>" \
        in p or "ReadSchema: struct<o_custkey:bigint,o_orderdate:timestamp_ntz,o_orderpriority:string>" in p


def test_top_n_limits_each_group_before_the_shuffle(raw):
    p = plan(SPECS["mostUsedHashtags__year_month"].run(raw))
    assert "WindowGroupLimit" in p and "Partial" in p


def test_item_sum_reuses_cube_partitioning(raw):
    # cube aggregate and the item sum share one exchange; the window adds the second
    p = plan(SPECS["mostTaggedUser__year_week_party"].run(raw))
    assert p.count("Exchange hashpartitioning") == 2


def test_aggregates_are_partial_before_shuffle(raw):
    p = plan(SPECS["countTweetByMonth__all"].run(raw))
    assert "partial_count" in p


def test_line_stats_are_combined_per_order_before_the_join(raw):
    p = plan(SPECS["averagelikestweet__all"].run(raw))
    assert "partial_sum(l_quantity" in p


def test_year_routes_prune_lineitem_with_a_runtime_filter_at_scale(spark, raw):
    """With tables too large to broadcast (as at scale), the year-filtered
    orders build a bloom filter that is applied at the lineitem scan, below
    the per-order aggregate and the part join."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "10KB"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        for key in ("averageTweetLength__year_month", "mostUsedHashtags__year_month_party"):
            p = plan(SPECS[key].run(raw))
            assert "might_contain" in p and "bloom_filter_agg(xxhash64(o_orderkey" in p, key
            assert "SortMergeJoin" in p and "BroadcastHashJoin" not in p, key
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_feed_job_bases_scan_each_raw_table_once(raw):
    from cubewise.plans.build import events_base, lines_base, orders_base

    for base, table, other in ((lines_base, "lineitem.parquet", "orders.parquet"),
                               (orders_base, "orders.parquet", None), (events_base, "events.parquet", None)):
        p = plan(base(raw))
        scans = [line for line in p.split("\n") if "FileScan parquet" in line]
        assert sum(table in s for s in scans) == 1, (table, scans)
        if other:
            assert sum(other in s for s in scans) == 1
        assert "Expand" in p  # grouping sets: one aggregate serves several cubes


def test_latest_list_routes_read_only_what_they_need(raw):
    one = plan(SPECS["liveTweets__party"].run(raw))
    assert "EqualTo(event_type,click)" in one and "TakeOrderedAndProject" not in one
    combined = plan(SPECS["liveTweets__all"].run(raw))
    assert "TakeOrderedAndProject(limit=15" in combined


def test_one_party_filter_reaches_the_scan(raw):
    for key, pushed in (("countTweetByMonth__year_month_party", "EqualTo(o_orderpriority,1-URGENT)"),
                        ("mostUsedUrls__party", "EqualTo(o_orderpriority,1-URGENT)"),
                        ("liveSource__day_party", "EqualTo(event_type,click)"),
                        ("liveSentiment__month_party", "EqualTo(event_type,click)")):
        assert pushed in plan(SPECS[key].run(raw)), key
