"""Stored cubes answer like derived cubes; streaming feeds equal batch feeds."""

import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from cubewise.plans.bindings import LIVE_CUBES, StoredCubes, TableCubes, build_all
from cubewise.plans.registry import route_specs
from cubewise.sources.cubes import read_cube
from cubewise.streaming import (live_updates, read_event_stream, read_latest_lists, start_hourly_cube,
                                start_latest_lists, upsert_hours)
from tests.conftest import SF_SMALL, rows


def test_stored_cubes_answer_every_route_like_derived_cubes(spark, scratch):
    raw = TableCubes(spark, SF_SMALL)
    written = build_all(raw, os.path.join(scratch, "cubes"))
    assert len(written) == 46
    stored = StoredCubes(spark, os.path.join(scratch, "cubes"))
    for spec in route_specs():
        assert rows(spec.run(stored)) == rows(spec.run(raw)), spec.key


def test_stored_cube_is_partition_pruned(spark, scratch):
    raw = TableCubes(spark, SF_SMALL)
    stored = StoredCubes(spark, os.path.join(scratch, "c"))
    from cubewise.sources.cubes import write_cube

    write_cube(raw.cube("hashtags", "month"), stored.path("hashtags", "month"))
    spec = {s.key: s for s in route_specs()}["mostUsedHashtags__year_month"]
    p = spec.run(stored)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in p and "(year" in p and "= 1997)" in p


@pytest.fixture(scope="module")
def event_chunks(tmp_path_factory):
    """The sf0.001 events table split by time into 3 files, arriving in order."""
    folder = tmp_path_factory.mktemp("events-stream")
    table = pq.read_table(f"{SF_SMALL}/events.parquet").sort_by("ts")
    n = table.num_rows
    for i, (a, b) in enumerate([(0, n // 3), (n // 3, 2 * n // 3), (2 * n // 3, n)]):
        pq.write_table(table.slice(a, b - a), folder / f"part-{i}.parquet")
        os.utime(folder / f"part-{i}.parquet", (1_700_000_000 + i,) * 2)  # a stream takes files by their time: ties have no order
    return str(folder)


@pytest.mark.parametrize("collection", sorted(LIVE_CUBES))
def test_hourly_stream_equals_batch(spark, scratch, event_chunks, collection):
    stream = read_event_stream(spark, event_chunks, max_files_per_trigger=1)
    cube_path = os.path.join(scratch, "cube")
    q = start_hourly_cube(live_updates(stream, collection, watermark="2 hours"), cube_path,
                          os.path.join(scratch, "ckpt"), trigger={"availableNow": True})
    q.awaitTermination(300)
    assert q.exception() is None
    want = TableCubes(spark, SF_SMALL).cube(collection)
    cols = want.columns
    got = read_cube(spark, cube_path).select(*[F.col(c).cast(want.schema[c].dataType) for c in cols])
    r = lambda df: [tuple(round(v, 9) if isinstance(v, float) else v for v in t) for t in rows(df.select(*cols))]
    assert r(got) == r(want)
    # the sink is the partitioned cube itself: one folder per day, nothing per micro-batch
    days = {d for d in os.listdir(os.path.join(cube_path, "year=2024", "month=1")) if d.startswith("day=")}
    assert len(days) == want.select("day").distinct().count()


def test_hourly_upsert_is_idempotent(spark, scratch):
    path = os.path.join(scratch, "cube")
    keys = ["party", "year", "month", "day", "hour"]
    schema = "party string, year bigint, month bigint, day bigint, hour bigint, count double"
    first = spark.createDataFrame([("a", 2024, 1, 1, 0, 1.0), ("a", 2024, 1, 2, 5, 2.0)], schema)
    upsert_hours(first, path, keys)
    update = spark.createDataFrame([("a", 2024, 1, 2, 5, 7.0), ("b", 2024, 1, 2, 6, 1.0)], schema)
    upsert_hours(update, path, keys)
    once = rows(read_cube(spark, path).select(*keys, "count"))
    upsert_hours(update, path, keys)  # a retried batch
    assert rows(read_cube(spark, path).select(*keys, "count")) == once == [
        ("a", 2024, 1, 1, 0, 1.0), ("a", 2024, 1, 2, 5, 7.0), ("b", 2024, 1, 2, 6, 1.0)]


def test_latest_stream_equals_batch(spark, scratch, event_chunks):
    stream = read_event_stream(spark, event_chunks, max_files_per_trigger=1)
    lists = os.path.join(scratch, "lists")
    q = start_latest_lists(stream, lists, os.path.join(scratch, "ckpt"), trigger={"availableNow": True})
    q.awaitTermination(300)
    assert q.exception() is None
    got = rows(read_latest_lists(spark, lists))
    want = rows(TableCubes(spark, SF_SMALL).cube("lastTweets"))
    assert got == want
    state = spark.read.parquet(lists)
    assert sorted(os.listdir(lists)) == ["slot=0", "slot=1"]  # three batches, two slots
    assert state.agg(F.max("batch_id")).first()[0] == 2
    assert state.groupBy("batch_id", "key").count().agg(F.max("count")).first()[0] <= 15


def test_cubes_as_id_documents_in_another_format(spark, scratch):
    """Cubes stored as JSON documents with the key fields in ``_id`` answer the same."""
    from cubewise.sources.cubes import nest_id

    raw = TableCubes(spark, SF_SMALL)
    root = os.path.join(scratch, "docs")
    stored = StoredCubes(spark, root, fmt="json")
    wanted = {("hashtags", "year"), ("hashtags", "month"), ("countTotal", "week"),
              ("sourceRunningByHourAndParty", None), ("lastTweets", None)}
    for collection, grain in wanted:
        df = raw.cube(collection, grain)
        if collection == "lastTweets":
            df = df.withColumnRenamed("key", "_id")
        else:
            df = nest_id(df, [c for c in df.columns if c not in ("count", "sentiment")])
        df.write.mode("overwrite").json(stored.path(collection, grain))
    keys = ["mostUsedHashtags__all", "mostUsedHashtags__year_month_party", "mostUsedHashtagsCloud__legislatur",
            "countTweetByMonth__year_week", "liveSource__month", "liveSource__day_party", "liveTweets__party"]
    specs = {s.key: s for s in route_specs()}
    for key in keys:
        assert rows(specs[key].run(stored)) == rows(specs[key].run(raw)), key


def test_watermark_decides_late_posts(spark, scratch):
    """Posts older than the watermark are not counted; late posts within it are.

    Spark judges late rows against the watermark of the previous batch, so the
    watermark raised by batch 1 filters from batch 3 on."""
    import datetime as dt

    import pyarrow as pa

    folder = os.path.join(scratch, "late")
    os.makedirs(folder)
    day = dt.datetime(2024, 1, 15)
    batches = [
        [day.replace(hour=10, minute=5), day.replace(hour=10, minute=40)],   # hour 10
        [day.replace(hour=14, minute=0)],                                    # watermark -> 12:00
        [day.replace(hour=14, minute=10)],
        [day.replace(hour=11, minute=30), day.replace(hour=12, minute=30)],  # 11:30 too late, 12:30 in time
    ]
    for i, times in enumerate(batches):
        table = pa.table({"event_id": pa.array(range(i * 10, i * 10 + len(times)), pa.int64()),
                          "ts": pa.array(times, pa.timestamp("us")),
                          "user_id": pa.array([1] * len(times), pa.int64()),
                          "event_type": ["click"] * len(times), "value": [1.0] * len(times),
                          "props": ['{"k": 1}'] * len(times)})
        pq.write_table(table, os.path.join(folder, f"part-{i}.parquet"))
    stream = read_event_stream(spark, folder, max_files_per_trigger=1)
    cube_path = os.path.join(scratch, "cube")
    q = start_hourly_cube(live_updates(stream, "metricsByHourAndParty", watermark="2 hours"), cube_path,
                          os.path.join(scratch, "ckpt"), trigger={"availableNow": True})
    q.awaitTermination(300)
    assert q.exception() is None
    got = {r.hour: r["count"] for r in read_cube(spark, cube_path).collect()}
    assert got == {10: 2.0, 12: 1.0, 14: 2.0}


def test_incremental_build_equals_full_build(spark, scratch):
    """Build from tables cut at 1998-01-01, then incrementally from the full
    tables since 1998: every route answers as after a full build."""
    import datetime as dt

    import pyarrow.compute as pc

    from tests.oracle_compare import TABLES

    cut = os.path.join(scratch, "cut")
    os.makedirs(cut)
    orders = pq.read_table(f"{SF_SMALL}/orders.parquet")
    early = orders.filter(pc.less(orders["o_orderdate"], pa.scalar(dt.datetime(1998, 1, 1), pa.timestamp("us"))))
    pq.write_table(early, os.path.join(cut, "orders.parquet"))
    events = pq.read_table(f"{SF_SMALL}/events.parquet")
    first_half = events.filter(pc.less(events["ts"], pa.scalar(dt.datetime(2024, 1, 15), pa.timestamp("us"))))
    pq.write_table(first_half, os.path.join(cut, "events.parquet"))
    for name in TABLES:
        if name not in ("orders", "events"):
            os.symlink(f"{SF_SMALL}/{name}.parquet", os.path.join(cut, f"{name}.parquet"))

    full_root, inc_root = os.path.join(scratch, "full"), os.path.join(scratch, "inc")
    build_all(TableCubes(spark, SF_SMALL), full_root)
    build_all(TableCubes(spark, cut), inc_root)
    build_all(TableCubes(spark, SF_SMALL), inc_root, since=dt.date(1998, 3, 1))
    full, inc = StoredCubes(spark, full_root), StoredCubes(spark, inc_root)
    for spec in route_specs():
        assert rows(spec.run(inc)) == rows(spec.run(full)), spec.key


def test_stored_value_cube_keys_are_verified(spark, scratch):
    import pytest

    from cubewise.sources.cubes import write_cube

    stored = StoredCubes(spark, scratch, verify_keys=True)
    dup = spark.createDataFrame([("CDU", 2021, 1, 1.0), ("CDU", 2021, 1, 2.0)],
                                "party string, year bigint, month bigint, count double")
    write_cube(dup, stored.path("countTotal", "month"))
    with pytest.raises(ValueError):
        stored.cube("countTotal", "month")
    ok = spark.createDataFrame([("CDU", 2021, 1, 1.0), ("SPD", 2021, 1, 2.0)],
                               "party string, year bigint, week bigint, count double")
    write_cube(ok, stored.path("countTotal", "week"))
    assert stored.cube("countTotal", "week").count() == 2


def test_command_line_build_and_route(spark, scratch):
    import json

    from cubewise.__main__ import main

    cubes, out = os.path.join(scratch, "cubes"), os.path.join(scratch, "answer")
    main(["build", "--tables", SF_SMALL, "--cubes", cubes])
    main(["route", "--cubes", cubes, "--family", "liveSource", "--shape", "month_party", "--party", "click",
          "--as-of", "2024-01-15", "--out", out])
    (doc,) = [json.loads(r.value) for r in spark.read.text(out).collect()]
    assert len(doc) == 31 and doc["31"] == {}


def test_stored_live_day_route_reads_one_day_partition(spark, scratch):
    from cubewise.sources.cubes import LIVE_PARTITIONS, write_cube

    raw = TableCubes(spark, SF_SMALL)
    stored = StoredCubes(spark, os.path.join(scratch, "c"))
    write_cube(raw.cube("metricsByHourAndParty"), stored.path("metricsByHourAndParty"), LIVE_PARTITIONS)
    spec = {s.key: s for s in route_specs()}["countTotalRunning__day_party"]
    df = spec.run(stored)
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in p and "(day" in p and "= 15)" in p and "(month" in p
    assert rows(df) == rows(spec.run(raw))


def test_upsert_reads_only_touched_day_partitions(spark, scratch):
    from cubewise.sources.cubes import LIVE_PARTITIONS, write_cube
    from cubewise.streaming.hourly import touched_days

    cube = TableCubes(spark, SF_SMALL).cube("metricsByHourAndParty")
    path = os.path.join(scratch, "cube")
    write_cube(cube, path, LIVE_PARTITIONS)
    batch = cube.where("day = 15 AND hour = 3")
    touched = touched_days(read_cube(spark, path), batch)
    assert {r.day for r in touched.collect()} == {15}
    assert "dynamicpruningexpression" in touched._jdf.queryExecution().executedPlan().toString()


def test_incremental_build_after_removed_and_moved_events(spark, scratch):
    """Events from 25 January on go, others move to another day: an incremental
    build answers every event route as a full one does."""
    import datetime as dt

    from tests.oracle_compare import TABLES

    changed = os.path.join(scratch, "changed")
    os.makedirs(changed)
    events = pq.read_table(f"{SF_SMALL}/events.parquet").to_pandas()
    events = events[events.ts < "2024-01-25"].copy()
    late = events.ts >= "2024-01-23"
    events.loc[late, "ts"] -= dt.timedelta(days=20)
    pq.write_table(pa.Table.from_pandas(events, preserve_index=False), os.path.join(changed, "events.parquet"), coerce_timestamps="us")
    for name in TABLES:
        if name != "events":
            os.symlink(f"{SF_SMALL}/{name}.parquet", os.path.join(changed, f"{name}.parquet"))
    full_root, inc_root = os.path.join(scratch, "full"), os.path.join(scratch, "inc")
    build_all(TableCubes(spark, SF_SMALL), inc_root)
    build_all(TableCubes(spark, changed), inc_root, since=dt.date(2024, 1, 1))
    build_all(TableCubes(spark, changed), full_root)
    full, inc = StoredCubes(spark, full_root), StoredCubes(spark, inc_root)
    for collection, grain in (("metricsByHourAndParty", None), ("sourceRunningByHourAndParty", None),
                              ("mostTweetsTime", "month"), ("lastTweets", None)):
        assert rows(inc.cube(collection, grain)) == rows(full.cube(collection, grain)), collection


def test_rollups_read_one_grouping_set(spark, scratch):
    from cubewise.plans.build import LINES, _Build, _only, lines_base

    build = _Build(TableCubes(spark, SF_SMALL), scratch, 1)
    build.base(LINES, lines_base(build.src), None)
    base = build.rows(LINES, None)
    p = _only(base, "hashtag")._jdf.queryExecution().executedPlan().toString()
    assert "(set" in p.split("PartitionFilters: [")[1].split("]")[0]


def test_stream_sink_prunes_stages_once_and_survives_a_crash(spark, scratch, event_chunks, monkeypatch):
    from cubewise.streaming import hourly

    plans, folders, failed = [], [], []
    merge, publish = hourly.merge_hours, hourly.publish_days
    path, checkpoint = os.path.join(scratch, "cube"), os.path.join(scratch, "ckpt")

    def merged(batch, *args):
        out = merge(batch, *args)
        if out is not None:  # else a batch without rows, at the end
            plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    def crashing(rows_, to):
        folders.append(sorted(os.listdir(os.path.join(checkpoint, "staged"))))
        if len(folders) == 2:  # a day is gone when the job dies
            stored = os.listdir(os.path.join(to, "year=2024", "month=1"))  # of its days, one that the cube has already
            day = min(r["day"] for r in rows_.select("day").distinct().collect() if f"day={r['day']}" in stored)
            for name in os.listdir(os.path.join(to, "year=2024", "month=1", f"day={day}")):
                os.remove(os.path.join(to, "year=2024", "month=1", f"day={day}", name))
            failed.append(day)
            raise RuntimeError("lost")
        publish(rows_, to)

    monkeypatch.setattr(hourly, "merge_hours", merged)
    monkeypatch.setattr(hourly, "publish_days", crashing)
    for fails in (True, False):
        stream = read_event_stream(spark, event_chunks, max_files_per_trigger=1)
        q = start_hourly_cube(live_updates(stream, "metricsByHourAndParty", watermark="2 hours"), path, checkpoint,
                              trigger={"availableNow": True})
        if fails:
            with pytest.raises(Exception, match="lost"):
                q.awaitTermination(300)
        else:
            q.awaitTermination(300)
            assert q.exception() is None
    assert failed and len(plans) == 3  # the retried batch came from its staging
    assert all("make_date" in p[p.index("PartitionFilters: ["):].split("PushedFilters")[0] for p in plans[1:])
    assert set(map(tuple, folders)) == {("marked", "rows")}
    got = read_cube(spark, path)
    want = TableCubes(spark, SF_SMALL).cube("metricsByHourAndParty")
    assert rows(got.select(*want.columns)) == rows(want)
    for day in os.listdir(os.path.join(path, "year=2024", "month=1")):
        files = [f for f in os.listdir(os.path.join(path, "year=2024", "month=1", day)) if f.endswith(".parquet")]
        assert len(files) == 1


def test_array_items_count_each_entry(spark):
    from cubewise.plans.cubes import hourly_item_cube, item_cube

    posts = spark.sql("""select * from values ('a', timestamp'2024-01-02 03:00:00', array('x', 'y', 'x')),
                         ('a', timestamp'2024-01-02 03:30:00', array('y')), ('a', timestamp'2024-01-02 04:00:00', array()),
                         ('b', timestamp'2024-01-02 04:00:00', null) as t(party, ts, tags)""")
    assert rows(item_cube(posts, "month", F.col("tags"), "hashtag")) == [("a", 2024, 1, "x", 2.0), ("a", 2024, 1, "y", 2.0)]
    assert rows(hourly_item_cube(posts, F.col("tags"), "hashtag")) == [
        ("a", 2024, 1, 2, 3, "x", 2.0), ("a", 2024, 1, 2, 3, "y", 2.0)]
