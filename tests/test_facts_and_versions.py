"""Line facts, published versions, late rows and change-driven builds."""

import datetime as dt
import os
import threading

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from cubewise.plans import build as build_module
from cubewise.plans.bindings import LateRows, StoredCubes, TableCubes, build_all
from cubewise.plans.build import add_rows
from cubewise.plans.facts import Changes, FactCubes, Facts
from cubewise.plans.registry import route_specs
from cubewise.sources.versions import PublishConflict, Versions
from tests.conftest import SF_SMALL, rows
from tests.oracle_compare import TABLES

LINE_FAMILIES = ("averageReply", "averagelikestweet", "averageTweetLength", "averageRetweetsTweet", "totalReplies",
                 "mostUsedHashtags", "mostUsedHashtagsCloud", "mostTaggedUser", "mostUsedUrls")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def tables(folder, **changed):
    """A folder of the test tables, some of them replaced."""
    os.makedirs(folder)
    for name in TABLES:
        if name in changed:
            pq.write_table(changed[name], os.path.join(folder, f"{name}.parquet"))
        else:
            os.symlink(f"{SF_SMALL}/{name}.parquet", os.path.join(folder, f"{name}.parquet"))
    return folder


def table(name):
    return pq.read_table(f"{SF_SMALL}/{name}.parquet")


def rounded(df):
    return [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows(df)]


@pytest.fixture(scope="module")
def facts_root(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("facts") / "f")
    Facts(spark, root).build(TableCubes(spark, SF_SMALL))
    return root


def test_part_texts_stay_out_of_the_shuffle_of_lines_on_orders(spark, scratch, monkeypatch):
    from cubewise.sources import versions

    built, write = {}, versions.Draft.write
    monkeypatch.setattr(versions.Draft, "write", lambda self, df, name, *args, **more: (built.update({name: df}), write(self, df, name, *args, **more))[1])
    Facts(spark, scratch).build(TableCubes(spark, SF_SMALL))
    joins = [line for line in built["lines"]._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join LeftOuter" in line]
    assert "p_partkey" in joins[0] and "o_orderkey" in joins[1] and len(joins) == 2  # the first is the outer one
    held = Versions(spark, scratch).newest().collections["lines"]
    assert len({f.rpartition("=")[2] for f in held.folders}) == 1  # one label for all partitions
    assert spark.read.parquet(f"{scratch}/lines").count() == table("lineitem").num_rows


def test_facts_answer_every_route_like_raw_tables(spark, facts_root):
    raw, facts = TableCubes(spark, SF_SMALL), FactCubes(spark, SF_SMALL, facts_root)
    for spec in route_specs():
        assert rounded(spec.run(facts)) == rounded(spec.run(raw)), spec.key


def test_one_year_line_routes_read_one_year_and_shuffle_no_order_key(spark, facts_root):
    facts = FactCubes(spark, SF_SMALL, facts_root)
    off = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.optimizer.runtime.bloomFilter.enabled": "false",
           "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    had = {k: spark.conf.get(k, None) for k in off}
    try:
        for k, v in off.items():
            spark.conf.set(k, v)
        for spec in route_specs():
            if spec.family.name not in LINE_FAMILIES or not spec.shape.startswith("year_"):
                continue
            p = plan(spec.run(facts))
            assert "Join" not in p and "orderkey" not in "".join(x for x in p.splitlines() if "Exchange" in x), spec.key
            scanned = [x for x in p.splitlines() if "FileScan" in x]
            assert len(scanned) == 1 and "1997" in scanned[0].split("PartitionFilters: [")[1].split("]")[0], spec.key
    finally:
        for k, v in had.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def moved_and_removed(seed=0):
    """Raw tables after changes, and the changes: orders of 1996 move to 1998,
    others go with or without their lines, lines change, go and come."""
    orders, lines = table("orders"), table("lineitem")
    key = orders["o_orderkey"]
    in_1996 = pc.equal(pc.year(orders["o_orderdate"]), 1996)
    moved = orders.filter(pc.and_(in_1996, pc.equal(pc.bit_wise_and(key, 7), 1)))
    moved = moved.set_column(moved.schema.get_field_index("o_orderdate"), "o_orderdate",
                             pa.array([t.replace(year=1998, day=min(t.day, 28)) for t in moved["o_orderdate"].to_pylist()], orders.schema.field("o_orderdate").type))
    gone = orders.filter(pc.and_(in_1996, pc.equal(pc.bit_wise_and(key, 7), 2)))
    bare = orders.filter(pc.and_(in_1996, pc.equal(pc.bit_wise_and(key, 7), 3))).slice(0, 3)  # their lines stay, without an order
    touched = pa.concat_arrays([c["o_orderkey"].combine_chunks() for c in (moved, gone, bare)])
    after_orders = pa.concat_tables([orders.filter(pc.invert(pc.is_in(key, touched))), moved])
    own = lines.filter(pc.is_in(lines["l_orderkey"], gone["o_orderkey"].combine_chunks()))
    others = lines.filter(pc.invert(pc.is_in(lines["l_orderkey"], gone["o_orderkey"].combine_chunks())))
    first = pc.and_(pc.equal(others["l_linenumber"], 1), pc.is_in(others["l_orderkey"], moved["o_orderkey"].combine_chunks()))
    changed = others.filter(first)
    changed = changed.set_column(changed.schema.get_field_index("l_quantity"), "l_quantity", pc.add(changed["l_quantity"], 5.0))
    new = changed.slice(0, 4).set_column(changed.schema.get_field_index("l_linenumber"), "l_linenumber", pa.array([99] * min(4, changed.num_rows), lines.schema.field("l_linenumber").type))
    after_lines = pa.concat_tables([others.filter(pc.invert(first)), changed, new])
    return after_orders, after_lines, moved, pa.concat_tables([gone, bare]), pa.concat_tables([changed, new]), own


def test_change_driven_build_equals_a_full_build(spark, scratch, facts_root):
    after_orders, after_lines, moved, gone, lines, own = moved_and_removed()
    assert min(t.num_rows for t in (moved, gone, lines, own)) > 0
    changed = tables(os.path.join(scratch, "changed"), orders=after_orders, lineitem=after_lines)
    root = os.path.join(scratch, "facts")
    facts = Facts(spark, root)
    facts.build(TableCubes(spark, SF_SMALL))
    cubes = os.path.join(scratch, "cubes")
    build_all(FactCubes(spark, SF_SMALL, root), cubes)
    frame = lambda t: spark.createDataFrame(t.to_pandas(), spark.read.parquet(f"{SF_SMALL}/{'orders' if 'o_orderkey' in t.column_names else 'lineitem'}.parquet").schema)
    before = Versions(spark, root).newest()
    days = facts.apply(Changes(orders=frame(moved), deleted_orders=frame(gone).select("o_orderkey"), lines=frame(lines),
                               deleted_lines=frame(own).select("l_orderkey", "l_linenumber")), TableCubes(spark, changed))
    assert {d.year for d in days} == {1996, 1998}
    after = Versions(spark, root).newest()
    # line folders of other years are those of the version before: not rewritten
    same = lambda m: {f for f in m.collections["lines"].folders if not f.startswith(("year=1996", "year=1998", "year=0"))}
    assert same(before) == same(after) and len(same(after)) > 12
    src = FactCubes(spark, changed, root)
    p = plan(build_module.lines_base(src, build_module.day_windows(days)))
    assert "Join" not in p
    scan = next(x for x in p.splitlines() if "FileScan" in x)
    only = scan.split("PartitionFilters: [")[1].split("DataFilters")[0] if "DataFilters" in scan.split("PartitionFilters: [")[1] else scan.split("PartitionFilters: [")[1]
    assert "year" in only and "1996" in only and "1998" in only and "1997" not in only
    build_all(src, cubes, days=days)
    full = os.path.join(scratch, "full")
    build_all(TableCubes(spark, changed), full)
    got, want = StoredCubes(spark, cubes), StoredCubes(spark, full)
    for spec in route_specs():
        assert rounded(spec.run(got)) == rounded(spec.run(want)), spec.key
    raw = TableCubes(spark, changed)
    for spec in route_specs():
        if spec.family.name in LINE_FAMILIES:
            assert rounded(spec.run(got)) == rounded(spec.run(raw)), spec.key


def test_changed_parts_and_waiting_lines(spark, scratch):
    """Lines that come before their order wait for it; a part's new brand reaches its lines."""
    orders, part = table("orders"), table("part")
    late = orders.slice(0, 40)
    early = tables(os.path.join(scratch, "early"), orders=orders.slice(40))
    facts = Facts(spark, os.path.join(scratch, "facts"))
    facts.build(TableCubes(spark, early))
    schema = spark.read.parquet(f"{SF_SMALL}/orders.parquet").schema
    brand = part["p_brand"].to_pylist()
    brand = ["Brand#new" if i < 5 else b for i, b in enumerate(brand)]
    new_part = part.set_column(part.schema.get_field_index("p_brand"), "p_brand", pa.array(brand))
    now = tables(os.path.join(scratch, "now"), part=new_part)
    src = TableCubes(spark, now)
    days = facts.apply(Changes(orders=spark.createDataFrame(late.to_pandas(), schema), parts=src.table("part").where("p_brand = 'Brand#new'").select("p_partkey")), src)
    assert days
    got, want = FactCubes(spark, now, os.path.join(scratch, "facts")), TableCubes(spark, now)
    for spec in route_specs():
        if spec.family.name in LINE_FAMILIES:
            assert rounded(spec.run(got)) == rounded(spec.run(want)), spec.key
    assert facts.apply(Changes(), src) == []


def test_late_rows_are_added_without_reading_counted_rows(spark, scratch, monkeypatch):
    """A day's orders, lines of known orders and events come late: all routes
    equal a full build, and nothing but the late rows (and the day's orders) is read."""
    orders, lines, events = table("orders"), table("lineitem"), table("events")
    day = orders["o_orderdate"][100].as_py().replace(hour=0, minute=0, second=0, microsecond=0)
    of_day = pc.and_(pc.greater_equal(orders["o_orderdate"], pa.scalar(day, orders.schema.field("o_orderdate").type)),
                     pc.less(orders["o_orderdate"], pa.scalar(day + dt.timedelta(days=1), orders.schema.field("o_orderdate").type)))
    those = orders.filter(of_day)
    late_orders = those.slice(0, max(1, those.num_rows // 2))
    of_late = pc.is_in(lines["l_orderkey"], late_orders["o_orderkey"].combine_chunks())
    known = pc.is_in(lines["l_orderkey"], those["o_orderkey"].combine_chunks())
    # all lines of late orders, and the second lines of the day's other orders
    is_late = pc.or_(of_late, pc.and_(known, pc.equal(lines["l_linenumber"], 2)))
    late_event = pc.equal(pc.day(events["ts"]), 15)
    early = tables(os.path.join(scratch, "early"), orders=orders.filter(pc.invert(pc.is_in(orders["o_orderkey"], late_orders["o_orderkey"].combine_chunks()))),
                   lineitem=lines.filter(pc.invert(is_late)), events=events.filter(pc.invert(late_event)))
    late = tables(os.path.join(scratch, "late"), orders=late_orders, lineitem=lines.filter(is_late), events=events.filter(late_event))
    root = os.path.join(scratch, "cubes")
    before = TableCubes(spark, early)
    build_all(before, root)
    stored = StoredCubes(spark, root)
    old = rounded({s.key: s for s in route_specs()}["averagelikestweet__all"].run(stored))
    asked = []
    read_orders = before.orders
    monkeypatch.setattr(before, "orders", lambda window=None, *extra: asked.append(window) or read_orders(window, *extra))
    for name in ("read", "events"):
        monkeypatch.setattr(before, name, lambda *a, **b: pytest.fail("counted rows were read"))
    window = (day, day + dt.timedelta(days=1))
    add_rows(LateRows(spark, late, known=before, days=(window,)), root)
    assert asked and all(w == (window,) for w in asked)
    manifest = Versions(spark, root).newest()
    assert manifest.collections["avgLikesByYear"].added_to and manifest.collections["sentimentRunningByHourAndParty"].meta["mean"]
    full = TableCubes(spark, SF_SMALL)
    for spec in route_specs():
        assert rounded(spec.run(stored)) == rounded(spec.run(full)), spec.key
    assert rounded({s.key: s for s in route_specs()}["averagelikestweet__all"].run(stored)) != old
    # the next build of those years merges what was added
    build_all(full, root, days=[day.date()], event_days=[dt.date(2024, 1, 15)])
    of_year = [f for f in Versions(spark, root).newest().collections["avgLikesByYear"].folders if f.startswith(f"year={day.year}/")]
    assert len(of_year) == 1
    for key in ("averagelikestweet__all", "countTweetByMonth__year_month", "liveSentiment__month", "mosttweetstime__all"):
        spec = {s.key: s for s in route_specs()}[key]
        assert rounded(spec.run(stored)) == rounded(spec.run(full)), key


def test_late_rows_need_a_version(spark, scratch):
    with pytest.raises(FileNotFoundError):
        add_rows(LateRows(spark, SF_SMALL), os.path.join(scratch, "none"))


# ---------------------------------------------------------------- versions


def small(spark, *values):
    return spark.createDataFrame([(f"p{v % 2}", 2000 + v % 3, float(v)) for v in values], "party string, year bigint, count double")


def total(df):
    return df.agg(F.sum("count")).first()[0]


def test_readers_see_whole_versions_during_builds_and_after_crashes(spark, scratch):
    versions = Versions(spark, scratch)
    draft = versions.draft()
    for name in ("a", "b"):
        draft.write(small(spark, 1, 2, 3), name, ("year",))
    assert versions.newest() is None
    assert draft.publish() == 1
    cubes = StoredCubes(spark, scratch, on_null="keep")
    pinned = cubes.snapshot()
    seen, stop = [], threading.Event()

    def read():
        while not stop.is_set():
            one = cubes.snapshot()
            seen.append((total(one.cube("a")), total(one.cube("b"))))

    reader = threading.Thread(target=read)
    reader.start()
    try:
        for k in range(2, 5):
            draft = versions.draft()
            draft.write(small(spark, *range(k * 10)), "a", ("year",))
            draft.write(small(spark, *range(k * 10)), "b", ("year",))
            draft.publish()
        crashed = versions.draft()  # one collection written, never published
        crashed.write(small(spark, 1000), "a", ("year",))
    finally:
        stop.set()
        reader.join()
    assert seen and all(a == b for a, b in seen)
    assert total(cubes.cube("a")) == total(cubes.cube("b")) == sum(range(40))
    assert total(pinned.cube("a")) == 6.0
    # partitions that a version leaves without rows are gone
    draft = versions.draft()
    draft.write(small(spark, 3), "a", ("year",), lambda k: k["year"] in ("2000", "2001"))
    draft.publish()
    assert sorted(r.year for r in cubes.cube("a").select("year").distinct().collect()) == [2000, 2002]
    assert total(cubes.cube("a").where("year = 2000")) == 3.0


def test_two_builds_from_one_version(spark, scratch):
    versions = Versions(spark, scratch)
    one, two = versions.draft(), versions.draft()
    one.write(small(spark, 1), "a", ("year",))
    two.write(small(spark, 2, 3), "a", ("year",))
    two.publish()
    with pytest.raises(PublishConflict):
        one.publish()
    assert total(StoredCubes(spark, scratch, on_null="keep").cube("a")) == 5.0
    assert versions.numbers() == [1]


def test_pruned_versions_leave_only_named_folders(spark, scratch):
    versions = Versions(spark, scratch)
    for k in range(4):
        draft = versions.draft()
        draft.write(small(spark, 1, 2, 3 + k), "a", ("year",), lambda key: key["year"] != "2002")
        if k == 0:
            draft.write(small(spark, 9), "gone", ("year",))
        else:
            draft.collections.pop("gone", None)
        draft.publish()
    orphan = versions.draft()
    orphan.write(small(spark, 50), "a", ("year",))
    kept = total(StoredCubes(spark, scratch, on_null="keep").cube("a"))
    assert versions.prune(2) == [1, 2] and versions.numbers() == [3, 4]
    fresh = StoredCubes(spark, scratch, on_null="keep")
    assert total(fresh.cube("a")) == kept
    on_disk = {os.path.join(d, n).split("/a/")[1] for d, names, _ in os.walk(os.path.join(scratch, "a")) for n in names if n.startswith("v=")}
    assert on_disk == {f for k in (3, 4) for f in versions.at(k).collections["a"].folders}
    assert not os.path.exists(os.path.join(scratch, "gone"))


def test_a_version_is_listed_once(spark, scratch, monkeypatch):
    versions = Versions(spark, scratch)
    draft = versions.draft()
    draft.write(small(spark, 1, 2), "a", ("year",))
    draft.publish()
    cubes = StoredCubes(spark, scratch, on_null="keep")
    calls = []
    frame = cubes.versions.frame
    monkeypatch.setattr(cubes.versions, "frame", lambda *a: calls.append(a) or frame(*a))
    assert cubes.cube("a") is cubes.cube("a") and len(calls) == 1
    draft = versions.draft()
    draft.write(small(spark, 5), "a", ("year",))
    draft.publish()
    assert total(cubes.cube("a")) == 5.0 and len(calls) == 2


def test_command_line_of_facts_changes_and_late_rows(spark, scratch, capsys):
    """Facts, cubes, a change and late events from the command line, against a full build."""
    from cubewise.__main__ import main

    after_orders, after_lines, moved, gone, lines, own = moved_and_removed()
    events = table("events")
    last = pc.equal(pc.day(events["ts"]), 20)
    early = tables(os.path.join(scratch, "early"), events=events.filter(pc.invert(last)))
    changed = tables(os.path.join(scratch, "changed"), orders=after_orders, lineitem=after_lines, events=events.filter(pc.invert(last)))
    late = tables(os.path.join(scratch, "late"), events=events.filter(last), orders=table("orders").slice(0, 0), lineitem=table("lineitem").slice(0, 0))
    now = tables(os.path.join(scratch, "now"), orders=after_orders, lineitem=after_lines)
    paths = {}
    for name, t in (("orders", moved), ("lines", lines), ("deleted-orders", gone.select(["o_orderkey"])), ("deleted-lines", own.select(["l_orderkey", "l_linenumber"]))):
        paths[name] = os.path.join(scratch, f"{name}.parquet")
        pq.write_table(t, paths[name])
    facts, cubes = os.path.join(scratch, "facts"), os.path.join(scratch, "cubes")
    main(["facts", "--tables", early, "--facts", facts])
    main(["build", "--tables", early, "--facts", facts, "--cubes", cubes])
    main(["change", "--tables", changed, "--facts", facts, "--cubes", cubes, *(x for n, p in paths.items() for x in (f"--{n}", p))])
    main(["late", "--tables", late, "--cubes", cubes])
    main(["prune", "--root", cubes, "--keep", "1"])
    assert "version 2 removed" in capsys.readouterr().out
    got, want = StoredCubes(spark, cubes), TableCubes(spark, now)
    for spec in route_specs():
        assert rounded(spec.run(got)) == rounded(spec.run(want)), spec.key


def test_items_are_counted_a_portion_of_years_at_a_time(spark, scratch, facts_root, monkeypatch):
    src, raw = FactCubes(spark, SF_SMALL, facts_root), TableCubes(spark, SF_SMALL)
    assert "Expand" not in plan(build_module.lines_base(src))  # stored lines: no wide row for each set
    years = {f.split("/")[0] for f in Versions(spark, facts_root).newest().collections["lines"].folders}
    assert len(build_module.line_bases(src, None)) == 1  # they are few
    monkeypatch.setattr(build_module, "PORTION", 1)
    monkeypatch.setattr(build_module, "LINE_PORTION", 1)
    assert len(build_module.line_bases(src, None)) == len(years - {"year=0"}) > 2
    root = os.path.join(scratch, "cubes")
    cubes = (("mostTaggedUsers", "taggedUser"), ("mostActiveUsers", "user"), ("urls", "url"), ("hashtags", "hashtag"))

    def same_as_raw():
        stored = StoredCubes(spark, root)
        for collection, item in cubes:
            for grain in ("year", "month", "week"):
                keys = dict.fromkeys(("party", "year", grain, item, "count"))
                assert rows(stored.cube(collection, grain), *keys) == rows(raw.cube(collection, grain), *keys), (collection, grain)
        assert not any(c.added_to for c in Versions(spark, root).newest().collections.values())

    build_all(src, root)
    same_as_raw()
    build_all(src, root, since=dt.date(1997, 5, 1))
    same_as_raw()


def test_historic_cubes_are_written_as_their_aggregate_left_them(spark, scratch, facts_root, monkeypatch):
    from cubewise.sources import versions

    written, write = {}, versions.Draft.write
    monkeypatch.setattr(versions.Draft, "write", lambda self, df, name, *args, **more: (written.update({name: more.get("clustered", False)}), write(self, df, name, *args, **more))[1])
    build_all(FactCubes(spark, SF_SMALL, facts_root), scratch)
    assert written["mostTaggedUsersByWeek"] and written["mostActiveUsersByYear"] and written[build_module.LINES]
    assert not written["sourceRunningByHourAndParty"]  # by day: clustered, or it would be many small files
