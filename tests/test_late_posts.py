"""Posts behind the watermark reach the stored cube."""

import datetime as dt
import os
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from cubewise.plans.bindings import TableCubes
from cubewise.sources.cubes import read_cube
from cubewise.streaming import correct_hours, live_updates, read_event_stream, start_hourly_cube, start_late_posts
from cubewise.streaming.late import pending
from tests.conftest import rows

DAY = dt.datetime(2024, 1, 15)


def events(times, first):
    n = len(times)
    return pa.table({"event_id": pa.array(range(first, first + n), pa.int64()), "ts": pa.array(times, pa.timestamp("us")),
                     "user_id": pa.array([i % 3 for i in range(n)], pa.int64()), "event_type": [("click", "view")[i % 2] for i in range(n)],
                     "value": [float(10 * (i % 9)) for i in range(n)], "props": [f'{{"k": {i % 4}}}' for i in range(n)]})


def late_batches():
    """Batches whose times go on by hours, each with posts from long before."""
    rng = random.Random(7)
    out = []
    for b in range(6):
        now = DAY + dt.timedelta(hours=4 * b)
        times = [now + dt.timedelta(minutes=rng.randint(0, 239)) for _ in range(20)]
        times += [now - dt.timedelta(hours=rng.randint(5, 30), minutes=rng.randint(0, 59)) for _ in range(4 if b > 1 else 0)]
        out.append(times)
    return out


@pytest.mark.parametrize("collection", ["metricsByHourAndParty", "sentimentRunningByHourAndParty", "sourceRunningByHourAndParty"])
def test_late_posts_reach_the_cube(spark, scratch, collection):
    arriving, raw = os.path.join(scratch, "arriving"), os.path.join(scratch, "raw")
    os.makedirs(arriving)
    os.makedirs(raw)
    parts = []
    cube, side = os.path.join(scratch, "cube"), os.path.join(scratch, "side")

    def run(start):
        q = start({"availableNow": True})
        q.awaitTermination(300)
        assert q.exception() is None

    dropped = False
    for half in (slice(0, 4), slice(4, 6)):
        for k, times in list(enumerate(late_batches()))[half]:
            parts.append(events(times, 100 * k))
            pq.write_table(parts[-1], os.path.join(arriving, f"part-{k}.parquet"))
        pq.write_table(pa.concat_tables(parts), os.path.join(raw, "events.parquet"))
        stream = lambda: read_event_stream(spark, arriving, max_files_per_trigger=1)
        run(lambda t: start_hourly_cube(live_updates(stream(), collection, watermark="2 hours"), cube, os.path.join(scratch, "ckpt"), t))
        run(lambda t: start_late_posts(stream(), side, os.path.join(scratch, "late-ckpt"), "2 hours", t))
        source = TableCubes(spark, raw)
        want = source.cube(collection)
        r = lambda df: [tuple(round(v, 9) if isinstance(v, float) else v for v in x) for x in rows(df.select(*want.columns))]
        dropped |= r(read_cube(spark, cube)) != r(want)
        assert correct_hours(source, side, cube, collection) > 0
        assert r(read_cube(spark, cube)) == r(want)
        assert pending(spark, side, collection) is None and correct_hours(source, side, cube, collection) == 0
    assert dropped  # without the correction posts are missing


def test_nothing_late(spark, scratch):
    assert pending(spark, scratch, "metricsByHourAndParty") is None
    assert correct_hours(TableCubes(spark, scratch), scratch, os.path.join(scratch, "cube"), "metricsByHourAndParty") == 0
