"""Latest lists with keyed state: moved and deleted posts equal the batch list."""

import datetime as dt
import os
import random

import pyarrow as pa
import pyarrow.parquet as pq

from cubewise.plans.cubes import latest_lists
from cubewise.streaming.changes import read_changing_lists, start_changing_lists
from tests.conftest import rows

SCHEMA = "event_id long, party string, ts timestamp, seq long, deleted boolean"
START = dt.datetime(2024, 1, 1)


def batches(seed=3, posts=400, steps=6):
    """Changes of posts, step by step, and the posts that are left after each."""
    rng = random.Random(seed)
    known, seq, out, last = {}, 0, [], []
    for step in range(steps):
        changes = []
        for _ in range(posts // steps):
            seq += 1
            oid = len(known) + 1
            known[oid] = [rng.choice("abc"), START + dt.timedelta(minutes=rng.randint(0, 5000)), seq, False]
            changes.append((oid, *known[oid]))
        newest = sorted((p for p in known if not known[p][3]), key=lambda p: known[p][1], reverse=True)
        # the newest posts go or move: lists must be refilled
        for oid in newest[:25] if step else []:
            seq += 1
            known[oid][2] = seq
            if rng.random() < 0.5:
                known[oid][3] = True
            else:
                known[oid][0] = rng.choice("abc")
                known[oid][1] -= dt.timedelta(minutes=rng.randint(0, 9000))
            changes.append((oid, *known[oid]))
        if last:  # an old change again, and out of order
            changes.append(last[0])
        rng.shuffle(changes)
        out.append((changes, {p: tuple(v) for p, v in known.items() if not v[3]}))
        last = changes
    # all posts of one party go
    gone = []
    for oid, v in known.items():
        if not v[3] and v[0] == "c":
            seq += 1
            v[2], v[3] = seq, True
            gone.append((oid, *v))
    return [*out, (gone, {p: tuple(v) for p, v in known.items() if not v[3]})]


def write(folder, number, changes):
    columns = list(zip(*changes))
    kinds = [pa.int64(), pa.string(), pa.timestamp("us", "UTC"), pa.int64(), pa.bool_()]
    pq.write_table(pa.table([pa.array([v.replace(tzinfo=dt.timezone.utc) if i == 2 else v for v in c], k) for i, (c, k) in enumerate(zip(columns, kinds))],
                            names=["event_id", "party", "ts", "seq", "deleted"]), os.path.join(folder, f"part-{number}.parquet"))


def test_moved_and_deleted_posts_equal_the_batch_list(spark, scratch):
    folder = os.path.join(scratch, "changes")
    os.makedirs(folder)
    steps = batches()
    for i, (changes, left) in enumerate(steps):
        write(folder, i, changes)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
        q = start_changing_lists(stream, os.path.join(scratch, "lists"), os.path.join(scratch, "ckpt"), shards=4, trigger={"availableNow": True})
        q.awaitTermination(300)  # ends and starts again after each step: state comes from the checkpoint
        assert q.exception() is None
        posts = spark.createDataFrame([(p, v[0], v[1]) for p, v in left.items()], "event_id long, party string, ts timestamp")
        assert rows(read_changing_lists(spark, os.path.join(scratch, "lists"))) == rows(latest_lists(posts, "event_id")), i
    assert "c" not in {r.key for r in read_changing_lists(spark, os.path.join(scratch, "lists")).collect()}
    assert sorted(os.listdir(os.path.join(scratch, "lists"))) == ["slot=0", "slot=1"]
