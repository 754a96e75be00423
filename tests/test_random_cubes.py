"""Randomized cubes against brute-force Python answers (ties are frequent:
few items, small counts)."""

import datetime as dt
from collections import defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from cubewise.operators.history import top_items
from cubewise.operators.live import day_leader, month_by_day, month_top_items
from tests.conftest import rows

PARTIES = ["A", "B", "C"]
ITEMS = ["i1", "i2", "i3", "i4", "x"]
AS_OF = dt.date(2024, 2, 10)  # a 29-day month

SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))

item_rows = st.lists(
    st.tuples(st.sampled_from(PARTIES), st.sampled_from([2023, 2024]), st.integers(1, 3),
              st.sampled_from(ITEMS), st.integers(1, 4).map(float)),
    min_size=1, max_size=40)

hourly_rows = st.lists(
    st.tuples(st.sampled_from(PARTIES), st.sampled_from([1, 2, 2, 2]), st.integers(1, 29), st.integers(0, 23),
              st.sampled_from(ITEMS), st.integers(1, 3).map(float)),
    min_size=1, max_size=60)


def brute_top(rows_, keyf, n):
    totals = defaultdict(float)
    for r in rows_:
        totals[keyf(r)] += r[-1]
    groups = defaultdict(list)
    for (g, item), t in totals.items():
        groups[g].append((item, t))
    out = []
    for g, lst in groups.items():
        lst.sort(key=lambda e: (-e[1], e[0]))
        out += [(*g, rank + 1, item, t) for rank, (item, t) in enumerate(lst[:n])]
    return sorted(out)


@SETTINGS
@given(data=item_rows, n=st.integers(1, 4))
def test_top_items_match_brute_force(spark, data, n):
    cube = spark.createDataFrame(data, "party string, year bigint, month bigint, hashtag string, count double")
    got = rows(top_items(cube, "hashtag", "month", n, year=2024))
    want = brute_top([r for r in data if r[1] == 2024], lambda r: ((r[0], r[2]), r[3]), n)
    assert got == want


@SETTINGS
@given(data=hourly_rows)
def test_live_month_routes_match_brute_force(spark, data):
    schema = "party string, month bigint, day bigint, hour bigint, source string, count double"
    cube = spark.createDataFrame(data, schema).selectExpr("party", "2024L AS year", "month", "day", "hour",
                                                          "source", "count")
    feb = [r for r in data if r[1] == 2]
    parties = sorted({r[0] for r in feb})
    # zero-filled daily sums
    sums = defaultdict(float)
    for r in feb:
        sums[(r[0], r[2])] += r[-1]
    want = sorted((p, d, sums.get((p, d), 0.0)) for p in parties for d in range(1, 30))
    assert rows(month_by_day(cube, AS_OF)) == want
    # top-3 items per (party, day), empty-filled
    top = brute_top(feb, lambda r: ((r[0], r[2]), r[4]), 3)
    present = {(p, d) for p, d, *_ in top}
    want_items = sorted([(p, d, item, t) for p, d, _, item, t in top] +
                        [(p, d, None, None) for p in parties for d in range(1, 30) if (p, d) not in present])
    got = sorted(month_top_items(cube, "source", AS_OF, n=3).collect(), key=lambda r: (r[0], r[1], r[2] or ""))
    assert [tuple(r) for r in got] == sorted(want_items, key=lambda r: (r[0], r[1], r[2] or ""))
    # leader of the day
    day = [r for r in feb if r[2] == AS_OF.day]
    lead = brute_top(day, lambda r: ((r[0],), r[4]), 1)
    assert rows(day_leader(cube, "source", AS_OF)) == sorted((p, item) for p, _, item, _ in lead)
