"""Latest lists and output shaping."""

import datetime as dt
import json

from cubewise.functions.shape import entries_json, pad2, to_nested_json
from cubewise.operators.latest import latest_items
from cubewise.plans.cubes import latest_lists
from tests.conftest import rows


def test_latest_items_numbers_newest_first(spark):
    lists = spark.createDataFrame([("combined", ["1", "2", "3"]), ("CDU", ["7"])], "key string, tweetIds array<string>")
    out = latest_items(lists, "combined")
    assert out.columns == ["key", "n", "tweet_id"]
    assert rows(out) == [("combined", 1, "3"), ("combined", 2, "2"), ("combined", 3, "1")]
    assert latest_items(lists, "SPD").count() == 0


def test_latest_lists_builder_keeps_n_newest_per_party_and_combined(spark):
    base = dt.datetime(2024, 1, 1)
    posts = spark.createDataFrame(
        [("CDU" if i % 3 else "SPD", base + dt.timedelta(minutes=i), i) for i in range(40)],
        "party string, ts timestamp, event_id bigint")
    lists = {r.key: r.tweetIds for r in latest_lists(posts, "event_id", n=5).collect()}
    assert lists["combined"] == ["35", "36", "37", "38", "39"]
    assert lists["SPD"] == ["27", "30", "33", "36", "39"]
    assert lists["CDU"] == ["32", "34", "35", "37", "38"]


def test_nested_json_for_ranked_month_result(spark):
    df = spark.createDataFrame(
        [("CDU", 2, 1, "a", 3.0), ("CDU", 2, 2, "b", 1.0), ("CDU", 10, 1, "c", 2.0), ("SPD", 2, 1, "d", 5.0)],
        "party string, month bigint, rank bigint, hashtag string, total double")
    from pyspark.sql import functions as F

    out = {r.key: json.loads(r.json) for r in to_nested_json(
        df, ["party", "month", "rank"], F.create_map("hashtag", "total"), pad=("month",)).collect()}
    assert out["CDU"] == {"CDU": {"02": {"1": {"a": 3.0}, "2": {"b": 1.0}}, "10": {"1": {"c": 2.0}}}}
    assert out["SPD"] == {"SPD": {"02": {"1": {"d": 5.0}}}}


def test_nested_json_empty_day_is_empty_map(spark):
    df = spark.createDataFrame([("CDU", 1, "x", 2.0), ("CDU", 2, None, None)],
                               "party string, day bigint, source string, total double")
    out = to_nested_json(df, ["party", "day", "source"], "total").first()
    assert json.loads(out.json) == {"CDU": {"1": {"x": 2.0}, "2": {}}}


def test_pad_and_entries(spark):
    df = spark.createDataFrame([("CDU", 3, 1.5)], "party string, m bigint, v double")
    assert df.select(pad2("m").alias("p")).first().p == "03"
    assert json.loads(entries_json(df, "party", "v").first().json) == {"CDU": 1.5}


def test_every_route_has_a_json_document(spark):
    from cubewise.plans.bindings import TableCubes
    from cubewise.plans.documents import route_json
    from cubewise.plans.registry import route_specs
    from tests.conftest import SF_SMALL

    raw = TableCubes(spark, SF_SMALL)
    docs = {}
    # all 33 shapes: every shape of the first family of each group, plus the spot-checked routes
    first_of_group, seen = [], set()
    for spec in route_specs():
        if spec.family.group not in seen or spec.family.name == first_of_group[-1]:
            seen.add(spec.family.group)
            if not first_of_group or first_of_group[-1] != spec.family.name:
                first_of_group.append(spec.family.name)
    spot = {"countTweetByMonth__year_month", "mostUsedHashtags__year_month_party", "liveSource__month_party",
            "liveTweets__all", "countTotalRunning__day"}
    for spec in route_specs():
        if spec.family.name not in first_of_group and spec.key not in spot:
            continue
        out = route_json(raw, spec.family.name, spec.shape, **spec.params).collect()
        assert out, spec.key
        docs[spec.key] = [json.loads(r.json) for r in out]
        if spec.shape.endswith("party") or spec.family.group == "latest":
            assert len(out) == 1, spec.key

    # value per month: two-digit month keys
    from cubewise.plans.routes import answer

    months = sorted(r.month for r in answer(raw, "countTweetByMonth", "year_month", year=1997)
                    .where("party = '1-URGENT'").collect())
    (cdu,) = [d for d in docs["countTweetByMonth__year_month"] if "1-URGENT" in d]
    assert sorted(cdu["1-URGENT"]) == [f"{m:02d}" for m in months]
    # one-party ranked: ordered list of single-key objects, rank -> {item: total}
    (lst,) = docs["mostUsedHashtags__year_month_party"]
    assert [list(x)[0] for x in lst] == [str(m) for m in months]
    first = lst[0]["1"]
    assert set(first) == {str(r) for r in range(1, len(first) + 1)}
    assert all(len(v) == 1 for v in first.values())
    # live month of items: 31 days, day 31 empty
    (click,) = docs["liveSource__month_party"]
    assert len(click) == 31 and click["31"] == {} and all(len(v) <= 10 for v in click.values())
    # latest: newest first numbering
    (latest,) = docs["liveTweets__all"]
    assert list(latest["combined"]) == [str(n) for n in range(1, 16)]
    # live day: one object per party
    assert all(len(d) == 1 for d in docs["countTotalRunning__day"])
