"""Values are served as stored; null keys are an error or dropped on purpose."""

import pytest
from pyspark.errors import PySparkException

from cubewise.functions.shape import to_nested_json
from cubewise.operators.history import period_values
from cubewise.plans.bindings import StoredCubes
from cubewise.plans.documents import route_json
from cubewise.plans.routes import answer
from cubewise.sources.cubes import null_key_rows, write_cube


def test_small_values_are_not_rounded(spark):
    cube = spark.createDataFrame([("A", 1997, 1e-8), ("A", 1998, 1234.56789012)], "party string, year int, count double")
    assert sorted(r.value for r in period_values(cube).collect()) == [1e-8, 1234.56789012]
    assert sorted(r.value for r in period_values(cube, digits=6).collect()) == [0.0, 1234.56789]


def hashtags(spark, root):
    df = spark.createDataFrame([("A", 1997, None, 5.0), ("A", 1997, "a", 4.0)], "party string, year int, hashtag string, count double")
    write_cube(df, StoredCubes(spark, root).path("hashtags", "year"))
    return df


def test_null_items_are_an_error_or_dropped(spark, scratch):
    df = hashtags(spark, scratch)
    assert null_key_rows(df, ["party", "hashtag"]) == 1
    with pytest.raises(PySparkException, match="null key"):
        answer(StoredCubes(spark, scratch), "mostUsedHashtagsCloud", "all").collect()
    kept = route_json(StoredCubes(spark, scratch, on_null="drop"), "mostUsedHashtagsCloud", "all").collect()
    assert [r.json for r in kept] == ['{"A":{"1997":{"a":4.0}}}']
    with pytest.raises(PySparkException):  # nothing is left out without being asked for
        route_json(StoredCubes(spark, scratch, on_null="keep"), "mostUsedHashtagsCloud", "all").collect()


def test_empty_days_stay_empty_objects(spark):
    df = spark.createDataFrame([("A", 1, "x", 2.0), ("A", 2, None, None)], "party string, day int, item string, total double")
    assert to_nested_json(df, ["party", "day", "item"], "total").first().json == '{"A":{"1":{"x":2.0},"2":{}}}'


def test_a_rebuilt_cube_is_read_anew(spark, scratch):
    stored = StoredCubes(spark, scratch)
    for value in (1.0, 2.0):
        df = spark.createDataFrame([("A", 1997, value)], "party string, year int, count double")
        write_cube(df, stored.path("countTotal", "year"))
        assert [r.value for r in answer(stored, "countTweetByMonth", "all").collect()] == [value]


def test_documents_respect_the_allowed_parties(spark, scratch):
    stored = StoredCubes(spark, scratch)
    with pytest.raises(ValueError):
        route_json(stored, "countTweetByMonth", "party", party="B", allowed_parties=("A",))


def test_a_cluster_needs_a_shared_checkpoint_folder():
    from types import SimpleNamespace

    from cubewise.session import checkpoint_dir

    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="yarn"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(fake)
