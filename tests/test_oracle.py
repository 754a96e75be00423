"""Every registered route against its DuckDB SQL on the sf0.001 tables."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL
from tests.oracle_compare import compare, duck, type_mismatches

QUERIES = E.queries()
SQL = E.oracle_sql()
ROUTES = [k for k in QUERIES if "__" in k]
EXTRAS = [k for k in QUERIES if k.startswith(("facts_", "stored_", "documents_", "ordered_", "allowed_", "top100_", "iso_"))]


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_registry_covers_every_shape_and_family():
    from cubewise.catalog import FAMILIES

    routes = [k for k in ROUTES if not k.endswith("__json")]
    assert len(routes) == sum(len(f.shapes) for f in FAMILIES) == 113
    assert len(ROUTES) == 113 + 33  # and the documents of a family of each group, in every shape
    assert set(ROUTES) <= set(SQL)
    assert {k.split("__")[0] for k in ROUTES} == {f.name for f in FAMILIES}


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["month", "rank", "hashtag", "total"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(ROUTES))
def test_route_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    ok, msg = compare(df, con, SQL[name])
    assert ok, msg
    assert not type_mismatches(df, con, SQL[name])


@pytest.mark.parametrize("name", sorted(EXTRAS))
def test_other_ways_to_an_answer_match_the_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    ok, msg = compare(df, con, SQL[name])
    assert ok, msg
    assert not type_mismatches(df, con, SQL[name])


def test_the_oracle_states_its_own_values():
    import ast
    import inspect

    from cubewise import catalog
    from cubewise.plans import oracle

    assert len(EXTRAS) == 39
    tree = ast.parse(inspect.getsource(oracle))
    assert not [n for n in ast.walk(tree) if isinstance(n, ast.ImportFrom) and n.level]  # nothing of the library
    assert [(f.name, f.cube, f.item, f.n) for f in oracle.FAMILIES] == [(f.name, f.cube, f.item, f.n) for f in catalog.FAMILIES]


def test_a_cut_of_100_is_reached(spark):
    from pyspark.sql import functions as F

    df = QUERIES["top100_users_legislatur"](spark, SF_SMALL)
    assert df.groupBy("party").count().agg(F.min("count"), F.max("count")).first() == (100, 100)
