"""A key holding a third of all rows: AQE splits the hot join partition and
the answer is unchanged."""

import os

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq

from cubewise.plans.bindings import TableCubes
from cubewise.plans.oracle import registered_sql
from cubewise.plans.registry import route_specs
from tests.conftest import SF_SMALL
from tests.oracle_compare import TABLES, compare, duck

SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1KB",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


def skewed_tables(folder: str) -> str:
    """sf0.001 tables, with lineitem grown so that one part key holds over a
    third of all lines (copies of real lines moved to that key)."""
    for name in TABLES:
        if name == "lineitem":
            continue
        os.symlink(f"{SF_SMALL}/{name}.parquet", os.path.join(folder, f"{name}.parquet"))
    li = pq.read_table(f"{SF_SMALL}/lineitem.parquet")
    hot = li.slice(0, li.num_rows).set_column(
        li.schema.get_field_index("l_partkey"), "l_partkey", pa.array([1] * li.num_rows, pa.int64()))
    skewed = pa.concat_tables([li, hot])
    share = pc.sum(pc.equal(skewed["l_partkey"], 1)).as_py() / skewed.num_rows
    assert share > 1 / 3
    pq.write_table(skewed, os.path.join(folder, "lineitem.parquet"))
    return folder


def test_hot_part_key_is_split_and_answers_match(spark, scratch):
    folder = skewed_tables(scratch)
    old = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    try:
        for k, v in SKEW_CONF.items():
            spark.conf.set(k, v)
        spec = {s.key: s for s in route_specs()}["mostUsedHashtags__all"]
        df = spec.run(TableCubes(spark, folder))
        ok, msg = compare(df, duck(folder), registered_sql()[spec.key])
        assert ok, msg
        final = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin(skew=true)" in final, final[:3000]
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
