"""Run a registered query in Spark and its SQL in DuckDB and compare.

Used by the test suite (sf0.001) and by ``check_oracle.py`` (any scale).
Comparison: same column names, same row count, and the same multiset of rows
(values compared exactly, floats after rounding to 9 places).
"""

from __future__ import annotations

import math

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        if math.isnan(v):
            return (1, "nan")
        return (1, repr(round(v, 9)))
    return (1, str(v))


def _rows(cols, tuples):
    order = sorted(range(len(cols)), key=lambda i: cols[i].lower())
    return sorted(tuple(_norm(r[i]) for i in order) for r in tuples)


def compare(spark_df, con, sql: str) -> tuple[bool, str]:
    s_cols = spark_df.columns
    s_rows = [tuple(r) for r in spark_df.collect()]
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    if sorted(c.lower() for c in s_cols) != sorted(c.lower() for c in d_cols):
        return False, f"columns differ: spark={s_cols} duckdb={d_cols}"
    if len(s_rows) != len(d_rows):
        return False, f"row count differs: spark={len(s_rows)} duckdb={len(d_rows)}"
    a, b = _rows(s_cols, s_rows), _rows(d_cols, d_rows)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        return False, f"values differ ({sum(x != y for x, y in zip(a, b))} rows), e.g. {diff}"
    return True, f"{len(s_rows)} rows"


def duck_types(con, sql: str) -> dict[str, str]:
    rel = con.sql(sql)
    return {c.lower(): str(t) for c, t in zip(rel.columns, rel.types)}


SPARK_TO_DUCK = {"string": "VARCHAR", "bigint": "BIGINT", "double": "DOUBLE", "int": "INTEGER",
                 "boolean": "BOOLEAN", "date": "DATE"}


def type_mismatches(spark_df, con, sql: str) -> list[str]:
    d = duck_types(con, sql)
    out = []
    for f in spark_df.schema.fields:
        s = SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString())
        if d.get(f.name.lower()) != s:
            out.append(f"{f.name}: spark {s} vs duckdb {d.get(f.name.lower())}")
    return out
