"""A spread of the registered queries against DuckDB on the smallest tables, and the driver's contract."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from babelframe.queries import CASES, TABLES
from babelframe.verify.checks import normal

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the driver's tables are not here")


@pytest.mark.parametrize("name", sorted(CASES)[::3])
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df, cur = CASES[name](spark, DIR), con.execute(CASES[name].check)
    cols = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(cols)
    pick = lambda r, names: tuple(normal(v) for _, v in sorted(zip(names, r, strict=True)))
    key = lambda r: tuple(str(v) for v in r)
    got = sorted((pick(r, df.columns) for r in df.collect()), key=key)
    want = sorted((pick(r, cols) for r in cur.fetchall()), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(x == y or (isinstance(x, float) and math.isclose(x, y, rel_tol=1e-6)) for x, y in zip(a, b, strict=True)), (a, b)


def test_contract(spark):
    assert set(CASES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


def test_plans_push_down(spark):
    plan = CASES["b_count_filtered"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,purchase)]" in plan and "ReadSchema: struct<event_type:string>" in plan
