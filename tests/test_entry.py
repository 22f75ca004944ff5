"""Every registered query of the engine against DuckDB on the same tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry
from pipeloom import workload, workload_io


@pytest.fixture(scope="module")
def duck(data):
    found = duckdb.connect()
    for name in workload.TABLES:
        path = f"{data}/{name}.parquet"
        found.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return found


def compare(df, duck, sql):
    rows, columns = [tuple(r) for r in df.collect()], df.columns
    found = duck.sql(sql)
    assert sorted(columns) == sorted(found.columns)
    place = [list(found.columns).index(c) for c in columns]
    expected = [tuple(r[k] for k in place) for r in found.fetchall()]
    assert sorted(map(repr, rows)) == sorted(map(repr, expected))


@pytest.mark.parametrize("name", workload.PAIRS)
def test_query(spark, data, duck, name):
    compare(workload.queries()[name](spark, data), duck, workload.oracle_sql()[name])


@pytest.mark.parametrize("name", workload_io.PAIRS)
def test_sources_and_special_values(spark, data, duck, name):
    compare(workload_io.queries()[name](spark, data), duck, workload_io.oracle_sql()[name])


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_registration():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert {*workload.PAIRS, *workload_io.PAIRS} <= set(queries) and set(sql) <= set(queries)


def test_plan_pushes_filters_and_prunes_columns(spark, data):
    plan = workload.queries()["tpch_q6"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_" in plan and "ReadSchema: struct<l_quantity:double,l_extendedprice:double,l_discount:double,l_shipdate:" in plan
    assert "l_orderkey" not in plan and "l_comment" not in plan
