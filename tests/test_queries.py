"""Every relational, text, graph, vector, version and command query against DuckDB."""

import math

import duckdb
import pytest

from tessera import queries
from tessera.sources.files import TABLES
from tests.conftest import SF


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    return v.isoformat() if hasattr(v, "isoformat") else v


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", queries.queries())
def test_query(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    want = duck.sql(queries.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def plan(df):
    return df._jdf.queryExecution().toString()


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(queries.queries()["filter_between"](spark, SF))
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThanOrEqual(o_totalprice,1000.0)" in text
    assert "o_orderdate" not in text.split("== Physical Plan ==")[1]


def test_null_safe_join_is_an_equi_join(spark):
    assert "NestedLoop" not in plan(queries.queries()["join_null_safe"](spark, SF))


def test_top_k_does_not_sort_everything(spark):
    assert "TakeOrderedAndProject" in plan(queries.queries()["topn_slowest"](spark, SF))
