"""Every registered query with SQL gives the rows DuckDB gives; the others give rows."""

import pytest
from compare import compare, connect

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf, duck, name):
    problem = compare(QUERIES[name](spark, sf), duck, SQL[name], rel=1e-9)
    assert problem in ("", "no rows") if name == "filter_local" else problem == ""


@pytest.mark.parametrize("name", ["flagship", "elastic_net_path", "lambda_search", "partial_dependence", "stump_gam", "bagged_gam"])
def test_query_without_sql_gives_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns == ["feat_name", "feat_idx", "x_num", "x_cat", "y", "n", "importance"]
    assert out.count() > 50
