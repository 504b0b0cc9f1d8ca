"""Driver contract: entry(), queries() and oracle_sql(); every SQL-backed query is
compared with its DuckDB twin on the smallest driver tables."""

import pytest

import __spark_entry__ as E
from oracle_compare import compare, duck

SF = "/root/testdata/sf0.001"


def test_entry(spark):
    df = E.entry(spark)
    assert set(df.columns) >= {"dataset", "num_posts", "share_question"}
    assert df.count() > 0


def test_registry():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 20


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_oracle(spark, con, name):
    ok, a, b = compare(spark, name, E.queries()[name], E.oracle_sql()[name], SF, con)
    assert ok, f"{name}: {a} vs {b} rows"
