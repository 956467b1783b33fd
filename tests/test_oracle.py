"""Every catalog query against its DuckDB oracle at sf0.01 (multiset, bit-equal doubles)."""

import pytest

import __spark_entry__ as E
from data_dirs import SF01
from oracle_compare import compare
from quadrant.plans.catalog import QUERIES
from quadrant.plans.oracle import oracle_sql

NAMES = sorted(QUERIES)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(oracle_sql()) and set(QUERIES) <= set(E.queries()) and set(QUERIES) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con01, name):
    r = compare(spark, con01, SF01, name, E.queries()[name], E.oracle_sql()[name])
    assert r["columns_match"], r
    assert r["spark_rows"] == r["oracle_rows"], r
    assert r["values_match"], r


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["window_id", "id", "x", "y"]
    assert df.count() >= 0
