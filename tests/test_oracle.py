"""Every registered query against its DuckDB oracle (the correctness gate), at sf0.001."""

import os

import pytest

import __spark_entry__ as E
from oracle_compare import compare
from spineworks.plans.registry import QUERIES as LIBRARY

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = E.queries(), E.oracle_sql()


def test_every_library_query_has_an_oracle():
    # optional operators that SQL cannot express are tested by brute force instead
    assert set(LIBRARY) <= set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, name):
    r = compare(spark, name, SF, QUERIES, ORACLES)
    assert r["ok"], r


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns[0] == "month_date"
    assert df.count() >= 0
