"""Reports read from the written clean tables equal reports from the sources."""

import tempfile

import pytest

from spineworks.plans.params import FIXTURE_PARAMS as P
from spineworks.plans.warehouse import WarehouseTables, materialize
from spineworks.plans.registry import QUERIES
from spineworks.plans.tables import Tables

SF = "/root/testdata/sf0.001"
NAMES = ("active_end_month_included", "accrued_revenue", "revenue_by_industry_pivot",
         "subs_without_usage", "null_profile", "clean_usage", "churn_reconciliation",
         "account_sub_attributes", "key_card_usage", "table_shapes")


@pytest.fixture(scope="module")
def warehouse(spark):
    target = tempfile.mkdtemp(prefix="spineworks-wh-test-")
    materialize(Tables(spark, SF), target)
    return WarehouseTables(spark, target, Tables(spark, SF))


def _bag(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


@pytest.mark.parametrize("name", NAMES)
def test_warehouse_equals_source(spark, warehouse, name):
    assert _bag(QUERIES[name](warehouse, P)) == _bag(QUERIES[name](Tables(spark, SF), P))
