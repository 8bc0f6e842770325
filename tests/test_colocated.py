"""Stage tables bucketed by account: joins on the account shuffle neither side, and a hot account is still split."""

import re
import tempfile

import pytest
from pyspark.sql import functions as F

from spineworks.plans.params import FIXTURE_PARAMS as P
from spineworks.plans.registry import QUERIES
from spineworks.plans.tables import Tables
from spineworks.plans.warehouse import WarehouseTables, materialize

SF = "/root/testdata/sf0.001"
#: Reports that join subscriptions, accounts or churn events on the account.
JOINING = ("recurring_rows", "revenue_by_plan_long", "revenue_by_plan_pivot", "revenue_by_industry_long",
           "revenue_by_industry_pivot", "churn_reactivation_map", "account_sub_attributes", "days_to_start",
           "account_lifetime", "churn_reconciliation", "churn_summary")


@pytest.fixture
def shuffled_joins(spark):
    """No broadcast joins: the plans of large tables."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def _exchanges_below_joins(plan: str) -> list[str]:
    """Shuffles that feed a join, by the tree's indentation."""
    lines = [(len(re.match(r"[\s:+\-|*]*", x)[0]), x) for x in plan.splitlines() if x.strip()]
    found, joins = [], []
    for depth, text in lines:
        joins = [d for d in joins if d < depth]
        if "Exchange hashpartitioning" in text and joins:
            found.append(text.strip())
        if "Join " in text:
            joins.append(depth)
    return found


@pytest.fixture(scope="module")
def even(spark):
    folder = tempfile.mkdtemp(prefix="spineworks-colocated-")
    materialize(Tables(spark, SF), folder, buckets=4)
    return WarehouseTables(spark, folder)


@pytest.mark.parametrize("name", JOINING)
def test_no_shuffle_below_the_account_joins(spark, shuffled_joins, even, name):
    assert even.manifest["buckets"] == {"dedup_subscription": 4, "raw_account": 4, "churn_event": 4}
    plan = _final_plan(QUERIES[name](even, P))
    assert "Join " in plan and "Bucketed: true" in plan
    assert _exchanges_below_joins(plan) == []
    assert plan.count("FileScan") == 2, plan  # every table once
    bag = lambda df: sorted(map(repr, (tuple(r) for r in df.collect())))
    assert bag(QUERIES[name](even, P)) == bag(QUERIES[name](Tables(spark, SF), P))


def test_the_plan_check_sees_shuffles(spark, shuffled_joins):
    assert _exchanges_below_joins(_final_plan(QUERIES["days_to_start"](Tables(spark, SF), P)))


def test_a_hot_account_keeps_the_tables_plain(spark, shuffled_joins):
    class Hot(Tables):
        def _load(self, name):
            df = super()._load(name)
            if name == "subscription":
                hot = F.when(F.col("subscription_id") % 3 == 0, F.lit(7)).otherwise(F.col("account_id"))
                return df.withColumn("account_id", hot.cast(df.schema["account_id"].dataType))
            return df
    folder = tempfile.mkdtemp(prefix="spineworks-hot-")
    materialize(Hot(spark, SF), folder, buckets=8)
    tables = WarehouseTables(spark, folder)
    assert tables.manifest["buckets"] == {}
    # both sides are shuffled, so AQE can split the hot account (tests/test_skew.py shows that it does)
    assert len(_exchanges_below_joins(_final_plan(QUERIES["days_to_start"](tables, P)))) == 2
