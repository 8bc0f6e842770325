"""Recompute one month with the independent check query (the original's own practice)."""

from pyspark.sql import functions as F

from spineworks.plans import revenue as R
from spineworks.plans import subscriptions as S
from spineworks.plans.params import FIXTURE_PARAMS as P
from spineworks.plans.tables import Tables

SF = "/root/testdata/sf0.01"


def _month(df, col):
    return {r["month_date"]: r[col] for r in df.collect()}[P.calendar_start]


def test_recurring_first_month_equals_direct_check(spark):
    sub = Tables(spark, SF).subscription
    strict = P.with_(strict_trial_filter=True)
    monthly = _month(R.recurring_revenue(sub, strict), "revenue")
    assert monthly == R.recurring_check(sub, P).first()["revenue"]


def test_accrued_first_month_equals_direct_check_without_trials(spark):
    sub = Tables(spark, SF).subscription
    monthly = _month(R.accrued_revenue(sub, P), "revenue_accrued")
    non_trial = sub.where(F.col("is_trial") == False)  # noqa: E712
    assert monthly == R.accrued_revenue_check(non_trial, P).first()["revenue_accrued"]


def test_membership_difference_is_ended_before_window(spark):
    sub = Tables(spark, SF).subscription
    diff = {r[0] for r in R.membership_difference(sub, P).collect()}
    want = {r[0] for r in sub.where(
        (F.col("is_trial") == False) & (F.col("start_date") <= F.lit(P.first_month_end))  # noqa: E712
        & (F.col("end_date") < F.lit(P.calendar_start))).select("subscription_id").collect()}
    assert diff == want and diff


def test_lost_rows_sum_to_lost_counts(spark):
    sub = Tables(spark, SF).subscription
    per = {r["month_date"]: r["lost_active_subscriptions"]
           for r in S.lost_per_month(sub, P).collect()}
    rows = S.lost_rows(sub, P).groupBy("month_date").count().collect()
    assert {r["month_date"]: r["count"] for r in rows} == per
