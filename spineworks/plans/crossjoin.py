"""The calendar cross-join formulation of the spine metrics.

This is how the original queries are written: every subscription paired
with every spine month, then filtered. It is kept as the reference
formulation -- tests compare the pre-aggregated operators with it, and the
benchmark times it as the baseline -- not for production use: it plans a
nested-loop join that emits rows x months before any aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spineworks.functions import month_last_day, month_start, whole_months
from spineworks.plans.params import Params
from spineworks.sources.calendar import month_spine


def _cross(sub: DataFrame, p: Params) -> DataFrame:
    return sub.crossJoin(month_spine(sub.sparkSession, p.calendar_start, p.calendar_end))


def active_end_month_included(sub: DataFrame, p: Params) -> DataFrame:
    m, s, e = F.col("month_date"), F.col("start_date"), F.col("end_date")
    return (_cross(sub, p).where((e >= F.lit(p.window_start)) | e.isNull())
            .where((m >= month_start(s)) & (m <= F.coalesce(e, F.lit(p.open_end_horizon))))
            .groupBy("month_date").agg(
                F.count(F.lit(1)).alias("active_subscriptions"),
                F.count(F.when(F.col("is_trial") == True, 1)).alias("trial_subscriptions")))  # noqa: E712


def accrued_revenue(sub: DataFrame, p: Params) -> DataFrame:
    m, s = F.col("month_date"), F.col("start_date")
    e = F.coalesce(F.col("end_date"), F.lit(p.accrual_horizon))
    return (_cross(sub, p)
            .where((s <= month_last_day(m)) & (F.col("is_trial") == False)  # noqa: E712
                   & (e >= month_last_day(m)))
            .groupBy("month_date").agg(
                F.sum(F.col("mrr_amount") * whole_months(m, s)).cast("double").alias("revenue_accrued"),
                F.sum("seats").alias("seats")))


def revenue_by_plan_pivot(sub: DataFrame, account: DataFrame, p: Params) -> DataFrame:
    m, s, e = F.col("month_date"), F.col("start_date"), F.col("end_date")
    member = ((F.col("is_trial") == False) & (e >= F.lit(p.window_start))) | e.isNull()  # noqa: E712
    rows = (_cross(sub, p).join(account.select("account_id"), "account_id").where(member)
            .where((m >= month_start(s)) & (F.coalesce(e, F.lit(p.open_end_horizon)) >= m)))
    long = rows.groupBy("month_date", "plan_tier").agg(
        F.sum("mrr_amount").cast("double").alias("rev_plan_tier"))
    wide = long.groupBy("month_date").pivot("plan_tier", list(p.plan_tiers)).agg(
        F.first("rev_plan_tier"))
    return wide.select("month_date", *[F.col(v).alias(lab)
                                       for v, lab in zip(p.plan_tiers, p.plan_tier_labels)])
