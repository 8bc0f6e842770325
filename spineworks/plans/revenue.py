"""Recurring and accrued revenue per month, and the plan / industry pivots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spineworks.functions import last_counted_month, month_start, whole_months
from spineworks.operators.spine import (
    clip_range, expand_months, not_ended_before, spread, started_by)
from spineworks.plans.params import Params


def _not_trial():
    return F.col("is_trial") == False  # noqa: E712


def _mrr():
    return F.col("mrr_amount")


def accrued_revenue(sub: DataFrame, p: Params) -> DataFrame:
    """Revenue accrued up to each month: MRR x whole months since the start date.

    Members of month m: not trial, started by m's last day, and (end or the
    accrual horizon) on/after m's last day. Earlier years accrue; the first,
    partial month does not (a start after the 1st loses one month).

    Rows are pre-aggregated by (start month, partial-start flag, last month),
    a key space of months^2 x 2, before expansion over the spine.
    """
    end = F.coalesce(F.col("end_date"), F.lit(p.accrual_horizon))
    members = sub.where(_not_trial() & started_by(p.calendar_end) & not_ended_before(p.calendar_start))
    lo_c, hi_c = clip_range(month_start("start_date"), last_counted_month(end),
                            p.calendar_start, p.calendar_end)
    pre = (members.select(month_start("start_date").alias("lo"),
                          (F.dayofmonth("start_date") > 1).cast("int").alias("partial"),
                          lo_c.alias("_lo"), hi_c.alias("_hi"), "mrr_amount", "seats")
           .where(F.col("_lo") <= F.col("_hi"))
           .groupBy("lo", "partial", "_lo", "_hi")
           .agg(F.sum("mrr_amount").alias("mrr"), F.sum("seats").alias("seats")))
    months = F.greatest(whole_months(F.col("month_date"), F.col("lo")) - F.col("partial"), F.lit(0))
    return (expand_months(pre, "_lo", "_hi")
            .groupBy("month_date")
            .agg(F.sum(F.col("mrr") * months).cast("double").alias("revenue_accrued"),
                 F.sum("seats").alias("seats")))


def accrued_revenue_check(sub: DataFrame, p: Params) -> DataFrame:
    """First-month accrued revenue recomputed directly (trials not excluded)."""
    m0, m0_end = p.calendar_start, p.first_month_end
    rows = sub.where((F.col("start_date") <= F.lit(m0_end))
                     & ((F.col("end_date") >= F.lit(m0_end)) | F.col("end_date").isNull()))
    return rows.agg(F.sum(whole_months(F.lit(m0), "start_date") * _mrr()).cast("double")
                    .alias("revenue_accrued"))


def _recurring_members(sub: DataFrame, p: Params) -> DataFrame:
    # "not trial AND ended on/after the window start OR open": AND binds
    # first, so open trials are members unless the strict filter is set.
    ended_late = F.col("end_date") >= F.lit(p.window_start)
    cond = (_not_trial() & ended_late) | F.col("end_date").isNull()
    if p.strict_trial_filter:
        cond = cond & _not_trial()
    return sub.where(cond & started_by(p.calendar_end))


def _recurring_range(p: Params):
    lo = month_start("start_date")
    hi = month_start(F.coalesce(F.col("end_date"), F.lit(p.open_end_horizon)))
    return lo, hi


def recurring_revenue(sub: DataFrame, p: Params) -> DataFrame:
    """Sum of MRR of member subscriptions per month (nothing carried over)."""
    lo, hi = _recurring_range(p)
    out = spread(_recurring_members(sub, p), lo, hi, p.calendar_start, p.calendar_end,
                 {"revenue": F.sum("mrr_amount")})
    return out.select("month_date", F.col("revenue").cast("double").alias("revenue"))


def recurring_rows(sub: DataFrame, account: DataFrame, p: Params) -> DataFrame:
    """(subscription, month) member rows joined to the account's industry."""
    lo, hi = _recurring_range(p)
    start, end = p.calendar_start, p.calendar_end
    lo_c, hi_c = clip_range(lo, hi, start, end)
    members = (_recurring_members(sub, p).where(F.col("start_date").isNotNull())
               .withColumn("_lo", lo_c).withColumn("_hi", hi_c)
               .where(F.col("_lo") <= F.col("_hi")))
    acc = account.select(F.col("account_id").alias("_acc"), "industry")
    joined = members.join(acc, members.account_id == acc._acc)
    rows = expand_months(joined, "_lo", "_hi")
    return rows.select(
        "subscription_id", "plan_tier", "industry", "month_date", "start_date",
        F.coalesce(F.col("end_date"), F.lit(p.open_end_horizon)).alias("end_date"),
        whole_months(F.col("month_date"), month_start("start_date")).alias("active_interval_months"),
        _mrr().cast("double").alias("mrr_amount"))


def _members_with_account(sub: DataFrame, account: DataFrame, p: Params) -> DataFrame:
    """Member rows with their month range, subscriptions inner-joined to accounts.

    The member rows are narrowed to (account, tier, start month, end month,
    MRR) and joined to the accounts first: co-located where both tables are
    bucketed by account; else AQE broadcasts the account side when its
    measured size allows, or sort-merge joins and splits a hot account's
    partition. The callers reduce the join output map-side per month range
    -- a tiny key space -- before the only other shuffle, and just that
    result is expanded over the spine.
    """
    lo, hi = _recurring_range(p)
    lo_c, hi_c = clip_range(lo, hi, p.calendar_start, p.calendar_end)
    members = (_recurring_members(sub, p).where(F.col("start_date").isNotNull())
               .select("account_id", "plan_tier", lo_c.alias("_lo"), hi_c.alias("_hi"),
                       "mrr_amount")
               .where(F.col("_lo") <= F.col("_hi")))
    acc = account.select(F.col("account_id").alias("_acc"), "industry")
    return members.join(acc, members.account_id == acc._acc)


def _long(members: DataFrame, by: str, out: str) -> DataFrame:
    grouped = members.groupBy(by, "_lo", "_hi").agg(F.sum("mrr_amount").alias("mrr"))
    rows = expand_months(grouped, "_lo", "_hi")
    return rows.groupBy("month_date", by).agg(F.sum("mrr").cast("double").alias(out))


def _pivot(members: DataFrame, by: str, values, labels) -> DataFrame:
    """One column for each value, as conditional sums from the first aggregate on.

    Member rows are reduced to one row for each month range with a sum for
    each value; only these are expanded over the spine and summed per month.
    """
    sums = [F.sum(F.when(F.col(by) == v, F.col("mrr_amount"))).alias(f"v{i}") for i, v in enumerate(values)]
    rows = expand_months(members.groupBy("_lo", "_hi").agg(*sums), "_lo", "_hi")
    return rows.groupBy("month_date").agg(
        *[F.sum(f"v{i}").cast("double").alias(lab) for i, lab in enumerate(labels)])


def revenue_by_plan_long(sub: DataFrame, account: DataFrame, p: Params) -> DataFrame:
    return _long(_members_with_account(sub, account, p), "plan_tier", "rev_plan_tier")


def revenue_by_industry_long(sub: DataFrame, account: DataFrame, p: Params) -> DataFrame:
    return _long(_members_with_account(sub, account, p), "industry", "rev_industry")


def revenue_by_plan_pivot(sub: DataFrame, account: DataFrame, p: Params) -> DataFrame:
    return _pivot(_members_with_account(sub, account, p), "plan_tier", p.plan_tiers, p.plan_tier_labels)


def revenue_by_industry_pivot(sub: DataFrame, account: DataFrame, p: Params) -> DataFrame:
    return _pivot(_members_with_account(sub, account, p), "industry", p.industries, p.industry_labels)


def recurring_check(sub: DataFrame, p: Params) -> DataFrame:
    """First-month recurring revenue recomputed directly."""
    m0, m0_end = p.calendar_start, p.first_month_end
    rows = sub.where((F.col("start_date") <= F.lit(m0_end)) & _not_trial()
                     & ((F.col("end_date") >= F.lit(m0)) | F.col("end_date").isNull()))
    return rows.agg(F.sum("mrr_amount").cast("double").alias("revenue"))


def _first_month_rows(sub: DataFrame, p: Params) -> DataFrame:
    # Non-trial subscriptions paired with the first spine month, started by then.
    m0 = F.lit(p.calendar_start)
    return (sub.where(_not_trial() & started_by(p.calendar_start))
            .withColumn("month_date", m0))


def recurring_rows_no_end_filter(sub: DataFrame, p: Params, subscription_id=None) -> DataFrame:
    """First-month rows without the end-date condition (shows ended ones leaking in)."""
    rows = _first_month_rows(sub, p)
    if subscription_id is not None:
        rows = rows.where(F.col("subscription_id") == F.lit(subscription_id))
    return rows.select(
        "subscription_id", "month_date", "start_date",
        F.coalesce(F.col("end_date"), F.lit(p.open_end_horizon)).alias("end_date"),
        whole_months(F.col("month_date"), month_start("start_date")).alias("active_interval_months"),
        _mrr().cast("double").alias("mrr_amount"))


def membership_difference(sub: DataFrame, p: Params) -> DataFrame:
    """Ids in the first-month rows without end filter EXCEPT ids of the direct check.

    One pass: an id may come from rows of both kinds, so both conditions are
    collected per id.
    """
    m0, m0_end = p.calendar_start, p.first_month_end
    loose = _not_trial() & started_by(p.calendar_start)
    strict = ((F.col("start_date") <= F.lit(m0_end)) & _not_trial()
              & ((F.col("end_date") >= F.lit(m0)) | F.col("end_date").isNull()))
    per_id = sub.where(loose | strict).groupBy("subscription_id").agg(
        F.bool_or(F.coalesce(loose, F.lit(False))).alias("_loose"),
        F.bool_or(F.coalesce(strict, F.lit(False))).alias("_strict"))
    return per_id.where("_loose and not _strict").select("subscription_id")


def accrual_inclusive(sub: DataFrame, p: Params, start_date=None) -> DataFrame:
    """First-month accrual counting the start month, floored at zero.

    The original spot check looks at one boundary start date; pass
    ``start_date`` for that, or leave it unset for every subscription.
    """
    m0 = F.lit(p.calendar_start)
    rows = sub.where(_not_trial()).withColumn("month_date", m0)
    if start_date is not None:
        rows = rows.where(F.col("start_date") == F.lit(start_date))
    months = whole_months(F.col("month_date"), month_start("start_date"))
    return rows.select(
        "subscription_id", "month_date", "start_date",
        F.coalesce(F.col("end_date"), F.lit(p.open_end_horizon)).alias("end_date"),
        months.alias("active_interval_months"),
        _mrr().cast("double").alias("mrr_amount"),
        F.greatest(_mrr() * (months + 1), F.lit(0)).cast("double").alias("revenue"))


def subscription_lookup(sub: DataFrame, ids: DataFrame) -> DataFrame:
    """Subscriptions whose id is in ``ids`` (a semi join; ``ids`` may be large)."""
    keys = ids.select(F.col("subscription_id").alias("_id"))
    return (sub.join(keys, sub.subscription_id == keys._id, "left_semi")
            .select("subscription_id", "start_date", "end_date",
                    _mrr().cast("double").alias("mrr_amount")))
