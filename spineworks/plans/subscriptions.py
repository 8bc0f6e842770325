"""Active, new and lost subscriptions per month."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spineworks.functions import (
    days_between, last_counted_month, month_last_day, month_start, percent_half_up, whole_months)
from spineworks.operators.spine import (
    clip_range, expand_months, in_months, not_ended_before, spread, started_by)
from spineworks.operators.trend import diff_previous
from spineworks.plans.params import Params



def _trial():
    return F.col("is_trial") == True  # noqa: E712


def active_end_month_included(sub: DataFrame, p: Params) -> DataFrame:
    """Active per month, counting the month in which a subscription ends.

    Member of month m: ended on/after the window start or open, m >= the
    start month, m <= coalesce(end, horizon).
    """
    members = sub.where(not_ended_before(p.window_start) & started_by(p.calendar_end))
    return spread(members, month_start(F.col("start_date")),
                  month_start(F.coalesce(F.col("end_date"), F.lit(p.open_end_horizon))),
                  p.calendar_start, p.calendar_end,
                  {"active_subscriptions": F.count(F.lit(1)),
                   "trial_subscriptions": F.count(F.when(_trial(), 1))})


def _active_at_month_end(sub: DataFrame, p: Params) -> DataFrame:
    # Member of month m: started by m's last day, ended on/after it or open.
    members = sub.where(started_by(p.calendar_end) & not_ended_before(p.calendar_start))
    return spread(members, month_start(F.col("start_date")), last_counted_month(F.col("end_date")),
                  p.calendar_start, p.calendar_end,
                  {"active_subscriptions": F.count("subscription_id"),
                   "trial_subs": F.count(F.when(_trial(), F.col("subscription_id")))})


def active_at_month_end(sub: DataFrame, p: Params) -> DataFrame:
    """Active at each month's last day, change vs previous month, trial share."""
    m = _active_at_month_end(sub, p)
    return m.select("month_date", "active_subscriptions",
                    diff_previous("active_subscriptions").alias("diff_subscriptions"),
                    "trial_subs",
                    percent_half_up("trial_subs", "active_subscriptions").alias("trial_perc"))


def _ended_in_calendar(sub: DataFrame, p: Params) -> DataFrame:
    # m <= end <= last day of m is an equality on the end's month: no range join.
    return sub.where(in_months("end_date", p.calendar_start, p.calendar_end)).withColumn(
        "month_date", month_start(F.col("end_date")))


def lost_per_month(sub: DataFrame, p: Params) -> DataFrame:
    """Subscriptions whose end date falls in each spine month."""
    return _ended_in_calendar(sub, p).groupBy("month_date").agg(
        F.count(F.lit(1)).alias("lost_active_subscriptions"),
        F.count(F.when(_trial(), 1)).alias("lost_trials"))


def lost_rows(sub: DataFrame, p: Params, month=None, subscription_id=None) -> DataFrame:
    """Row listing behind ``lost_per_month`` (optionally one month and/or id)."""
    rows = _ended_in_calendar(sub, p)
    if month is not None:
        rows = rows.where(F.col("month_date") == F.lit(month))
    if subscription_id is not None:
        rows = rows.where(F.col("subscription_id") == F.lit(subscription_id))
    return rows.select("month_date", "subscription_id", "start_date", "end_date",
                       days_between(F.col("end_date"), F.col("month_date")).alias("duration_days"))


def _active_and_lost(sub: DataFrame, p: Params, member, lo, hi, counted) -> DataFrame:
    """Both counts of each month in one pass: a row enters its active range and its lost month.

    ``counted`` is what the active counts count. Columns ``_active`` and
    ``_lost`` hold the rows of each kind, for months with rows of one kind
    only.
    """
    ended, end = in_months("end_date", p.calendar_start, p.calendar_end), month_start(F.col("end_date"))
    kinds = F.array_compact(F.array(
        F.when(member, F.struct(lo.alias("lo"), hi.alias("hi"), F.lit(True).alias("active"))),
        F.when(ended, F.struct(end.alias("lo"), end.alias("hi"), F.lit(False).alias("active")))))
    rows = sub.where(member | ended).select("subscription_id", "is_trial", F.explode(kinds).alias("k"))
    active, lost = F.col("k.active"), ~F.col("k.active")
    return spread(rows, F.col("k.lo"), F.col("k.hi"), p.calendar_start, p.calendar_end, {
        "active_subscriptions": F.count(F.when(active, counted)),
        "trial_subscriptions": F.count(F.when(active & _trial(), counted)),
        "lost_active_subscriptions": F.count(F.when(lost, 1)), "lost_trials": F.count(F.when(lost & _trial(), 1)),
        "_active": F.count(F.when(active, 1)), "_lost": F.count(F.when(lost, 1))})


def active_vs_lost(sub: DataFrame, p: Params, fill_gaps: bool = False) -> DataFrame:
    """Active (end month included) next to lost.

    By default only months having both appear (the original inner join);
    ``fill_gaps`` keeps every active month and reports 0 losses where none
    occurred. One scan of the subscriptions.
    """
    member = not_ended_before(p.window_start) & started_by(p.calendar_end)
    m = _active_and_lost(sub, p, member, month_start(F.col("start_date")),
                         month_start(F.coalesce(F.col("end_date"), F.lit(p.open_end_horizon))), F.lit(1))
    m = m.where(F.col("_active") > 0)
    return (m if fill_gaps else m.where(F.col("_lost") > 0)).drop("_active", "_lost")


def lost_trend(sub: DataFrame, p: Params) -> DataFrame:
    """Ended per month (started by the month's end), change and trial share."""
    m = (_ended_in_calendar(sub, p).where(F.col("start_date") <= month_last_day(F.col("end_date")))
         .groupBy("month_date")
         .agg(F.count("subscription_id").alias("ended_subscriptions"),
              F.count(F.when(_trial(), F.col("subscription_id"))).alias("trial_subs")))
    return m.select("month_date", "ended_subscriptions",
                    diff_previous("ended_subscriptions").alias("diff_subscriptions"),
                    "trial_subs",
                    percent_half_up("trial_subs", "ended_subscriptions").alias("trial_perc"))


def active_unbounded_vs_lost(sub: DataFrame, p: Params) -> DataFrame:
    """Earlier report: active counted from the start month with no end bound, next to lost (one scan)."""
    m = _active_and_lost(sub, p, started_by(p.calendar_end), month_start(F.col("start_date")),
                         F.lit(p.calendar_end), F.col("subscription_id"))
    return m.where("_active > 0 and _lost > 0").drop("_active", "_lost")


def active_rows_closed_only(sub: DataFrame, p: Params) -> DataFrame:
    """(subscription, month) rows active at month end, ended subscriptions only."""
    closed = sub.where((F.col("end_date") >= F.lit(p.calendar_start)) & started_by(p.calendar_end))
    lo, hi = clip_range(month_start(F.col("start_date")), last_counted_month(F.col("end_date")),
                        p.calendar_start, p.calendar_end)
    rows = expand_months(closed.withColumn("_lo", lo).withColumn("_hi", hi), "_lo", "_hi")
    return rows.select("subscription_id", "month_date", "start_date", "end_date")


def count_open_subs(sub: DataFrame, p: Params) -> DataFrame:
    return sub.where(F.col("end_date").isNull()).agg(F.count(F.lit(1)).alias("open_subscriptions"))


def count_ended_by(sub: DataFrame, p: Params) -> DataFrame:
    return sub.where(F.col("end_date") <= F.lit(p.ended_by)).agg(
        F.count(F.lit(1)).alias("ended_subscriptions"))


def open_sub_ids(sub: DataFrame, p: Params) -> DataFrame:
    return sub.where(F.col("end_date").isNull()).select("subscription_id").distinct()


def ended_in_month(sub: DataFrame, p: Params, trials_only: bool = False) -> DataFrame:
    rows = sub.where(in_months("end_date", p.ended_month, p.ended_month))
    if trials_only:
        rows = rows.where(_trial())
    return rows.select("subscription_id", "start_date", "end_date")


def new_per_month(account: DataFrame, sub: DataFrame, p: Params) -> DataFrame:
    """Account signups and subscription starts per month (months having both)."""
    acc = account.groupBy(month_start("signup_date").alias("signup_month")).agg(
        F.count(F.lit(1)).alias("number_of_account_signups"))
    subs = sub.groupBy(month_start("start_date").alias("start_month")).agg(
        F.count(F.lit(1)).alias("number_of_started_subscriptions"))
    return acc.join(subs, acc.signup_month == subs.start_month).select(
        "signup_month", "number_of_account_signups", "number_of_started_subscriptions")


def starts_per_month(sub: DataFrame, p: Params) -> DataFrame:
    return sub.groupBy(month_start("start_date").alias("start_month")).agg(
        F.count(F.lit(1)).alias("started_subscriptions"))


def lifetime_value(sub: DataFrame, p: Params) -> DataFrame:
    """MRR times whole months from the start month to the end month (or the horizon)."""
    months = whole_months(F.coalesce(month_start(F.col("end_date")), F.lit(p.lifetime_horizon)),
                          month_start(F.col("start_date")))
    return sub.select("subscription_id",
                      (F.col("mrr_amount") * months).cast("double").alias("lifetime_value"))
