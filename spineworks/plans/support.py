"""Support-ticket statistics and monthly ticket metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spineworks.functions import avg_half_up, exact_avg, month_last_day, month_start
from spineworks.operators.shares import group_counts
from spineworks.operators.spine import month_after
from spineworks.operators.trend import diff_previous
from spineworks.plans.params import Params
from spineworks.sources.calendar import month_spine


def resolution_stats(t: DataFrame, p: Params) -> DataFrame:
    h = F.col("resolution_time_hours")
    return t.agg(exact_avg(h).alias("avg_resolution_time_hours"),
                 F.min(h).alias("min_resolution_time_hours"),
                 F.max(h).alias("max_resolution_time_hours"))


def count_escalation(t: DataFrame, p: Params) -> DataFrame:
    return group_counts(t, "escalation_flag", name="tickets")


def first_response_range(t: DataFrame, p: Params) -> DataFrame:
    c = F.col("first_response_time_minutes")
    return t.agg(F.min(c).alias("min_first_response_minutes"),
                 F.max(c).alias("max_first_response_minutes"))


def avg_satisfaction(t: DataFrame, p: Params) -> DataFrame:
    return t.agg(exact_avg("satisfaction_score").alias("avg_satisfaction_score"))


def count_satisfaction(t: DataFrame, p: Params) -> DataFrame:
    return group_counts(t, "satisfaction_score", name="tickets")


def submitted_range(t: DataFrame, p: Params) -> DataFrame:
    c = F.col("submitted_at")
    return t.agg(F.max(c).alias("max_submitted_at"), F.min(c).alias("min_submitted_at"))


def _at_max(t: DataFrame, column: str) -> DataFrame:
    # Rows holding the column's maximum: the maximum is one global row, so
    # broadcasting it is bounded.
    top = t.agg(F.max(column).alias("_max"))
    return t.join(F.broadcast(top), F.col(column) == F.col("_max"), "left_semi")


def escalation_at_max_resolution(t: DataFrame, p: Params, hours=None) -> DataFrame:
    """Escalation counts among tickets with the longest resolution time (or ``hours``)."""
    rows = _at_max(t, "resolution_time_hours") if hours is None else t.where(
        F.col("resolution_time_hours") == F.lit(hours))
    return group_counts(rows, "escalation_flag", name="tickets")


def tickets_at_max_response(t: DataFrame, p: Params, minutes=None) -> DataFrame:
    """Tickets with the longest first response time (or ``minutes``)."""
    if minutes is None:
        return _at_max(t, "first_response_time_minutes")
    return t.where(F.col("first_response_time_minutes") == F.lit(minutes))


def _ticket_months(p: Params):
    # Plain bounds on the timestamp itself, which reach the scan.
    m, at = month_start("submitted_at"), F.col("submitted_at")
    last = month_after(p.ticket_calendar_end)
    return m, (at >= F.lit(p.ticket_calendar_start).cast("timestamp_ntz")) & (at < F.lit(last).cast("timestamp_ntz"))


def tickets_per_month(t: DataFrame, p: Params, fill_gaps: bool = False) -> DataFrame:
    """Tickets per spine month (month of submission) and change vs previous month.

    By default months without tickets are absent (the original inner join),
    so the change spans the gap; ``fill_gaps`` reports them with 0 tickets.
    """
    m, in_cal = _ticket_months(p)
    per = (t.where(F.col("submitted_at") >= F.lit(p.ticket_window_start))
           .withColumn("month_date", m).where(in_cal)
           .groupBy("month_date").agg(F.count("month_date").alias("ticket")))
    if fill_gaps:
        spine = month_spine(t.sparkSession, p.ticket_calendar_start, p.ticket_calendar_end)
        # Both sides hold at most one row per calendar month; the right side
        # of a left join is the one that can be broadcast.
        per = spine.join(F.broadcast(per), "month_date", "left").select(
            "month_date", F.coalesce(F.col("ticket"), F.lit(0)).alias("ticket"))
    return per.select("month_date", "ticket", diff_previous("ticket").alias("diff"))


def ticket_satisfaction_per_month(t: DataFrame, p: Params) -> DataFrame:
    """Tickets and average satisfaction per month, month end taken at midnight.

    Membership ``m <= submitted_at <= last day of m 00:00`` is an equality on
    the submission month plus a cut at the last midnight, so no range join.
    """
    m, in_cal = _ticket_months(p)
    sub_at = F.col("submitted_at")
    rows = (t.where(sub_at >= F.lit(p.ticket_window_start))
            .withColumn("month_date", m).where(in_cal)
            .where(sub_at <= month_last_day(sub_at).cast("timestamp_ntz")))
    return rows.groupBy("month_date").agg(
        F.count("submitted_at").alias("ticket_amount"),
        avg_half_up("satisfaction_score").alias("avg_support_satisfaction"))


def tickets_in_range(t: DataFrame, p: Params) -> DataFrame:
    """Tickets submitted from the first month's start to its last day at midnight."""
    lo = F.lit(p.ticket_calendar_start).cast("timestamp_ntz")
    hi = month_last_day(F.lit(p.ticket_calendar_start)).cast("timestamp_ntz")
    return t.where(F.col("submitted_at").between(lo, hi)).agg(
        F.count(F.lit(1)).alias("ticket_count"))
