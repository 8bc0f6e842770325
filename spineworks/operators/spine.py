"""Spreading interval memberships over a month spine.

A subscription counts in month m of the spine when ``lo <= m <= hi`` for two
month starts derived from its dates (the rule decides how). The naive form
crosses every row with every month and filters. Here rows are first reduced
to partial aggregates per (lo, hi, group keys) -- after clipping lo and hi to
the spine, there are at most months*(months+1)/2 ranges per group -- and only
that small result is expanded over its months with ``sequence``. The shuffle
carries partial aggregates, not rows x months, and no nested-loop join is
planned over the raw table.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _month():
    return F.expr("interval 1 month")


def month_after(day: dt.date) -> dt.date:
    """First day of the next month."""
    return (day.replace(day=1) + dt.timedelta(days=32)).replace(day=1)


def in_months(date: str, start: dt.date, end: dt.date) -> Column:
    """``date`` lies in the months start..end, as plain bounds that reach the scan."""
    return (F.col(date) >= F.lit(start)) & (F.col(date) < F.lit(month_after(end)))


def started_by(end: dt.date, date: str = "start_date") -> Column:
    """``date`` lies in month ``end`` or before, as a plain bound that reaches the scan."""
    return F.col(date) < F.lit(month_after(end))


def not_ended_before(start: dt.date, date: str = "end_date") -> Column:
    """``date`` is open or not before ``start``, as a plain bound that reaches the scan."""
    return F.col(date).isNull() | (F.col(date) >= F.lit(start))


def clip_range(lo: Column, hi: Column | None, start: dt.date, end: dt.date):
    """Clip a month range to the spine; a null ``hi`` means open-ended."""
    lo_c = F.greatest(lo, F.lit(start))
    hi_c = F.lit(end) if hi is None else F.least(F.coalesce(hi, F.lit(end)), F.lit(end))
    return lo_c, hi_c


def expand_months(df: DataFrame, lo: str, hi: str, out: str = "month_date") -> DataFrame:
    """One row per month from ``lo`` to ``hi`` (rows with lo > hi produce none)."""
    months = F.when(F.col(lo) <= F.col(hi), F.sequence(F.col(lo), F.col(hi), _month()))
    return df.withColumn(out, F.explode(months))


def spread(df: DataFrame, lo: Column, hi: Column | None, start: dt.date, end: dt.date,
           partials: dict[str, Column], keys: Sequence[str] = (),
           finals: dict[str, Column] | None = None, out: str = "month_date") -> DataFrame:
    """Aggregate per spine month over rows whose [lo, hi] covers the month.

    ``partials`` are aggregate expressions computed per (lo, hi, keys);
    they must be re-aggregatable by ``sum`` (counts, sums, conditional
    counts). ``finals`` optionally maps output names to expressions over the
    summed partials. Months with no member rows are absent, like a grouped
    cross join.
    """
    lo_c, hi_c = clip_range(lo, hi, start, end)
    ranged = (df.where(lo.isNotNull()).withColumn("_lo", lo_c).withColumn("_hi", hi_c)
              .where(F.col("_lo") <= F.col("_hi")))
    pre = ranged.groupBy("_lo", "_hi", *keys).agg(
        *[e.alias(n) for n, e in partials.items()])
    per_month = expand_months(pre, "_lo", "_hi", out).groupBy(out, *keys).agg(
        *[F.sum(n).alias(n) for n in partials])
    if finals:
        per_month = per_month.select(out, *keys, *[e.alias(n) for n, e in finals.items()])
    return per_month
