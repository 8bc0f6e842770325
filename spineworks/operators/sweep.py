"""Interval memberships over long calendars by an event sweep.

A row counts on every spine day (or month) from ``lo`` to ``hi``. ``spread``
(``operators.spine``) groups rows by their clipped range, which suits a year
of months; for a daily spine the number of ranges grows with the square of
the calendar. The sweep turns a row into two events instead -- its measures
enter at ``lo`` and leave after ``hi`` -- sums the events of each day map-side,
and adds them up along the calendar. What crosses the shuffle is at most two
events for each day and group, whatever the number of rows.

The running sum is cut into blocks of about the square root of the
calendar: sums inside a block, totals of the blocks before, one added to the
other. No window holds more than the days of one block or the blocks of one
group, and none holds rows of the table.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spineworks.functions import month_start

_EXACT = (T.IntegralType, T.DecimalType)


def _place(day: Column, start: dt.date, unit: str) -> Column:
    """Number of days (months) from ``start``."""
    if unit == "day":
        return F.datediff(day, F.lit(start))
    return (F.year(day) - start.year) * 12 + F.month(day) - start.month


def _day(place: Column, start: dt.date, unit: str) -> Column:
    return F.date_add(F.lit(start), place) if unit == "day" else F.add_months(F.lit(start), place)


def spine_length(start: dt.date, end: dt.date, unit: str) -> int:
    """Number of spine points from ``start`` to ``end``, both included."""
    if unit not in ("day", "month"):
        raise ValueError(f"unit {unit!r} is neither day nor month")
    if unit == "day":
        return max(0, (end - start).days + 1)
    return max(0, (end.year - start.year) * 12 + end.month - start.month + 1)


def running(events: DataFrame, measures: Sequence[str], length: int, keys: Sequence[str] = (),
            place: str = "_at") -> DataFrame:
    """``events`` (one row for each key and place) with each measure summed up to its place.

    Prefix sums by blocks of places with carried block totals.
    """
    block = max(1, math.isqrt(max(length, 1)))
    cut = events.withColumn("_block", F.floor(F.col(place) / block))
    inside = Window.partitionBy(*keys, "_block").orderBy(place)
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = cut.groupBy(*keys, "_block").agg(*[F.sum(m).alias(f"_t_{m}") for m in measures])
    # blocks of one group: at most the calendar's length / block
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_block").alias("_b"),
                            *[F.coalesce(F.sum(f"_t_{m}").over(before), F.lit(0)).alias(f"_c_{m}") for m in measures])
    same = F.col("_block") == F.col("_b")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    summed = cut.select(*keys, place, "_block", *[F.sum(m).over(inside).alias(m) for m in measures])
    return summed.join(carried, same).select(
        *keys, place, *[(F.col(m) + F.col(f"_c_{m}")).alias(m) for m in measures])


def sweep(df: DataFrame, lo: Column, hi: Column | None, start: dt.date, end: dt.date, measures: dict[str, Column],
          keys: Sequence[str] = (), unit: str = "day", out: str = "day") -> DataFrame:
    """(``out``, keys, measures): sums over the rows whose [lo, hi] covers each spine point.

    ``measures`` are row expressions of whole or decimal numbers (they are
    added and taken away again, so they must be exact; a float is an error).
    A null ``hi`` is open-ended, a null ``lo`` no member. Points without a
    member row are absent, as in a grouped cross join with the spine; a
    member whose measure is null counts as nothing, and a point where all are
    null reports null, like ``sum``.
    """
    length = spine_length(start, end, unit)
    names = list(measures)
    rows = df.where(lo.isNotNull()).select(
        *keys, F.greatest(_place(lo, start, unit), F.lit(0)).alias("_from"),
        F.least(F.lit(length - 1) if hi is None else F.coalesce(_place(hi, start, unit), F.lit(length - 1)),
                F.lit(length - 1)).alias("_to"), *[e.alias(n) for n, e in measures.items()])
    for n in names:
        if not isinstance(rows.schema[n].dataType, _EXACT):
            raise TypeError(f"{n} is {rows.schema[n].dataType.simpleString()}; a sweep needs whole or decimal numbers")
    rows = rows.where("_from <= _to")
    some = [F.col(n).isNotNull().cast("long").alias(f"_n_{n}") for n in names]
    wide = rows.select(*keys, "_from", "_to", F.lit(1).cast("long").alias("_members"), *some,
                       *[F.coalesce(n, F.lit(0)).alias(n) for n in names])
    values = ["_members", *[f"_n_{n}" for n in names], *names]
    both = F.explode(F.array(
        F.struct(F.col("_from").alias("_at"), *[F.col(v).alias(v) for v in values]),
        F.struct((F.col("_to") + 1).alias("_at"), *[(-F.col(v)).cast(wide.schema[v].dataType).alias(v) for v in values])))
    events = wide.select(*keys, both.alias("_e")).select(*keys, "_e.*").groupBy(*keys, "_at").agg(
        *[F.sum(v).alias(v) for v in values])
    at = running(events, values, length + 1, keys)
    # between two events nothing changes: each one stands for the points up to the next
    onward = Window.partitionBy(*keys).orderBy("_at")
    spans = at.withColumn("_next", F.coalesce(F.lead("_at").over(onward), F.lit(length))).where(
        (F.col("_members") > 0) & (F.col("_at") < length))
    days = spans.withColumn("_p", F.explode(F.sequence(F.col("_at"), F.least(F.col("_next"), F.lit(length)) - 1)))
    return days.select(_day(F.col("_p"), start, unit).alias(out), *keys,
                       *[F.when(F.col(f"_n_{n}") > 0, F.col(n)).alias(n) for n in names])


def growing(df: DataFrame, lo: Column, hi: Column | None, start: dt.date, end: dt.date, amount: Column,
            since: Column, keys: Sequence[str] = (), unit: str = "month", out: str = "month_date") -> DataFrame:
    """(``out``, keys, total): sum of amount x (points from ``since`` to this one, at least 0) over the members.

    Each member adds amount x (p - since) from max(lo, since) on, which is p x
    (sum of amounts) - (sum of amount x since): two sums to carry. Members
    before their ``since`` add nothing but still make the point appear.
    """
    shown = sweep(df, lo, hi, start, end, {"_shown": F.lit(1).cast("long")}, keys, unit, out).drop("_shown")
    zero = dt.date(start.year, start.month, 1) if unit == "month" else start
    first = F.greatest(lo, since)
    months = _place(since, zero, unit)
    grown = sweep(df, first, hi, start, end, {"_amount": amount, "_base": (amount * months)}, keys, unit, out)
    grown = grown.select(F.col(out).alias("_out"), *[F.col(k).alias(f"_k_{k}") for k in keys],
                         (F.col("_amount") * _place(F.col(out), zero, unit) - F.col("_base")).alias("_total"))
    same = F.col(out) == F.col("_out")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return shown.join(grown, same, "left").select(out, *keys, F.coalesce("_total", F.lit(0)).alias("total"))


def accrued(sub: DataFrame, start: dt.date, end: dt.date, horizon: dt.date) -> DataFrame:
    """(month_date, total): accrued revenue per month, as ``revenue.accrued_revenue``, for calendars of any length."""
    from spineworks.functions import last_counted_month
    first = month_start("start_date")
    whole = F.when(F.dayofmonth("start_date") > 1, F.add_months(first, 1)).otherwise(first)
    members = sub.where(F.col("is_trial") == False)  # noqa: E712
    return growing(members, first, last_counted_month(F.coalesce(F.col("end_date"), F.lit(horizon))), start, end,
                   F.col("mrr_amount"), whole)
