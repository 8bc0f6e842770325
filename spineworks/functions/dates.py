"""Month arithmetic with the boundary rules of the reporting queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(x) -> Column:
    if isinstance(x, Column):
        return x
    if isinstance(x, (dt.date, dt.datetime)):
        return F.lit(x)
    return F.col(x)


def month_start(x) -> Column:
    """First day of the month of a date or timestamp, as a DATE."""
    return F.trunc(as_col(x).cast("date"), "MM")


def month_last_day(x) -> Column:
    """Last day of the month (``month + interval '1 month - 1 day'``), as a DATE."""
    return F.last_day(as_col(x).cast("date"))


def whole_months(later, earlier) -> Column:
    """Whole months from ``earlier`` to ``later``, truncated toward zero.

    Equals ``years * 12 + months`` of the symbolic age between the two
    dates: 2024-01-31 -> 2024-02-29 is 0 months, 2024-01-15 -> 2024-01-01 is
    0 (not -1), 2024-01-01 -> 2024-02-01 is 1.
    """
    return F.timestamp_diff(
        "MONTH", as_col(earlier).cast("timestamp_ntz"), as_col(later).cast("timestamp_ntz"))


def days_between(later, earlier) -> Column:
    """Whole days from ``earlier`` to ``later`` as BIGINT (date difference)."""
    return F.datediff(as_col(later).cast("date"), as_col(earlier).cast("date")).cast("bigint")


def last_counted_month(end) -> Column:
    """Last month whose final day is on or before ``end``.

    A subscription counts as active at the end of month m when its end date
    is on or after m's last day: that is the end date's own month if it ends
    on the month's last day, else the month before. Null stays null (open).
    """
    e = as_col(end).cast("date")
    own = F.trunc(e, "MM")
    return F.when(e == F.last_day(e), own).otherwise(F.add_months(own, -1))
