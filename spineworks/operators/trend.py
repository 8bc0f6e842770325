"""Month-over-month change on a per-month result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def diff_previous(value: str, order: str = "month_date") -> Column:
    """``value - LAG(value)`` in month order.

    Only applied to results already reduced to one row per spine month
    (bounded by the calendar length), so the unpartitioned window is tiny.
    """
    return F.col(value) - F.lag(value).over(Window.orderBy(order))
