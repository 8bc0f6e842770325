"""Month spine: one row per month start, both ends inclusive."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def month_spine(spark: SparkSession, start: dt.date, end: dt.date,
                name: str = "month_date") -> DataFrame:
    """``generate_series(start, end, 1 month)`` as a DataFrame of dates.

    Catalyst folds the sequence into a constant array, so the spine costs a
    single tiny local relation and is always safe to broadcast.
    """
    return spark.range(1).select(
        F.explode(F.sequence(F.lit(start), F.lit(end), F.expr("interval 1 month"))).alias(name))
