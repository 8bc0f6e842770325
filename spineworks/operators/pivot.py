"""Fixed-domain pivot (crosstab with an explicit category list)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pivot_fixed(long: DataFrame, row: str, category: str, value: str,
                values: Sequence[str], labels: Sequence[str] | None = None) -> DataFrame:
    """One row per ``row`` value, one column per listed category.

    Categories outside ``values`` are ignored; a missing cell is null; a
    row whose categories are all unlisted is still present. The value list
    is given, so Spark needs no extra job to discover it, and the pivot is a
    single grouped aggregate (partial aggregation map-side).
    """
    labels = list(labels or values)
    wide = long.groupBy(row).pivot(category, list(values)).agg(F.first(value))
    return wide.select(row, *[F.col(f"`{v}`").alias(lab) for v, lab in zip(values, labels)])
