"""Category counts, shares of a total, value counts and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spineworks.functions import percent_half_up


def share_of_total(df: DataFrame, category: str, count_name: str = "freq",
                   total_name: str = "total", pct_name: str | None = None,
                   count_nulls: bool = True) -> DataFrame:
    """(category, count, total, percent of total rounded to 2 decimals).

    ``count_nulls=False`` counts the category column itself, so the null
    group is kept with a count of 0 (``COUNT(col)`` instead of ``COUNT(*)``).
    The total is one global row -- a single row, always safe to broadcast --
    instead of a window over all groups, which would pull every group into
    one partition.
    """
    pct_name = pct_name or f"{count_name}_perc"
    counted = F.count(F.lit(1)) if count_nulls else F.count(F.col(category))
    groups = df.groupBy(category).agg(counted.alias(count_name))
    total = groups.agg(F.sum(count_name).alias(total_name))
    return (groups.crossJoin(F.broadcast(total))
            .select(category, count_name, total_name,
                    percent_half_up(F.col(count_name), F.col(total_name)).alias(pct_name)))


def group_counts(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    """``SELECT keys, COUNT(*) ... GROUP BY keys`` (the null group is kept)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def value_counts_long(df: DataFrame, table: str, columns, dropna: bool = False) -> DataFrame:
    """Value counts of several columns in long form (table, column, value, count).

    Values are rendered as text so columns of different types share one
    output column. One scan of ``df`` feeds all columns: the rows are
    exploded into (column, value) pairs, then counted (map-side first).
    """
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
        for c in columns]))
    long = df.select(pairs.alias("p")).select("p.column", "p.value")
    if dropna:
        long = long.where(F.col("value").isNotNull())
    return (long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))
            .select(F.lit(table).alias("table_name"), "column", "value", "count"))


def top_k(df: DataFrame, key: str, measure: Column, name: str, k: int) -> DataFrame:
    """Top ``k`` keys by an aggregate, descending, ties broken by key.

    Planned as a partial aggregate then TakeOrderedAndProject: each task
    keeps only its k best rows, so nothing unbounded reaches one task.
    """
    agg = df.where(F.col(key).isNotNull()).groupBy(key).agg(measure.alias(name))
    return agg.orderBy(F.desc(name), F.asc(key)).limit(k)
