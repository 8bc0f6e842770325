"""Sums and averages: missing values, very large and very small ones."""

import math
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from spineworks.functions import exact_avg, exact_sum
from spineworks.functions.numbers import avg_half_up


def _of(spark, values, kind="double"):
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    return tuple(df.agg(exact_sum("x"), exact_avg("x"), avg_half_up("x")).first())


@pytest.mark.parametrize("values,want", [
    ([math.nan, 1.0], (1.0, 1.0, 1.0)),
    ([math.nan, None], (None, None, None)),
    ([], (None, None, None)),
    ([1e19, 1e19, 5.0], (2e19, 2e19 / 3, 2e19 / 3)),
    ([1e17, 1e17], (2e17, 1e17, 1e17)),
    ([1e-12, 3e-12], (0.0, 2e-12, 0.0)),
    ([123456789.12, 1e12], (1000123456789.12, 500061728394.56, 500061728394.56)),
    ([2.5, -7.5, None, math.nan], (-5.0, -2.5, -2.5)),
])
def test_doubles(spark, values, want):
    assert _of(spark, values) == want


def test_decimals_and_whole_numbers(spark):
    assert _of(spark, [Decimal("1.25"), Decimal("3.10")], "decimal(18,2)") == (4.35, 2.175, 2.18)
    assert _of(spark, [1, 2, None], "long") == (3.0, 1.5, 1.5)
    assert _of(spark, [10 ** 18 + 1, 10 ** 18 + 1], "long")[1] == float(10 ** 18)


def test_sums_do_not_depend_on_partitions(spark):
    df = spark.range(20_000).select((F.col("id") % 977 / 10 + 0.01).alias("x"))
    got = {tuple(df.repartition(n).agg(exact_sum("x", 6), exact_avg("x"), avg_half_up("x", 6)).first()) for n in (1, 3, 17)}
    assert len(got) == 1


def test_infinite_values_end_the_job(spark):
    with pytest.raises(Exception, match="infinite"):
        _of(spark, [math.inf, 1.0])
