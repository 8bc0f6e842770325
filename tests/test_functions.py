import datetime as dt

from pyspark.sql import functions as F

from spineworks.functions import (
    avg_half_up, is_blank, is_empty, last_counted_month, percent_half_up, whole_months)

D = dt.date.fromisoformat


def _one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


def test_whole_months_matches_age_rule(spark):
    cases = [("2024-02-01", "2024-01-31", 0), ("2024-03-01", "2024-01-31", 1),
             ("2024-02-01", "2024-01-01", 1), ("2024-01-01", "2024-01-15", 0),
             ("2024-02-29", "2024-01-31", 0), ("2024-01-01", "2023-01-10", 11),
             ("2023-01-01", "2024-03-01", -14)]
    for later, earlier, want in cases:
        assert _one(spark, whole_months(F.lit(D(later)), F.lit(D(earlier)))) == want, (later, earlier)


def test_last_counted_month(spark):
    assert _one(spark, last_counted_month(F.lit(D("2024-06-30")))) == D("2024-06-01")
    assert _one(spark, last_counted_month(F.lit(D("2024-06-20")))) == D("2024-05-01")
    assert _one(spark, last_counted_month(F.lit(D("2024-02-29")))) == D("2024-02-01")
    assert _one(spark, last_counted_month(F.lit(None).cast("date"))) is None


def test_percent_half_up_exact(spark):
    assert _one(spark, percent_half_up(F.lit(1), F.lit(32))) == 3.13   # 3.125 -> up
    assert _one(spark, percent_half_up(F.lit(1), F.lit(3))) == 33.33
    assert _one(spark, percent_half_up(F.lit(2), F.lit(3))) == 66.67
    assert _one(spark, percent_half_up(F.lit(0), F.lit(0))) is None


def test_avg_half_up(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (None,), (2.0,)], "x double")
    assert df.agg(avg_half_up("x").alias("a")).first()["a"] == 1.67


def test_blank_and_empty(spark):
    df = spark.createDataFrame([(" ",), ("\t\n",), ("",), (None,), ("a",)], "s string")
    got = df.agg(F.count(F.when(is_blank("s"), 1)).alias("w"),
                 F.count(F.when(is_empty("s"), 1)).alias("e"),
                 F.count(F.when(F.col("s").isNull(), 1)).alias("n")).first()
    assert (got["w"], got["e"], got["n"]) == (2, 1, 1)


def test_ratio_is_exact_for_large_counts(spark):
    from spineworks.functions.numbers import percent_half_up
    pairs = [(123456789012345 + 7 * i, 987654321098765 + 13 * i) for i in range(500)] + [(10 ** 15, 3 * 10 ** 15), (1, 0)]
    df = spark.createDataFrame(pairs, "a long, b long").select("a", "b", percent_half_up("a", "b").alias("p"))
    for r in df.collect():
        assert r.p == (None if r.b == 0 else (r.a * 20000 + r.b) // (2 * r.b) / 100)


def test_averages_and_sums_round_once(spark):
    from spineworks.functions import exact_avg, exact_sum
    df = spark.createDataFrame([(0.005,), (0.015,), (0.004,), (None,)], "x double")
    r = df.agg(exact_sum("x", 3).alias("s"), exact_avg("x").alias("a"), avg_half_up("x").alias("h"),
               avg_half_up(-F.col("x")).alias("n")).first()
    assert (r.s, r.a, r.h, r.n) == (0.024, 0.008, 0.01, -0.01)
    big = spark.createDataFrame([(10 ** 15 + 1,), (10 ** 15 + 2,)], "x long")
    assert big.agg(avg_half_up("x").alias("h")).first()["h"] == 10 ** 15 + 1.5
    assert df.where("x > 1").agg(avg_half_up("x").alias("h")).first()["h"] is None
