import tempfile

from helpers import rows

from spineworks.operators.quality import (
    column_profile, dedupe_keep_min, duplicate_members, duplicate_rows_count, rule_violations,
    surrogate_key)
from spineworks.plans.tables import usage_outlier
from spineworks.operators.quality import drop_where
from pyspark.sql import functions as F


def test_dedupe_with_nulls(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "a", 1)],
                               "id bigint, s string, n bigint")
    assert rows(dedupe_keep_min(df, "id"), "id") == [(1,), (3,)]
    assert duplicate_rows_count(df, ["id"]).first()["duplicates"] == 1
    assert rows(duplicate_members(df, ["s", "n"]), "id") == [(1,), (2,)]


def test_dedupe_is_idempotent(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(30)], "id bigint, v bigint")
    once = dedupe_keep_min(df, "id")
    assert rows(dedupe_keep_min(once, "id"), "id", "v") == rows(once, "id", "v")
    assert duplicate_rows_count(once, ["id"]).first()["duplicates"] == 0


def test_usage_outlier_rule_keeps_nulls_drops_zero_errors(spark):
    df = spark.createDataFrame([(1, None, 3), (2, 5, 0), (3, 5, 2), (4, 0, 2)],
                               "id bigint, usage_count bigint, error_count bigint")
    kept = drop_where(df, usage_outlier(df))
    assert rows(kept, "id") == [(1,), (3,)]
    assert drop_where(kept, usage_outlier(kept)).count() == 2


def test_surrogate_key_consecutive_and_ordered(spark):
    data = [(100 + (i * 7) % 13, f"f{i % 4}") for i in range(200)] + [(5, "dup")] * 50
    df = spark.createDataFrame(data, "sub bigint, name string").withColumn("usage_id", F.lit(0))
    out = surrogate_key(df, "usage_id", ["sub", "name"], tempfile.mkdtemp() + "/ranked", num_partitions=7)
    got = out.orderBy("usage_id").collect()
    assert [r["usage_id"] for r in got] == list(range(1, 251))
    keys = [(r["sub"], r["name"]) for r in got]
    assert keys == sorted(keys)


def test_profile_counts(spark):
    df = spark.createDataFrame([(" ", 1), ("\t\n", None), ("", 2), (None, 3), ("a", 4)],
                               "s string, n bigint")
    got = {r["column"]: (r["null_count"], r["empty_count"], r["whitespace_count"], r["rows"])
           for r in column_profile(df, "t").collect()}
    assert got == {"s": (1, 1, 2, 5), "n": (1, 0, 0, 5)}


def test_rule_violations_tags_each_rule(spark):
    df = spark.createDataFrame([(1, 0, 5), (2, 3, None), (3, -1, -1)], "id bigint, a bigint, b bigint")
    out = rule_violations(df, "t", "id", {"a_le0": F.col("a") <= 0, "b_le0": F.col("b") <= 0})
    assert rows(out, "rule", "record_id") == [("a_le0", "1"), ("a_le0", "3"), ("b_le0", "3")]


def test_distinct_counts_null_is_a_value_and_empty_tables_report_zero(spark):
    from spineworks.operators.quality import distinct_counts
    df = spark.createDataFrame([(1, None), (1, "a"), (2, None)], "k bigint, s string")
    got = {r["column"]: (r["nunique"], r["rows"]) for r in distinct_counts(df, "t", ["k", "s"]).collect()}
    assert got == {"k": (2, 3), "s": (2, 3)}
    empty = df.where("k > 5")
    got = {r["column"]: (r["nunique"], r["rows"]) for r in distinct_counts(empty, "t", ["k", "s"]).collect()}
    assert got == {"k": (0, 0), "s": (0, 0)}
