"""Anti joins behind a key bitmap: same rows, and only possible matches are shuffled."""

import random

import pytest
from pyspark.sql import functions as F

from spineworks.operators.relations import anti_join, in_except, key_bitmap, not_in

SF = "/root/testdata/sf0.01"


def _df(spark, keys, name):
    return spark.createDataFrame([(k, i) for i, k in enumerate(keys)], f"{name} long, {name}_row int")


def _ids(df):
    return sorted(r[1] for r in df.collect())


@pytest.mark.parametrize("bits", [1 << 20, 64])  # 64: every place is taken by chance
@pytest.mark.parametrize("right", [[], [1, 2, 2], [None], [3, None], list(range(0, 400, 3))])
def test_against_sql(spark, bits, right):
    rnd = random.Random(len(right))
    left = [rnd.choice([None, *range(420)]) for _ in range(300)] + [1] * 200
    a, b = _df(spark, left, "k"), _df(spark, right, "r")
    a.createOrReplaceTempView("bitmap_left")
    b.createOrReplaceTempView("bitmap_right")
    want = _ids(spark.sql("SELECT * FROM bitmap_left WHERE k NOT IN (SELECT r FROM bitmap_right)"))
    assert _ids(not_in(a, "k", b, "r", bits)) == want
    want = _ids(spark.sql("SELECT * FROM bitmap_left WHERE k IN (SELECT k FROM bitmap_left EXCEPT SELECT r FROM bitmap_right)"))
    assert _ids(in_except(a, "k", a, "k", b, "r", bits)) == want
    assert _ids(in_except(a, "k", a.alias("again"), "k", b, "r", bits)) == want


def test_text_keys_and_clashing_names(spark):
    a = spark.createDataFrame([("x", 1, 9), ("y", 2, 9), (None, 3, 9)], "k string, _at int, _bits int")
    b = spark.createDataFrame([("y",)], "k string")
    assert sorted(r["k"] for r in not_in(a, "k", b, "k").collect()) == ["x"]


def test_bitmap_size_is_bounded(spark):
    keys = spark.range(100_000).select(F.col("id").alias("k"))
    bitmap = key_bitmap(keys, "k", bits=1 << 12).collect()
    assert len(bitmap) <= (1 << 12) // 64
    assert all(r["__bitmap_bits"] == -1 for r in bitmap)  # saturated
    few = key_bitmap(keys.where("k < 5"), "k", bits=1 << 12).agg(F.sum(F.bit_count("__bitmap_bits"))).first()[0]
    assert few == 5


def _shuffled_left_rows(df):
    """Rows written by the shuffle on the left join key, from the executed plan's metrics."""
    df.collect()
    plan, found = df._jdf.queryExecution().executedPlan(), []

    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name in ("ShuffleQueryStageExec", "BroadcastQueryStageExec", "ResultQueryStageExec"):
            return walk(node.plan())
        if name == "ShuffleExchangeExec" and "o_orderkey" in node.outputPartitioning().toString():
            found.append(node.metrics().apply("shuffleRecordsWritten").value())
        for i in range(node.children().size()):
            walk(node.children().apply(i))
    walk(plan)
    return found


def test_only_possible_matches_are_shuffled(spark):
    left = spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", "o_custkey")
    right = spark.read.parquet(f"{SF}/lineitem.parquet").where("l_orderkey % 10 = 0").select("l_orderkey")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        keys = right.distinct()
        matches = left.join(keys, left.o_orderkey == keys.l_orderkey, "left_semi").count()
        rows = _shuffled_left_rows(anti_join(left, "o_orderkey", keys, "l_orderkey"))
        plain = _shuffled_left_rows(left.join(keys, left.o_orderkey.eqNullSafe(keys.l_orderkey), "left_anti"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert left.count() in plain
    # the matches, and a few rows by chance
    assert matches <= rows[0] <= 1.02 * matches + 5, (rows, matches, left.count())
