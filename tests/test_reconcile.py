"""Reconciling by digests equals EXCEPT and EXCEPT ALL both ways; equal leaves are not shuffled by row."""

import random

import pytest
from pyspark.sql import functions as F

from spineworks.operators.reconcile import digests, merged, only_left, reconcile

SCHEMA = "k long, s string, d double"


def _rows(rnd, n):
    return [(rnd.choice([None, *range(40)]), rnd.choice([None, "", "a", "b"]), rnd.choice([None, 0.5, 1.0])) for _ in range(n)]


def _bag(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("seed", range(4))
def test_random_edits(spark, seed):
    rnd = random.Random(seed)
    left = _rows(rnd, 300)
    right = [r for r in left if rnd.random() > .05] + _rows(rnd, 10) + rnd.sample(left, 5)
    rnd.shuffle(right)
    a, b = spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA).select("d", "k", "s")
    found = reconcile(a, b, leaves=64)
    more = found.withColumn("x", F.explode(F.expr("sequence(1, greatest(left_rows - right_rows, 0))"))).where("left_rows > right_rows")
    assert _bag(more.select("k", "s", "d")) == _bag(a.exceptAll(b.select("k", "s", "d")))
    assert _bag(only_left(a, b, leaves=64)) == _bag(a.subtract(b.select("k", "s", "d")))
    assert _bag(only_left(b, a, leaves=64).select("k", "s", "d")) == _bag(b.select("k", "s", "d").subtract(a))


def test_equal_tables_in_any_order(spark):
    df = spark.createDataFrame(_rows(random.Random(9), 200), SCHEMA)
    assert reconcile(df, df.repartition(7).orderBy("d")).count() == 0
    assert reconcile(df.limit(0), df.limit(0)).count() == 0
    assert reconcile(df, df.limit(0)).agg(F.sum("left_rows")).first()[0] == 200
    with pytest.raises(ValueError):
        reconcile(df, df.drop("d"))


def test_even_copies_do_not_cancel(spark):
    df = spark.createDataFrame([(1, "a", 0.5)], SCHEMA)
    assert [tuple(r) for r in reconcile(df.union(df), df.limit(0)).collect()] == [(1, "a", 0.5, 2, 0)]
    assert [tuple(r) for r in reconcile(df.union(df).union(df), df).collect()] == [(1, "a", 0.5, 3, 1)]


def test_digests_merge_and_stand_for_the_table(spark):
    df = spark.createDataFrame(_rows(random.Random(5), 500), SCHEMA)
    parts = df.randomSplit([.3, .7], seed=1)
    assert _bag(merged(digests(parts[0]), digests(parts[1]))) == _bag(digests(df))
    changed = df.where("k is null or k <> 7")
    assert _bag(reconcile(df, changed, left_digests=digests(df))) == _bag(reconcile(df, changed))


def test_only_differing_leaves_are_opened(spark):
    df = spark.range(20_000).selectExpr("id", "id % 7 AS v")
    other = df.withColumn("v", F.when(F.col("id") == 77, 99).otherwise(F.col("v")))
    out = reconcile(df, other)
    assert sorted(tuple(r) for r in out.collect()) == [(77, 0, 1, 0), (77, 99, 0, 1)]
    # rows that reach the exact comparison: the two that differ, hardly any neighbours
    plan, shuffled = out._jdf.queryExecution().executedPlan(), []

    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name in ("ShuffleQueryStageExec", "BroadcastQueryStageExec", "ResultQueryStageExec"):
            return walk(node.plan())
        if name == "ShuffleExchangeExec":
            shuffled.append(node.metrics().apply("shuffleRecordsWritten").value())
        for i in range(node.children().size()):
            walk(node.children().apply(i))
    walk(plan)
    assert sum(shuffled) <= 4
