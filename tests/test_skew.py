"""A third of all subscriptions on one account: AQE must split that partition.

Thresholds are lowered so the effect shows on test-sized data, broadcasts
are disabled so the sort-merge joins (the large-scale plans) are used.
"""

import tempfile

from pyspark.sql import functions as F

from spineworks.plans import exploration as X
from spineworks.plans.params import Params

SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


def _subs(spark, n=60000):
    # account 0 holds a third of the rows; the rest spread over 2000 accounts
    return spark.range(n).select(
        F.col("id").alias("subscription_id"),
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(1 + F.col("id") % 2000).alias("account_id"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 300).cast("int")).alias("start_date"))


def _accounts(spark):
    return spark.range(2001).select(F.col("id").alias("account_id"),
                                    F.lit("2023-06-01").cast("date").alias("signup_date"))


def _run_with(spark, conf, build):
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        df = build()
        rows = df.count()
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        return rows, plan
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_hot_account_is_split_in_left_join(spark):
    subs, acc = _subs(spark), _accounts(spark)
    n, plan = _run_with(spark, SKEW_CONF, lambda: X.days_to_start(subs, acc, Params()))
    assert n == 60000
    assert "SortMergeJoin" in plan and "skew=true" in plan


def test_hot_account_is_split_when_subscriptions_are_the_right_side(spark):
    subs = _subs(spark)
    churn = spark.range(4000).select(
        F.col("id").alias("churn_event_id"), (F.col("id") % 2001).alias("account_id"),
        F.lit("2024-05-01").cast("date").alias("churn_date"), F.lit("p").alias("reason_code"),
        F.lit(None).cast("string").alias("feedback_text"), F.lit(0.0).alias("refund_amount_usd"),
        (F.col("id") % 5 == 0).alias("is_reactivation"))
    n, plan = _run_with(spark, SKEW_CONF,
                        lambda: X.churn_reactivation_map(churn, subs, Params()))
    assert n > 0
    assert "skew=true" in plan


def test_plain_left_join_with_hot_right_side_is_not_split(spark):
    # Why left_join_unique_to_skewed exists: AQE cannot split the right
    # side of a left outer join, so the plain form keeps the hot partition.
    subs = _subs(spark)
    keys = spark.range(2001).select(F.col("id").alias("k"))
    n, plan = _run_with(spark, SKEW_CONF, lambda: keys.join(
        subs, keys.k == subs.account_id, "left"))
    assert n == 60000
    assert "skew=true" not in plan


def _hot_account(subs):
    return subs.groupBy("account_id").count().orderBy(F.desc("count")).limit(1).select("account_id")


def test_hot_account_is_split_in_not_in(spark):
    from spineworks.operators.relations import not_in
    subs = _subs(spark)
    tickets = spark.range(3000).select(((F.col("id") % 1500) + 501).alias("account_id"))
    with_hot = tickets.unionByName(_hot_account(subs))
    n, plan = _run_with(spark, SKEW_CONF, lambda: not_in(subs, "account_id", with_hot, "account_id"))
    assert n == subs.join(_hot_account(subs), "account_id", "left_anti").where("account_id < 501").count()
    assert "skew=true" in plan
    # a hot account without tickets is not even shuffled: the key bitmap lets its rows pass
    n, plan = _run_with(spark, SKEW_CONF, lambda: not_in(subs, "account_id", tickets, "account_id"))
    assert n == subs.where("account_id < 501").count()
    assert "skew=true" not in plan


def test_hot_account_is_split_in_full_outer_form(spark):
    from spineworks.operators.relations import full_outer_skew_safe
    subs = _subs(spark)
    acc = spark.range(2500).select(F.col("id").alias("a_id"), F.lit("x").alias("tier"))
    n, plan = _run_with(spark, SKEW_CONF, lambda: full_outer_skew_safe(subs, acc, "account_id", "a_id"))
    assert n == 60000 + (2500 - 2001)
    assert "skew=true" in plan


def test_hot_group_of_copies_is_split_in_duplicate_listing(spark):
    from spineworks.operators.quality import duplicate_members
    rows = spark.range(60000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("v"),
        F.when(F.col("id") % 3 == 0, F.lit("same")).otherwise(F.col("id").cast("string")).alias("s"))
    n, plan = _run_with(spark, SKEW_CONF, lambda: duplicate_members(rows, ["v", "s"]))
    assert n == 20000
    assert "skew=true" in plan


def test_surrogate_key_spreads_a_hot_group_of_copies(spark):
    from spineworks.operators.quality import surrogate_key
    n = 30000
    rows = spark.range(n).repartition(6).select(
        F.lit(0).alias("usage_id"),
        F.when(F.col("id") % 3 == 0, F.lit(5)).otherwise(F.col("id")).alias("sub"),
        F.when(F.col("id") % 3 == 0, F.lit("dup")).otherwise(F.lit("x")).alias("name"))
    out = surrogate_key(rows, "usage_id", ["sub", "name"], tempfile.mkdtemp() + "/ranked", num_partitions=8)
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == n and max(sizes) < n / 4   # the 10,000 copies are cut up
    ids = out.agg(F.min("usage_id"), F.max("usage_id"), F.countDistinct("usage_id")).first()
    assert tuple(ids) == (1, n, n)


def test_hot_account_is_split_in_in_except(spark):
    from spineworks.operators.relations import in_except
    subs = _subs(spark)
    churn = spark.range(3000).select(((F.col("id") % 1500) + 501).alias("account_id")).unionByName(_hot_account(subs))
    n, plan = _run_with(spark, SKEW_CONF,
                        lambda: in_except(subs, "account_id", subs, "account_id", churn, "account_id"))
    assert n == subs.join(_hot_account(subs), "account_id", "left_anti").where("account_id < 501").count()
    assert "skew=true" in plan
