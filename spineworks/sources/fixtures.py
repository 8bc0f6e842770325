"""The five entity tables derived from the driver's star-schema Parquet tables.

The entity CSVs of the original analysis are not available, so the test and
benchmark inputs are deterministic views over ``orders``, ``lineitem``,
``customer``, ``nation``, ``region`` and ``events``. They are written with
the DataFrame API; the identical definitions in SQL (used by the DuckDB
oracle) live in ``spineworks.plans.oracle``. Column pruning reaches the
Parquet scans, so a query that needs two subscription columns reads only the
source columns behind them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def subscription(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _read(spark, sf_dir, "orders")
    lines = (_read(spark, sf_dir, "lineitem")
             .groupBy("l_orderkey")
             .agg(F.max("l_shipdate").alias("last_ship"), F.sum("l_quantity").alias("qty")))
    key = F.col("o_orderkey")
    status = F.col("o_orderstatus")
    base = orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left").select(
        key.alias("subscription_id"),
        F.col("o_custkey").alias("account_id"),
        F.col("o_orderdate").cast("date").alias("start_date"),
        F.when(status == "O", F.lit(None).cast("date"))
         .otherwise(F.col("last_ship").cast("date")).alias("end_date"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "Enterprise")
         .when(F.col("o_orderpriority") == "2-HIGH", "Pro")
         .when(F.col("o_orderpriority") == "3-MEDIUM", "Basic")
         .otherwise(F.col("o_orderpriority")).alias("plan_tier"),
        F.col("qty").cast("bigint").alias("seats"),
        F.when(status == "P", F.lit(0.0)).otherwise(F.col("o_totalprice"))
         .cast(MONEY).alias("mrr_amount"),
        (status == "P").alias("is_trial"),
        (key % 10 == 0).alias("upgrade_flag"),
        (key % 15 == 0).alias("downgrade_flag"),
        ((status != "O") & (key % 4 != 0)).alias("churn_flag"),
        F.when(key % 3 == 0, "annual").otherwise("monthly").alias("billing_frequency"),
        (key % 2 == 0).alias("auto_renew_flag"),
    )
    priced = base.withColumn(
        "arr_amount",
        F.when(F.col("subscription_id") % 97 == 0, F.col("mrr_amount") * 11)
         .otherwise(F.col("mrr_amount") * 12).cast(MONEY))
    # Every 500th subscription also appears as an exact copy under a new
    # (negated) id. Emitting both ids from one row keeps this a single pass
    # over orders and lineitem instead of a second scan for the copies.
    sid = F.col("subscription_id")
    ids = F.when((sid > 0) & (sid % 500 == 0), F.array(sid, -sid)).otherwise(F.array(sid))
    return priced.withColumn("subscription_id", F.explode(ids)).select(*priced.columns)


def account(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account table with the four subscription-grain columns still present."""
    cust = _read(spark, sf_dir, "customer")
    nation = _read(spark, sf_dir, "nation")
    region = _read(spark, sf_dir, "region")
    first = (_read(spark, sf_dir, "orders").groupBy("o_custkey")
             .agg(F.min("o_orderdate").alias("first_order")))
    key = F.col("c_custkey")
    return (cust.join(nation, cust.c_nationkey == nation.n_nationkey)
            .join(region, F.col("n_regionkey") == region.r_regionkey)
            .join(first, key == first.o_custkey, "left")
            .select(key.alias("account_id"),
                    F.col("c_name").alias("account_name"),
                    F.when(key % 101 == 0, F.lit(None).cast("string"))
                     .otherwise(F.col("c_mktsegment")).alias("industry"),
                    F.col("n_name").alias("country"),
                    F.col("r_name").alias("referral_source"),
                    F.col("first_order").cast("date").alias("signup_date"),
                    F.when(key % 3 == 0, "Basic").when(key % 3 == 1, "Pro")
                     .otherwise("Enterprise").alias("plan_tier"),
                    (1 + key % 50).cast("bigint").alias("seats"),
                    (key % 5 == 0).alias("is_trial"),
                    (key % 7 == 0).alias("churn_flag")))


def feature_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem")
    line = F.col("l_linenumber")
    return (li.select((F.col("l_orderkey") * 10 + line % 3).cast("bigint").alias("usage_id"),
                    F.col("l_orderkey").alias("subscription_id"),
                    F.col("l_shipdate").cast("date").alias("usage_date"),
                    F.concat(F.lit("feature_"), line.cast("string")).alias("feature_name"),
                    (F.col("l_quantity").cast("bigint") - 1).alias("usage_count"),
                    F.floor(F.col("l_extendedprice") / 100).cast("bigint").alias("usage_duration_secs"),
                    (line - 1).cast("bigint").alias("error_count")))


def support_ticket(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _read(spark, sf_dir, "events")
    eid, ts, et = F.col("event_id"), F.col("ts"), F.col("event_type")
    return ev.select(
        eid.alias("ticket_id"),
        F.col("user_id").alias("account_id"),
        F.when(eid % 3 == 0, ts)
         .when(eid % 3 == 1, ts + F.expr("interval 1 month"))
         .otherwise(ts + F.expr("interval 3 month")).alias("submitted_at"),
        F.when(eid % 50 == 0, ts - F.expr("interval 1 day"))
         .otherwise(ts + F.expr("interval 120 day")).alias("closed_at"),
        F.when(et == "purchase", "urgent").when(et == "error", "high")
         .when(et == "signup", "medium").when(et == "view", "low")
         .otherwise("other").alias("priority"),
        (et == "error").alias("escalation_flag"),
        F.when(eid % 4 == 0, F.lit(None)).otherwise(1 + eid % 5).cast("double")
         .alias("satisfaction_score"),
        F.col("value").alias("resolution_time_hours"),
        (eid * 37 % 181).cast("bigint").alias("first_response_time_minutes"))


def churn_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _read(spark, sf_dir, "events")
    eid, et = F.col("event_id"), F.col("event_type")
    return (ev.where(et.isin("error", "signup"))
            .select(eid.alias("churn_event_id"),
                    F.col("user_id").alias("account_id"),
                    F.col("ts").cast("date").alias("churn_date"),
                    F.when(eid % 3 == 0, "pricing").when(eid % 3 == 1, "features")
                     .otherwise("support").alias("reason_code"),
                    F.when(eid % 4 == 0, F.lit(None).cast("string"))
                     .when(eid % 13 == 0, "   ").when(eid % 19 == 0, "")
                     .when(eid % 2 == 0, "too expensive")
                     .otherwise("missing features").alias("feedback_text"),
                    F.when(eid % 3 == 0, F.col("value")).otherwise(F.lit(0.0))
                     .cast("double").alias("refund_amount_usd"),
                    (et == "signup").alias("is_reactivation")))


LOADERS = {
    "subscription": subscription,
    "account": account,
    "feature_usage": feature_usage,
    "support_ticket": support_ticket,
    "churn_event": churn_event,
}
