"""Load-time profiling and cleaning: profiles, duplicates, keys, rules, reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spineworks.operators.quality import (
    distinct_counts, duplicate_members, duplicate_rows_count, profile_report, rule_violations,
    shape)
from spineworks.operators.shares import top_k, value_counts_long
from spineworks.plans.params import Params
from spineworks.plans.tables import Tables
from spineworks.sources.schemas import ID_COLUMNS


def _union(frames):
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def null_profile(t: Tables, p: Params) -> DataFrame:
    return profile_report(t.profile(("null",)), "null")


def empty_profile(t: Tables, p: Params) -> DataFrame:
    return profile_report(t.profile(("empty",)), "empty")


def whitespace_profile(t: Tables, p: Params) -> DataFrame:
    return profile_report(t.profile(("whitespace",)), "whitespace")


_ID_BY_LABEL = {"subscription": ID_COLUMNS["subscription"], "account": ID_COLUMNS["account"],
                "churn_event": ID_COLUMNS["churn_event"], "usage_event": ID_COLUMNS["feature_usage"],
                "support_ticket": ID_COLUMNS["support_ticket"]}


def dup_rows_ignoring_id(t: Tables, p: Params) -> DataFrame:
    """Per table: rows repeating another row on every column except the id."""
    return _union([duplicate_rows_count(df, [_ID_BY_LABEL[name]])
                   .select(F.lit(name).alias("table_name"), "duplicates")
                   for name, df in t.raw_tables().items()])


# Key columns checked for repeats, per table (as loaded).
DUP_KEY_COLUMNS = (("subscription", "subscription_id"), ("subscription", "account_id"),
                   ("account", "account_id"), ("usage_event", "subscription_id"),
                   ("usage_event", "usage_id"), ("support_ticket", "ticket_id"),
                   ("churn_event", "churn_event_id"))


def dup_key_counts(t: Tables, p: Params) -> DataFrame:
    """Per key column: rows repeating an earlier row's value (rows minus distinct values)."""
    tabs = t.raw_tables()
    by_table: dict[str, list[str]] = {}
    for name, col in DUP_KEY_COLUMNS:
        by_table.setdefault(name, []).append(col)
    return _union([distinct_counts(tabs[name], name, cols).select(
        "table_name", "column", (F.col("rows") - F.col("nunique")).alias("duplicates"))
        for name, cols in by_table.items()])


def dup_row_listing(t: Tables, p: Params) -> DataFrame:
    """Every subscription row that has an exact copy under another id."""
    sub = t.raw_subscription
    cols = [c for c in sub.columns if c != "subscription_id"]
    return duplicate_members(sub, cols).orderBy("account_id", "subscription_id")


def dup_usage_id_rows(t: Tables, p: Params) -> DataFrame:
    """Every usage row whose (source) usage id is shared with another row."""
    return duplicate_members(t.raw_usage, ["usage_id"]).orderBy(
        "usage_id", "usage_date", "subscription_id", "feature_name")


def dedupe_subscription(t: Tables, p: Params) -> DataFrame:
    return t.dedup_subscription


def rekey_usage(t: Tables, p: Params) -> DataFrame:
    return t.rekeyed_usage()


# Columns whose distinct counts are reported, per table (after de-duplication
# and re-keying).
NUNIQUE_COLUMNS = (("subscription", "plan_tier"), ("subscription", "billing_frequency"),
                   ("subscription", "auto_renew_flag"), ("subscription", "subscription_id"),
                   ("subscription", "account_id"), ("account", "account_id"),
                   ("account", "account_name"), ("feature_usage", "usage_id"),
                   ("feature_usage", "subscription_id"), ("support_ticket", "ticket_id"),
                   ("support_ticket", "account_id"), ("churn_event", "churn_event_id"),
                   ("churn_event", "account_id"))


def _profiled(t: Tables, with_usage_ids: bool) -> dict[str, DataFrame]:
    usage = t.rekeyed_usage() if with_usage_ids else t.raw_usage.drop("usage_id")
    return {"subscription": t.dedup_subscription, "account": t.raw_account,
            "feature_usage": usage, "support_ticket": t.support_ticket,
            "churn_event": t.churn_event}


def nunique_profile(t: Tables, p: Params) -> DataFrame:
    """Distinct values per column, null counted as a value (pandas ``dropna=False``).

    Re-keyed usage ids are consecutive, so their count is the usage row count.
    """
    tabs = _profiled(t, with_usage_ids=False)
    by_table: dict[str, list[str]] = {}
    for name, col in NUNIQUE_COLUMNS:
        if not (name == "feature_usage" and col == "usage_id"):
            by_table.setdefault(name, []).append(col)
    parts = []
    for name, cols in by_table.items():
        found = F.struct("column", "nunique")
        if name == "feature_usage":
            ids = F.struct(F.lit("usage_id").alias("column"), F.col("rows").alias("nunique"))
            found = F.explode(F.when(F.col("column") == cols[0], F.array(found, ids)).otherwise(F.array(found)))
        parts.append(distinct_counts(tabs[name], name, cols).select("table_name", found.alias("f"))
                     .select("table_name", "f.*"))
    return _union(parts)


VALUE_COUNT_COLUMNS = {
    "subscription": ("plan_tier", "billing_frequency", "auto_renew_flag"),
    "account": ("industry", "country", "referral_source", "plan_tier"),
    "feature_usage": ("feature_name",),
    "support_ticket": ("priority", "satisfaction_score"),
    "churn_event": ("reason_code",),
}


def value_counts_profile(t: Tables, p: Params) -> DataFrame:
    tabs = _profiled(t, with_usage_ids=False)
    return _union([value_counts_long(tabs[name], name, cols)
                   for name, cols in VALUE_COUNT_COLUMNS.items()])


def flag_counts(t: Tables, p: Params) -> DataFrame:
    """Subscription churn flags and churn-event reactivation flags (nulls dropped)."""
    return _union([value_counts_long(t.dedup_subscription, "subscription", ["churn_flag"], True),
                   value_counts_long(t.churn_event, "churn_event", ["is_reactivation"], True)])


def top_accounts_by_subs(t: Tables, p: Params) -> DataFrame:
    return top_k(t.dedup_subscription, "account_id", F.count("subscription_id"),
                 "subscription_count", p.top_k)


def _seat_sum():
    # pandas sums an all-missing group to 0, not to null.
    return F.coalesce(F.sum("seats"), F.lit(0)).cast("bigint")


def top_accounts_by_seats(t: Tables, p: Params) -> DataFrame:
    return top_k(t.raw_account, "account_id", _seat_sum(), "seats", p.top_k)


def top_sub_accounts_by_seats(t: Tables, p: Params) -> DataFrame:
    return top_k(t.dedup_subscription, "account_id", _seat_sum(), "seats", p.top_k)


def top_accounts_by_churn(t: Tables, p: Params) -> DataFrame:
    return top_k(t.churn_event, "account_id", F.count("churn_event_id"), "churn_events", p.top_k)


def _rows_of_top(df: DataFrame, top: DataFrame) -> DataFrame:
    # The top list has at most k rows: a bounded broadcast.
    keys = top.select(F.col("account_id").alias("_top"))
    return df.join(F.broadcast(keys), df.account_id == keys._top, "left_semi")


def top_account_subscriptions(t: Tables, p: Params) -> DataFrame:
    """Drill-down: every subscription of the account with the most subscriptions."""
    top = top_k(t.dedup_subscription, "account_id", F.count("subscription_id"), "n", 1)
    return _rows_of_top(t.dedup_subscription, top).orderBy("start_date", "subscription_id")


def top_churn_account_events(t: Tables, p: Params) -> DataFrame:
    """Drill-down: every churn event of the account with the most churn events."""
    top = top_k(t.churn_event, "account_id", F.count("churn_event_id"), "n", 1)
    return _rows_of_top(t.churn_event, top)


def table_shapes(t: Tables, p: Params) -> DataFrame:
    # Re-keying replaces the usage id in place, so the raw usage shape is the same.
    tabs = dict(_profiled(t, with_usage_ids=False), feature_usage=t.raw_usage)
    return _union([shape(t.spark, df, name) for name, df in tabs.items()])


def _rules(t: Tables):
    """The row checks of the load-time audit, per table."""
    mrr, arr = F.col("mrr_amount"), F.col("arr_amount")
    up, down, trial = F.col("upgrade_flag"), F.col("downgrade_flag"), F.col("is_trial")
    zero = (mrr == 0) & (arr == 0)
    sub = {
        "seats_not_positive": F.col("seats") <= 0,
        "zero_revenue_trial": (mrr <= 0) & (arr <= 0) & trial,
        "trial": trial,
        "zero_revenue_upgrade_and_downgrade": zero & up & down,
        "zero_revenue_no_flag_not_trial": zero & ~up & ~down & ~trial,
        "zero_revenue_upgrade_not_trial": zero & up & ~down & ~trial,
        "zero_revenue_downgrade": zero & ~up & down,
        "mrr_above_arr": mrr > arr,
        "arr_not_twelve_mrr": ~(mrr * 12).eqNullSafe(arr) | (mrr.isNull() & arr.isNull()),
    }
    acc = {"seats_not_positive": F.col("seats") <= 0}
    usage = {"usage_count_not_positive": F.col("usage_count") <= 0,
             "usage_duration_not_positive": F.col("usage_duration_secs") <= 0}
    ticket = {"submitted_after_closed": F.col("submitted_at") > F.col("closed_at"),
              "resolution_not_positive": F.col("resolution_time_hours") <= 0,
              "first_response_not_positive": F.col("first_response_time_minutes") <= 0}
    tabs = _profiled(t, with_usage_ids=False)
    return [("subscription", tabs["subscription"], "subscription_id", sub),
            ("account", tabs["account"], "account_id", acc),
            ("feature_usage", t.raw_usage, "usage_id", usage),
            ("support_ticket", tabs["support_ticket"], "ticket_id", ticket)]


def rule_violations_report(t: Tables, p: Params) -> DataFrame:
    """(table, rule, record id) for every row breaking an audit rule; one scan per table.

    Usage rows are identified by their source usage id here.
    """
    return _union([rule_violations(df, name, idc, rules) for name, df, idc, rules in _rules(t)])


def rule_violation_counts(t: Tables, p: Params) -> DataFrame:
    return rule_violations_report(t, p).groupBy("table_name", "rule").agg(
        F.count(F.lit(1)).alias("violations"))


def _flag_sum(c: str):
    # Number of true flags; an all-null group sums to 0, as in pandas.
    return F.coalesce(F.sum(F.col(c).cast("bigint")), F.lit(0)).cast("bigint")


def _churn_counts(t: Tables) -> DataFrame:
    return (t.churn_event.where((F.col("is_reactivation") == False)  # noqa: E712
                                & F.col("account_id").isNotNull())
            .groupBy("account_id").agg(F.count("churn_event_id").alias("churn_event_count")))


def churn_reconciliation(t: Tables, p: Params) -> DataFrame:
    """Accounts whose churned-subscription count differs from their churn-event count.

    Both sides are per-account aggregates (unique keys, no skew left), joined
    full outer on the account; a side missing for an account counts as
    different.
    """
    flags = (t.dedup_subscription.where(F.col("account_id").isNotNull())
             .groupBy("account_id").agg(_flag_sum("churn_flag").alias("churn_flag")))
    j = flags.join(_churn_counts(t), "account_id", "full_outer")
    return (j.where(~F.col("churn_flag").eqNullSafe(F.col("churn_event_count"))
                    | (F.col("churn_flag").isNull() & F.col("churn_event_count").isNull()))
            .select("account_id", "churn_flag", "churn_event_count").orderBy("account_id"))


def churn_summary(t: Tables, p: Params) -> DataFrame:
    """Per account: subscriptions, churned subscriptions and churn events."""
    subs = (t.dedup_subscription.where(F.col("account_id").isNotNull())
            .groupBy("account_id").agg(
                F.count("subscription_id").alias("total_subscriptions"),
                _flag_sum("churn_flag").alias("churned_subscriptions")))
    return (subs.join(_churn_counts(t), "account_id", "full_outer")
            .select("account_id", "total_subscriptions", "churned_subscriptions",
                    "churn_event_count")
            .orderBy(F.desc_nulls_last("churned_subscriptions"), F.asc_nulls_last("account_id")))


def clean_subscription(t: Tables, p: Params) -> DataFrame:
    return t.subscription


def clean_usage(t: Tables, p: Params) -> DataFrame:
    return t.clean_usage()
