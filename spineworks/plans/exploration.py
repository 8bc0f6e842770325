"""Distributions, key checks and cross-table relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spineworks.functions import days_between, exact_avg, exact_sum
from spineworks.operators.quality import distinct_row
from spineworks.operators.relations import (
    full_outer_skew_safe, in_except, left_join_unique_to_skewed, not_in)
from spineworks.operators.shares import group_counts, share_of_total
from spineworks.plans.params import Params

# Ticket priorities in their reporting order.
PRIORITY_ORDER = ("urgent", "high", "medium", "low")


# consistency audit ---------------------------------------------------------

def subs_without_churn_event(sub: DataFrame, churn: DataFrame, p: Params) -> DataFrame:
    """Subscriptions of accounts that have subscriptions but no churn event."""
    rows = in_except(sub, "account_id", sub, "account_id", churn, "account_id")
    return rows.select("is_trial", "start_date", "end_date")


def unused_subs_by_tier(sub: DataFrame, usage: DataFrame, p: Params) -> DataFrame:
    """Plan tiers of subscriptions never seen in feature usage (NOT IN semantics)."""
    unused = not_in(sub, "subscription_id", usage, "subscription_id")
    return group_counts(unused, "plan_tier", name="subscriptions").orderBy("subscriptions", F.asc_nulls_last("plan_tier"))


def resolve_time_by_priority(t: DataFrame, p: Params) -> DataFrame:
    rank = F.when(F.col("priority") == PRIORITY_ORDER[0], 1)
    for i, v in enumerate(PRIORITY_ORDER[1:], start=2):
        rank = rank.when(F.col("priority") == v, i)
    return (t.groupBy("escalation_flag", "priority")
            .agg(exact_avg("resolution_time_hours").alias("avg_resolve_time"))
            .orderBy(F.asc_nulls_last("escalation_flag"), F.asc_nulls_last(rank)))


def reason_feedback_matrix(churn: DataFrame, p: Params) -> DataFrame:
    return group_counts(churn, "reason_code", "feedback_text", name="events")


# distributions -------------------------------------------------------------

def share_industry(account: DataFrame, p: Params) -> DataFrame:
    return share_of_total(account, "industry", "amt", count_nulls=False)


def share_country(account: DataFrame, p: Params) -> DataFrame:
    return share_of_total(account, "country")


def share_referral(account: DataFrame, p: Params) -> DataFrame:
    return share_of_total(account, "referral_source")


def share_feedback(churn: DataFrame, p: Params) -> DataFrame:
    return share_of_total(churn, "feedback_text")


def share_plan_tier(sub: DataFrame, p: Params) -> DataFrame:
    return share_of_total(sub, "plan_tier")


def share_trial(sub: DataFrame, p: Params) -> DataFrame:
    return share_of_total(sub, "is_trial")


def reason_feedback_rows(churn: DataFrame, p: Params) -> DataFrame:
    # The event id breaks ties so range partitioning can split a common text.
    return (churn.orderBy(F.asc_nulls_last("feedback_text"), "churn_event_id")
            .select("reason_code", "feedback_text"))


def refund_by_feedback(churn: DataFrame, p: Params) -> DataFrame:
    """Refund totals per feedback text, exact to the cent."""
    return churn.groupBy("feedback_text").agg(
        exact_sum("refund_amount_usd").alias("refund_total"))


def refunded_reactivations(churn: DataFrame, p: Params) -> DataFrame:
    return churn.where((F.col("refund_amount_usd") > 0) & (F.col("is_reactivation") == True))  # noqa: E712


def trial_durations(sub: DataFrame, p: Params) -> DataFrame:
    return sub.where(F.col("is_trial") == True).select(  # noqa: E712
        "start_date", "end_date",
        days_between(F.col("end_date"), F.col("start_date")).alias("trial_days"))


def count_billing_frequency(sub: DataFrame, p: Params) -> DataFrame:
    return group_counts(sub, "billing_frequency", name="subscriptions")


def count_priority_escalation(t: DataFrame, p: Params) -> DataFrame:
    return group_counts(t, "priority", "escalation_flag", name="tickets").orderBy(
        F.asc_nulls_last("priority"), F.asc_nulls_last("escalation_flag"))


def subs_per_account(sub: DataFrame, p: Params) -> DataFrame:
    return (sub.groupBy(F.col("account_id").alias("acc"))
            .agg(F.count("subscription_id").alias("sub_count"))
            .orderBy(F.desc("sub_count"), F.asc_nulls_last("acc")))


# key cardinality -----------------------------------------------------------

def key_cardinality(df: DataFrame, keys: dict[str, str], rows_name: str) -> DataFrame:
    """Distinct counts of several key columns plus the row count, one row (ids as bitmap words)."""
    return distinct_row(df, keys, rows_name)


def key_card_account(account: DataFrame, p: Params) -> DataFrame:
    return key_cardinality(account, {"nunique_account_id": "account_id"}, "account_rows")


def key_card_usage(usage: DataFrame, p: Params) -> DataFrame:
    return key_cardinality(usage, {"nunique_subscription_id": "subscription_id"},
                           "feature_usage_rows")


def key_card_ticket(t: DataFrame, p: Params) -> DataFrame:
    return key_cardinality(t, {"nunique_ticket_id": "ticket_id",
                               "nunique_account_id": "account_id"}, "support_ticket_rows")


def key_card_churn(churn: DataFrame, p: Params) -> DataFrame:
    return key_cardinality(churn, {"nunique_churn_event_id": "churn_event_id",
                                   "nunique_account_id": "account_id"}, "churn_event_rows")


def key_card_subscription(sub: DataFrame, p: Params) -> DataFrame:
    return key_cardinality(sub, {"nunique_subscription_id": "subscription_id",
                                 "nunique_account_id": "account_id"}, "subscription_rows")


# relations -----------------------------------------------------------------

def account_subscriptions(sub: DataFrame, p: Params, account_id=None) -> DataFrame:
    """Subscriptions by account and start date (one account if ``account_id`` is given).

    The subscription id breaks ties in the sort, so range partitioning can
    split even an account holding a large share of all subscriptions.
    """
    rows = sub if account_id is None else sub.where(F.col("account_id") == F.lit(account_id))
    return rows.select("account_id", "subscription_id", "start_date", "is_trial", "plan_tier",
                       "upgrade_flag", "downgrade_flag", "churn_flag", "billing_frequency",
                       "auto_renew_flag").orderBy("account_id", "start_date", "subscription_id")


def churn_reactivation_map(churn: DataFrame, sub: DataFrame, p: Params, colocated: bool = False) -> DataFrame:
    """Reactivation and churn counts per account, full-joined, then matched to subscriptions.

    One grouped pass over the churn events gives both counts; an account
    with one kind only shows the other side as null (what a full outer join
    of the two counts gives), and the events without an account show as a row
    of their own for each kind. A subscription is attached only when both
    sides name the same account, so accounts on one side only get a null
    subscription. The per-account counts are unique per key and the
    subscription side may hold hot accounts, so the left join is done as an
    inner join plus the unmatched rows (see ``left_join_unique_to_skewed``).
    """
    back = F.col("is_reactivation")
    counts = churn.where(back.isNotNull()).groupBy("account_id").agg(
        F.count(F.when(back, 1)).alias("n_re"), F.count(F.when(~back, 1)).alias("n_ch"))
    named = F.col("account_id").isNotNull()
    re, ch = F.col("n_re") > 0, F.col("n_ch") > 0
    zero, none, nobody = (F.lit(0).cast("long"), F.lit(None).cast("long"),
                          F.lit(None).cast(churn.schema["account_id"].dataType))

    def row(re_id, ch_id, n_re, n_ch):
        return F.struct(re_id.alias("reactivated_account_id"), ch_id.alias("churned_account_id"),
                        n_re.alias("reactivated_times"), n_ch.alias("churned_times"))
    kinds = F.when(named, F.array(row(F.when(re, F.col("account_id")), F.when(ch, F.col("account_id")),
                                      F.when(re, F.col("n_re")), F.when(ch, F.col("n_ch"))))).otherwise(
        F.array_compact(F.array(F.when(re, row(nobody, nobody, zero, none)), F.when(ch, row(nobody, nobody, none, zero)))))
    keyed = counts.select("account_id", (named & re & ch).alias("_both"), F.explode(kinds).alias("k")).select(
        F.col("account_id").alias("_account"), "_both", "k.*")
    names = ["reactivated_account_id", "churned_account_id", "subscription_id", "reactivated_times", "churned_times"]
    if colocated:  # one join in place
        right = sub.select(F.col("account_id").alias("_sk"), "subscription_id")
        return keyed.join(right, (F.col("_account") == F.col("_sk")) & F.col("_both"), "left").select(*names)
    matched = left_join_unique_to_skewed(keyed.where("_both"), sub, "_account", "account_id", ["subscription_id"])
    rest = keyed.where("not _both").withColumn("subscription_id", F.lit(None).cast(sub.schema["subscription_id"].dataType))
    return matched.select(*names).unionByName(rest.select(*names))


def account_sub_attributes(raw_account: DataFrame, sub: DataFrame, p: Params,
                           account_id=None, colocated: bool = False) -> DataFrame:
    """Account-level vs subscription-level copies of the same attributes, side by side.

    Full outer join on account; ``account_id`` restricts it to one account
    (the original spot check), otherwise every account is compared.
    """
    a = raw_account.select(F.col("account_id").alias("a_account_id"),
                           F.col("churn_flag").alias("acc_churn"),
                           F.col("is_trial").alias("acc_trial"),
                           F.col("plan_tier").alias("acc_plan_tier"),
                           F.col("seats").alias("acc_seats"))
    b = sub.select("account_id", "subscription_id",
                   F.col("churn_flag").alias("sub_churn"), F.col("is_trial").alias("sub_trial"),
                   F.col("plan_tier").alias("sub_plan_tier"), F.col("seats").alias("sub_seats"))
    if account_id is not None:
        a = a.where(F.col("a_account_id") == F.lit(account_id))
        out = a.join(b, a.a_account_id == b.account_id, "left")
    else:
        out = full_outer_skew_safe(b, a, "account_id", "a_account_id", colocated)
    return out.select("account_id", "subscription_id", "acc_churn", "sub_churn", "acc_trial",
                      "sub_trial", "acc_plan_tier", "sub_plan_tier", "acc_seats", "sub_seats")


def days_to_start(sub: DataFrame, account: DataFrame, p: Params) -> DataFrame:
    """Days from the account's signup to each subscription's start."""
    acc = account.select(F.col("account_id").alias("_acc"), "signup_date")
    j = sub.join(acc, sub.account_id == acc._acc, "left")
    return (j.select(F.col("subscription_id").alias("acc"),
                     days_between(F.col("start_date"), F.col("signup_date"))
                     .alias("days_to_start_since_regist"))
            .orderBy(F.asc_nulls_last("days_to_start_since_regist"), "acc"))


def accounts_without_tickets(sub: DataFrame, tickets: DataFrame, account: DataFrame,
                             p: Params) -> DataFrame:
    """Accounts with subscriptions but no support ticket (NOT IN semantics)."""
    none = not_in(sub, "account_id", tickets, "account_id").select(
        "account_id", "is_trial", "churn_flag").distinct()
    acc = account.select(F.col("account_id").alias("_acc"), "signup_date")
    return none.join(acc, none.account_id == acc._acc).select(
        "account_id", "signup_date", "is_trial", "churn_flag")


def subs_without_usage(sub: DataFrame, usage: DataFrame, p: Params) -> DataFrame:
    return not_in(sub, "subscription_id", usage, "subscription_id").select("subscription_id")


def account_lifetime(account: DataFrame, churn: DataFrame, p: Params) -> DataFrame:
    """Days from signup to each churn event, longest first."""
    acc = account.select(F.col("account_id").alias("_acc"), "signup_date")
    j = acc.join(churn, acc._acc == churn.account_id)
    dur = days_between(F.col("churn_date"), F.col("signup_date"))
    return (j.orderBy(F.desc_nulls_first(dur), "churn_event_id")
            .select("signup_date", "churn_date", dur.alias("active_dur")))
