"""Registry of named queries: name -> (Tables, Params) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spineworks.plans import exploration as X
from spineworks.plans import profiling as P
from spineworks.plans import revenue as R
from spineworks.plans import support as T
from spineworks.plans import subscriptions as S
from spineworks.plans.tables import Tables

Query = Callable[[Tables, object], DataFrame]


def _sub(fn, **kw):
    return lambda t, p: fn(t.subscription, p, **kw)


QUERIES: dict[str, Query] = {
    # subscription metrics
    "active_end_month_included": _sub(S.active_end_month_included),
    "lost_per_month": _sub(S.lost_per_month),
    "lost_rows": _sub(S.lost_rows),
    "active_vs_lost": _sub(S.active_vs_lost),
    "active_at_month_end": _sub(S.active_at_month_end),
    "lost_trend": _sub(S.lost_trend),
    "active_unbounded_vs_lost": _sub(S.active_unbounded_vs_lost),
    "active_rows_closed_only": _sub(S.active_rows_closed_only),
    "count_open_subs": _sub(S.count_open_subs),
    "count_ended_by": _sub(S.count_ended_by),
    "open_sub_ids": _sub(S.open_sub_ids),
    "ended_in_month": _sub(S.ended_in_month),
    "ended_in_month_trials": _sub(S.ended_in_month, trials_only=True),
    "new_per_month": lambda t, p: S.new_per_month(t.account, t.subscription, p),
    "starts_per_month": _sub(S.starts_per_month),
    "lifetime_value": _sub(S.lifetime_value),
    # revenue metrics
    "accrued_revenue": _sub(R.accrued_revenue),
    "accrued_revenue_check": _sub(R.accrued_revenue_check),
    "recurring_rows": lambda t, p: R.recurring_rows(t.subscription, t.account, p),
    "recurring_revenue": _sub(R.recurring_revenue),
    "recurring_check": _sub(R.recurring_check),
    "recurring_rows_no_end_filter": _sub(R.recurring_rows_no_end_filter),
    "membership_difference": _sub(R.membership_difference),
    "subscription_lookup": lambda t, p: R.subscription_lookup(
        t.subscription, R.membership_difference(t.subscription, p)),
    "accrual_inclusive": _sub(R.accrual_inclusive),
    "revenue_by_plan_long": lambda t, p: R.revenue_by_plan_long(t.subscription, t.account, p),
    "revenue_by_plan_pivot": lambda t, p: R.revenue_by_plan_pivot(t.subscription, t.account, p),
    "revenue_by_industry_long": lambda t, p: R.revenue_by_industry_long(
        t.subscription, t.account, p),
    "revenue_by_industry_pivot": lambda t, p: R.revenue_by_industry_pivot(
        t.subscription, t.account, p),
}


def _tic(fn, **kw):
    return lambda t, p: fn(t.support_ticket, p, **kw)


def _churn(fn):
    return lambda t, p: fn(t.churn_event, p)


def _acc(fn):
    return lambda t, p: fn(t.account, p)


QUERIES.update({
    # support tickets
    "resolution_stats": _tic(T.resolution_stats),
    "count_escalation": _tic(T.count_escalation),
    "first_response_range": _tic(T.first_response_range),
    "avg_satisfaction": _tic(T.avg_satisfaction),
    "count_satisfaction": _tic(T.count_satisfaction),
    "submitted_range": _tic(T.submitted_range),
    "escalation_at_max_resolution": _tic(T.escalation_at_max_resolution),
    "tickets_at_max_response": _tic(T.tickets_at_max_response),
    "tickets_per_month": _tic(T.tickets_per_month),
    "ticket_satisfaction_per_month": _tic(T.ticket_satisfaction_per_month),
    "tickets_in_range": _tic(T.tickets_in_range),
    # consistency audit
    "subs_without_churn_event": lambda t, p: X.subs_without_churn_event(
        t.subscription, t.churn_event, p),
    "unused_subs_by_tier": lambda t, p: X.unused_subs_by_tier(t.subscription, t.feature_usage, p),
    "resolve_time_by_priority": _tic(X.resolve_time_by_priority),
    "reason_feedback_matrix": _churn(X.reason_feedback_matrix),
    # distributions
    "share_industry": _acc(X.share_industry),
    "share_country": _acc(X.share_country),
    "share_referral": _acc(X.share_referral),
    "share_feedback": _churn(X.share_feedback),
    "reason_feedback_rows": _churn(X.reason_feedback_rows),
    "refund_by_feedback": _churn(X.refund_by_feedback),
    "refunded_reactivations": _churn(X.refunded_reactivations),
    "share_plan_tier": _sub(X.share_plan_tier),
    "share_trial": _sub(X.share_trial),
    "trial_durations": _sub(X.trial_durations),
    "count_billing_frequency": _sub(X.count_billing_frequency),
    "count_priority_escalation": _tic(X.count_priority_escalation),
    "subs_per_account": _sub(X.subs_per_account),
    # keys and relations
    "key_card_account": _acc(X.key_card_account),
    "key_card_usage": lambda t, p: X.key_card_usage(t.feature_usage, p),
    "key_card_ticket": _tic(X.key_card_ticket),
    "key_card_churn": _churn(X.key_card_churn),
    "key_card_subscription": _sub(X.key_card_subscription),
    "account_subscriptions": _sub(X.account_subscriptions),
    "churn_reactivation_map": lambda t, p: X.churn_reactivation_map(
        t.churn_event, t.subscription, p, t.colocated),
    "account_sub_attributes": lambda t, p: X.account_sub_attributes(
        t.raw_account, t.subscription, p, colocated=t.colocated),
    "days_to_start": lambda t, p: X.days_to_start(t.subscription, t.account, p),
    "accounts_without_tickets": lambda t, p: X.accounts_without_tickets(
        t.subscription, t.support_ticket, t.account, p),
    "subs_without_usage": lambda t, p: X.subs_without_usage(t.subscription, t.feature_usage, p),
    "account_lifetime": lambda t, p: X.account_lifetime(t.account, t.churn_event, p),
})

# load-time profiling and cleaning
for _name in ("null_profile", "empty_profile", "whitespace_profile", "dup_rows_ignoring_id",
              "dup_key_counts", "dup_row_listing", "dup_usage_id_rows", "dedupe_subscription",
              "nunique_profile", "rekey_usage", "value_counts_profile", "flag_counts",
              "top_accounts_by_subs", "top_accounts_by_seats", "top_sub_accounts_by_seats",
              "top_accounts_by_churn", "top_account_subscriptions", "top_churn_account_events",
              "table_shapes", "rule_violation_counts",
              "churn_reconciliation", "churn_summary", "clean_subscription", "clean_usage"):
    QUERIES[_name] = getattr(P, _name)
QUERIES["rule_violations"] = P.rule_violations_report

#: Final row order of the reports that end in a sort ("-" is descending, nulls
#: last). Ids break ties, so a range sort can cut a hot key.
FINAL_ORDER = {
    "accrued_revenue": ("month_date",),
    "recurring_revenue": ("month_date",),
    "recurring_rows_no_end_filter": ("subscription_id", "month_date"),
    "accrual_inclusive": ("subscription_id", "month_date"),
    "revenue_by_plan_pivot": ("month_date",),
    "revenue_by_industry_pivot": ("month_date",),
    "churn_reactivation_map": ("reactivated_account_id", "churned_account_id", "subscription_id"),
    "account_sub_attributes": ("account_id", "subscription_id"),
    "active_rows_closed_only": ("subscription_id", "month_date", "start_date"),
    "starts_per_month": ("start_month",),
    "ticket_satisfaction_per_month": ("month_date",),
    "reason_feedback_matrix": ("reason_code", "feedback_text"),
    "value_counts_profile": ("table_name", "column", "-count", "value"),
}


def _ordered(fn: Query, keys) -> Query:
    def run(t, p):
        return fn(t, p).orderBy(*[F.desc_nulls_last(k[1:]) if k[0] == "-" else F.asc_nulls_last(k) for k in keys])
    return run


QUERIES.update({name: _ordered(QUERIES[name], keys) for name, keys in FINAL_ORDER.items()})
