"""Explicit schemas of the five entity tables (no inference at load time)."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _D, _B, _F = T.StringType(), T.LongType(), T.DateType(), T.BooleanType(), T.DoubleType()
MONEY = T.DecimalType(18, 2)
_TS = T.TimestampNTZType()


def _schema(*fields):
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


SUBSCRIPTION = _schema(
    ("subscription_id", _S), ("account_id", _S), ("start_date", _D), ("end_date", _D),
    ("plan_tier", _S), ("seats", _L), ("mrr_amount", MONEY), ("arr_amount", MONEY),
    ("is_trial", _B), ("upgrade_flag", _B), ("downgrade_flag", _B), ("churn_flag", _B),
    ("billing_frequency", _S), ("auto_renew_flag", _B))

ACCOUNT = _schema(
    ("account_id", _S), ("account_name", _S), ("industry", _S), ("country", _S),
    ("signup_date", _D), ("referral_source", _S), ("plan_tier", _S), ("seats", _L),
    ("is_trial", _B), ("churn_flag", _B))

FEATURE_USAGE = _schema(
    ("usage_id", _S), ("subscription_id", _S), ("usage_date", _D), ("feature_name", _S),
    ("usage_count", _L), ("usage_duration_secs", _L), ("error_count", _L))

SUPPORT_TICKET = _schema(
    ("ticket_id", _S), ("account_id", _S), ("submitted_at", _TS), ("closed_at", _TS),
    ("resolution_time_hours", _F), ("first_response_time_minutes", _L),
    ("priority", _S), ("escalation_flag", _B), ("satisfaction_score", _F))

CHURN_EVENT = _schema(
    ("churn_event_id", _S), ("account_id", _S), ("churn_date", _D), ("reason_code", _S),
    ("refund_amount_usd", _F), ("feedback_text", _S), ("is_reactivation", _B))

SCHEMAS = {
    "subscription": SUBSCRIPTION,
    "account": ACCOUNT,
    "feature_usage": FEATURE_USAGE,
    "support_ticket": SUPPORT_TICKET,
    "churn_event": CHURN_EVENT,
}

# Columns of the account table that describe subscriptions rather than
# accounts; they are dropped from the account table before reporting.
ACCOUNT_SUBSCRIPTION_COLUMNS = ("plan_tier", "seats", "is_trial", "churn_flag")

# Row identifiers of each table (excluded when looking for duplicate rows).
ID_COLUMNS = {
    "subscription": "subscription_id",
    "account": "account_id",
    "feature_usage": "usage_id",
    "support_ticket": "ticket_id",
    "churn_event": "churn_event_id",
}
