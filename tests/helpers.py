"""Hand-made entity rows for unit tests."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from spineworks.plans.tables import Tables

D = dt.date.fromisoformat

SUB_COLS = ("subscription_id", "account_id", "start_date", "end_date", "plan_tier", "seats",
            "mrr_amount", "is_trial", "upgrade_flag", "downgrade_flag", "churn_flag",
            "billing_frequency", "auto_renew_flag", "arr_amount")
SUB_SCHEMA = ("subscription_id bigint, account_id bigint, start_date date, end_date date, "
              "plan_tier string, seats bigint, mrr_amount decimal(18,2), is_trial boolean, "
              "upgrade_flag boolean, downgrade_flag boolean, churn_flag boolean, "
              "billing_frequency string, auto_renew_flag boolean, arr_amount decimal(18,2)")
ACC_SCHEMA = ("account_id bigint, account_name string, industry string, country string, "
              "referral_source string, signup_date date, plan_tier string, seats bigint, "
              "is_trial boolean, churn_flag boolean")
USAGE_SCHEMA = ("usage_id bigint, subscription_id bigint, usage_date date, feature_name string, "
                "usage_count bigint, usage_duration_secs bigint, error_count bigint")
TICKET_SCHEMA = ("ticket_id bigint, account_id bigint, submitted_at timestamp_ntz, "
                 "closed_at timestamp_ntz, priority string, escalation_flag boolean, "
                 "satisfaction_score double, resolution_time_hours double, "
                 "first_response_time_minutes bigint")
CHURN_SCHEMA = ("churn_event_id bigint, account_id bigint, churn_date date, reason_code string, "
                "feedback_text string, refund_amount_usd double, is_reactivation boolean")


def sub_row(i, start, end=None, acc=1, tier="Basic", mrr="10.00", trial=False, seats=1,
            up=False, down=False, churn=False, arr=None):
    mrr_d = Decimal(mrr)
    return (i, acc, D(start), D(end) if end else None, tier, seats, mrr_d, trial, up, down,
            churn, "monthly", False, Decimal(arr) if arr else mrr_d * 12)


def make_tables(spark, subs=(), accounts=None, usage=(), tickets=(), churn=()):
    accounts = accounts if accounts is not None else [
        (1, "a1", "FinTech", "X", "web", D("2023-01-01"), "Basic", 1, False, False)]
    frames = {
        "subscription": spark.createDataFrame(list(subs), SUB_SCHEMA),
        "account": spark.createDataFrame(list(accounts), ACC_SCHEMA),
        "feature_usage": spark.createDataFrame(list(usage), USAGE_SCHEMA),
        "support_ticket": spark.createDataFrame(list(tickets), TICKET_SCHEMA),
        "churn_event": spark.createDataFrame(list(churn), CHURN_SCHEMA),
    }
    return Tables(spark, "mem", {k: (lambda s, src, df=v: df) for k, v in frames.items()})


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()),
                  key=lambda t: tuple((x is None, x if x is not None else 0) for x in t))
