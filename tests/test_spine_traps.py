"""Month-boundary traps on hand-made rows (calendar 2024)."""

import datetime as dt

from helpers import D, make_tables, rows, sub_row

from spineworks.plans import revenue as R
from spineworks.plans import subscriptions as S
from spineworks.plans import support as T
from spineworks.plans.params import Params

P24 = Params(calendar_start=D("2024-01-01"), calendar_end=D("2024-12-01"),
             open_end_horizon=D("2024-12-31"), accrual_horizon=D("2025-12-31"),
             lifetime_horizon=D("2025-07-01"), ended_by=D("2024-12-01"),
             ended_month=D("2024-02-01"))


def _months(df, col="month_date"):
    return sorted(r[col] for r in df.collect())


def test_end_mid_month(spark):
    t = make_tables(spark, [sub_row(1, "2024-01-10", "2024-06-20")])
    d1 = _months(S.active_end_month_included(t.subscription, P24))
    d2 = _months(S.active_at_month_end(t.subscription, P24))
    d3 = _months(S.lost_per_month(t.subscription, P24))
    assert D("2024-06-01") in d1 and D("2024-06-01") not in d2
    assert d2[-1] == D("2024-05-01") and d3 == [D("2024-06-01")]


def test_end_on_last_day(spark):
    t = make_tables(spark, [sub_row(1, "2024-01-10", "2024-06-30")])
    assert _months(S.active_end_month_included(t.subscription, P24))[-1] == D("2024-06-01")
    assert _months(S.active_at_month_end(t.subscription, P24))[-1] == D("2024-06-01")


def test_start_on_last_day(spark):
    t = make_tables(spark, [sub_row(1, "2024-01-31", None, mrr="100.00")])
    jan = D("2024-01-01")
    for df in (S.active_end_month_included(t.subscription, P24),
               S.active_at_month_end(t.subscription, P24),
               R.accrued_revenue(t.subscription, P24),
               R.recurring_revenue(t.subscription, P24)):
        assert jan in _months(df)
    acc = {r["month_date"]: r["revenue_accrued"] for r in
           R.accrued_revenue(t.subscription, P24).collect()}
    # whole months from 2024-01-31: 0 at Feb 1st, 1 at Mar 1st
    assert acc[D("2024-02-01")] == 0.0 and acc[D("2024-03-01")] == 100.0


def test_open_trial_leaks_into_recurring_unless_strict(spark):
    t = make_tables(spark, [sub_row(1, "2024-03-05", None, trial=True, mrr="0.00"),
                            sub_row(2, "2024-03-05", "2024-05-01", trial=True, mrr="0.00")])
    ids = {r["subscription_id"] for r in R.recurring_rows(t.subscription, t.account, P24).collect()}
    assert ids == {1}
    strict = P24.with_(strict_trial_filter=True)
    assert R.recurring_rows(t.subscription, t.account, strict).count() == 0


def test_ended_before_window(spark):
    t = make_tables(spark, [sub_row(1, "2023-05-01", "2023-11-05"),
                            sub_row(2, "2023-05-01", None)])
    assert {r["subscription_id"] for r in
            R.recurring_rows(t.subscription, t.account, P24).collect()} == {2}
    assert S.active_end_month_included(t.subscription, P24).count() == 12
    assert rows(R.membership_difference(t.subscription, P24), "subscription_id") == [(1,)]


def test_ticket_at_last_day_after_midnight(spark):
    ts = dt.datetime(2024, 1, 31, 10, 0)
    t = make_tables(spark, tickets=[(1, 1, ts, ts, "high", False, 4.0, 1.0, 10)])
    assert rows(T.tickets_per_month(t.support_ticket, P24), "month_date", "ticket") == [
        (D("2024-01-01"), 1)]
    assert T.ticket_satisfaction_per_month(t.support_ticket, P24).count() == 0
    assert T.tickets_in_range(t.support_ticket, P24).first()["ticket_count"] == 0


def test_active_vs_lost_drops_months_without_losses(spark):
    t = make_tables(spark, [sub_row(1, "2024-01-10", "2024-03-20"),
                            sub_row(2, "2024-01-10", None)])
    assert _months(S.active_vs_lost(t.subscription, P24)) == [D("2024-03-01")]
    filled = {r["month_date"]: r["lost_active_subscriptions"]
              for r in S.active_vs_lost(t.subscription, P24, fill_gaps=True).collect()}
    assert len(filled) == 12 and filled[D("2024-03-01")] == 1 and filled[D("2024-04-01")] == 0


def test_unlisted_pivot_category_row_kept(spark):
    t = make_tables(spark, [sub_row(1, "2024-01-10", "2024-01-20", tier="Other")])
    out = R.revenue_by_plan_pivot(t.subscription, t.account, P24).collect()
    assert len(out) == 1 and out[0]["Basic"] is None and out[0]["Pro"] is None


def test_industry_label_mapping(spark):
    t = make_tables(spark, [sub_row(1, "2024-01-10", "2024-01-20")])
    out = R.revenue_by_industry_pivot(t.subscription, t.account, P24)
    assert out.columns == ["month_date", "Fintech", "EdTech", "Cybersecurity", "HealthTech",
                           "DevTools"]
    assert out.first()["Fintech"] == 10.0


def test_lifetime_value(spark):
    t = make_tables(spark, [sub_row(1, "2024-01-20", "2024-04-02", mrr="5.00"),
                            sub_row(2, "2025-01-05", None, mrr="1.00")])
    got = dict(rows(S.lifetime_value(t.subscription, P24), "subscription_id", "lifetime_value"))
    assert got == {1: 15.0, 2: 6.0}


def test_tickets_fill_gaps(spark):
    mk = lambda i, m: (i, 1, dt.datetime(2024, m, 3), dt.datetime(2024, m, 9), "low", False,
                       3.0, 1.0, 5)
    t = make_tables(spark, tickets=[mk(1, 1), mk(2, 1), mk(3, 3)])
    plain = rows(T.tickets_per_month(t.support_ticket, P24), "month_date", "ticket", "diff")
    assert plain == [(D("2024-01-01"), 2, None), (D("2024-03-01"), 1, -1)]
    filled = rows(T.tickets_per_month(t.support_ticket, P24, fill_gaps=True),
                  "month_date", "ticket", "diff")
    assert len(filled) == 12 and filled[1] == (D("2024-02-01"), 0, -2)


def test_register_views_runs_original_sql(spark):
    from spineworks.plans.tables import register_views
    t = make_tables(spark, [sub_row(1, "2024-01-10", "2024-06-20"), sub_row(2, "2024-02-01")])
    assert "cal" in register_views(t, P24)
    got = spark.sql("""SELECT month_date, COUNT(*) AS n FROM subscription CROSS JOIN cal
                       WHERE end_date BETWEEN month_date AND last_day(month_date) GROUP BY 1""").collect()
    assert [(r[0], r[1]) for r in got] == [(D("2024-06-01"), 1)]


def test_first_partial_month_adds_seats_not_revenue(spark):
    # T15: whole months from a mid-month start are 0 in its first full month.
    t = make_tables(spark, [sub_row(1, "2024-01-15", None, mrr="10.00", seats=3)])
    got = {r["month_date"]: (r["revenue_accrued"], r["seats"])
           for r in R.accrued_revenue(t.subscription, P24).collect()}
    assert got[D("2024-01-01")] == (0.0, 3)
    assert got[D("2024-02-01")] == (0.0, 3)   # 2024-01-15 -> 2024-02-01 is 0 whole months
    assert got[D("2024-03-01")] == (10.0, 3)


def test_share_counts_column_keeps_null_group_at_zero(spark):
    # T12: COUNT(industry) gives the null group 0; COUNT(*) would count it.
    from spineworks.plans import exploration as X
    acc = [(i, f"a{i}", ind, "X", "web", D("2023-01-01"), "Basic", 1, False, False)
           for i, ind in enumerate(["FinTech", "FinTech", None, "EdTech"])]
    t = make_tables(spark, accounts=acc)
    got = {r["industry"]: (r["amt"], r["total"], r["amt_perc"])
           for r in X.share_industry(t.account, P24).collect()}
    assert got == {"FinTech": (2, 3, 66.67), "EdTech": (1, 3, 33.33), None: (0, 3, 0.0)}


def test_recurring_filter_uses_raw_end_date(spark):
    # T3: the membership filter sees the stored end date, the month bound the
    # horizon-filled one; an open subscription counts to the horizon only.
    t = make_tables(spark, [sub_row(1, "2023-06-01", None, mrr="5.00")])
    p = P24.with_(open_end_horizon=D("2024-03-31"))
    months = _months(R.recurring_revenue(t.subscription, p))
    assert months == [D("2024-01-01"), D("2024-02-01"), D("2024-03-01")]


def test_hot_account_results_match_plain_joins(spark):
    # One account holds most subscriptions: the skew-safe join forms must
    # still give exactly the plain join results.
    from spineworks.plans import exploration as X
    subs = [sub_row(i, f"2024-{1 + i % 12:02d}-{1 + i % 27:02d}", None, acc=1 if i % 3 else 2,
                    mrr=f"{i}.00")
            for i in range(300)]
    acc = [(a, f"a{a}", "FinTech", "X", "web", D("2023-01-01"), "Basic", 1, False, False)
           for a in (1, 2, 3)]
    churn = [(10, 1, D("2024-02-01"), "p", None, 0.0, True),
             (11, 1, D("2024-02-01"), "p", None, 0.0, False),
             (12, 3, D("2024-02-01"), "p", None, 0.0, False)]
    t = make_tables(spark, subs, accounts=acc, churn=churn)
    m = X.churn_reactivation_map(t.churn_event, t.subscription, P24)
    assert m.where("subscription_id IS NOT NULL").count() == 200
    assert m.where("subscription_id IS NULL").count() == 1
    attrs = X.account_sub_attributes(t.raw_account, t.subscription, P24)
    assert attrs.count() == 301   # 300 subscriptions + account 3 without any


def test_session_catalog_after_register_views(spark):
    from spineworks.plans.tables import register_views
    from spineworks.sources.catalog import session_columns, session_tables
    t = make_tables(spark, [sub_row(1, "2024-01-10")])
    names = register_views(t, P24)
    listed = {r["table_name"] for r in session_tables(spark).collect()}
    assert set(names) <= listed
    cols = [(r["column_name"], r["ordinal_position"]) for r in
            session_columns(spark, ["cal"]).collect()]
    assert cols == [("month_date", 1)]
