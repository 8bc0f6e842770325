"""The pre-aggregated spine forms equal the naive calendar cross join."""

import random

from pyspark.sql import functions as F
from helpers import D, make_tables, sub_row

from spineworks.functions import month_last_day, month_start, whole_months
from spineworks.plans import revenue as R
from spineworks.plans import subscriptions as S
from spineworks.sources.calendar import month_spine
from test_spine_traps import P24


def _random_subs(n=400, seed=7):
    rnd = random.Random(seed)
    base = D("2022-06-01").toordinal()
    out = []
    for i in range(n):
        s = base + rnd.randrange(0, 1000)
        e = None if rnd.random() < 0.3 else s + rnd.randrange(-60, 500)
        out.append(sub_row(i, D("2000-01-01").fromordinal(s).isoformat(),
                           None if e is None else D("2000-01-01").fromordinal(e).isoformat(),
                           acc=rnd.randrange(1, 4), tier=rnd.choice(["Basic", "Pro", "X"]),
                           mrr=f"{rnd.randrange(0, 5000) / 100:.2f}", trial=rnd.random() < 0.2,
                           seats=rnd.choice([1, 2, 5, None])))
    return out


def _as_set(df, cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()),
                  key=lambda t: tuple((x is None, x if x is not None else 0) for x in t))


def _cross(spark, sub):
    return sub.crossJoin(month_spine(spark, P24.calendar_start, P24.calendar_end))


def test_active_end_month_included_equals_cross_join(spark):
    t = make_tables(spark, _random_subs())
    m, s, e = F.col("month_date"), F.col("start_date"), F.col("end_date")
    naive = (_cross(spark, t.subscription)
             .where((e >= F.lit(P24.window_start)) | e.isNull())
             .where((m >= month_start(s)) & (m <= F.coalesce(e, F.lit(P24.open_end_horizon))))
             .groupBy("month_date").agg(F.count(F.lit(1)).alias("active_subscriptions"),
                                        F.count(F.when(F.col("is_trial"), 1)).alias("trial_subscriptions")))
    cols = ["month_date", "active_subscriptions", "trial_subscriptions"]
    assert _as_set(naive, cols) == _as_set(S.active_end_month_included(t.subscription, P24), cols)


def test_active_at_month_end_equals_cross_join(spark):
    t = make_tables(spark, _random_subs(seed=11))
    m, s, e = F.col("month_date"), F.col("start_date"), F.col("end_date")
    naive = (_cross(spark, t.subscription)
             .where((s <= month_last_day(m)) & ((e >= month_last_day(m)) | e.isNull()))
             .groupBy("month_date").agg(F.count("subscription_id").alias("active_subscriptions")))
    cols = ["month_date", "active_subscriptions"]
    assert _as_set(naive, cols) == _as_set(S.active_at_month_end(t.subscription, P24), cols)


def test_accrued_revenue_equals_cross_join(spark):
    t = make_tables(spark, _random_subs(seed=3))
    m, s = F.col("month_date"), F.col("start_date")
    e = F.coalesce(F.col("end_date"), F.lit(P24.accrual_horizon))
    naive = (_cross(spark, t.subscription)
             .where((s <= month_last_day(m)) & (F.col("is_trial") == False)  # noqa: E712
                    & (e >= month_last_day(m)))
             .groupBy("month_date").agg(
                 F.sum(F.col("mrr_amount") * whole_months(m, s)).cast("double").alias("revenue_accrued"),
                 F.sum("seats").alias("seats")))
    cols = ["month_date", "revenue_accrued", "seats"]
    assert _as_set(naive, cols) == _as_set(R.accrued_revenue(t.subscription, P24), cols)


def test_recurring_revenue_and_pivot_equal_cross_join(spark):
    t = make_tables(spark, _random_subs(seed=5), accounts=[
        (a, f"a{a}", ind, "X", "web", D("2020-01-01"), "Basic", 1, False, False)
        for a, ind in ((1, "FinTech"), (2, "EdTech"), (3, None))])
    m, s, e = F.col("month_date"), F.col("start_date"), F.col("end_date")
    member = (((F.col("is_trial") == False) & (e >= F.lit(P24.window_start))) | e.isNull())  # noqa: E712
    naive_rows = (_cross(spark, t.subscription).where(member)
                  .where((m >= month_start(s)) & (F.coalesce(e, F.lit(P24.open_end_horizon)) >= m)))
    naive = naive_rows.groupBy("month_date").agg(F.sum("mrr_amount").cast("double").alias("revenue"))
    assert _as_set(naive, ["month_date", "revenue"]) == _as_set(
        R.recurring_revenue(t.subscription, P24), ["month_date", "revenue"])
    joined = naive_rows.join(t.account.select("account_id", "industry"), "account_id")
    by_ind = joined.groupBy("month_date", "industry").agg(
        F.sum("mrr_amount").cast("double").alias("rev_industry"))
    cols = ["month_date", "industry", "rev_industry"]
    assert _as_set(by_ind, cols) == _as_set(
        R.revenue_by_industry_long(t.subscription, t.account, P24), cols)
    # pivot row sums equal long sums over the listed categories
    long = {(r["month_date"], r["plan_tier"]): r["rev_plan_tier"]
            for r in R.revenue_by_plan_long(t.subscription, t.account, P24).collect()}
    for r in R.revenue_by_plan_pivot(t.subscription, t.account, P24).collect():
        for tier in ("Basic", "Pro", "Enterprise"):
            assert r[tier] == long.get((r["month_date"], tier))


def test_active_balance_property(spark):
    """active(m) - active(m-1) = rows starting in m - rows whose last month is m-1."""
    t = make_tables(spark, [r for r in _random_subs(seed=13) if r[2] >= D("2024-01-01")])
    act = {r["month_date"]: r["active_subscriptions"] for r in
           S.active_at_month_end(t.subscription, P24).collect()}
    from spineworks.functions import last_counted_month
    sub = t.subscription.select(month_start("start_date").alias("lo"),
                                last_counted_month("end_date").alias("hi")).collect()
    months = sorted(act)
    for prev, cur in zip(months, months[1:]):
        starts = sum(1 for r in sub if r["lo"] == cur and (r["hi"] is None or r["hi"] >= r["lo"]))
        ends = sum(1 for r in sub if r["hi"] == prev and r["hi"] >= r["lo"])
        assert act[cur] - act[prev] == starts - ends
