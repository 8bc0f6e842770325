"""Reports kept by changes equal the reports over all rows, after any batches."""

import random
import tempfile

import pytest

from helpers import SUB_SCHEMA, make_tables
from spineworks.operators import maintained as M
from spineworks.plans import revenue as R
from spineworks.plans import subscriptions as S
from test_spine_equivalence import _random_subs
from test_spine_traps import P24


def _bag(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def _equal(spark, state, rows):
    sub = make_tables(spark, rows).subscription
    raw = spark.createDataFrame(rows, SUB_SCHEMA)
    for kept, full in ((M.active_end_month_included(state, P24), S.active_end_month_included(raw, P24)),
                       (M.active_at_month_end(state, P24), S.active_at_month_end(raw, P24)),
                       (M.lost_per_month(state, P24), S.lost_per_month(raw, P24)),
                       (M.recurring_revenue(state, P24), R.recurring_revenue(raw, P24))):
        assert sorted(kept.columns) == sorted(full.columns)
        assert _bag(kept.select(*full.columns)) == _bag(full)
    assert sub.columns


def test_random_batches(spark):
    rnd = random.Random(3)
    pool = _random_subs(260, seed=4) + [(None, *r[1:]) for r in _random_subs(20, seed=9)]
    pool += [(r[0], r[1], *r[2:6], None, *r[7:]) for r in _random_subs(15, seed=11)]
    kept = M.MaintainedMonths(spark, tempfile.mkdtemp() + "/state")
    with pytest.raises(FileNotFoundError):
        kept.state()
    now, rest = pool[:120], pool[120:]
    kept.update(added=spark.createDataFrame(now, SUB_SCHEMA))
    _equal(spark, kept.state(), now)
    for _ in range(3):
        rnd.shuffle(now)
        gone, now = now[:40], now[40:]
        come, rest = rest[:35] + gone[:5], rest[35:]  # some come back
        kept.update(spark.createDataFrame(come, SUB_SCHEMA), spark.createDataFrame(gone, SUB_SCHEMA))
        now += come
        assert _bag(kept.state().select(*M.KEYS, *M.WEIGHTS)) == _bag(
            M.partials(spark.createDataFrame(now, SUB_SCHEMA)).select(*M.KEYS, *M.WEIGHTS))
    _equal(spark, kept.state(), now)
    kept.update(removed=spark.createDataFrame(now, SUB_SCHEMA))
    assert kept.state().count() == 0


def test_revenue_by_plan_of_joined_rows(spark):
    t = make_tables(spark, _random_subs(150, seed=21), accounts=[
        (a, f"a{a}", "FinTech", "X", "web", None, "Basic", 1, False, False) for a in (1, 2)])
    members = t.raw_subscription.join(t.raw_account.select("account_id"), "account_id")
    got = M.revenue_by_plan_long(M.partials(members), P24)
    full = R.revenue_by_plan_long(t.raw_subscription, t.account, P24)
    assert _bag(got.select(*full.columns)) == _bag(full)


def test_removing_unknown_rows_changes_nothing(spark):
    rows = _random_subs(30, seed=6)
    kept = M.MaintainedMonths(spark, tempfile.mkdtemp() + "/state")
    kept.update(added=spark.createDataFrame(rows[:10], SUB_SCHEMA))
    before = _bag(kept.state())
    with pytest.raises(ValueError):
        kept.update(removed=spark.createDataFrame(rows[10:], SUB_SCHEMA))
    assert _bag(kept.state()) == before
