from helpers import D, make_tables, rows, sub_row

from spineworks.operators.relations import (
    full_outer_skew_safe, in_except, left_join_unique_to_skewed, not_in)
from spineworks.plans import exploration as X
from spineworks.plans import profiling as P
from spineworks.plans.params import Params


def _df(spark, vals, name="k"):
    return spark.createDataFrame([(v,) for v in vals], f"{name} bigint")


def test_not_in_null_on_right_gives_nothing(spark):
    out = not_in(_df(spark, [1, 2, 3]), "k", _df(spark, [1, None], "r"), "r")
    assert out.count() == 0


def test_not_in_empty_right_keeps_null_keys(spark):
    out = not_in(_df(spark, [1, None]), "k", _df(spark, [], "r"), "r")
    assert sorted(rows(out, "k"), key=str) == sorted([(1,), (None,)], key=str)


def test_not_in_plain(spark):
    out = not_in(_df(spark, [1, 2, None]), "k", _df(spark, [2, 5], "r"), "r")
    assert rows(out, "k") == [(1,)]


def test_not_in_matches_sql(spark):
    l, r = _df(spark, [1, 2, None, 4]), _df(spark, [2, 7], "r")
    l.createOrReplaceTempView("l_v")
    r.createOrReplaceTempView("r_v")
    want = rows(spark.sql("SELECT k FROM l_v WHERE k NOT IN (SELECT r FROM r_v)"), "k")
    assert rows(not_in(l, "k", r, "r"), "k") == want


def test_in_except(spark):
    left = _df(spark, [1, 1, 2, 3, None])
    out = in_except(left, "k", _df(spark, [1, 2, None], "a"), "a", _df(spark, [2], "b"), "b")
    assert rows(out, "k") == [(1,), (1,)]


def test_full_outer_skew_safe_equals_full_join(spark):
    big = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z"), (None, "n")], "k bigint, v string")
    small = spark.createDataFrame([(1, "A"), (3, "C")], "sk bigint, w string")
    got = full_outer_skew_safe(big, small, "k", "sk")
    want = big.join(small, big.k == small.sk, "full_outer")
    cols = ["k", "v", "sk", "w"]
    key = lambda t: tuple(str(x) for x in t)
    assert sorted(rows(got, *cols), key=key) == sorted(rows(want, *cols), key=key)


def test_left_join_unique_to_skewed_equals_left_join(spark):
    uniq = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k bigint, t string")
    sk = spark.createDataFrame([(1, 10), (1, 11), (3, 12)], "ak bigint, sid bigint")
    got = left_join_unique_to_skewed(uniq, sk, "k", "ak", ["sid"])
    want = uniq.join(sk, uniq.k == sk.ak, "left").select("k", "t", "sid")
    key = lambda t: tuple(str(x) for x in t)
    assert sorted(rows(got, "k", "t", "sid"), key=key) == sorted(rows(want, "k", "t", "sid"), key=key)


def test_churn_mismatch_reported_for_one_sided_account(spark):
    t = make_tables(spark, [sub_row(1, "2024-01-01", churn=True, acc=1)],
                    churn=[(10, 2, D("2024-02-01"), "pricing", None, 0.0, False),
                           (11, 1, D("2024-02-01"), "pricing", None, 0.0, False)])
    got = rows(P.churn_reconciliation(t, Params()), "account_id", "churn_flag", "churn_event_count")
    assert got == [(2, None, 1)]


def test_churn_reactivation_map_one_sided_rows_get_null_subscription(spark):
    t = make_tables(spark, [sub_row(1, "2024-01-01", acc=1), sub_row(2, "2024-01-02", acc=1),
                            sub_row(3, "2024-01-01", acc=2)],
                    churn=[(10, 1, D("2024-02-01"), "p", None, 0.0, True),
                           (11, 1, D("2024-02-01"), "p", None, 0.0, False),
                           (12, 2, D("2024-02-01"), "p", None, 0.0, False)])
    got = rows(X.churn_reactivation_map(t.churn_event, t.subscription, Params()),
               "reactivated_account_id", "churned_account_id", "subscription_id")
    assert sorted(got, key=str) == sorted([(1, 1, 1), (1, 1, 2), (None, 2, None)], key=str)


def test_in_except_same_table_shortcut(spark):
    left = _df(spark, [1, 1, 2, 3, None])
    out = in_except(left, "k", left, "k", _df(spark, [2], "b"), "b")
    assert rows(out, "k") == [(1,), (1,), (3,)]
