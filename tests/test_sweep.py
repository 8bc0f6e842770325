"""The event sweep equals the calendar cross join, on long daily spines too."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from helpers import make_tables
from spineworks.operators.sweep import accrued, running, spine_length, sweep
from spineworks.plans import revenue as R
from test_spine_equivalence import _random_subs
from test_spine_traps import P24

START, END = dt.date(2015, 3, 1), dt.date(2025, 2, 28)
SCHEMA = "lo date, hi date, amount decimal(18,2), n long, k string"


def _rows(rnd, n):
    def day(spread):
        return START + dt.timedelta(days=rnd.randint(-400, spread))
    out = []
    for _ in range(n):
        lo = day(4200)
        out.append((None if rnd.random() < .05 else lo,
                    None if rnd.random() < .2 else lo + dt.timedelta(days=rnd.randint(-30, 900)),
                    None if rnd.random() < .1 else Decimal(rnd.randint(-500, 99999)) / 100,
                    rnd.choice([None, 1, 2]), rnd.choice([None, "a", "b"])))
    return out


def _naive(rows, days, keys):
    out = {}
    for lo, hi, amount, n, k in rows:
        for d in days:
            if lo is not None and lo <= d and (hi is None or d <= hi):
                got = out.setdefault((d, k) if keys else (d,), [None, None])
                for i, v in enumerate((amount, n)):
                    got[i] = got[i] if v is None else v + (got[i] or 0)
    return sorted(((*at, *v) for at, v in out.items()), key=str)


@pytest.mark.parametrize("keys", [(), ("k",)])
def test_daily_spine_of_ten_years(spark, keys):
    rows = _rows(random.Random(len(keys)), 150)
    df = spark.createDataFrame(rows, SCHEMA)
    days = [START + dt.timedelta(days=i) for i in range(spine_length(START, END, "day"))]
    got = sweep(df, F.col("lo"), F.col("hi"), START, END, {"amount": F.col("amount"), "n": F.col("n")}, keys)
    assert sorted((tuple(r) for r in got.collect()), key=str) == _naive(rows, days, keys)


def test_events_not_rows_cross_the_shuffle(spark):
    df = spark.range(200_000).select(F.date_add(F.lit(START), (F.col("id") % 50).cast("int")).alias("lo"),
                                     F.date_add(F.lit(START), (F.col("id") % 50 + F.col("id") % 7).cast("int")).alias("hi"))
    out = sweep(df, F.col("lo"), F.col("hi"), START, END, {"n": F.lit(1)})
    assert out.agg(F.sum("n")).first()[0] == sum(i % 7 + 1 for i in range(200_000))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
    # events are summed map-side before any of them is shuffled
    below = plan[plan.rindex("Exchange"):]
    assert "partial_sum" in below and "Generate explode" in below


def test_months_and_edges(spark):
    rows = [(dt.date(2024, 1, 1), None, 1), (dt.date(2023, 5, 1), dt.date(2024, 2, 1), 10), (dt.date(2024, 12, 1), dt.date(2025, 6, 1), 100),
            (dt.date(2025, 1, 1), None, 1000), (dt.date(2024, 3, 1), dt.date(2024, 2, 1), 10_000), (None, None, 5)]
    df = spark.createDataFrame(rows, "lo date, hi date, n long")
    got = sweep(df, F.col("lo"), F.col("hi"), dt.date(2024, 1, 1), dt.date(2024, 12, 1), {"n": F.col("n")}, unit="month", out="m")
    assert {(r["m"].month): r["n"] for r in got.collect()} == {1: 11, 2: 11, **dict.fromkeys(range(3, 12), 1), 12: 101}
    assert sweep(df.limit(0), F.col("lo"), None, START, END, {"n": F.col("n")}).count() == 0
    with pytest.raises(TypeError):
        sweep(df, F.col("lo"), None, START, END, {"n": F.col("n").cast("double")})
    with pytest.raises(ValueError):
        spine_length(START, END, "week")


def test_running_sums_by_blocks(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), F.col("id").alias("_at"), F.lit(1).cast("long").alias("v"))
    for r in running(df, ["v"], 1000, ["k"]).collect():
        assert r["v"] == r["_at"] // 2 + 1


def test_accrued_revenue_over_short_and_long_calendars(spark):
    sub = make_tables(spark, _random_subs(seed=5)).subscription
    short = {r["month_date"]: r["revenue_accrued"] for r in R.accrued_revenue(sub, P24).collect()}
    swept = accrued(sub, P24.calendar_start, P24.calendar_end, P24.accrual_horizon)
    assert {r["month_date"]: float(r["total"]) for r in swept.collect()} == short
    long = accrued(sub, dt.date(2000, 1, 1), dt.date(2049, 12, 1), P24.accrual_horizon).collect()
    assert {r["month_date"]: float(r["total"]) for r in long if r["month_date"] in short} == short
