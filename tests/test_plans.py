"""Physical-plan checks: the shapes that decide whether a query scales."""

import re
import tempfile

import __spark_entry__ as E
from spineworks.plans.params import FIXTURE_PARAMS
from spineworks.plans.registry import FINAL_ORDER, QUERIES
from spineworks.plans.tables import Tables
from spineworks.operators.spine import month_after
from spineworks.plans.warehouse import WarehouseTables, materialize

SF = "/root/testdata/sf0.001"
Q = E.queries()

SPINE_QUERIES = ("active_end_month_included", "active_at_month_end", "active_unbounded_vs_lost",
                 "accrued_revenue", "recurring_revenue", "revenue_by_plan_long",
                 "revenue_by_plan_pivot", "revenue_by_industry_pivot", "lost_per_month",
                 "lost_trend", "tickets_per_month", "ticket_satisfaction_per_month")


def _plan(spark, name):
    df = Q[name](spark, SF)
    return df._jdf.queryExecution().executedPlan().toString() + \
        df._jdf.queryExecution().optimizedPlan().toString()


def test_spine_metrics_never_cross_join_rows(spark):
    for name in SPINE_QUERIES:
        plan = _plan(spark, name)
        assert "BroadcastNestedLoopJoin" not in plan, name
        assert "CartesianProduct" not in plan, name


def test_not_in_is_not_a_null_aware_broadcast(spark):
    # The built-in NOT IN plan is a null-aware anti join that must broadcast
    # the whole right side; ours is a plain anti join on distinct keys plus a
    # one-row statistics side.
    for name in ("subs_without_usage", "unused_subs_by_tier", "accounts_without_tickets"):
        df = Q[name](spark, SF)
        opt = df._jdf.queryExecution().optimizedPlan().toString()
        assert "LeftAnti" in opt, name
        assert "OR isnull" not in opt, name
        phys = df._jdf.queryExecution().executedPlan().toString()
        assert "LeftAnti, BuildRight, true" not in phys, name


def test_share_of_total_has_no_global_window(spark):
    for name in ("share_industry", "share_country", "share_plan_tier", "share_feedback"):
        plan = _plan(spark, name)
        assert "Window" not in plan, name


TICKET_BOUNDS = tuple(f"{op}(submitted_at,{day}T00:00)" for op, day in (
    ("GreaterThanOrEqual", FIXTURE_PARAMS.ticket_calendar_start),
    ("LessThan", month_after(FIXTURE_PARAMS.ticket_calendar_end))))
DATE_BOUNDS = {  # column bounds that the scan of the written subscriptions must get
    "lost_per_month": ("GreaterThanOrEqual(end_date,1997-01-01)", "LessThan(end_date,1998-01-01)"),
    "lost_rows": ("GreaterThanOrEqual(end_date,1997-01-01)", "LessThan(end_date,1998-01-01)"),
    "lost_trend": ("GreaterThanOrEqual(end_date,1997-01-01)", "LessThan(end_date,1998-01-01)"),
    "ended_in_month": ("GreaterThanOrEqual(end_date,", "LessThan(end_date,"),
    "active_at_month_end": ("LessThan(start_date,1998-01-01)", "GreaterThanOrEqual(end_date,1997-01-01)"),
    "active_unbounded_vs_lost": ("LessThan(start_date,1998-01-01)",),
    "accrued_revenue": ("LessThan(start_date,1998-01-01)", "GreaterThanOrEqual(end_date,1997-01-01)"),
    "recurring_rows_no_end_filter": ("LessThan(start_date,1997-02-01)",),
    "tickets_per_month": TICKET_BOUNDS,
    "ticket_satisfaction_per_month": TICKET_BOUNDS,
}


def _scans(spark, df):
    """[(pushed filters, read schema)] of all file scans."""
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"PushedFilters: \[(.*?)\], ReadSchema: (struct<.*?>)(?:\n|$)", plan)


def test_date_bounds_and_columns_reach_the_scan(spark):
    target = tempfile.mkdtemp(prefix="spineworks-plans-")
    materialize(Tables(spark, SF), target)
    tables = WarehouseTables(spark, target)
    for name, bounds in DATE_BOUNDS.items():
        pushed = [f for f, _ in _scans(spark, QUERIES[name](tables, FIXTURE_PARAMS))]
        assert any(all(b in f for b in bounds) for f in pushed), (name, pushed)
    (_, schema), = _scans(spark, tables.dedup_subscription.where("end_date is null").groupBy().count())
    assert schema == "struct<end_date:date>"
    (_, schema), = _scans(spark, QUERIES["lost_per_month"](tables, FIXTURE_PARAMS))
    assert "seats" not in schema and "plan_tier" not in schema


def test_final_row_order(spark):
    tables = Tables(spark, SF)
    for name, keys in FINAL_ORDER.items():
        rows = QUERIES[name](tables, FIXTURE_PARAMS).collect()
        rank = lambda r, k: ((r[k.lstrip("-")] is None), 0 if r[k.lstrip("-")] is None else (
            -r[k[1:]] if k[0] == "-" else r[k]))
        at = [[rank(r, k) for k in keys] for r in rows]
        assert at == sorted(at), name


def test_dedupe_and_profiles_use_no_window(spark):
    for name in ("dedupe_subscription", "dup_row_listing", "null_profile", "dup_key_counts"):
        plan = _plan(spark, name)
        assert "Window" not in plan, name


def test_not_in_scans_the_right_side_once(spark):
    from spineworks.operators.relations import not_in
    left = spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey")
    right = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey")
    df = not_in(left, "o_orderkey", right, "l_orderkey")
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "ReusedExchange" in plan
    assert plan.count("lineitem.parquet") == 1
