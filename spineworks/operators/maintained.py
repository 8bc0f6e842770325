"""Monthly reports kept up to date by changes instead of recomputed from all rows.

The state holds one row for each (start month, end, trial, plan tier) with
summed weights. An end is kept as one day that stands for all ends of its
month: the month's last day for ends on it, else its first day, which is all
that the month rules look at. A batch of added and removed subscriptions is
reduced to the same keys with signs and added to the state; keys whose weights
are all zero go. So a change costs the rows of the batch and the keys of the
state (calendar months squared at most), never the table.

A changed subscription is one removed and one added row. Weights are whole
numbers and decimals, so sums and differences are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spineworks.functions import last_counted_month, month_last_day, month_start, percent_half_up
from spineworks.operators.spine import in_months, not_ended_before, spread, started_by
from spineworks.operators.trend import diff_previous
from spineworks.plans.params import Params
from spineworks.sources import versions

KEYS = ("start_date", "end_date", "is_trial", "plan_tier")
#: Rows, rows with an id, rows with revenue, revenue.
WEIGHTS = ("n", "ids", "paid", "mrr")


def partials(rows: DataFrame, sign: int = 1) -> DataFrame:
    """The state of subscription rows (subscription_id, KEYS, mrr_amount), weights times ``sign``."""
    end = F.col("end_date")
    one = F.lit(sign).cast("long")
    counted = rows.select(
        month_start("start_date").alias("start_date"),
        F.when(end == month_last_day(end), end).otherwise(month_start(end)).alias("end_date"), "is_trial", "plan_tier",
        one.alias("n"), F.when(F.col("subscription_id").isNotNull(), one).otherwise(F.lit(0).cast("long")).alias("ids"),
        F.when(F.col("mrr_amount").isNotNull(), one).otherwise(F.lit(0).cast("long")).alias("paid"),
        (F.coalesce("mrr_amount", F.lit(0)) * sign).cast("decimal(38,2)").alias("mrr"))
    return _summed(counted)


def _summed(df: DataFrame) -> DataFrame:
    return df.groupBy(*KEYS).agg(*[F.sum(w).cast("decimal(38,2)" if w == "mrr" else "long").alias(w) for w in WEIGHTS])


def merge(*states: DataFrame) -> DataFrame:
    """Sum of states; keys whose weights are all zero are left out."""
    out = states[0]
    for s in states[1:]:
        out = out.unionByName(s)
    nothing = F.lit(True)
    for w in WEIGHTS:
        nothing = nothing & (F.col(w) == 0)
    return _summed(out).where(~nothing)


class MaintainedMonths:
    """State in a versioned folder: batches of added and removed rows are published one by one."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def state(self) -> DataFrame:
        folder = versions.current(self.spark, self.folder)
        if folder is None:
            raise FileNotFoundError(f"{self.folder} holds no state; start with update(all rows)")
        return self.spark.read.parquet(folder)

    def update(self, added: DataFrame | None = None, removed: DataFrame | None = None) -> None:
        """Apply a batch. A removed row that the state does not hold is an error, and nothing changes."""
        parts = [] if versions.current(self.spark, self.folder) is None else [self.state()]
        parts += [partials(added)] if added is not None else []
        parts += [partials(removed, -1)] if removed is not None else []

        def write(folder: str) -> None:
            merge(*parts).write.parquet(folder)
            wrong = self.spark.read.parquet(folder).where("n < 0 or ids < 0 or paid < 0").count()
            if wrong:
                raise ValueError(f"{wrong} keys would hold fewer than no rows: the batch removes rows that were never added")
        versions.publish(self.spark, self.folder, write)


def _weight(w: str, cond=None):
    return F.sum(F.col(w) if cond is None else F.when(cond, F.col(w)).otherwise(F.lit(0)))


def _check(p: Params) -> None:
    if p.window_start.day != 1 or p.calendar_start.day != 1 or p.open_end_horizon is None:
        raise ValueError("the state knows months: windows must start on the first of one")


def active_end_month_included(state: DataFrame, p: Params) -> DataFrame:
    """``subscriptions.active_end_month_included`` from the state."""
    _check(p)
    members = state.where(not_ended_before(p.window_start) & started_by(p.calendar_end))
    return spread(members, F.col("start_date"), month_start(F.coalesce(F.col("end_date"), F.lit(p.open_end_horizon))),
                  p.calendar_start, p.calendar_end,
                  {"active_subscriptions": _weight("n"), "trial_subscriptions": _weight("n", F.col("is_trial"))})


def active_at_month_end(state: DataFrame, p: Params) -> DataFrame:
    """``subscriptions.active_at_month_end`` from the state."""
    _check(p)
    members = state.where(started_by(p.calendar_end) & not_ended_before(p.calendar_start))
    m = spread(members, F.col("start_date"), last_counted_month(F.col("end_date")), p.calendar_start, p.calendar_end,
               {"active_subscriptions": _weight("ids"), "trial_subs": _weight("ids", F.col("is_trial"))})
    return m.select("month_date", "active_subscriptions", diff_previous("active_subscriptions").alias("diff_subscriptions"),
                    "trial_subs", percent_half_up("trial_subs", "active_subscriptions").alias("trial_perc"))


def lost_per_month(state: DataFrame, p: Params) -> DataFrame:
    """``subscriptions.lost_per_month`` from the state."""
    _check(p)
    return state.where(in_months("end_date", p.calendar_start, p.calendar_end)).groupBy(
        month_start("end_date").alias("month_date")).agg(
        _weight("n").alias("lost_active_subscriptions"), _weight("n", F.col("is_trial")).alias("lost_trials"))


def _recurring(state: DataFrame, p: Params) -> DataFrame:
    _check(p)
    paying = F.col("is_trial") == False  # noqa: E712
    cond = (paying & (F.col("end_date") >= F.lit(p.window_start))) | F.col("end_date").isNull()
    return state.where((cond & paying) if p.strict_trial_filter else cond).where(started_by(p.calendar_end))


def _revenue(state: DataFrame, p: Params, keys=()) -> DataFrame:
    hi = month_start(F.coalesce(F.col("end_date"), F.lit(p.open_end_horizon)))
    out = spread(_recurring(state, p), F.col("start_date"), hi, p.calendar_start, p.calendar_end,
                 {"paid": _weight("paid"), "mrr": _weight("mrr")}, keys=keys)
    return out.withColumn("revenue", F.when(F.col("paid") > 0, F.col("mrr")).cast("double"))


def recurring_revenue(state: DataFrame, p: Params) -> DataFrame:
    """``revenue.recurring_revenue`` from the state."""
    return _revenue(state, p).select("month_date", "revenue")


def revenue_by_plan_long(state: DataFrame, p: Params) -> DataFrame:
    """``revenue.revenue_by_plan_long`` from the state of the subscriptions that have an account."""
    return _revenue(state, p, ("plan_tier",)).select("month_date", "plan_tier", F.col("revenue").alias("rev_plan_tier"))
