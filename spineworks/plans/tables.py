"""The entity tables at each stage of cleaning.

Stages follow the original workflow: ``raw`` tables as loaded; the
``dedup`` stage (subscription copies removed, usage re-keyed) on which the
notebook-style profiling runs; and the ``clean`` stage (outliers removed,
subscription-grain columns dropped from accounts) that the reporting queries
read. Every table is a lazy DataFrame over the source files.
"""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spineworks.operators.quality import column_profile, dedupe_keep_min, drop_where, surrogate_key
from spineworks.session import ensure_checkpoint_dir
from spineworks.sources import fixtures
from spineworks.sources.schemas import ACCOUNT_SUBSCRIPTION_COLUMNS

# Content order that defines the consecutive usage ids (file order is not
# reproducible in a distributed scan).
USAGE_ORDER = ("subscription_id", "usage_date", "feature_name", "usage_count",
               "usage_duration_secs", "error_count")


def subscription_outlier(df: DataFrame):
    """Zero recurring revenue with both the upgrade and the downgrade flag set."""
    return ((F.col("mrr_amount") == 0) & (F.col("arr_amount") == 0)
            & (F.col("upgrade_flag") == True) & (F.col("downgrade_flag") == True))  # noqa: E712


def usage_outlier(df: DataFrame):
    """No recorded use, or no recorded error (the original rule, kept as is)."""
    return (F.col("usage_count") <= 0) | (F.col("error_count") <= 0)


class Tables:
    """Entity tables for one dataset. ``loaders`` maps table name -> (spark, src) -> DataFrame."""

    #: Subscriptions, accounts and churn events lie bucketed by account.
    colocated = False

    def __init__(self, spark: SparkSession, source: str, loaders=None):
        self.spark = spark
        self.source = source
        self._loaders = loaders or fixtures.LOADERS
        self._rekeyed = None

    def _load(self, name: str) -> DataFrame:
        return self._loaders[name](self.spark, self.source)

    # raw stage -----------------------------------------------------------
    @cached_property
    def raw_subscription(self) -> DataFrame:
        return self._load("subscription")

    @cached_property
    def raw_account(self) -> DataFrame:
        return self._load("account")

    @cached_property
    def raw_usage(self) -> DataFrame:
        return self._load("feature_usage")

    @cached_property
    def support_ticket(self) -> DataFrame:
        return self._load("support_ticket")

    @cached_property
    def churn_event(self) -> DataFrame:
        return self._load("churn_event")

    def raw_tables(self) -> dict[str, DataFrame]:
        # Table labels as the profiling reports name them.
        return {"subscription": self.raw_subscription, "account": self.raw_account,
                "churn_event": self.churn_event, "usage_event": self.raw_usage,
                "support_ticket": self.support_ticket}

    # dedup stage ---------------------------------------------------------
    @cached_property
    def dedup_subscription(self) -> DataFrame:
        return dedupe_keep_min(self.raw_subscription, "subscription_id")

    def rekeyed_usage(self, staging: str | None = None) -> DataFrame:
        """Usage rows with consecutive ids.

        Positions need one pass over the sorted rows before the first id is
        known: that pass runs here, once for this object, and is written to
        ``staging`` (by default a folder of ``spark.checkpoint.dir``).
        """
        if self._rekeyed is None:
            staging = staging or f"{ensure_checkpoint_dir(self.spark)}/ranked-usage-{uuid.uuid4().hex}"
            self._rekeyed = surrogate_key(self.raw_usage, "usage_id", USAGE_ORDER, staging)
        return self._rekeyed

    def profile(self, kinds=("null", "empty", "whitespace")) -> DataFrame:
        """Null, empty and blank counts of all columns of the raw tables; one scan for each table."""
        return self._scanned_profile(self.raw_tables(), kinds)

    def _scanned_profile(self, tables: dict[str, DataFrame], kinds=("null", "empty", "whitespace")) -> DataFrame:
        parts = [column_profile(df, name, kinds) for name, df in tables.items()]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    # clean stage ---------------------------------------------------------
    @cached_property
    def subscription(self) -> DataFrame:
        return drop_where(self.dedup_subscription, subscription_outlier(self.dedup_subscription))

    @cached_property
    def feature_usage(self) -> DataFrame:
        """Clean usage rows for key-level queries (ids not re-keyed: not used there)."""
        return drop_where(self.raw_usage, usage_outlier(self.raw_usage))

    def clean_usage(self) -> DataFrame:
        """Clean usage rows with the consecutive ids assigned before outlier removal."""
        u = self.rekeyed_usage()
        return drop_where(u, usage_outlier(u))

    @cached_property
    def account(self) -> DataFrame:
        return self.raw_account.drop(*ACCOUNT_SUBSCRIPTION_COLUMNS)

    def clean_tables(self) -> dict[str, DataFrame]:
        return {"subscription": self.subscription, "account": self.account,
                "feature_usage": self.feature_usage, "support_ticket": self.support_ticket,
                "churn_event": self.churn_event}


def register_views(tables: Tables, params=None) -> list[str]:
    """Register the clean tables (and the month spine as ``cal``) as temp views.

    Lets the original SQL statements run through ``spark.sql`` against the
    same tables the reports read. Returns the view names.
    """
    from spineworks.plans.params import Params
    from spineworks.sources.calendar import month_spine
    p = params or Params()
    views = dict(tables.clean_tables())
    views["cal"] = month_spine(tables.spark, p.calendar_start, p.calendar_end)
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return sorted(views)
