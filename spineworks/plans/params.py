"""Parameters of the metric queries.

The reference hard-codes its calendar (the twelve months of one year), the
open-end horizons and the check dates. Here they are fields, so that month
boundaries stay explicit and any year can be reported.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace


def _d(s: str) -> dt.date:
    return dt.date.fromisoformat(s)


# Pivot domains used by the reference's crosstab reports (fixed values).
# Plan tiers, in column order:
REFERENCE_PLAN_TIERS = ("Basic", "Pro", "Enterprise")
# Industries, in column order, with the output labels the reference gives
# them (the first label is spelled "Fintech" while the category is "FinTech"):
REFERENCE_INDUSTRIES = ("FinTech", "EdTech", "Cybersecurity", "HealthTech", "DevTools")
REFERENCE_INDUSTRY_LABELS = ("Fintech", "EdTech", "Cybersecurity", "HealthTech", "DevTools")


@dataclass(frozen=True)
class Params:
    """Report parameters; the defaults are the original analysis's values (fixed values)."""

    # Month spine for subscription and revenue metrics (both ends inclusive).
    calendar_start: dt.date = _d("2024-01-01")
    calendar_end: dt.date = _d("2024-12-01")
    # Open-ended subscriptions are treated as ending on this date by the
    # active-subscription and recurring-revenue rules.
    open_end_horizon: dt.date = _d("2024-12-31")
    # Horizon used by the accrued-revenue rule.
    accrual_horizon: dt.date = _d("2025-12-31")
    # Horizon (a month start) used by the lifetime-value rule.
    lifetime_horizon: dt.date = _d("2025-07-01")
    # Date used by the "ended by" count (subscriptions ended on or before it).
    ended_by: dt.date = _d("2024-12-01")
    # Month used by the "ended in month" listings.
    ended_month: dt.date = _d("2024-02-01")
    # Month spine for support-ticket metrics.
    ticket_calendar_start: dt.date = _d("2024-01-01")
    ticket_calendar_end: dt.date = _d("2024-12-01")
    # Open trials leak into recurring revenue through the unparenthesised
    # "not trial and ended late or open" filter; set True to exclude them.
    strict_trial_filter: bool = False
    # Pivot domains and labels.
    plan_tiers: tuple = REFERENCE_PLAN_TIERS
    plan_tier_labels: tuple = REFERENCE_PLAN_TIERS
    industries: tuple = REFERENCE_INDUSTRIES
    industry_labels: tuple = REFERENCE_INDUSTRY_LABELS
    # Number of rows in the top-k account reports.
    top_k: int = 10

    @property
    def window_start(self) -> dt.date:
        """First day of the reporting window (first calendar month)."""
        return self.calendar_start

    @property
    def first_month_end(self) -> dt.date:
        """Last day of the first calendar month."""
        return _last_day(self.calendar_start)

    @property
    def ticket_window_start(self) -> dt.date:
        return self.ticket_calendar_start

    def with_(self, **kw) -> "Params":
        return replace(self, **kw)


def _last_day(d: dt.date) -> dt.date:
    nxt = dt.date(d.year + (d.month == 12), d.month % 12 + 1, 1)
    return nxt - dt.timedelta(days=1)


# The driver's fixture tables carry market segments instead of the
# reference's industries; these are the five segments, in alphabetical order,
# used as the industry pivot domain for them.
FIXTURE_INDUSTRIES = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")

# The fixture subscriptions start between 1995 and 2001, so their reports use
# a 1997 calendar with horizons shifted by the same 27 years; tickets keep
# the 2024 calendar (the fixture events are from January 2024).
FIXTURE_PARAMS = Params(
    calendar_start=_d("1997-01-01"), calendar_end=_d("1997-12-01"),
    open_end_horizon=_d("1997-12-31"), accrual_horizon=_d("1998-12-31"),
    lifetime_horizon=_d("2002-07-01"), ended_by=_d("1997-12-01"), ended_month=_d("1997-02-01"),
    industries=FIXTURE_INDUSTRIES, industry_labels=FIXTURE_INDUSTRIES)
