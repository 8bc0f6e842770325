"""Column functions (all built-in Spark expressions; no Python UDFs)."""

from spineworks.functions.dates import (  # noqa: F401
    as_col, last_counted_month, month_last_day, month_start, whole_months, days_between)
from spineworks.functions.numbers import (  # noqa: F401
    avg_half_up, exact_avg, exact_sum, percent_half_up, round_half_up_ratio)
from spineworks.functions.text import is_blank, is_empty  # noqa: F401
