"""Deterministic rounding and averaging.

Floating-point sums depend on the order in which partitions are combined, so
averages and rounded ratios are computed from exact integer or decimal sums
and rounded half-up on the exact value. Results are then identical on every
run and every cluster size.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spineworks.functions.dates import as_col


def round_half_up_ratio(num, den, scale: int = 2, factor: int = 1) -> Column:
    """``round(num * factor / den, scale)`` half-up, for non-negative integers.

    Computed with integer division on the exact rational value, then scaled
    back to a double; null or zero denominators give null.
    """
    n, d = as_col(num).cast("decimal(38,0)"), as_col(den).cast("decimal(38,0)")
    unit = 10 ** scale
    a = n * (2 * factor * unit) + d
    b = d * 2
    q = F.call_function("div", a, F.when(d != 0, b))  # exact floor(a / b)
    return F.when(d == 0, F.lit(None).cast("double")).otherwise(q.cast("double") / unit)


def percent_half_up(part, whole, scale: int = 2) -> Column:
    """``round(part / whole * 100, scale)`` half-up on exact counts."""
    return round_half_up_ratio(part, whole, scale=scale, factor=100)


#: Values below the first bound are summed with 18 decimals, below the second
#: with 8, larger ones as whole numbers (a double has no finer digits there).
FINE_BELOW, MIDDLE_BELOW = 1e9, 1e18


def present(x) -> Column:
    """``x`` with NaN as null: both stand for a missing value, as in the loaded files."""
    c = as_col(x)
    return F.when(~F.isnan(c.cast("double")), c)


def _sums(x) -> tuple[Column, Column, Column]:
    """Exact decimal sums of the values by size; infinite values are an error."""
    c = present(x)
    size = F.abs(c)
    endless = F.raise_error(F.lit("an exact sum met an infinite value"))
    c = F.when(size.cast("double") == float("inf"), endless.cast("double")).otherwise(c)
    return (F.sum(F.when(size < FINE_BELOW, c.cast("decimal(38,18)"))),
            F.sum(F.when((size >= FINE_BELOW) & (size < MIDDLE_BELOW), c.cast("decimal(38,8)"))),
            F.sum(F.when(size >= MIDDLE_BELOW, c.cast("decimal(38,0)"))))


def _total(x) -> tuple[Column, Column]:
    """(sum as DECIMAL with 10 decimals, null beyond 1e17; sum as DOUBLE)."""
    fine, middle, large = _sums(x)
    none = fine.isNull() & middle.isNull() & large.isNull()
    zero = F.lit(0)
    fine, middle = F.coalesce(fine, zero), F.coalesce(middle, zero)
    small = ~none & large.isNull() & (F.abs(fine) < 1e17) & (F.abs(middle) < 1e17)
    # each part is rounded only here, where the sum is complete
    exact = F.when(small, fine).cast("decimal(28,10)") + F.when(small, middle).cast("decimal(28,10)")
    rough = fine.cast("double") + middle.cast("double") + F.coalesce(large.cast("double"), F.lit(0.0))
    tiny = (middle == 0) & (F.abs(fine) < 1)  # digits below the tenth decimal count here
    return exact, F.when(none, F.lit(None).cast("double")).when(small & ~tiny, exact.cast("double")).otherwise(rough)


def exact_sum(x, scale: int = 2) -> Column:
    """``round(sum(x), scale)`` as DOUBLE; values are summed unrounded, the sum is rounded once.

    Exact for sums up to 1e17; larger sums are rounded as doubles. Values keep
    18 decimals (8 from 1e9 on). Nulls and NaN are skipped; a sum beyond 38
    digits or an infinite value ends the job with an error.
    """
    exact, rough = _total(x)
    return F.when(exact.isNotNull(), F.round(exact, scale).cast("double")).otherwise(F.round(rough, scale))


def exact_avg(x) -> Column:
    """Average of a measure (nulls and NaN skipped) from an exact sum, not rounded.

    The sum is an exact DECIMAL (see ``exact_sum``), so the result does not
    depend on partition order.
    """
    return _total(x)[1] / F.count(present(x))


def avg_half_up(x, decimals: int = 2) -> Column:
    """``round(avg(x), decimals)``, halves away from zero, on the exact average (nulls and NaN skipped)."""
    exact, rough = _total(x)
    n = F.count(present(x))
    digits = (F.abs(exact) * 10 ** 10).cast("decimal(38,0)")
    size = round_half_up_ratio(digits, n.cast("decimal(20,0)") * 10 ** 10, scale=decimals)
    return (F.when(exact.isNull(), F.round(rough / n, decimals))
            .when(exact < 0, -size).otherwise(size))
