"""Empty and whitespace-only text tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spineworks.functions.dates import as_col


def is_empty(x) -> Column:
    """True for the empty string (null stays null)."""
    return as_col(x) == F.lit("")


def is_blank(x) -> Column:
    """True for non-empty text made only of whitespace (tabs and newlines too).

    ``trim`` strips spaces only, so a regular expression is used.
    """
    return as_col(x).rlike(r"^\s+$")
