"""Reusable DataFrame operators (spine spreading, relations, shares, quality)."""
