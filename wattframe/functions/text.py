"""Text rules: case-insensitive keys and lenient numbers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The collation of identifiers and units, and the accepted number texts.
KEY_COLLATION = "UNICODE_CI"
NUMBER_LETTERS = "^[-+.eE0-9]+$"
INFINITY_PATTERN = r"^[+-]?(?i:inf|infinity)$"
NAN_PATTERN = r"^[+-]?(?i:nan)$"


def key(column: Column | str) -> Column:
    """``column`` compared without regard to case, for joins, groups and filters."""
    return F.collate(column, KEY_COLLATION)


def number_or_zero(raw: Column) -> Column:
    """Read a number; bad, blank or missing text counts as 0.0.

    The letters keep out what a plain cast would also take: outer blanks, type
    suffixes such as ``1d`` and hexadecimal floats.
    """
    return (
        F.when(raw.rlike(NUMBER_LETTERS), F.coalesce(raw.try_cast("double"), F.lit(0.0)))
        .when(raw.rlike(INFINITY_PATTERN) & raw.startswith("-"), F.lit(float("-inf")))
        .when(raw.rlike(INFINITY_PATTERN), F.lit(float("inf")))
        .when(raw.rlike(NAN_PATTERN), F.lit(float("nan")))
        .otherwise(F.lit(0.0))
    )
