"""Numeric functions whose results are the same on every engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two conversions of square feet are both in use.
ACRE_M2 = 4046.8564224
SQFT_M2 = 0.09290304
M2_SQFT = 10.7639104167
FOOT_M = 0.3048


def rounded(x: Column, digits: int = 4) -> Column:
    """Half up from IEEE steps only; engines differ in their own round()."""
    scale = float(10**digits)
    return F.floor(x.cast("double") * scale + F.lit(0.5)) / F.lit(scale)


def share(part: Column, whole: Column) -> Column:
    """Percentage; null if the whole is 0 or null."""
    return F.lit(100.0) * part / F.nullif(whole, F.lit(0.0))


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def not_nan(x: Column) -> Column:
    """NaN as null: Spark holds NaN above every number."""
    return F.when(~F.isnan(x), x)
