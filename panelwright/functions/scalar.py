"""Row functions. A missing value is NULL, never NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b; NULL where b is 0, whatever the ANSI setting."""
    return F.try_divide(a, b)


def tidy(x: Column) -> Column:
    """NULL in place of NaN and the infinities."""
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), None).otherwise(x)


def safe_log(x: Column) -> Column:
    """ln(|x| + 1e-9)."""
    return F.ln(F.abs(x) + 1e-9)


def clip(x: Column, low: Column | float, high: Column | float) -> Column:
    """x limited to [low, high]; NULL stays NULL (``least`` and ``greatest`` would skip it)."""
    low, high = (F.lit(b) if isinstance(b, int | float) else b for b in (low, high))
    return F.when(x.isNotNull(), F.least(F.greatest(x, low), high))


def positive_part(x: Column) -> Column:
    """x where above 0, else 0; NULL counts as 0."""
    return F.when(x > 0, x).otherwise(F.lit(0.0))


def negative_part(x: Column) -> Column:
    """-x where below 0, else 0; NULL counts as 0."""
    return F.when(x < 0, -x).otherwise(F.lit(0.0))


def rounded(x: Column, digits: int = 6) -> Column:
    """To so many digits, for output. The step lies off the middle: sums of prices often end exactly there,
    where the last bit of a double would decide. What is too large for a digit behind the point, infinite or NaN stays so: Spark's floor
    is a LONG."""
    scale = 10.0**digits
    moved = x * scale + 0.414213562373
    return F.when(F.abs(moved) < 2.0**53, F.floor(moved) / scale).otherwise(moved / scale)


def signed_log(x: Column) -> Column:
    """sign(x) · ln(1 + |x|): curves of any size on one scale."""
    return F.signum(x) * F.ln(1 + F.abs(x))
