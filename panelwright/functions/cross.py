"""Functions across all codes of one date."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelwright.functions.scalar import clip

def by_date() -> WindowSpec:
    return Window.partitionBy("date")


def average_rank(x: Column, w: WindowSpec | None = None) -> Column:
    """Rank from 1, ties sharing the mean; NULL for NULL."""
    ordered = (w or by_date()).orderBy(x.asc_nulls_last())
    ties = F.count(F.lit(1)).over(ordered.rangeBetween(0, 0))
    return F.when(x.isNotNull(), F.rank().over(ordered) + (ties - 1) / 2)


def cs_rank(x: Column, w: WindowSpec | None = None) -> Column:
    """Average rank over the number of values: (0, 1]."""
    return average_rank(x, w) / F.count(x).over(w or by_date())


def cs_zscore(x: Column, w: WindowSpec | None = None) -> Column:
    """(x - mean) / sample deviation; NULL where that is 0 or missing."""
    return F.try_divide(x - F.avg(x).over(w or by_date()), F.stddev_samp(x).over(w or by_date()))


def cs_mean(x: Column, w: WindowSpec | None = None) -> Column:
    return F.avg(x).over(w or by_date())


def mad_bounds(x: Column, median: Column, mad: Column, width: float = 3.0) -> Column:
    """x clipped to median ± width · 1.4826 · MAD."""
    return clip(x, median - width * 1.4826 * mad, median + width * 1.4826 * mad)
