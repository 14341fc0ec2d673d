"""Calendar gaps of a daily series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.functions.ts import forward_fill


def densify(bars: DataFrame) -> DataFrame:
    """One row for each calendar day between a code's first and last bar; new rows are NULL."""
    days = bars.groupBy("code").agg(F.explode(F.sequence(F.min("date"), F.max("date"))).alias("date"))
    return days.join(bars, ["code", "date"], "left")


def fill_gaps(bars: DataFrame) -> DataFrame:
    """Dense days, volume 0 and other values carried forward on new ones, then Monday to Friday alone, complete rows alone.

    The fill runs over weekends before these go, so a Monday may carry a Saturday's bar.
    """
    values = [c for c in bars.columns if c not in ("code", "date", "volume")]
    dense = densify(bars).withColumn("volume", F.coalesce("volume", F.lit(0.0)))
    filled = dense.withColumns({c: forward_fill(F.col(c)) for c in values})
    return filled.na.drop("any").where(F.weekday("date") < 5).select(*bars.columns)
