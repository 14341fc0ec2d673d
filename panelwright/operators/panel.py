"""Point-in-time joins and filters that make a panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelwright.functions import moving
from panelwright.sources.bars import FUNDAMENTALS

PREFIXES = ("style_", "tech_", "alpha_", "adv_", "ind_", "fund_", "cs_rank_", "mkt_", "rel_")


def asof_fundamentals(bars: DataFrame, fundamentals: DataFrame, lag_days: int = 60, columns: Sequence[str] = FUNDAMENTALS) -> DataFrame:
    """Attach to each bar the newest fundamentals published by its date, ``lag_days`` after their report date.

    One whole row is taken: NULLs in it stay NULL. Of rows available on one day the latest report wins.
    Bars and reports share one exchange by code; nothing is compared pairwise.
    """
    columns = [c for c in columns if c in fundamentals.columns]
    values = [c for c in bars.columns if c not in ("code", "date")]
    both, w = _stacked(bars, fundamentals, lag_days, columns)
    return (
        both.withColumn("_row", F.last("_row", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .where(F.col("_side") == 1)
        .select("code", "date", *values, *(F.col(f"_row.{c}").alias(c) for c in columns))
    )


def _stacked(bars: DataFrame, fundamentals: DataFrame, lag_days: int, columns: Sequence[str]) -> tuple[DataFrame, WindowSpec]:
    """Bars (``_side`` 1) and, at the day from which they are known, reports (0, with a struct ``_row``), and the order in which a code's rows stand."""
    reports = fundamentals.select(
        "code", F.date_add("date", lag_days).alias("date"), F.lit(0).alias("_side"), F.col("date").alias("_report"), F.struct(*columns).alias("_row")
    )
    both = bars.select("code", "date", F.lit(1).alias("_side"), *(c for c in bars.columns if c not in ("code", "date"))).unionByName(reports, allowMissingColumns=True)
    return both, Window.partitionBy("code").orderBy("date", "_side", "_report")


def lasting_fundamentals(bars: DataFrame, fundamentals: DataFrame, lag_days: int = 60, columns: Sequence[str] = FUNDAMENTALS) -> DataFrame:
    """What ``dense_fundamentals`` makes its rows of, dealt by code and sorted by date: each row holds for ``_days`` days.

    Bars and reports are stacked; each lasts until the day before the next one, a code's last bar is its end.
    """
    columns = [c for c in columns if c in fundamentals.columns]
    values = [c for c in bars.columns if c not in ("code", "date", "volume")]
    both, w = _stacked(bars.where(F.col("code").isNotNull() & F.col("date").isNotNull()), fundamentals, lag_days, columns)
    so_far, bar = w.rowsBetween(Window.unboundedPreceding, 0), F.col("_side") == 1
    end = F.max(F.when(bar, F.col("date"))).over(Window.partitionBy("code"))
    both = both.withColumns({"_begun": F.max("_side").over(so_far) == 1, "_next": F.lead("date").over(w), "_end": end, **{c: F.last(c, ignorenulls=True).over(so_far) for c in (*values, "_row")}})
    days = F.datediff(F.least(F.date_sub("_next", 1), "_end"), "date") + 1  # none of a report on a bar's day, or after the end
    both = both.withColumns({"_days": F.when(bar, F.greatest(days, F.lit(1))).otherwise(days), "volume": F.coalesce("volume", F.lit(0.0))}).where(F.col("_begun") & (F.col("_days") > 0))
    return both.na.drop("any", subset=values).select(*bars.columns, *(F.col(f"_row.{c}").alias(c) for c in columns), "_days")


def dense_fundamentals(bars: DataFrame, fundamentals: DataFrame, lag_days: int = 60, columns: Sequence[str] = FUNDAMENTALS) -> DataFrame:
    """``asof_fundamentals(fill_gaps(bars), fundamentals)``, dealt by code and sorted by date, without a join, an exchange or a sort of the many filled rows."""
    rows = lasting_fundamentals(bars, fundamentals, lag_days, columns)
    dense = rows.drop("_days")
    return rows.mapInArrow(moving.each_day(dense.columns), dense.schema)


def fill_fundamentals(panel: DataFrame, null_missing: bool = False) -> DataFrame:
    """0 for missing fundamentals, as the factors expect by default; ``null_missing`` leaves them NULL."""
    return panel if null_missing else panel.na.fill(0.0, [c for c in FUNDAMENTALS if c in panel.columns])


def in_universe(min_price: float = 2.0, min_bars: int = 60) -> Column:
    """Whether a bar is traded, at or above the price floor, and not among the first ``min_bars`` + 1 such bars of its code."""
    alive = F.coalesce((F.col("volume") > 0) & (F.col("close") >= min_price), F.lit(False))
    age = F.count_if(alive).over(Window.partitionBy("code").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)) - 1
    return alive & (age > min_bars)


def universe_filter(panel: DataFrame, min_price: float = 2.0, min_bars: int = 60) -> DataFrame:
    """Traded bars at or above the price floor, without the first ``min_bars`` + 1 of these in each code."""
    return panel.withColumn("_in", in_universe(min_price, min_bars)).where("_in").drop("_in")


def filter_report(panel: DataFrame, kept: Column) -> DataFrame:
    """(n_before, n_removed, share) of a filter that keeps the rows where ``kept`` is true, in one pass."""
    counts = panel.select(kept.alias("_in")).agg(F.count("*").alias("n_before"), F.count_if("_in").alias("n_after"))
    removed = F.col("n_before") - F.col("n_after")
    return counts.select("n_before", removed.alias("n_removed"), F.try_divide(removed, F.col("n_before")).alias("share"))


def observed_filter(panel: DataFrame, kept: Column, name: str = "filter") -> tuple[DataFrame, Observation]:
    """The rows where ``kept`` is true, and what Spark observes in the same pass: n_before and n_after.

    The counts are there once the first action on the rows has run.
    """
    seen = Observation(name)
    flagged = panel.withColumn("_in", kept).observe(seen, F.count(F.lit(1)).alias("n_before"), F.count_if("_in").alias("n_after"))
    return flagged.where("_in").drop("_in"), seen


def labelled(panel: DataFrame, mode: str = "train") -> DataFrame:
    """Rows with a target; in mode ``predict`` all rows."""
    return panel.where(F.col("target").isNotNull()) if mode == "train" else panel


def slice_dates(panel: DataFrame, start: Column, end: Column, look_back: int = 60) -> DataFrame:
    """Rows from ``look_back`` calendar days before ``start`` up to ``end``."""
    return panel.where(F.col("date").between(F.date_sub(start, look_back), end))


def feature_columns(panel: DataFrame) -> list[str]:
    return [c for c in panel.columns if c.startswith(PREFIXES)]


def feature_table(panel: DataFrame) -> DataFrame:
    """Features without NULL, narrowed to FLOAT."""
    features = feature_columns(panel)
    return panel.na.fill(0.0, features).withColumns({c: F.col(c).cast("float") for c in features})


def still_trading(panel: DataFrame) -> DataFrame:
    """Codes whose last date is that of the panel."""
    last = panel.groupBy("code").agg(F.max("date").alias("last"))
    live = last.join(F.broadcast(panel.agg(F.max("date").alias("last"))), "last", "left_semi")  # one row
    return panel.join(live.select("code"), "code", "left_semi")


def enough_context(panel: DataFrame, least: int = 30) -> DataFrame:
    return panel.withColumn("_n", F.count("*").over(Window.partitionBy("code"))).where(F.col("_n") >= least).drop("_n")


def latest_slice(panel: DataFrame) -> DataFrame:
    """Rows of the panel's last date."""
    return panel.join(F.broadcast(panel.agg(F.max("date").alias("date"))), "date", "left_semi").select(*panel.columns)  # one row


def look_back_prune(bars: DataFrame, start: Column, bars_back: int = 250) -> DataFrame:
    """Bars that results from ``start`` on can depend on: those from ``start`` and ``bars_back`` before it in each code.

    Exact for all rolling factors (120 bars of momentum plus 60 of normalisation); exponentially
    weighted means differ by less than their weight at that age, and the age of a listing and the
    cumulative VWAP must be taken from the whole history.
    """
    ahead = F.count(F.when(F.col("date") < start, 1)).over(Window.partitionBy("code").orderBy(F.desc("date")).rowsBetween(Window.unboundedPreceding, 0))
    return bars.withColumn("_back", ahead).where((F.col("date") >= start) | (F.col("_back") <= bars_back)).drop("_back")
