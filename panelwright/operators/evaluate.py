"""Evaluation of a score: information coefficients, quantile layers, regimes, performance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelwright.functions.cross import average_rank
from panelwright.functions.ordered import BLOCK, with_halo, with_position
from panelwright.functions.scalar import ratio
from panelwright.functions.ts import Rolling, cum_max, cum_prod, with_rolling
from panelwright.sources.scratch import materialise

YEAR, RISK_FREE = 252, 0.03


def pearson(x: str, y: str) -> Column:
    """Aggregate correlation of complete pairs; NULL where either side is constant."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    flat = (F.min(a) == F.max(a)) | (F.min(b) == F.max(b))
    return F.when(~flat, F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def rank_ic(predictions: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """(date, ic): Spearman correlation of score and label on each date, pairs with NULL left out; to 12 digits."""
    pairs = predictions.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    ranks = pairs.select("date", average_rank(F.col(score)).alias("a"), average_rank(F.col(label)).alias("b"))
    return ranks.groupBy("date").agg(F.round(pearson("a", "b"), 12).alias("ic"))


def ic_summary(ics: DataFrame) -> DataFrame:
    """Mean, annual ratio of mean to deviation, and share of positive dates (missing ones count as not positive)."""
    return ics.agg(
        F.avg("ic").alias("mean_ic"),
        (F.avg("ic") / (F.stddev_samp("ic") + 1e-9) * YEAR**0.5).alias("icir"),
        F.avg(F.when(F.col("ic") > 0, 1.0).otherwise(0.0)).alias("win_share"),
    )


def global_rank(df: DataFrame, x: str, name: str, cuts: Sequence[float]) -> DataFrame:
    """Average rank of ``x`` over all rows; ``cuts`` part its values into ranges of like size.

    A range knows from the totals of the others how many rows lie below it, so no task sees all rows,
    and the ranks are exact wherever the cuts fall.
    """
    counts = materialise(df.groupBy(F.col(x).alias("_v")).agg(F.count("*").alias("_n")))  # read for the ranges' totals and for the ranks
    below_cut = F.size(F.filter(F.lit(sorted(set(cuts))).cast("array<double>"), lambda c: c < F.col("_v"))) if cuts else F.lit(0)
    ranged = counts.withColumn("_part", below_cut)
    within = Window.partitionBy("_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    totals = ranged.groupBy("_part").agg(F.sum("_n").alias("_t"))
    below = F.sum("_t").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # one row a range
    totals = totals.select("_part", F.coalesce(below, F.lit(0)).alias("_below"))
    ranged = ranged.withColumn("_in", F.sum("_n").over(within)).join(totals, "_part")
    ranks = ranged.select("_v", (F.col("_below") + F.col("_in") - (F.col("_n") - 1) / 2).alias(name))
    return df.join(ranks, df[x] == ranks["_v"]).drop("_v")


def pooled_ic(predictions: DataFrame, score: str = "score", label: str = "label", ranges: int = 64) -> DataFrame:
    """(ic): one Spearman correlation over all rows. The driver fetches ``ranges`` approximate quantiles of each side once."""
    pairs = materialise(predictions.where(F.col(score).isNotNull() & F.col(label).isNotNull()).select(score, label))  # read for the quantiles and for each side's ranks
    shares = [k / ranges for k in range(1, ranges)]
    cuts = pairs.agg(*(F.percentile_approx(c, shares, 1000).alias(a) for c, a in ((score, "a"), (label, "b")))).first()
    ranked = global_rank(global_rank(pairs, score, "_a", cuts.a or []), label, "_b", cuts.b or [])
    return ranked.agg(pearson("_a", "_b").alias("ic"))


def quantile_layers(predictions: DataFrame, layers: int = 5, score: str = "score", label: str = "label") -> DataFrame:
    """(date, layer, label, n): mean label by quantile of the score on each date.

    Edges are interpolated quantiles; equal edges are merged, so a date may have fewer layers. Scores and
    edges are compared at 12 digits, as interpolation between equal scores may be off by a bit.
    """
    edges = predictions.groupBy("date").agg(F.percentile(score, [k / layers for k in range(layers + 1)]).alias("_edges"))
    rows = predictions.where(F.col(score).isNotNull()).join(edges, "date")
    edges = F.array_distinct(F.transform("_edges", lambda e: F.round(e, 12)))
    below = F.size(F.filter(edges, lambda e: e < F.round(score, 12)))
    layer = F.greatest(below - 1, F.lit(0)).cast("long")
    return rows.withColumn("layer", layer).groupBy("date", "layer").agg(F.avg(label).alias("label"), F.count("*").alias("n"))


def layer_pivot(layers: DataFrame, n: int = 5) -> DataFrame:
    """(date, layer_0 ...): one column a layer."""
    wide = layers.groupBy("date").pivot("layer", list(range(n))).agg(F.first("label"))
    return wide.withColumnsRenamed({str(k): f"layer_{k}" for k in range(n)})


def layer_curve(wide: DataFrame, n: int = 5) -> DataFrame:
    """Cumulated return of each layer; missing dates are skipped. The series has one row a date."""
    w = Window.orderBy("date")
    return wide.select("date", *(cum_prod(1 + F.col(f"layer_{k}"), w).alias(f"curve_{k}") for k in range(n)))


def long_short(wide: DataFrame, n: int = 5) -> DataFrame:
    """Cumulated return of the top layer less the bottom one."""
    spread = F.col(f"layer_{n - 1}") - F.col("layer_0")
    return wide.select("date", spread.alias("spread"), cum_prod(1 + spread, Window.orderBy("date")).alias("curve"))


def factor_screen(
    panel: DataFrame, factors: Sequence[str], target: str = "target", n: int = 60, least: float = 0.01, order: Sequence[str] | None = None, block: int = BLOCK
) -> DataFrame:
    """(factor, ic, ir, selected): mean and ratio of the rolling correlation of each factor with the target.

    By code; or, with ``order``, over the whole frame in that order, so that windows also run from one code into the next. The frame
    is cut into blocks of ``block`` rows, and each borrows the ``n`` - 1 rows before it.
    """
    by, at = "code", "date"
    if order is None:
        panel = panel.select(*dict.fromkeys((by, at, *factors, target)))
    else:
        by, at = "_block", "_at"
        panel = with_halo(with_position(panel.select(*dict.fromkeys((*order, *factors, target))), order), n, block=block).select(by, at, "_own", *dict.fromkeys((*factors, target)))
    wide = with_rolling(panel, {f"_c_{f}": Rolling("corr", n, f, target) for f in factors}, by, at)
    wide = wide if order is None else wide.where("_own")
    pairs = ", ".join(f"'{f}', `_c_{f}`" for f in factors)
    long = wide.select(F.expr(f"stack({len(factors)}, {pairs}) as (factor, c)"))
    return long.groupBy("factor").agg(
        F.avg("c").alias("ic"),
        (F.avg("c") / (F.stddev_samp("c") + 1e-9)).alias("ir"),
        (F.abs(F.avg("c")) > least).alias("selected"),
    )


def benchmark_returns(index: DataFrame, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """(date, benchmark): change of the close within the range; 0 on its first date. The series has one row a date."""
    if start is not None:
        index = index.where(F.col("date").between(start, end))
    change = ratio(F.col("close"), F.lag("close").over(Window.orderBy("date"))) - 1
    return index.select("date", F.coalesce(change, F.lit(0.0)).alias("benchmark"))


def align_returns(strategy: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(date, strategy, benchmark) on the dates that both have."""
    return strategy.join(benchmark, "date", "inner").select("date", "strategy", "benchmark")


def drawdown(returns: DataFrame, column: str = "strategy") -> DataFrame:
    """The series with curve, peak and drawdown; the curve starts after the first return. The series has one row a date."""
    w = Window.orderBy("date")
    curve = returns.withColumn("curve", cum_prod(1 + F.col(column), w)).withColumn("peak", cum_max(F.col("curve"), w))
    return curve.withColumn("drawdown", F.try_divide(F.col("peak") - F.col("curve"), F.col("peak")))


def performance(returns: DataFrame, min_days: int = 10) -> DataFrame:
    """One row of performance figures of (date, strategy, benchmark); all NULL under ``min_days`` dates."""
    annual = lambda c: F.pow(F.product(1 + F.col(c)), YEAR / F.count("*")) - 1
    vol = F.stddev_samp("strategy") * YEAR**0.5
    beta = F.covar_samp("strategy", "benchmark") / (F.var_samp("benchmark") + 1e-9)
    one = drawdown(returns).agg(
        F.count("*").alias("days"), annual("strategy").alias("annual"), annual("benchmark").alias("benchmark_annual"), vol.alias("volatility"),
        beta.alias("beta"), F.avg(F.when(F.col("strategy") > 0, 1.0).otherwise(0.0)).alias("win_rate"), F.max("drawdown").alias("max_drawdown"),
    )
    figures = {
        "annual": F.col("annual"),
        "excess": F.col("annual") - F.col("benchmark_annual"),
        "volatility": F.col("volatility"),
        "sharpe": (F.col("annual") - RISK_FREE) / (F.col("volatility") + 1e-9),
        "max_drawdown": F.col("max_drawdown"),
        "beta": F.col("beta"),
        "alpha": F.col("annual") - (RISK_FREE + F.col("beta") * (F.col("benchmark_annual") - RISK_FREE)),
        "win_rate": F.col("win_rate"),
    }
    return one.select("days", *(F.when(F.col("days") >= min_days, x).alias(name) for name, x in figures.items()))


def regime(panel: DataFrame, momentum: str = "style_mom_1m") -> DataFrame:
    """(date, up_share, median, regime): Bear, Bull or Shock by breadth and median momentum; Unknown without values."""
    sums = panel.groupBy("date").agg(F.avg(F.when(F.col(momentum) > 0, 1.0).otherwise(0.0)).alias("up_share"), F.median(momentum).alias("median"), F.count(momentum).alias("_n"))
    kind = (
        F.when(F.col("_n") == 0, "Unknown")
        .when((F.col("up_share") < 0.4) | (F.col("median") < -0.02), "Bear")
        .when(F.col("up_share") > 0.6, "Bull")
        .otherwise("Shock")
    )
    return sums.select("date", "up_share", "median", kind.alias("regime"))


def hybrid_loss(predictions: DataFrame, by: str, weight: float = 0.5, score: str = "score", label: str = "label") -> DataFrame:
    """(by, loss): 1 - correlation + weight · mean squared error; the error alone where a side is constant or n < 2."""
    mse = F.avg(F.pow(F.col(score) - F.col(label), 2))
    return predictions.groupBy(by).agg(F.coalesce(1 - pearson(score, label) + weight * mse, mse).alias("loss"))


def last_value(panel: DataFrame, column: str) -> DataFrame:
    """(code, column) at the code's last bar; NULL if it is NULL there or the column is missing."""
    value = F.max_by(column, "date") if column in panel.columns else F.lit(None).cast("double")
    return panel.groupBy("code").agg(value.alias(column))
