"""Normalisation of factors through time and across codes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from panelwright.functions import moving
from panelwright.functions.cross import by_date, cs_mean, mad_bounds
from panelwright.functions.ts import in_order

#: Prefixes of factors that are normalised through time.
NORMALISED = ("style_", "tech_", "alpha_", "adv_", "ind_", "fund_")
RANKED = (
    "style_mom_1m", "style_vol_1m", "style_liquidity", "tech_rsi_14", "tech_kdj_j", "tech_bb_width", "alpha_money_flow", "adv_skew_20",
    "alpha_006", "ind_yang_zhang_vol", "ind_roll_spread", "ind_max_ret", "fund_ep", "fund_roe", "fund_growth",
)
RELATIVE = ("style_mom_1m", "style_vol_1m", "style_liquidity", "alpha_006")


def normalize(panel: DataFrame, columns: Sequence[str] | None = None, n: int = 60, limit: float = 4.0, ordered: bool = False) -> DataFrame:
    """Infinities to NULL, forward fill then 0, rolling z-score over ``n`` bars, clipped to ±``limit``, 0 before it exists.

    One pass of tasks over the bars in order, all columns at once. ``ordered`` says that the rows are in order already (``ts.in_order``).
    """
    columns = [c for c in panel.columns if c.startswith(NORMALISED)] if columns is None else list(columns)
    panel = panel.withColumns({c: F.col(c).cast("double") for c in columns})
    return (panel if ordered else in_order(panel)).mapInArrow(moving.normal(columns, "code", n, limit), panel.schema) if columns else panel


def winsorize(panel: DataFrame, columns: Sequence[str], method: str = "mad", width: float = 3.0, suffix: str = "") -> DataFrame:
    """Clip to median ± width · 1.4826 · MAD of the date. Other methods than ``mad`` change nothing.

    Where the MAD is 0 the whole date takes the median.
    """
    if method != "mad":
        return panel.withColumns({c + suffix: F.col(c) for c in columns}) if suffix else panel
    panel = panel.withColumns({f"_med_{c}": F.median(c).over(by_date()) for c in columns})
    panel = panel.withColumns({f"_mad_{c}": F.median(F.abs(F.col(c) - F.col(f"_med_{c}"))).over(by_date()) for c in columns})
    panel = panel.withColumns({c + suffix: mad_bounds(F.col(c), F.col(f"_med_{c}"), F.col(f"_mad_{c}"), width) for c in columns})
    return panel.drop(*(f"_{k}_{c}" for c in columns for k in ("med", "mad")))


def _share(x: np.ndarray) -> np.ndarray:
    """Average rank over the number of values, NaN for none."""
    order = np.sort(x[~np.isnan(x)])
    rank = (np.searchsorted(order, x, "left") + np.searchsorted(order, x, "right") + 1) / 2
    return np.where(np.isnan(x), np.nan, rank / max(1, len(order)))


def _average_rank(x: np.ndarray) -> np.ndarray:
    """Winsorised average rank over the number of values, moved to (-1, 1], NaN for none."""
    v = x[~np.isnan(x)]
    if not len(v):
        return x
    mid = np.median(v)
    width = 3 * 1.4826 * np.median(np.abs(v - mid))
    return (_share(np.where(np.isnan(x), np.nan, np.minimum(np.maximum(x, mid - width), mid + width))) - 0.5) * 2


def _ranks(columns: list[str], names: list[str]):
    def rank(table: pa.Table) -> pa.Table:
        for c, name in zip(columns, names, strict=True):
            table = table.append_column(name, moving.doubles(_average_rank(moving.numbers(table[c]))))
        return table

    return rank


def cross_ranks(panel: DataFrame, columns: Sequence[str] = RANKED) -> DataFrame:
    """``cs_rank_*``: winsorised percentile rank of the date, moved to (-1, 1].

    A window would sort the date's rows once for each column; here they meet once, as an Arrow table, and each column is sorted alone.
    """
    columns = [c for c in columns if c in panel.columns]
    names = [f"cs_rank_{c}" for c in columns]
    schema = StructType([*panel.schema.fields, *(StructField(c, DoubleType()) for c in names)])
    return panel.groupBy("date").applyInArrow(_ranks(columns, names), schema) if columns else panel


def market_relative(panel: DataFrame, columns: Sequence[str] = RELATIVE) -> DataFrame:
    """``mkt_mean_*``, the mean of the date, and ``rel_*``, the value less that mean."""
    columns = [c for c in columns if c in panel.columns]
    panel = panel.withColumns({f"mkt_mean_{c}": cs_mean(F.col(c)) for c in columns})
    return panel.withColumns({f"rel_{c}": F.col(c) - F.col(f"mkt_mean_{c}") for c in columns})


def _root(gram: np.ndarray) -> np.ndarray:
    """The inverse root of a Gram matrix, 0 in directions that are none."""
    values, vectors = np.linalg.eigh(gram)
    keep = values > 1e-10 * max(values.max(), 0)
    scale = np.where(keep, 1 / np.sqrt(np.where(keep, values, 1)), 0)
    one = (vectors * scale) @ vectors.T
    flat = np.diag(gram) <= 1e-10 * max(np.diag(gram).max(), 0)  # constant columns are 0, not what rounding leaves of them
    one[flat] = one[:, flat] = 0
    return one


def _inverse_root(k: int):
    def root(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for gram in pdf["gram"]:
                full = np.zeros((k, k))
                full[np.triu_indices(k)] = gram
                out.append(_root(full + np.triu(full, 1).T).ravel().tolist())
            yield pd.DataFrame({"date": pdf["date"], "map": out})

    return root


def orthogonalize(panel: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Symmetric (Löwdin) orthogonalisation of the ``style_*`` columns within each date, in place.

    Columns are standardised (population deviation + 1e-9), multiplied by the inverse root of their
    Gram matrix, and standardised again; NULL counts as 0. Spark sums the Gram matrices; only these k · k numbers a date
    go through Python. Directions with an eigenvalue under 1e-10 of the largest are left at 0, so
    collinear columns and dates with fewer codes than columns have a defined result.

    The sums read date and ``columns`` alone, apart from the pass that makes the result: hand in a table that is written already
    where ``panel`` is costly.
    """
    columns = [c for c in panel.columns if c.startswith("style_")] if columns is None else list(columns)
    k, w = len(columns), by_date()

    def standard(df: DataFrame, source: Sequence[str], target: Sequence[str]) -> DataFrame:
        return df.withColumns({t: (F.col(s) - F.avg(s).over(w)) / (F.stddev_pop(s).over(w) + 1e-9) for s, t in zip(source, target, strict=True)})

    z, mixed = [f"_z{i}" for i in range(k)], [f"_m{j}" for j in range(k)]
    filled = panel.withColumns({f"_f{i}": F.coalesce(F.col(c), F.lit(0.0)) for i, c in enumerate(columns)})
    df = standard(filled, [f"_f{i}" for i in range(k)], z)
    sums = [F.sum(F.col(z[i]) * F.col(z[j])) for i in range(k) for j in range(i, k)]
    gram = df.select("date", *z).groupBy("date").agg(F.array(*sums).alias("gram"))
    kind = panel.schema["date"].dataType.simpleString()
    maps = gram.mapInPandas(_inverse_root(k), f"date {kind}, map array<double>")
    df = df.join(maps, "date").withColumns({mixed[j]: sum((F.col(z[i]) * F.col("map")[i * k + j] for i in range(1, k)), F.col(z[0]) * F.col("map")[j]) for j in range(k)})
    return standard(df, mixed, columns).select(*panel.columns)


def cross_section(table: pa.Table) -> dict[str, np.ndarray]:
    """``cross_ranks``, ``market_relative``, ``orthogonalize`` and ``labels.date_labels``, one after the other, of the rows of one date. Ranks and means use the styles before these turn."""
    ranked, relative, styles = [c for c in RANKED if c in table.column_names], [c for c in RELATIVE if c in table.column_names], [c for c in table.column_names if c.startswith("style_")]
    x = {c: moving.numbers(table[c]) for c in {*ranked, *relative, *styles, "target"}}

    def mean(values: np.ndarray) -> float:
        there = values[~np.isnan(values)]
        return there.mean() if len(there) else np.nan

    def standard(values: np.ndarray) -> np.ndarray:
        return (values - values.mean(0)) / (values.std(0) + 1e-9)

    made = {f"cs_rank_{c}": _average_rank(x[c]) for c in ranked}
    made |= {f"mkt_mean_{c}": np.full(table.num_rows, mean(x[c])) for c in relative}
    made |= {f"rel_{c}": x[c] - made[f"mkt_mean_{c}"] for c in relative}
    made |= {"rank_label": _share(x["target"]), "excess_label": x["target"] - mean(x["target"])}
    if styles:
        z = standard(np.stack([np.where(np.isnan(x[c]), 0.0, x[c]) for c in styles], 1))
        turned = standard(z @ _root(z.T @ z))
        made |= {c: turned[:, i] for i, c in enumerate(styles)}
    return made


def standard_scale(panel: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Standardise over a code's whole history (population deviation, 1 if that is 0). Looks ahead."""
    w = Window.partitionBy("code")
    sd = lambda c: F.when(F.stddev_pop(c).over(w) == 0, 1.0).otherwise(F.stddev_pop(c).over(w))
    return panel.withColumns({c: (F.col(c) - F.avg(c).over(w)) / sd(c) for c in columns})
