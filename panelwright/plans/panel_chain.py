"""The fixed chain from bars to a labelled, normalised panel.

The rolling part runs by code, in one pass of tasks over the bars in order; the cross-section by date, where a date's rows meet once.
Between the two only the rows that stay are dealt out, once; nothing is written on the way.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StructField, StructType

from panelwright.functions import moving
from panelwright.functions.ts import in_order
from panelwright.operators import factors
from panelwright.operators.calendar import fill_gaps
from panelwright.operators.normalize import NORMALISED, RANKED, RELATIVE, cross_section
from panelwright.operators.panel import PREFIXES, asof_fundamentals, fill_fundamentals, lasting_fundamentals

FAMILIES = tuple(f for f in factors.ALL if f != "time")  # dates' own numbers are made where they are wanted


def _in_universe(min_price: float, train: bool) -> Callable[[moving.Arrays, np.ndarray], np.ndarray]:
    """Which bars are traded, at or above the price floor and, to train, have a target."""
    return lambda bars, target: (bars("volume") > 0) & (bars("close") >= min_price) & (~np.isnan(target) if train else True)


def _rows(bars: DataFrame, narrow: bool = False, kept: Callable | None = None, seen: int = 0) -> DataFrame:
    """Sorted bars (or what they are made of, as from ``lasting_fundamentals``) with factors, normalised, and the target. ``narrow``: factors that have no part in the cross-section come in one list of floats, ``_narrow``."""
    columns = [c for c in bars.columns if c != "_days"]
    names = list(factors.expressions(FAMILIES, columns))
    small = [c for c in names if narrow and not c.startswith("style_") and c not in (*RANKED, *RELATIVE)]
    wide = StructType([*(bars.schema[c] for c in columns), *(StructField(c, DoubleType()) for c in (*names, "target") if c not in small), *[StructField("_narrow", ArrayType(FloatType(), False))] * bool(small)])
    values = lambda x: factors.factor_values(FAMILIES, columns, x)
    scaled = [c for c in names if c.startswith(NORMALISED)]
    made = moving.panel_rows(values, names, scaled, small, "code", factors.past_bars(FAMILIES), 60, 4.0, 5, kept, seen, to_arrow_schema(wide))
    daily = moving.each_day(columns)
    return bars.mapInArrow((lambda batches: made(daily(batches))) if "_days" in bars.columns else made, wide)


def code_stage(bars: DataFrame, fundamentals: DataFrame | None = None, null_missing: bool = False) -> DataFrame:
    """As-of fundamentals, factors, normalisation and target of each code, in this order."""
    if fundamentals is not None:
        bars = fill_fundamentals(asof_fundamentals(bars, fundamentals), null_missing)
    panel, on = _rows(in_order(bars)), factors.Columns()
    return panel.select(*panel.columns[:-1], *(e(on).alias(c) for c, e in factors.CALENDAR.items()), "target")


def date_stage(panel: DataFrame, bars: Sequence[str]) -> DataFrame:
    """Ranks, market means, orthogonal styles and labels of each date, where its rows meet once, as an Arrow table.

    ``panel`` comes from ``_rows`` over these columns of bars; the list of narrow factors becomes columns again, and then all features are as in ``feature_table``.
    """
    factor_names, given = list(factors.expressions(FAMILIES, bars)), panel.schema
    small = [c for c in factor_names if c not in panel.columns]
    ranked, relative = ([c for c in names if c in factor_names] for names in (RANKED, RELATIVE))
    after = [*(f"cs_rank_{c}" for c in ranked), *(f"{p}_{c}" for p in ("mkt_mean", "rel") for c in relative), "rank_label", "excess_label"]
    kind = lambda c: FloatType() if small and c.startswith(PREFIXES) else DoubleType()
    schema = StructType([*(given[c] for c in bars), *(StructField(c, kind(c)) for c in (*factor_names, *factors.CALENDAR)), given["target"], *(StructField(c, kind(c)) for c in after)])
    arrow = to_arrow_schema(schema)

    def made(table: pa.Table) -> pa.Table:
        found, on = cross_section(table), moving.Arrays(table)
        found |= {c: e(on) for c, e in factors.CALENDAR.items()}
        if small:
            cells = table["_narrow"].combine_chunks().flatten().to_numpy().reshape(-1, len(small))
            found |= {c: cells[:, i] for i, c in enumerate(small)}
            found |= {c: np.nan_to_num(found[c] if c in found else moving.numbers(table[c]), nan=0.0, posinf=np.inf, neginf=-np.inf) for c in (*factor_names, *after) if c.startswith(PREFIXES)}
        columns = [pa.array(found[f.name], from_pandas=True).cast(f.type, safe=False) if f.name in found else table[f.name].combine_chunks().cast(f.type) for f in arrow]
        return pa.table(columns, schema=arrow)

    return panel.groupBy("date").applyInArrow(made, schema)


def build_panel(bars: DataFrame, fundamentals: DataFrame | None = None, mode: str = "train", min_price: float = 2.0, min_bars: int = 60, fill: bool = False, narrow: bool = False) -> DataFrame:
    """The whole chain. Mode ``predict`` keeps the unlabelled tail; ``fill`` fills the calendar's gaps first (``fill_gaps``).

    ``narrow``: features come as ``feature_table`` makes them. Those without a part in the cross-section are so from the start, which makes the rows that are dealt out smaller.
    """
    if fill and fundamentals is not None:
        bars = fill_fundamentals(lasting_fundamentals(bars, fundamentals))  # in order already; days become rows in the pass over them
    else:
        bars = fill_gaps(bars) if fill else bars
        bars = in_order(bars if fundamentals is None else fill_fundamentals(asof_fundamentals(bars, fundamentals)))
    return date_stage(_rows(bars, narrow, _in_universe(min_price, mode == "train"), min_bars + 1), [c for c in bars.columns if c != "_days"])


def flagship(bars: DataFrame, k: int = 5) -> DataFrame:
    """(date, code, place, mom, rank): the k codes of strongest monthly momentum on each date."""
    from panelwright.functions.cross import cs_rank
    from panelwright.functions.scalar import rounded
    from panelwright.functions.ts import log_return, ts_sum
    from panelwright.operators.score import top_k

    mom = bars.withColumn("_lr", log_return(F.col("close"))).select("code", "date", ts_sum(F.col("_lr"), 20).alias("mom")).where(F.col("mom").isNotNull())
    ranked = mom.withColumn("score", cs_rank(F.col("mom")))
    return top_k(ranked, k).select("date", "code", "place", rounded(F.col("mom")).alias("mom"), rounded(F.col("score")).alias("rank"))
