"""The factor catalogue: named expressions over the bars of one code, for Spark columns and for arrays of sorted bars alike.

Window functions cannot be nested, so the catalogue has stages: series by lags, moving values in one pass over the
bars in order, row expressions over these. All stages share one exchange and one sort by (code, date).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions import moving, ts
from panelwright.functions.scalar import negative_part, positive_part, ratio, tidy

EPS = 1e-9
#: What an entry is made of: a value by its name, and functions. Called with ``Columns`` it is an expression of Spark, with ``moving.Arrays`` an array.
Expr = Callable[[Any], Any]


class Columns:
    """The functions of the catalogue on Spark columns."""

    def __call__(self, name: str) -> Column:
        return F.col(name)

    weekday, dayofmonth, month = staticmethod(F.weekday), staticmethod(F.dayofmonth), staticmethod(F.month)
    ln, sqrt, abs, sign = staticmethod(F.ln), staticmethod(F.sqrt), staticmethod(F.abs), staticmethod(F.signum)
    delay, delta, returns, log_return = staticmethod(ts.delay), staticmethod(ts.delta), staticmethod(ts.ts_returns), staticmethod(ts.log_return)
    positive_part, negative_part, tidy = staticmethod(positive_part), staticmethod(negative_part), staticmethod(tidy)

    @staticmethod
    def ratio(a: Column | float, b: Column) -> Column:
        return ratio(F.lit(a), b)

    @staticmethod
    def square(x: Column) -> Column:
        return F.pow(x, 2)

    @staticmethod
    def where(test: Column, yes: Column | float, no: Column | float) -> Column:
        return F.when(test, yes).otherwise(no)


#: Series that several factors share, in order of need.
BASE: dict[str, Expr] = {
    "_r": lambda m: m.returns(m("close")),
    "_lr": lambda m: m.log_return(m("close")),
    "_dc": lambda m: m.delta(m("close"), 1),
    "_prev": lambda m: m.delay(m("close"), 1),
    "_dc10": lambda m: m.delta(m("close"), 10),
    "_dv": lambda m: m.delta(m("volume"), 1),
    "_clv": lambda m: ((m("close") - m("low")) - (m("high") - m("close"))) / (m("high") - m("low") + EPS) * m("volume"),
    "_range": lambda m: m.ratio(m("high") - m("low"), m("close")),
    "_log_hl": lambda m: m.ln(m.ratio(m("high"), m("low"))),
    "_log_co": lambda m: m.ln(m.ratio(m("close"), m("open"))),
    "_rs": lambda m: m.ln(m.ratio(m("high"), m("close"))) * m.ln(m.ratio(m("high"), m("open")))
    + m.ln(m.ratio(m("low"), m("close"))) * m.ln(m.ratio(m("low"), m("open"))),
}
DERIVED: dict[str, Expr] = {
    "_r1": lambda m: m.delay(m("_r"), 1),
    "_dc1": lambda m: m.delay(m("_dc"), 1),
    "_up": lambda m: m.positive_part(m("_dc")),
    "_down": lambda m: m.negative_part(m("_dc")),
    "_rises": lambda m: m.where(m("_r") > 0, 1.0, 0.0),
    "_loss": lambda m: m.where(m("_r") > 0, 0.0, m("_r")),
    "_abs_dc": lambda m: m.abs(m("_dc")),
    "_log_oc": lambda m: m.ln(m.ratio(m("open"), m("_prev"))),
}
#: Moving values, by family; a later one may be made of an earlier one.
R = ts.Rolling
MOVING: dict[str, dict[str, ts.Rolling]] = {
    "style": {
        "style_mom_1m": R("sum", 20, "_lr"), "style_mom_3m": R("sum", 60, "_lr"), "style_mom_6m": R("sum", 120, "_lr"), "style_vol_1m": R("std", 20, "_r"),
        "style_vol_3m": R("std", 60, "_r"), "_v20": R("sum", 20, "volume"), "style_beta_proxy": R("corr", 20, "_r", "_r1"),
    },
    "tech": {
        "_e12": R("ewm", 1, "close", alpha=2 / 13), "_e26": R("ewm", 1, "close", alpha=2 / 27), "_up14": R("mean", 14, "_up"), "_down14": R("mean", 14, "_down"),
        "_ma20": R("mean", 20, "close"), "_sd20": R("std", 20, "close"), "_rises12": R("sum", 12, "_rises"), "_low9": R("min", 9, "low"), "_high9": R("max", 9, "high"),
    },
    "alpha": {
        "_c10": R("corr", 10, "open", "volume"), "alpha_trend_strength": R("mean", 14, "_range"), "_rank_c": R("rank", 5, "close"), "_rank_v": R("rank", 5, "volume"),
        "alpha_pv_corr": R("corr", 5, "_rank_c", "_rank_v"), "alpha_money_flow": R("decay", 20, "_clv"),
    },
    "adv": {
        "adv_skew_20": R("skew", 20, "_r"), "adv_kurt_20": R("kurt", 20, "_r"), "adv_downside_vol": R("std", 20, "_loss"), "_abs10": R("sum", 10, "_abs_dc"),
        "adv_spread_proxy": R("mean", 5, "_log_hl"), "_sd5": R("std", 5, "_r"), "adv_vol_of_vol": R("std", 20, "_sd5"),
    },
    "ind": {
        "_sd_oc": R("std", 20, "_log_oc"), "_sd_co": R("std", 20, "_log_co"), "_rs20": R("mean", 20, "_rs"), "_cov": R("cov", 20, "_dc", "_dc1"),
        "ind_max_ret": R("max", 20, "_r"), "_sdv": R("std", 20, "volume"), "_mav": R("mean", 20, "volume"),
    },
}
#: Moving values of what row expressions make of those above.
SECOND: dict[str, tuple[dict[str, Expr], dict[str, ts.Rolling]]] = {
    "tech": (
        {"_dif": lambda m: m("_e12") - m("_e26"), "_rsv": lambda m: (m("close") - m("_low9")) / (m("_high9") - m("_low9") + EPS) * 100},
        {"_dea": R("ewm", 1, "_dif", alpha=2 / 10), "_k": R("ewm", 1, "_rsv", alpha=1 / 3, adjust=True), "_d": R("ewm", 1, "_k", alpha=1 / 3, adjust=True)},
    ),
}
STYLE: dict[str, Expr] = {
    "style_mom_1m": lambda m: m("style_mom_1m"),
    "style_mom_3m": lambda m: m("style_mom_3m"),
    "style_mom_6m": lambda m: m("style_mom_6m"),
    "style_vol_1m": lambda m: m("style_vol_1m"),
    "style_vol_3m": lambda m: m("style_vol_3m"),
    "style_liquidity": lambda m: m.ln(m("_v20") + 1),
    "style_size_proxy": lambda m: m.ln(m("close") * m("volume") + 1),
    "style_beta_proxy": lambda m: m("style_beta_proxy"),
}
TECH: dict[str, Expr] = {
    "tech_macd_hist": lambda m: 2 * (m("_dif") - m("_dea")),
    "tech_rsi_14": lambda m: 100 - 100 / (1 + m("_up14") / (m("_down14") + EPS)),
    "tech_bias_20": lambda m: m.ratio(m("close") - m("_ma20"), m("_ma20")),
    "tech_psy_12": lambda m: m("_rises12") / 12,
    "tech_kdj_k": lambda m: m("_k"),
    "tech_kdj_d": lambda m: m("_d"),
    "tech_kdj_j": lambda m: 3 * m("_k") - 2 * m("_d"),
    "tech_bb_width": lambda m: 4 * m("_sd20") / (m("_ma20") + EPS),
    "tech_bb_pctb": lambda m: (m("close") - (m("_ma20") - 2 * m("_sd20"))) / (4 * m("_sd20") + EPS),
}
FUND: dict[str, tuple[str, Expr]] = {
    "fund_ep": ("pe_ttm", lambda m: m.ratio(1.0, m("pe_ttm") + EPS)),
    "fund_bp": ("pb", lambda m: m.ratio(1.0, m("pb") + EPS)),
    "fund_roe": ("roe", lambda m: m("roe")),
    "fund_growth": ("profit_growth", lambda m: m("profit_growth")),
    "fund_safety": ("debt_ratio", lambda m: -m("debt_ratio")),
}
ALPHA: dict[str, Expr] = {
    "alpha_006": lambda m: -m("_c10"),
    "alpha_012": lambda m: m.sign(m("_dv")) * -m("_dc"),
    "alpha_trend_strength": lambda m: m("alpha_trend_strength"),
    "alpha_pv_corr": lambda m: m("alpha_pv_corr"),
    "alpha_money_flow": lambda m: m("alpha_money_flow"),
}
ADV: dict[str, Expr] = {
    "adv_skew_20": lambda m: m("adv_skew_20"),
    "adv_kurt_20": lambda m: m("adv_kurt_20"),
    "adv_downside_vol": lambda m: m("adv_downside_vol"),
    "adv_ker_10": lambda m: m.abs(m("_dc10")) / (m("_abs10") + EPS),
    "adv_amihud": lambda m: m.abs(m("_r")) / (m("close") * m("volume") + EPS),
    "adv_spread_proxy": lambda m: m("adv_spread_proxy"),
    "adv_vol_of_vol": lambda m: m("adv_vol_of_vol"),
}
IND: dict[str, Expr] = {
    "ind_yang_zhang_vol": lambda m: m.tidy(m.sqrt(m.square(m("_sd_oc")) + 0.34 * m.square(m("_sd_co")) + 0.66 * m("_rs20"))),
    "ind_roll_spread": lambda m: 2 * m.sqrt(m.where(m("_cov") > 0, 0.0, -m("_cov")) + EPS),
    "ind_max_ret": lambda m: m("ind_max_ret"),
    "ind_vol_cv": lambda m: m("_sdv") / (m("_mav") + EPS),
    "ind_smart_money": lambda m: m.abs(m("close") - m("open")) / (m("high") - m("low") + EPS) * m.ln(m("volume") + 1),
}
CALENDAR: dict[str, Expr] = {
    "time_dow": lambda m: (m.weekday("date") - 2) / 2,
    "time_dom": lambda m: (m.dayofmonth("date") - 15) / 15,
    "time_moy": lambda m: (m.month("date") - 6.5) / 5.5,
}
FAMILIES = {"style": STYLE, "tech": TECH, "alpha": ALPHA, "adv": ADV, "ind": IND, "time": CALENDAR}


#: Series that the row expressions of a family use beside its moving values.
USED = {"style": (), "tech": (), "alpha": ("_dc", "_dv"), "adv": ("_dc10", "_r"), "ind": (), "time": (), "fund": ()}


ALL = ("style", "tech", "fund", "alpha", "adv", "ind", "time")


def needed(families: Sequence[str]) -> tuple[dict[str, ts.Rolling], set[str]]:
    """The moving values of these families, and the series that are used."""
    rolling = {k: r for family in families for k, r in MOVING.get(family, {}).items()}
    return rolling, {c for r in rolling.values() for c in (r.x, r.y)} | {c for family in families for c in USED[family]}


def expressions(families: Sequence[str], columns: Sequence[str]) -> dict[str, Expr]:
    """The factors of these families over bars with such columns, in order; fundamentals where their columns exist."""
    made: dict[str, Expr] = {}
    for family in families:
        made |= {k: e for k, (needs, e) in FUND.items() if needs in columns} if family == "fund" else FAMILIES[family]
    return made


def with_factors(bars: DataFrame, families: tuple[str, ...] = ALL) -> DataFrame:
    """``bars`` and the factors of these families; fundamentals where their columns exist. Rows come out dealt by code and sorted, as from ``ts.in_order``."""
    (rolling, used), on = needed(families), Columns()
    df = bars.withColumns({k: e(on) for k, e in BASE.items()})
    df = df.withColumns({k: e(on) for k, e in DERIVED.items()})
    df = df.select(*bars.columns, *(c for c in (*BASE, *DERIVED) if c in used))
    if rolling:
        df = ts.with_rolling(df, rolling)
    for family in families:
        if family in SECOND:
            between, second = SECOND[family]
            df = ts.with_rolling(df.withColumns({k: e(on) for k, e in between.items()}), second, ordered=True)
    return df.select(*bars.columns, *(e(on).alias(k) for k, e in expressions(families, bars.columns).items()))


def past_bars(families: Sequence[str]) -> int:
    """How many bars before its own a factor of these families depends on."""
    return 10 + moving.past_rows(needed(families)[0]) + max((moving.past_rows(SECOND[f][1]) for f in families if f in SECOND), default=0)  # 10: the longest lag


def factor_values(families: Sequence[str], columns: Sequence[str], bars: moving.Arrays) -> list[np.ndarray]:
    """What ``with_factors`` adds, for arrays of sorted bars."""
    for k, e in (BASE | DERIVED).items():
        bars.made[k] = e(bars)
    bars.made |= bars.rolled(needed(families)[0])
    for family in families:
        if family in SECOND:
            between, second = SECOND[family]
            bars.made |= {k: e(bars) for k, e in between.items()}
            bars.made |= bars.rolled(second)
    return [e(bars) for e in expressions(families, columns).values()]
