"""Rolling values by merged states against pandas, at many window lengths, with NULLs and constant stretches."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from panelwright.functions import ts

DAY = dt.date(2020, 1, 1)


@pytest.fixture(scope="module")
def series():
    rnd = np.random.default_rng(8)
    frames = []
    for code, n in (("a", 300), ("b", 40), ("c", 3)):
        x, y = 1e6 + rnd.normal(size=n), rnd.normal(size=n).cumsum()
        x[: n // 4] = 5.0
        frame = pd.DataFrame({"code": code, "date": [DAY + dt.timedelta(days=k) for k in range(n)], "x": x, "y": y})
        frame.loc[frame.index[n // 2], "x"] = np.nan
        frames.append(frame)
    return pd.concat(frames, ignore_index=True)


THEIRS = {
    "mean": lambda g, n: g.x.rolling(n).mean(), "sum": lambda g, n: g.x.rolling(n).sum(), "std": lambda g, n: g.x.rolling(n).apply(lambda v: np.std(v, ddof=1)), "max": lambda g, n: g.x.rolling(n).max(),
    "min": lambda g, n: g.x.rolling(n).min(), "skew": lambda g, n: g.x.rolling(n).apply(lambda v: pd.Series(v).skew()), "kurt": lambda g, n: g.x.rolling(n).apply(lambda v: pd.Series(v).kurt()),
    "cov": lambda g, n: g.x.rolling(n).apply(lambda v: np.cov(v, g.y[v.index])[0, 1]),
    "corr": lambda g, n: g.x.rolling(n).apply(lambda v: np.corrcoef(v, g.y[v.index])[0, 1] if v.max() > v.min() else np.nan),
}


@pytest.mark.parametrize("lengths", [(5, 20), (7, 64), (100,)])
def test_equals_pandas(spark, series, lengths):
    df = spark.createDataFrame(series).replace(float("nan"), None)
    columns = {f"{kind}_{n}": ts.Rolling(kind, n, "x", "y" if kind in ("corr", "cov") else None) for kind in THEIRS for n in lengths}
    found = ts.with_rolling(df, columns)
    assert found.columns == [*df.columns, *columns]
    got = found.toPandas().sort_values(["code", "date"]).reset_index(drop=True)
    for kind, theirs in THEIRS.items():
        for n in lengths:
            want = pd.concat([theirs(g, n) for _, g in series.groupby("code")])
            if kind in ("skew", "kurt"):  # pandas has 0 and -3 on constant windows
                flat = pd.concat([g.x.rolling(n).max() == g.x.rolling(n).min() for _, g in series.groupby("code")])
                want = want.where(~flat)
            assert np.allclose(got[f"{kind}_{n}"].astype(float), want, rtol=1e-6, atol=1e-6, equal_nan=True), (kind, n)


def test_one_sort_for_all(spark, series):
    found = ts.with_rolling(spark.createDataFrame(series).replace(float("nan"), None), {"a": ts.Rolling("std", 250, "x"), "b": ts.Rolling("max", 33, "y"), "c": ts.Rolling("mean", 1, "x")})
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("Sort [") <= 1
    assert [r.c for r in found.where("code = 'c'").orderBy("date").collect()] == [None if np.isnan(v) else v for v in series[series.code == "c"].x]
