import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwright.functions import ts
from panelwright.functions.scalar import clip, negative_part, positive_part, ratio, safe_log, tidy

DAY = dt.date(2020, 1, 1)
SERIES = {
    "a": [1.0, 2.0, 2.0, 5.0, 3.0, 8.0, 8.0, 1.0, 4.0, 6.0, 7.0, 2.0],
    "b": [3.0] * 12,
    "c": [2.0, None, 4.0, 1.0, 7.0, 7.0, 3.0, None, 5.0, 9.0, 2.0, 6.0],
    "d": [1.5, 2.5],
}


@pytest.fixture(scope="module")
def bars(spark):
    rows = [(code, DAY + dt.timedelta(days=k), x, None if x is None else x * x - 3 * k) for code, xs in SERIES.items() for k, x in enumerate(xs)]
    return spark.createDataFrame(rows, "code string, date date, x double, y double").cache()


def spark_values(df, expression):
    out = {}
    for r in df.select("code", "date", expression.alias("v")).orderBy("code", "date").collect():
        out.setdefault(r.code, []).append(r.v)
    return out


def agree(got, expected):
    for code, values in expected.items():
        for a, b in zip(got[code], values, strict=True):
            assert (a is None and (b is None or math.isnan(b))) or (a is not None and abs(a - b) < 1e-9), (code, got[code], list(values))


def frames():
    return {c: pd.Series([np.nan if x is None else x for x in xs], dtype=float) for c, xs in SERIES.items()}


@pytest.mark.parametrize(
    ("ours", "theirs"),
    [
        (lambda x: ts.ts_mean(x, 4), lambda s: s.rolling(4).mean()),
        (lambda x: ts.ts_std(x, 4), lambda s: s.rolling(4).std()),
        (lambda x: ts.ts_sum(x, 3), lambda s: s.rolling(3).sum()),
        (lambda x: ts.ts_max(x, 3), lambda s: s.rolling(3).max()),
        (lambda x: ts.ts_min(x, 3), lambda s: s.rolling(3).min()),
        (lambda x: ts.delta(x, 2), lambda s: s.diff(2)),
        (lambda x: ts.delay(x, -2), lambda s: s.shift(-2)),
        (lambda x: ts.ts_rank(x, 5), lambda s: s.rolling(5).apply(lambda w: (pd.Series(w).rank().iloc[-1] - 1) / 4)),
        (lambda x: ts.decay_linear(x, 4), lambda s: s.rolling(4).apply(lambda w: (w * [1, 2, 3, 4]).sum() / 10, raw=True)),
        (lambda x: ts.cum_sum(F.coalesce(x, F.lit(0.0))), lambda s: s.fillna(0).cumsum()),
        (lambda x: ts.forward_fill(x), lambda s: s.ffill()),
    ],
)
def test_against_pandas(bars, ours, theirs):
    agree(spark_values(bars, ours(F.col("x"))), {c: theirs(s) for c, s in frames().items()})


def test_moments_need_movement(bars):
    for ours, theirs in ((ts.ts_skew, lambda s: s.rolling(6).skew()), (ts.ts_kurt, lambda s: s.rolling(6).kurt())):
        expected = {c: theirs(s) if c != "b" else [None] * 12 for c, s in frames().items()}
        agree(spark_values(bars, ours(F.col("x"), 6)), expected)


def test_correlation_and_covariance(bars):
    pairs = {c: (s, s * s - 3 * np.arange(len(s))) for c, s in frames().items()}
    agree(spark_values(bars, ts.ts_cov(F.col("x"), F.col("y"), 5)), {c: a.rolling(5).cov(b) for c, (a, b) in pairs.items()})
    agree(spark_values(bars, ts.ts_corr(F.col("x"), F.col("y"), 5)), {c: a.rolling(5).corr(b) if c != "b" else [None] * 12 for c, (a, b) in pairs.items()})


def test_zscore_of_a_constant_is_zero(bars):
    got = spark_values(bars, ts.rolling_zscore(F.col("x"), 5))
    assert got["b"][4:] == [0.0] * 8 and got["b"][:4] == [None] * 4


@pytest.mark.parametrize("adjust", [False, True])
@pytest.mark.parametrize("alpha", [2 / 27, 1 / 3, 0.9])
def test_ewm_over_many_blocks(spark, alpha, adjust):
    rng = random.Random(1)
    xs = [None, None] * adjust + [rng.uniform(5, 15) for _ in range(1500)]
    rows = [("a", DAY + dt.timedelta(days=k), x) for k, x in enumerate(xs)]
    df = ts.with_ewm(spark.createDataFrame(rows, "code string, date date, x double"), [("y", "x", alpha, adjust)])
    expected = pd.Series(xs, dtype=float).ewm(alpha=alpha, adjust=adjust).mean()
    agree(spark_values(df, F.col("y")), {"a": expected})


def test_scalars(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-4.0, 2.0), (None, 1.0), (float("nan"), 1.0), (float("inf"), 1.0)], "x double, y double")
    x, y = F.col("x"), F.col("y")
    got = df.select(ratio(x, y), tidy(x), clip(tidy(x), -2, 0.5), positive_part(tidy(x)), negative_part(tidy(x)), safe_log(tidy(x))).collect()
    assert [r[0] for r in got[:3]] == [None, -2.0, None]
    assert [r[1] for r in got] == [1.0, -4.0, None, None, None]
    assert [r[2] for r in got] == [0.5, -2.0, None, None, None]
    assert [r[3] for r in got] == [1.0, 0.0, 0.0, 0.0, 0.0] and [r[4] for r in got] == [0.0, 4.0, 0.0, 0.0, 0.0]
    assert abs(got[1][5] - math.log(4 + 1e-9)) < 1e-12


def test_ewm_of_a_small_alpha_forgets_nothing(spark):
    """A large first value at span 400 still shows after more than 16 blocks of 64 bars; another alpha beside it."""
    xs = [1e6] + [1.0 + i % 7 for i in range(1, 2500)]
    rows = [("A", DAY + dt.timedelta(days=i), x) for i, x in enumerate(xs)]
    made = spark.createDataFrame(rows, "code string, date date, x double")
    got = ts.with_ewm(made, [("y", "x", 2 / 401, False), ("z", "x", 2 / 3, True)]).orderBy("date").toPandas()
    for name, alpha, adjust in (("y", 2 / 401, False), ("z", 2 / 3, True)):
        assert np.allclose(got[name], pd.Series(xs).ewm(alpha=alpha, adjust=adjust).mean(), rtol=1e-9)
