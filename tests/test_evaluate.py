import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwright.operators import evaluate, portfolio, samples, score

DAY = dt.date(2022, 1, 3)


def day(k):
    return DAY + dt.timedelta(days=k)


@pytest.fixture(scope="module")
def predictions(spark):
    rng, rows = random.Random(4), []
    for d in range(12):
        for k in range(rng.randrange(1, 30)):
            rows.append((day(d), f"c{k:02d}", float(rng.randrange(4 + d)), None if rng.random() < 0.1 else rng.gauss(0, 1)))
    rows += [(day(20), "a", 1.0, 0.1), (day(20), "b", 1.0, 0.2), (day(21), "a", None, 0.3)]
    return spark.createDataFrame(rows, "date date, code string, score double, label double").cache()


def test_rank_ic(predictions):
    pdf = predictions.toPandas().dropna()
    got = {r.date: r.ic for r in evaluate.rank_ic(predictions).collect()}
    for d, g in pdf.groupby("date"):
        expected = g["score"].rank().corr(g["label"].rank()) if len(g) > 1 else np.nan
        assert (got[d] is None) == bool(np.isnan(expected)) and (got[d] is None or abs(got[d] - expected) < 1e-9)
    pooled = evaluate.pooled_ic(predictions, ranges=5).first().ic
    assert pooled == pytest.approx(pdf["score"].rank().corr(pdf["label"].rank()))


def test_layers_are_those_of_qcut(predictions):
    pdf = predictions.toPandas().dropna(subset=["score"])
    got = {(r.date, r.layer): r.label for r in evaluate.quantile_layers(predictions).collect()}
    seen = set()
    for d, g in pdf.groupby("date"):
        if g["score"].nunique() < 2:
            continue
        layers = pd.qcut(g["score"], 5, labels=False, duplicates="drop")
        for layer, x in g.groupby(layers)["label"].mean().items():
            seen.add((d, layer))
            assert (got[d, layer] is None and np.isnan(x)) or got[d, layer] == pytest.approx(x)
    assert seen <= set(got)


def test_performance_needs_ten_days(spark):
    rng = random.Random(2)
    rows = [(day(k), rng.gauss(0.001, 0.02), rng.gauss(0, 0.01)) for k in range(10)]
    df = spark.createDataFrame(rows, "date date, strategy double, benchmark double")
    one = evaluate.performance(df).first()
    p, m = (np.array([r[k] for r in rows]) for k in (1, 2))
    annual = np.prod(1 + p) ** 25.2 - 1
    curve = np.cumprod(1 + p)
    assert one.annual == pytest.approx(annual) and one.volatility == pytest.approx(p.std(ddof=1) * 252**0.5)
    assert one.max_drawdown == pytest.approx(((np.maximum.accumulate(curve) - curve) / np.maximum.accumulate(curve)).max())
    beta = np.cov(p, m)[0, 1] / (m.var(ddof=1) + 1e-9)
    assert one.beta == pytest.approx(beta) and one.alpha == pytest.approx(annual - (0.03 + beta * (np.prod(1 + m) ** 25.2 - 1 - 0.03)))
    short = evaluate.performance(df.where(F.col("date") < day(9))).first()
    assert short.days == 9 and short.annual is None and short.alpha is None
    lost = spark.createDataFrame([(day(0), 0.1, 0.0), (day(1), -1.0, 0.0), (day(2), 0.5, 0.0)], "date date, strategy double, benchmark double")
    assert [r.curve for r in evaluate.drawdown(lost).orderBy("date").collect()] == pytest.approx([1.1, 0.0, 0.0])


def test_regimes(spark):
    rows = [(day(0), x) for x in (1.0, 1.0, 1.0, -1.0)] + [(day(1), x) for x in (-1.0, -1.0, 1.0)] + [(day(2), x) for x in (0.1, -0.01)] + [(day(3), None)]
    got = {r.date: r.regime for r in evaluate.regime(spark.createDataFrame(rows, "date date, style_mom_1m double")).collect()}
    assert got == {day(0): "Bull", day(1): "Bear", day(2): "Shock", day(3): "Unknown"}


def test_loss_screen_and_last_value(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("b", 1.0, 2.0), ("b", 2.0, 3.0), ("c", 1.0, 0.0), ("c", 1.0, 2.0)], "k string, score double, label double")
    assert {r.k: r.loss for r in evaluate.hybrid_loss(df, "k").collect()} == pytest.approx({"a": 1.0, "b": 0.5, "c": 1.0})
    rows = spark.createDataFrame([("a", day(0), 1.0), ("a", day(1), None), ("b", day(0), 2.0)], "code string, date date, pe_ttm double")
    assert {r.code: r.pe_ttm for r in evaluate.last_value(rows, "pe_ttm").collect()} == {"a": None, "b": 2.0}
    assert {r.none for r in evaluate.last_value(rows, "none").collect()} == {None}


def test_picks_and_advice(spark):
    rows = [(day(0), c, s, r, pe) for c, s, r, pe in (("b", 0.9, "Bear", 0.0), ("a", 0.9, "Bull", 12.345), ("c", 0.5, "Bear", None), ("d", None, "Bull", 1.0))]
    picks = score.top_k(spark.createDataFrame(rows, "date date, code string, score double, regime string, pe_ttm double"), 3)
    got = [(r.place, r.code, r.advice, r.pe) for r in score.advice(picks).orderBy("place").collect()]
    assert got == [(1, "a", "buy", "12.35"), (2, "b", "cautious", "-"), (3, "c", "watch", "-")]


def test_costs_and_lots(spark):
    trades = spark.createDataFrame([(0.0, 10.0), (100.0, 1.0), (-100.0, 1.0), (100000.0, 10.0), (-100000.0, 10.0)], "q double, p double")
    assert [r[0] for r in trades.select(portfolio.trade_cost(F.col("q"), F.col("p"))).collect()] == pytest.approx([0, 5, 5.05, 300, 800])
    lots = spark.createDataFrame([(1e6, 10.0, 1e6), (1e6, 10.0, 500.0), (1e3, 10.0, 1e6), (1e6, 0.0, 1.0), (1e6, 10.0, 0.0)], "cash double, p double, v double")
    assert [r[0] for r in lots.select(portfolio.lot_size(F.col("cash"), F.lit(5), F.col("p"), F.col("v"))).collect()] == [19600, 1000, 0, 0, 0]


def test_window_bounds(spark):
    rows = [(c, day(k), float(k), float(k)) for c, n in (("a", 30), ("b", 31), ("c", 40)) for k in range(n)]
    df = spark.createDataFrame(rows, "code string, date date, f double, target double")
    got = [(r.code, r.start_date, r.end_date, r.label) for r in samples.training_windows(df, ["f"]).orderBy("code", "start_date").collect()]
    assert got == [("b", day(0), day(29), 29.0), *(("c", day(k), day(k + 29), 29.0 + k) for k in (0, 5, 10))]
    dense = samples.dense_windows(df, ["f"], F.lit(day(29)), F.lit(day(30)))
    assert sorted((r.code, r.end_date) for r in dense.collect()) == [("a", day(29)), ("b", day(29)), ("b", day(30)), ("c", day(29)), ("c", day(30))]
    latest = samples.latest_windows(df, ["f"]).collect()
    assert [(r.code, len(r.past_values), r.past_values[0]) for r in latest] == [("c", 30, [10.0])]
    assert sorted((r.code, r.start_date) for r in samples.intraday_windows(df, ["f"]).collect()) == [("b", day(0)), ("c", day(0)), ("c", day(5))]
    split = samples.date_split(samples.training_windows(df, ["f"]), df)
    assert {(r.code, r.end_date): r.split for r in split.collect()} == {("b", day(29)): "train", ("c", day(29)): "train", ("c", day(34)): "train", ("c", day(39)): "test"}
    scored = score.batch_score(samples.training_windows(df, ["f"]), lambda x: x[:, -1, 0], batch=2).collect()
    assert sorted((r.code, r.score) for r in scored) == [("b", 29.0), ("c", 29.0), ("c", 34.0), ("c", 39.0)]
    assert samples.code_boundaries(df).count() == 3 and samples.shuffled(samples.training_windows(df, ["f"]), 3).count() == 4


def test_trade_and_portfolio_summaries(spark):
    trades = spark.createDataFrame([(1.0,), (-2.0,), (None,)], "profit double")
    assert tuple(portfolio.trade_summary(trades).first()) == (2, 1, 0.5, -1.0)
    assert tuple(portfolio.trade_summary(trades.limit(0)).first()) == (0, 0, 0.0, 0.0)
    values = spark.createDataFrame([(day(1), 121.0), (day(0), 110.0)], "date date, value double")
    assert [r.ret for r in portfolio.portfolio_returns(values, 100.0).orderBy("date").collect()] == pytest.approx([0.1, 0.1])
    assert tuple(portfolio.portfolio_summary(values, 100.0).first()) == pytest.approx((121.0, 0.21))
