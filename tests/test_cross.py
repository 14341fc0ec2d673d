import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwright.functions.cross import cs_rank, cs_zscore
from panelwright.operators.normalize import cross_ranks, market_relative, orthogonalize, standard_scale, winsorize

D1, D2, D3 = (dt.date(2021, 3, k) for k in (1, 2, 3))


@pytest.fixture(scope="module")
def panel(spark):
    rows = [(str(k), D1, x, float(k)) for k, x in enumerate([5.0, 1.0, 5.0, None, 2.0, 900.0])] + [("0", D2, 7.0, 1.0)] + [(str(k), D3, 4.0 + (k == 9), 0.0) for k in range(10)]
    return spark.createDataFrame(rows, "code string, date date, x double, y double").cache()


def by_date(df, c):
    return {d: g.sort_values("code")[c].tolist() for d, g in df.toPandas().groupby("date")}


def test_rank_and_zscore_against_pandas(panel):
    pdf = panel.toPandas()
    got = panel.select("code", "date", cs_rank(F.col("x")).alias("r"), cs_zscore(F.col("x")).alias("z")).toPandas()
    both = pdf.merge(got, on=["code", "date"])
    grouped = both.groupby("date")["x"]
    pd.testing.assert_series_equal(both["r"], grouped.rank(pct=True), check_names=False)
    z = (both["x"] - grouped.transform("mean")) / grouped.transform("std")
    pd.testing.assert_series_equal(both["z"], z, check_names=False)


def test_winsorize(panel):
    got = by_date(winsorize(panel, ["x"]), "x")
    assert got[D1][-1] == pytest.approx(5 + 3 * 1.4826 * 3) and np.isnan(got[D1][3])
    assert got[D3] == [4.0] * 10, "a MAD of 0 takes the date to its median"
    assert by_date(winsorize(panel, ["x"], method="other"), "x")[D1][-1] == 900.0


def test_ranks_of_a_flat_date_and_relative_values(panel):
    out = market_relative(cross_ranks(panel.withColumnRenamed("x", "alpha_006")))
    ranks = by_date(out, "cs_rank_alpha_006")
    assert ranks[D3] == pytest.approx([(5.5 / 10 - 0.5) * 2] * 10) and ranks[D2] == [1.0]
    assert by_date(out, "rel_alpha_006")[D2] == [0.0] and by_date(out, "mkt_mean_alpha_006")[D3][0] == pytest.approx(4.1)


def test_orthogonal_styles(spark):
    rng = random.Random(8)
    rows = []
    for d, n in ((D1, 40), (D2, 12), (D3, 3)):
        for k in range(n):
            base = rng.gauss(0, 1)
            rows.append((str(k), d, *(base + rng.gauss(0, 0.7) for _ in range(4))))
    names = [f"style_{i}" for i in range(4)]
    df = spark.createDataFrame(rows, f"code string, date date, {', '.join(f'{c} double' for c in names)}")
    out = orthogonalize(df).toPandas()
    for d, n in ((D1, 40), (D2, 12)):
        z = out[out.date == d][names].to_numpy()
        assert np.allclose(z.T @ z, n * np.eye(4), atol=1e-5 * n)
        raw = df.where(F.col("date") == d).toPandas().merge(out[out.date == d], on="code", suffixes=("", "_o"))
        m = raw[names].to_numpy()
        m = (m - m.mean(0)) / (m.std(0) + 1e-9)
        u, _, v = np.linalg.svd(m, full_matrices=False)
        assert np.allclose(raw[[f"{c}_o" for c in names]].to_numpy(), u @ v * np.sqrt(n), atol=1e-6)
    assert np.isfinite(out[names].to_numpy()).all()
    same = orthogonalize(df.withColumn("style_3", F.col("style_0"))).toPandas()
    assert np.isfinite(same[names].to_numpy()).all() and np.allclose(same["style_3"], same["style_0"])


def test_eight_styles_on_all_dates_with_nulls(spark):
    """Every date, also those with fewer codes than columns, a constant or a collinear column, against the singular values."""
    rng = np.random.default_rng(9)
    names, rows, want = [f"style_{i}" for i in range(8)], [], {}
    for day in range(24):
        n = [1, 2, 5, 8, 9, 30][day % 6]
        m = rng.normal(size=(n, 8)) + rng.normal(size=(n, 1))
        m[rng.random((n, 8)) < 0.1] = np.nan
        if day % 4 == 1:
            m[:, 3] = 2.0
        if day % 4 == 2:
            m[:, 5] = -2 * m[:, 4]
        date = D1 + dt.timedelta(days=day)
        rows += [(f"{k:02}", date, *(None if np.isnan(v) else float(v) for v in m[k])) for k in range(n)]
        z = np.nan_to_num(m)
        z = (z - z.mean(0)) / (z.std(0) + 1e-9)
        u, size, v = np.linalg.svd(z, full_matrices=False)
        keep = size**2 > 1e-10 * max(size.max() ** 2, 1e-300)
        o = (u * keep) @ v
        o[:, np.abs(z).max(axis=0) < 1e-6] = 0
        want[date] = (o - o.mean(0)) / (o.std(0) + 1e-9)
    got = orthogonalize(spark.createDataFrame(rows, f"code string, date date, {', '.join(f'{c} double' for c in names)}")).toPandas()
    assert len(got) == len(rows)
    for date, part in got.groupby("date"):
        assert np.allclose(part.sort_values("code")[names].to_numpy(), want[date], atol=1e-6), date


def test_standard_scale_of_a_constant(panel):
    out = standard_scale(panel.where(F.col("date") == D3).withColumn("code", F.lit("z")), ["y"]).toPandas()
    assert out["y"].tolist() == [0.0] * 10
