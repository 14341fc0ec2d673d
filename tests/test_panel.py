import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwright.operators.calendar import fill_gaps
from panelwright.operators.factors import with_factors
from panelwright.operators.labels import forward_target
from panelwright.operators.normalize import RANKED, RELATIVE, normalize
from panelwright.operators.panel import asof_fundamentals, fill_fundamentals, look_back_prune, universe_filter
from panelwright.plans.panel_chain import build_panel, code_stage
from panelwright.sources import bars as src
from panelwright.sources.scratch import clean, materialise, shared_dir

DAY = dt.date(2020, 1, 1)
BAR = "code string, date date, open double, high double, low double, close double, volume double"


def day(k):
    return DAY + dt.timedelta(days=k)


def make_bars(spark, n=150, codes=("a", "b"), seed=1):
    rng, rows = random.Random(seed), []
    for code in codes:
        p = 50.0
        for k in range(n):
            o = p * rng.uniform(0.97, 1.03)
            c = o * rng.uniform(0.97, 1.03)
            rows.append((code, day(k), o, max(o, c) * rng.uniform(1, 1.02), min(o, c) * rng.uniform(0.98, 1), c, float(rng.randrange(100, 9999))))
            p = c
    return spark.createDataFrame(rows, BAR)


def test_gap_fill(spark):
    friday = dt.date(2024, 1, 5)
    rows = [("a", friday, 1.0, 2.0, 0.5, 1.5, 10.0), ("a", friday + dt.timedelta(days=1), 3.0, 4.0, 2.5, 3.5, 20.0), ("a", friday + dt.timedelta(days=4), 5.0, 6.0, 4.5, 5.5, 30.0), ("b", friday, 9.0, 9.0, 9.0, 9.0, 1.0)]
    got = [tuple(r) for r in fill_gaps(spark.createDataFrame(rows, BAR)).orderBy("code", "date").collect()]
    assert got == [rows[0], ("a", friday + dt.timedelta(days=3), 3.0, 4.0, 2.5, 3.5, 0.0), rows[2], rows[3]]


def test_asof_takes_whole_rows(spark):
    bars = spark.createDataFrame([("a", day(k), 1.0, 1.0, 1.0, 1.0, 1.0) for k in (0, 59, 60, 61, 90, 120)] + [("z", day(200), 1.0, 1.0, 1.0, 1.0, 1.0)], BAR)
    reports = spark.createDataFrame([("a", day(0), 1.0, 10.0), ("a", day(30), None, 20.0), ("a", day(30) - dt.timedelta(days=365), 7.0, 70.0), ("q", day(0), 9.0, 9.0)], "code string, date date, roe double, pb double")
    got = [(r.code, r.roe, r.pb) for r in asof_fundamentals(bars, reports).orderBy("code", "date").collect()]
    assert got == [("a", 7.0, 70.0)] * 2 + [("a", 1.0, 10.0)] * 2 + [("a", None, 20.0)] * 2 + [("z", None, None)]
    filled = fill_fundamentals(asof_fundamentals(bars, reports)).where(F.col("code") == "z").first()
    assert (filled.roe, filled.pb) == (0.0, 0.0)


def test_universe_counts_survivors(spark):
    for n, left in ((60, 0), (61, 0), (62, 1)):
        rows = [("a", day(k), 3.0, 3.0, 3.0, 3.0, 1.0) for k in range(n)] + [("a", day(500 + k), 1.0, 1.0, 1.0, 1.9, 1.0) for k in range(9)] + [("a", day(600), 3.0, 3.0, 3.0, 3.0, 0.0)]
        assert universe_filter(spark.createDataFrame(rows, BAR)).count() == left


def test_min_history_bound(spark):
    rows = [("a", day(k), *[1.0] * 5) for k in range(30)] + [("b", day(k), *[1.0] * 5) for k in range(31)]
    assert src.min_history(spark.createDataFrame(rows, BAR)).select("code").distinct().collect() == [("b",)]


def test_no_feature_looks_ahead(spark):
    bars = make_bars(spark)
    columns = [c for c in with_factors(bars).columns if c.split("_")[0] in ("style", "tech", "alpha", "adv", "ind")]
    cut = F.col("date") < F.lit(day(120))
    whole = normalize(with_factors(bars)).where(cut).orderBy("code", "date").select("code", "date", *columns).toPandas()
    part = normalize(with_factors(bars.where(cut))).orderBy("code", "date").select("code", "date", *columns).toPandas()
    pd.testing.assert_frame_equal(whole, part, rtol=1e-9, atol=1e-9)
    assert len(columns) == 34 and (whole[columns].abs() <= 4).all().all()


def test_factors_of_flat_bars_have_no_nan(spark):
    rows = [("a", day(k), 5.0, 5.0, 5.0, 5.0, 0.0) for k in range(130)]
    out = normalize(with_factors(spark.createDataFrame(rows, BAR))).toPandas()
    numbers = out.drop(columns=["code", "date"])
    assert not numbers.isna().any().any() and numbers["style_mom_1m"].abs().max() == 0


def test_target(spark):
    rows = [("a", day(k), float(10 + k), 0.0, 0.0, float(20 + k), 1.0) for k in range(8)]
    got = [r.target for r in forward_target(spark.createDataFrame(rows, BAR)).orderBy("date").collect()]
    assert got[:3] == pytest.approx([25 / 11 - 1, 26 / 12 - 1, 27 / 13 - 1]) and got[3:] == [None] * 5


def test_look_back_pruning_keeps_the_result(spark):
    bars, start = make_bars(spark, 400), F.lit(day(380))
    of = lambda df: with_factors(df, ("style", "adv", "ind")).where(F.col("date") >= start).orderBy("code", "date").toPandas()
    pruned = look_back_prune(bars, start, 130)
    assert pruned.count() == 2 * 150
    pd.testing.assert_frame_equal(of(bars), of(pruned), rtol=1e-9, atol=1e-12)


def test_coercion_and_files(spark, tmp_path):
    raw = spark.createDataFrame([("2020-01-02", "1.5", "x"), ("no date", "2", "y"), ("2020-01-03", "bad", "z")], "day string, px string, note string")
    assert src.canonical(raw, {"day": "date", "px": "close", "none": "n"}, ["close"]).collect() == [(dt.date(2020, 1, 2), 1.5, "x")]
    for code, n in (("000001", 100), ("000002", 99)):
        spark.range(n).selectExpr("timestamp'2020-01-01' + make_interval(0,0,0,0,0,cast(id*5 as int)) as ts", "1D as close").coalesce(1).toPandas().to_parquet(tmp_path / f"{code}_5m.parquet", coerce_timestamps="us")
    assert {r.code for r in src.read_intraday(spark, str(tmp_path), 5).select("code").distinct().collect()} == {"000001"}


def test_fundamental_files_and_bucketed_bars(spark, tmp_path):
    for code in ("a", "b"):
        pd.DataFrame({"date": [day(0), day(9)], "roe": [1.0, None], "note": ["x", "y"]}).to_parquet(tmp_path / f"{code}.parquet")
    assert src.read_fundamentals(spark, str(tmp_path)).columns == ["code", "date", "roe"]
    assert sorted(map(tuple, src.read_fundamentals(spark, str(tmp_path)).fillna(-1).collect())) == [("a", day(0), 1.0), ("a", day(9), -1.0), ("b", day(0), 1.0), ("b", day(9), -1.0)]
    bars = make_bars(spark, 5)
    src.write_bars(bars, "bucketed_bars", 4)
    stored = forward_target(spark.table("bucketed_bars"), 1)
    assert "Exchange" not in stored._jdf.queryExecution().executedPlan().toString()
    assert stored.count() == 10 and sorted(map(tuple, spark.table("bucketed_bars").collect())) == sorted(map(tuple, bars.collect()))
    spark.sql("DROP TABLE bucketed_bars")


def test_scratch_tables_are_deleted(spark):
    kept, other = materialise(spark.range(5)), f"{shared_dir(spark)}/panelwright-another/table"
    spark.range(3).write.parquet(other)
    assert kept.count() == 5 and clean(spark) and not clean(spark)
    assert spark.read.parquet(other).count() == 3 and materialise(spark.range(2)).count() == 2


def test_chain_against_pandas(spark):
    """Cross-section of the whole chain, computed again in pandas from the rolling part."""
    codes = tuple(f"c{k}" for k in range(12))
    bars = make_bars(spark, 140, codes)
    reports = spark.createDataFrame([(c, day(20 * k), float(k + i), 1.0, 2.0 * i, 3.0, 5.0 + i, 2.0) for i, c in enumerate(codes) for k in range(4)], f"code string, date date, {', '.join(f'{c} double' for c in src.FUNDAMENTALS)}")
    got = build_panel(bars, reports).toPandas().sort_values(["date", "code"]).reset_index(drop=True)
    pdf = code_stage(bars, reports).toPandas().sort_values(["code", "date"])
    pdf = pdf[pdf.target.notna() & (pdf.volume > 0) & (pdf.close >= 2)]
    pdf = pdf[pdf.groupby("code").cumcount() > 60].sort_values(["date", "code"]).reset_index(drop=True)
    assert len(pdf) > 700 and pdf[["code", "date"]].equals(got[["code", "date"]])
    by = pdf.groupby("date")
    for c in RANKED:
        mid = by[c].transform("median")
        mad = (pdf[c] - mid).abs().groupby(pdf.date).transform("median") * 3 * 1.4826
        rank = pdf[c].clip(mid - mad, mid + mad).groupby(pdf.date).rank(pct=True)
        assert np.allclose(got[f"cs_rank_{c}"], (rank - 0.5) * 2), c
    for c in RELATIVE:
        assert np.allclose(got[f"mkt_mean_{c}"], by[c].transform("mean")) and np.allclose(got[f"rel_{c}"], pdf[c] - by[c].transform("mean"))
    assert np.allclose(got.rank_label, by.target.rank(pct=True)) and np.allclose(got.excess_label, pdf.target - by.target.transform("mean"))
    styles = [c for c in pdf.columns if c.startswith("style_")]
    for date, part in by:
        m = part[styles].to_numpy()
        m = (m - m.mean(0)) / (m.std(0) + 1e-9)
        u, size, v = np.linalg.svd(m, full_matrices=False)
        if size[-1] > 1e-3 * size[0]:
            assert np.allclose(got.loc[got.date == date, styles], u @ v * np.sqrt(len(part)), atol=1e-5), date


def test_panel_cache(spark, tmp_path):
    first = spark.range(3).toDF("x")
    assert src.materialise_panel(first, str(tmp_path), "2024-01-01", "train").count() == 3
    assert src.materialise_panel(spark.range(9).toDF("x"), str(tmp_path), "2024-01-01", "train").count() == 3
    stored = src.materialise_panel(spark.range(9).toDF("x"), str(tmp_path), "2024-01-01", "train", refresh=True)
    assert stored.count() == 9
    assert src.materialise_panel(stored.where("x > 3"), str(tmp_path), "2024-01-01", "train", refresh=True).count() == 5  # made of what it replaces
    broken = spark.range(9).selectExpr("raise_error('no') AS x")
    with pytest.raises(Exception, match="no"):
        src.materialise_panel(broken, str(tmp_path), "2024-01-01", "train", refresh=True)
    assert src.materialise_panel(broken, str(tmp_path), "2024-01-01", "train").count() == 5


def test_random_code(spark):
    bars = make_bars(spark, 3, codes=tuple("abcdef"))
    assert src.sample_code(bars, 1).select("code").distinct().count() == 1
