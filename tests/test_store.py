"""The stored panel in versions, file listings, the profile, the observed filter, the linear scorer, frames in order."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwright.functions import ordered, ts
from panelwright.operators import evaluate, linear, panel
from panelwright.sources import bars as src
from panelwright.sources.store import PanelStore, StaleVersionError

DAY = dt.date(2024, 1, 1)


def panel_rows(spark, codes, n, shift=0.0):
    return spark.createDataFrame([(f"c{k}", DAY + dt.timedelta(days=i), float(k * i) + shift) for k in range(codes) for i in range(n)], "code string, date date, close double")


def content(df):
    return sorted(map(tuple, df.select("code", "date", "close").collect()))


def test_a_refresh_writes_only_the_buckets_it_touches(spark, tmp_path):
    store = PanelStore(spark, str(tmp_path), buckets=8)
    old = panel_rows(spark, 20, 5)
    assert store.replace_all(old) == 1 and content(store.read()) == content(old)
    before = store._manifest(1)["buckets"]
    fresh = panel_rows(spark, 20, 7, 1.0).where("code = 'c3'")
    assert store.replace(fresh.select("code").distinct(), fresh) == 2
    after = store._manifest(2)["buckets"]
    assert len([k for k in after if after[k] != before.get(k)]) == 1
    assert content(store.read()) == content(old.where("code <> 'c3'").unionByName(fresh)) and content(store.read(1)) == content(old)
    assert store.replace(fresh.select("code").where("false"), fresh.where("false")) == 2
    gone = spark.createDataFrame([("c4",)], "code string")
    store.replace(gone, old.where("false"))
    assert content(store.read()) == content(old.where("code NOT IN ('c3', 'c4')").unionByName(fresh))
    assert store.vacuum() == 0 or content(store.read()) == content(old.where("code NOT IN ('c3', 'c4')").unionByName(fresh))
    assert store._versions() == [3]


def test_a_failed_write_and_a_second_writer_leave_the_panel(spark, tmp_path):
    store, old = PanelStore(spark, str(tmp_path), buckets=4), panel_rows(spark, 6, 4)
    with pytest.raises(FileNotFoundError):
        store.read()
    store.replace_all(old)
    broken = old.withColumn("close", F.expr("CASE WHEN code = 'c5' THEN raise_error('no') ELSE close END").cast("double"))
    with pytest.raises(Exception, match="no"):
        store.replace(old.select("code").distinct(), broken)
    assert store.version() == 1 and content(store.read()) == content(old)
    with pytest.raises(StaleVersionError):
        store._publish(store._manifest(1), 0)
    assert store.version() == 1 and content(store.read()) == content(old)


def test_a_refresh_equals_a_full_build(spark, tmp_path):
    bars = panel_rows(spark, 9, 40)
    build = lambda some: some.withColumn("r", ts.ts_sum(F.col("close"), 5))
    store = PanelStore(spark, str(tmp_path), buckets=4)
    store.replace_all(build(bars.where("code NOT IN ('c1', 'c7') OR (code = 'c7' AND date < '2024-01-20')")))
    store.refresh(bars.select("code"), bars, spark.createDataFrame([(DAY + dt.timedelta(days=39),)], "date date"), build)
    key = lambda df: sorted(map(tuple, df.select("code", "date", "close", F.coalesce("r", F.lit(-1.0))).collect()))
    assert key(store.read()) == key(build(bars))


def test_unfinished_codes_by_size(spark, tmp_path):
    for code, size in (("a", 2000), ("b", 1024), ("c", 1025), ("d", 0)):
        (tmp_path / f"{code}_daily.parquet").write_bytes(b"x" * size)
    (tmp_path / "e_5m.parquet").write_bytes(b"x" * 5000)
    universe = spark.createDataFrame([(c,) for c in "abcdee"], "code string")
    files = src.code_files(spark, str(tmp_path), "_daily.parquet")
    assert {r.code: r.length for r in files.collect()} == {"a": 2000, "b": 1024, "c": 1025}
    assert sorted(r.code for r in src.unfinished_codes(universe, files).collect()) == ["b", "d", "e"]
    assert "content" not in files._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]


def test_describe(spark):
    values = [float(v) for v in np.random.default_rng(1).permutation(2001)]
    df = spark.createDataFrame([(v, None if v < 5 else v * v, float("nan") if v == 7 else 1.0) for v in values], "x double, `y z` double, n double")
    got = {r["column"]: r for r in src.describe(df, ["x", "y z", "n"], accuracy=100).collect()}
    x = got["x"]
    assert (x.n, x["min"], x["max"]) == (2001, 0.0, 2000.0) and abs(x["mean"] - 1000) < 1e-9 and abs(x.sd - np.std(values, ddof=1)) < 1e-9
    for q, v in ((0.25, x.q25), (0.5, x.q50), (0.75, x.q75)):
        assert abs(v - q * 2000) <= 2001 / 100 + 1
    assert got["y z"].n == 1996 and got["n"].n == 2000 and got["n"].sd == 0
    empty = src.describe(df.where("x < 0"), ["x"]).collect()[0]
    assert (empty.n, empty["mean"], empty.q50) == (0, None, None)


def test_observed_filter_reads_once(spark):
    rows = panel_rows(spark, 3, 100).withColumn("volume", F.lit(1.0)).where("true")
    kept = panel.in_universe(min_price=10.0, min_bars=20)
    filtered, seen = panel.observed_filter(rows, kept)
    n = filtered.count()
    one = panel.filter_report(rows, kept).collect()[0]
    assert seen.get == {"n_before": 300, "n_after": n} and (one.n_before, one.n_removed) == (300, 300 - n) and 0 < n < 300
    assert n == panel.universe_filter(rows, 10.0, 20).count()
    assert panel.filter_report(rows, kept)._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") <= 1


def windows(n, seed):
    rnd = np.random.default_rng(seed)
    return [(f"c{k}", DAY, rnd.normal(size=(4, 3)).astype(np.float32).tolist(), float(rnd.normal())) for k in range(n)]


@pytest.mark.parametrize(("features", "pick"), [(linear.last_bar, lambda x: x[:, -1]), (linear.every_bar, lambda x: x.reshape(len(x), -1))])
def test_linear_scorer(spark, features, pick):
    rows = windows(200, 3)
    df = spark.createDataFrame([*rows, ("n", DAY, None, 1.0), ("m", DAY, rows[0][2], None)], "code string, end_date date, past_values array<array<float>>, label double")
    model = linear.fit_linear(df, features())
    x = pick(np.array([r[2] for r in rows], np.float64))
    want, *_ = np.linalg.lstsq(np.c_[np.ones(len(x)), x], np.array([r[3] for r in rows]), rcond=None)
    assert np.allclose([model.intercept, *model.weights], want, atol=1e-8)
    scores = {r.code: r.score for r in model.score(df, features()).collect()}
    assert scores["n"] is None and all(abs(scores[r[0]] - (want[0] + x[k] @ want[1:])) < 1e-8 for k, r in enumerate(rows))
    assert "Python" not in model.score(df, features())._jdf.queryExecution().executedPlan().toString()


def test_positions_and_halos(spark):
    values = np.random.default_rng(5).permutation(1000).tolist()
    df = spark.createDataFrame([(v,) for v in values], "k long").repartition(7)
    placed = ordered.with_position(df, ["k"])
    assert all(r["_at"] == r.k for r in placed.collect())
    for block, n in ((10, 10), (64, 7), (3, 8)):
        own = ordered.with_halo(placed, n, block=block)
        sums = own.withColumn("s", F.sum("k").over(ordered.halo_window().rowsBetween(1 - n, 0))).where("_own")
        assert {r.k: r.s for r in sums.collect()} == {k: sum(range(max(0, k - n + 1), k + 1)) for k in range(1000)}, (block, n)


def test_screen_over_the_frame_as_given(spark):
    rnd = np.random.default_rng(6)
    pdf = pd.DataFrame({"code": [f"c{k // 50}" for k in range(400)], "date": [DAY + dt.timedelta(days=k % 50) for k in range(400)], "f": rnd.normal(size=400), "target": rnd.normal(size=400)})
    pdf.loc[rnd.choice(400, 9), "f"] = np.nan
    df = spark.createDataFrame(pdf).replace(float("nan"), None)
    got = evaluate.factor_screen(df, ["f"], n=20, order=("code", "date"), block=33).collect()[0]
    want = pdf.f.rolling(20).corr(pdf.target)
    assert abs(got.ic - want.mean()) < 1e-9 and abs(got.ir - want.mean() / (want.std() + 1e-9)) < 1e-9
