"""Moving values in tasks: batches that cut codes, values of values, exponential means, labels after a close of 0, files a code, exact quartiles."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwright.functions import ts
from panelwright.functions.scalar import rounded
from panelwright.operators import labels, normalize, samples
from panelwright.operators.factors import with_factors
from panelwright.sources import bars as src

DAY = dt.date(2020, 1, 1)


@pytest.fixture(scope="module")
def bars(spark):
    rnd = np.random.default_rng(5)
    rows = []
    for code, n in (("a", 150), ("b", 40), ("c", 2)):
        close = np.exp(rnd.normal(size=n).cumsum() / 10)
        rows += [(code, DAY + dt.timedelta(days=k), float(c), float(c * 1.1), float(c * 0.9), float(c), float(rnd.integers(1, 99))) for k, c in enumerate(close)]
    return spark.createDataFrame(rows, "code string, date date, open double, high double, low double, close double, volume double")


@pytest.fixture()
def tiny_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, "7")
    yield
    spark.conf.set(key, old)


def test_batches_that_cut_codes(spark, bars, tiny_batches):
    R = ts.Rolling
    columns = {"rank": R("rank", 5, "close"), "of": R("std", 6, "rank"), "ewm": R("ewm", 1, "close", alpha=0.3), "adj": R("ewm", 1, "close", alpha=0.3, adjust=True), "decay": R("decay", 4, "close")}
    got = ts.with_rolling(bars, columns).toPandas().sort_values(["code", "date"]).reset_index(drop=True)
    groups = got.groupby("code").close
    want = {
        "rank": groups.transform(lambda s: s.rolling(5).apply(lambda v: ((v[:-1] < v[-1]).sum() + (v[:-1] == v[-1]).sum() / 2) / 4, raw=True)),
        "ewm": groups.transform(lambda s: s.ewm(alpha=0.3, adjust=False).mean()),
        "adj": groups.transform(lambda s: s.ewm(alpha=0.3).mean()),
        "decay": groups.transform(lambda s: s.rolling(4).apply(lambda v: (v * [1, 2, 3, 4]).sum() / 10, raw=True)),
    }
    want["of"] = want["rank"].groupby(got.code).transform(lambda s: s.rolling(6).std())
    for c, w in want.items():
        assert np.allclose(got[c].astype(float), w.astype(float), rtol=1e-9, atol=1e-12, equal_nan=True), c


def test_normalised_and_sampled_alike_in_any_batches(spark, bars, tiny_batches):
    def both():
        frame = normalize.normalize(with_factors(bars), ordered=True).orderBy("code", "date").toPandas()
        found = samples.training_windows(bars.withColumn("target", F.col("close")), ["close", "volume"]).orderBy("code", "start_date").collect()
        return frame, found

    small = both()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    large = both()
    assert small[1] == large[1] and len(large[1]) == 25 + 3
    pd.testing.assert_frame_equal(small[0], large[0], rtol=1e-9, atol=1e-9)


def test_no_moving_frames_are_left(bars):
    plan = with_factors(bars)._jdf.queryExecution().optimizedPlan().toString()
    assert "currentrow" not in plan and plan.count("MapInArrow") == 2


def test_label_after_a_close_of_0(spark):
    rows = [("a", DAY + dt.timedelta(days=k), c) for k, c in enumerate([0.0, 2.0, 0.0, 4.0])]
    df = spark.createDataFrame(rows, "code string, date date, close double")
    got = [r.t for r in labels.simple_target(df, 1).orderBy("date").select(rounded(F.col("target")).alias("t")).collect()]
    assert got[:3] == [float("inf"), -1.0, float("inf")] and got[3] is None


def test_quartiles_are_exact(spark):
    values = np.random.default_rng(3).permutation(10_001).astype(float)
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    got = src.describe(df, ["x"], accuracy=100).collect()[0]
    assert (got.q25, got.q50, got.q75) == (2500.0, 5000.0, 7500.0)


def test_files_by_tasks(spark, bars, tiny_batches, tmp_path):
    path = str(tmp_path / "codes")
    src.write_code_files(bars.withColumn("code", F.when(F.col("code") == "a", "a/1").otherwise(F.col("code"))), path)
    names = sorted(p.name for p in (tmp_path / "codes").iterdir() if p.suffix == ".parquet")
    assert names == ["a%2F1.parquet", "b.parquet", "c.parquet"]
    assert spark.read.parquet(path).count() == 192
