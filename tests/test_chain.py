"""The panel in one pass by code and one by date: against the steps one by one, in any batches, with nothing written between."""

import datetime as dt
import os
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwright.operators.calendar import fill_gaps
from panelwright.operators.factors import with_factors
from panelwright.operators.labels import date_labels, forward_target
from panelwright.operators.normalize import cross_ranks, market_relative, normalize, orthogonalize
from panelwright.operators.panel import asof_fundamentals, dense_fundamentals, feature_table, fill_fundamentals, universe_filter
from panelwright.plans.panel_chain import build_panel, code_stage
from panelwright.sources import bars as src
from panelwright.sources.scratch import session_dir

DAY = dt.date(2020, 1, 1)
CODES = ("a", "b", "c", "d", "e")


@pytest.fixture(scope="module")
def bars(spark):
    """Bars with gaps, a flat code, prices under the floor and codes too short for a panel."""
    rng, rows = random.Random(3), []
    for code, n in zip((*CODES, "short", "one"), (300, 260, 200, 230, 150, 4, 1), strict=True):
        p, day = 30.0, rng.randrange(9)
        for _ in range(n):
            o, c = p * rng.uniform(0.9, 1.1), p * rng.uniform(0.9, 1.1)
            o, c = (5.0, 5.0) if code == "e" else (o, c)
            rows.append((code, DAY + dt.timedelta(days=day), o, max(o, c) * 1.01, min(o, c) * 0.99, c, float(rng.randrange(0, 99))))
            p, day = c if 1 < c < 90 else 30.0, day + rng.choice((1, 1, 1, 2, 6))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "code string, date date, open double, high double, low double, close double, volume double").repartition(5).cache()


@pytest.fixture(scope="module")
def reports(spark):
    rows = [(c, DAY + dt.timedelta(days=70 * k - 300), float(k + i), None if k == 5 else 0.1 * k, 2.0 * i, 3.0, 5.0 * (k % 3), 2.0) for i, c in enumerate((*CODES, "none")) for k in range(14)]
    return spark.createDataFrame(rows, f"code string, date date, {', '.join(f'{c} double' for c in src.FUNDAMENTALS)}").cache()


@pytest.fixture()
def tiny_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, "3")
    yield
    spark.conf.set(key, old)


def step_by_step(bars, reports, mode):
    """The chain by its operators, each by Spark's own means."""
    panel = normalize(with_factors(fill_fundamentals(asof_fundamentals(bars, reports))))
    panel = panel.join(forward_target(bars).select("code", "date", "target"), ["code", "date"])
    panel = universe_filter(panel if mode == "predict" else panel.where(F.col("target").isNotNull()))
    return date_labels(orthogonalize(market_relative(cross_ranks(panel)).localCheckpoint()))


def same(got, want):
    assert sorted(got.columns) == sorted(want.columns)
    got, want = (df.toPandas().sort_values(["code", "date"]).reset_index(drop=True) for df in (got, want))
    pd.testing.assert_frame_equal(got[want.columns], want, rtol=1e-7, atol=1e-7)
    return got


@pytest.mark.parametrize("mode", ["train", "predict"])
def test_steps_one_by_one(bars, reports, mode):
    dense = fill_gaps(bars).localCheckpoint()
    got = same(build_panel(dense, reports, mode), step_by_step(dense, reports, mode))
    assert len(got) > 300 and got.target.isna().any() == (mode == "predict")
    same(code_stage(dense, reports), normalize(with_factors(fill_fundamentals(asof_fundamentals(forward_target(dense), reports)))))


def test_batches_and_fill_in_the_chain(bars, reports, tiny_batches):
    small = build_panel(bars, reports, fill=True, narrow=True).localCheckpoint()
    bars.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    wide = build_panel(fill_gaps(bars), reports)
    same(small, feature_table(wide))
    assert small.dtypes == feature_table(wide).dtypes and small.columns == wide.columns


def test_reports_before_gaps_are_filled(spark, bars, reports):
    more = [("a", None, 1.0, 1.0, 1.0, 1.0, 1.0), (None, DAY, 1.0, 1.0, 1.0, 1.0, 1.0)]  # no day, no code
    holes = bars.withColumns({"close": F.when(F.col("volume") % 7 > 0, F.col("close")), "volume": F.when(F.col("volume") % 5 > 0, F.col("volume"))}).union(spark.createDataFrame(more, bars.schema))
    twice = holes.union(holes.where("code = 'b' AND volume > 90"))  # days with two bars
    for frame in (bars, holes, twice):
        got, want = dense_fundamentals(frame, reports), asof_fundamentals(fill_gaps(frame), reports)
        assert got.columns == want.columns
        key = lambda r: tuple((x is not None, x) for x in r)
        rows = [tuple(r) for r in got.collect()]
        assert rows and [r[:2] for r in rows if r[0] == "a"] == sorted(r[:2] for r in rows if r[0] == "a")
        if frame is not twice:  # which of two bars of a day comes last is open
            assert sorted(rows, key=key) == sorted((tuple(r) for r in want.collect()), key=key)
        else:
            assert len(rows) == want.count()


def test_nothing_is_written_and_rows_are_dealt_once(spark, bars, reports):
    folder = session_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    panel = build_panel(bars, reports, fill=True, narrow=True)
    plan = panel._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(date") == 1
    assert plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan  # by code, and what stays by date
    assert panel.count() and (set(os.listdir(folder)) if os.path.isdir(folder) else set()) == before


def test_dates_of_few_codes(bars, reports):
    out = build_panel(bars.where("code = 'a'"), reports).toPandas()
    styles = [c for c in out.columns if c.startswith("style_")]
    assert len(out) and np.allclose(out[styles], 0) and (out.rank_label == 1).all() and np.allclose(out.excess_label, 0)
