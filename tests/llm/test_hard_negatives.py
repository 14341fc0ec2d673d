"""Hard negatives against SQL and plain loops."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.llm import hard_negatives as H
from panelwright.llm.queries import OP12_SQL, op12_hard_negatives

COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def plain(rows, n_positives=5, n_negatives=10, every=100):
    """Rows (id, vector, label) by the written rules."""
    one = {}
    for i, x, label in rows:
        if i is None or label is None or x is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        row = (label, [math.floor(256 * v) for v in x])
        one[i] = min(one.get(i, row), row)
    out = []
    for a, (label, q) in one.items():
        if a % every:
            continue
        score = {i: sum(p * v for p, v in zip(q, x)) for i, (_, x) in one.items()}
        best = sorted((i for i in one if i != a), key=lambda i: (-score[i], i))
        for p in [i for i in best if one[i][0] == label][:n_positives]:
            fits = [i for i in best if one[i][0] != label and 30 * score[p] <= 100 * score[i] <= 90 * score[p]]
            out += [(a, p, r + 1, i, score[p], score[i]) for r, i in enumerate(fits[:n_negatives])]
    return sorted(out)


def mined(spark, rows, every=100, **options):
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, score int, query int")
    return sorted(tuple(r) for r in H.mine(H.usable(frame, F.col("label")), F.col("vec_id") % every == 0, **options).select(*COLUMNS).collect())


def clustered(n, labels, dim, seed, spread=0.1):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(max(2, n // 20), dim))
    return [(i, (centres[rnd.integers(len(centres))] + spread * rnd.normal(size=dim)).astype(np.float32).tolist(), int(rnd.integers(labels))) for i in range(n)]


def test_query_against_sql(spark, sf):
    found = {tuple(r) for r in op12_hard_negatives(spark, sf).select(*COLUMNS).collect()}
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = {tuple(r) for r in db.execute(f"SELECT {', '.join(COLUMNS)} FROM ({OP12_SQL})").fetchall()}
    assert found == want and len(want) > 100


@pytest.mark.parametrize(("labels", "block", "leaf"), [(3, 4096, 64), (12, 3, 4)])
def test_clusters_in_blocks_and_small_boxes(spark, monkeypatch, labels, block, leaf):
    monkeypatch.setattr(H, "LEAF", leaf)
    monkeypatch.setattr(H, "PARTITION", 100)
    rows = clustered(700, labels, 6, labels)
    assert mined(spark, rows, every=10, block=block) == plain(rows, every=10)


def test_ties_copies_and_odd_rows(spark):
    rnd = random.Random(5)
    shapes = [[1.0, 0.0], [0.5, 0.25], [0.5, 0.25], [-1.0, 2.0], [0.0, 0.0]]
    rows = [(i, rnd.choice(shapes), rnd.choice([0, 1, 1, 2])) for i in range(300)]
    rows += [(400 + i, [0.5, 0.5], 0) for i in range(60)] + [(500 + i, [0.25, 0.25], 1) for i in range(60)]  # groups of copies
    rows += rows[:20]
    rows += [(900, None, 1), (901, [1.0, None], 1), (902, [float("nan"), 1.0], 1), (903, [float("inf"), 1.0], 0), (904, [1.0, 1.0], None), (None, [1.0, 1.0], 1)]
    rows += [(910, [], 1), (920, [1.0], 1), (930, [1.0, 2.0, 3.0], 2), (940, [9.0, 9.0], 7), (5, [0.1, 0.1], 9), (0, [-5.0, 1.0], 4)]
    assert mined(spark, rows, every=10) == plain(rows, every=10)


def test_no_rows_no_anchors_one_label(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 0), (2, [1.0], 1)]) == []
    assert mined(spark, [(100, [1.0], 0), (2, [1.0], 0)]) == []
    assert mined(spark, [(100, [1.0], 0), (2, [1.0], 1)]) == []
    with pytest.raises(ValueError, match="beyond"):
        mined(spark, [(100, [1e9], 0), (2, [1.0], 0)])


def test_boxes_hold_their_rows_and_intervals_their_scores():
    rnd = np.random.default_rng(2)
    x, label = rnd.integers(-50, 50, (1000, 5)).astype(np.float64), np.sort(rnd.integers(0, 3, 1000))
    tree = H.Tree.over(x, np.arange(1000), label)
    q = rnd.integers(-9, 9, (20, 5)).astype(np.float64)
    least, most = tree.intervals(q)
    scores = q @ x.T
    for b in range(tree.n_leaves):
        part = slice(tree.start[b], tree.end[b])
        assert (tree.low[b] <= x[part]).all() and (x[part] <= tree.high[b]).all() and len(set(label[part])) == 1
        assert (least[:, b] <= scores[:, part].min(axis=1)).all() and (scores[:, part].max(axis=1) <= most[:, b]).all()
    assert sorted(r for rs in tree.roots.values() for r in rs) and set(tree.roots) == {0, 1, 2} and all(len(r) == 1 for r in tree.roots.values())


def test_tight_boxes_stay_closed():
    """Of 64 far-apart clusters, the best rows of a query are found in a few leaves, and equal to a full search."""
    rnd = np.random.default_rng(4)
    x = np.repeat(rnd.integers(-1000, 1000, (64, 4)), 64, axis=0) + rnd.integers(-3, 3, (4096, 4))
    x, ids = x.astype(np.float64), np.arange(4096)
    tree = H.Tree.over(x, ids, np.zeros(4096, np.int64))
    for q in x[::500]:
        scores = x @ q
        for low, high in ((-np.inf, np.inf), (0.3 * scores.max(), 0.6 * scores.max())):
            ask = H.Ask(10, low, high)
            least, most = (v[0] for v in tree.intervals(q[None]))
            seen = H.search(tree, q, least, most, tree.roots[0], [ask])
            fits = np.flatnonzero((scores >= low) & (scores <= high))
            want = fits[np.lexsort((ids[fits], -scores[fits]))][:10]
            assert ask.ids.tolist() == want.tolist()
            assert seen <= 2 * H.AT_ONCE
