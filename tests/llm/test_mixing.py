import random

import numpy as np
import pytest
from helpers import alnum_words, frame

from panelwright.llm.mixing import calibrate, mix, rake, sample_mix
from panelwright.llm.queries import op10_mixing


def test_rake_meets_the_marginals():
    rng = np.random.default_rng(1)
    cells = np.array([(i, j, k) for i in range(4) for j in range(3) for k in range(5) if (i + j + k) % 4])
    observed = rng.integers(1, 1000, len(cells)).astype(float)
    targets = [rng.random(n) + 0.1 for n in (4, 3, 5)]
    fitted, miss = rake(cells, observed, targets)
    assert miss <= 1e-9
    for m, target in enumerate(targets):
        assert np.allclose(np.bincount(cells[:, m], fitted), target / target.sum() * observed.sum(), rtol=1e-6)


def test_rake_tells_of_margins_that_contradict_each_other():
    cells = np.array([(0, 0), (1, 1)])
    fitted, miss = rake(cells, np.array([10.0, 10.0]), [np.array([0.9, 0.1]), np.array([0.5, 0.5])])
    assert miss > 0.3


def test_calibrate_meets_the_budget():
    tokens, weight = np.array([10.0, 100.0, 50.0, 5.0]), np.array([9.0, 1.0, 0.5, 0.0])
    for budget in (1, 40, 100, 159):
        p = calibrate(tokens, weight, budget)
        assert (p <= 1).all() and p[3] == 0 and np.isclose((p * tokens).sum(), budget)
        free = p < 1
        assert len(set(np.round(p[free & (weight > 0)] / weight[free & (weight > 0)], 9))) <= 1
    assert calibrate(tokens, weight, 1000).tolist() == [1, 1, 1, 0]


def sample():
    rng = random.Random(6)
    return [(k, " ".join(f"w{rng.randrange(200)}" for _ in range(rng.randrange(1, 80))), f"s{min(k % 7, 3)}", rng.choice(["en", "de"])) for k in range(2000)]


def test_sample_follows_the_targets(spark):
    rows = sample()
    targets = {"source": {"s0": 1, "s1": 1, "s2": 1, "s3": 1}, "lang": {"en": 3, "de": 1}}
    got = mix(frame(spark, rows), targets, budget_share=0.2).collect()
    assert len(got) == len(rows)
    assert all(r.n_tokens == len(alnum_words(dict((d, t) for d, t, *_ in rows)[r.doc_id])) for r in got[:50])
    total = sum(r.n_tokens for r in got)
    assert abs(sum(r.n_tokens * r.probability for r in got) - 0.2 * total) < 1e-6 * total
    kept = [r for r in got if r.kept]
    tokens = sum(r.n_tokens for r in kept)
    assert abs(tokens / total - 0.2) < 0.03
    assert abs(sum(r.n_tokens for r in kept if r.lang == "en") / tokens - 0.75) < 0.06
    for s in ("s0", "s1", "s2", "s3"):
        assert abs(sum(r.n_tokens for r in kept if r.source == s) / tokens - 0.25) < 0.07


def test_edge_rows(spark):
    rows = [(1, None, "a", "en"), (2, "", "a", "en"), (None, "some words", None, None), (3, "x y z", "b", None), (3, "x y z", "b", None), (4, "w " * 100_000, "a", "en")]
    docs = frame(spark, rows, "weight string, topic string, n_tokens string, kept string")
    got = mix(docs, budget_share=1.0).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.kept) for r in got) == [(0, 2, True), (1, 0, False), (2, 0, False), (3, 3, True), (3, 3, True), (4, 100_000, True)]
    assert len(sample_mix(docs, budget_share=1.0).collect()) == 4
    assert mix(docs.limit(0)).collect() == []
    with pytest.raises(ValueError, match="cells"):
        mix(docs, max_cells=1)


def test_query_against_plain_fitting(spark, sf):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op10_mixing(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    cells = {}
    for r in got:
        assert (r.n_tokens, r.source, r.lang) == (len(alnum_words(docs[r.doc_id].text)), docs[r.doc_id].source or "", docs[r.doc_id].lang or "")
        if r.n_tokens:
            cells[r.source, r.lang, r.topic] = cells.get((r.source, r.lang, r.topic), 0) + r.n_tokens
    total, fit = sum(cells.values()), dict(cells)
    have = [{} for _ in range(3)]
    for c, n in cells.items():
        for m in range(3):
            have[m][c[m]] = have[m].get(c[m], 0) + n
    for _ in range(2000):
        for m in range(3):
            want = {v: n**0.5 for v, n in have[m].items()}
            now = {v: sum(x for c, x in fit.items() if c[m] == v) for v in want}
            fit = {c: x * want[c[m]] / sum(want.values()) * total / now[c[m]] for c, x in fit.items()}
    full = [r for r in got if r.n_tokens]
    assert all(abs(r.weight - fit[r.source, r.lang, r.topic] / cells[r.source, r.lang, r.topic]) < 1e-6 * r.weight for r in full)
    assert abs(sum(r.n_tokens * r.probability for r in full) - 0.5 * total) < 1e-6 * total
    free = {round(r.probability / r.weight, 9) for r in full if r.probability < 1}
    assert len(free) == 1 and all(r.weight * max(free) >= 1 - 1e-9 for r in full if r.probability == 1)
    kept = sum(r.n_tokens for r in got if r.kept)
    spread = sum(r.n_tokens**2 * r.probability * (1 - r.probability) for r in full) ** 0.5
    assert abs(kept - 0.5 * total) < 5 * spread and not any(r.kept for r in got if not r.n_tokens)
