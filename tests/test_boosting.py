"""Histogram boosting against brute force: cuts, splits, leaf-wise growth, early stopping, folds side by side."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from onsetry.operators import boosting as B
from onsetry.operators import modelling as M


def brute_split(x, g, h, min_leaf, l2):
    best = (-np.inf, None, None)
    for j in range(x.shape[1]):
        for cut in B.cuts_of(x[:, j]):
            a = x[:, j] <= cut
            if min(a.sum(), (~a).sum()) < min_leaf or min(h[a].sum(), h[~a].sum()) < B.MIN_HESSIAN:
                continue
            gain = sum(g[s].sum() ** 2 / (h[s].sum() + l2) for s in (a, ~a)) - g.sum() ** 2 / (h.sum() + l2)
            if gain > best[0] + 1e-9:
                best = (gain, j, cut)
    return best


@pytest.mark.parametrize("seed", range(6))
def test_split_is_the_best_of_all(seed):
    r = np.random.default_rng(seed)
    x = r.integers(0, 12, (80, 5)).astype(float)
    g, h = r.normal(size=80), r.random(80)
    cuts = [B.cuts_of(x[:, j]) for j in range(5)]
    codes = np.stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(cuts)], 1)
    tree = B._Tree(codes, 12, g, h, np.arange(80), B.Growth(leaves=2, min_leaf=5, l2=0.3))
    gain, column, cut = brute_split(x, g, h, 5, 0.3)
    assert tree.nodes[0][0] == column and cuts[column][tree.nodes[0][1]] == cut
    assert B.best_split(tree._sums(np.arange(80)), 5, 0.3)[0] == pytest.approx(gain)


def test_the_leaf_of_largest_gain_grows_first():
    r = np.random.default_rng(0)
    x, g, h = r.random((300, 4)), r.normal(size=300), r.random(300) + 0.1
    cuts = [B.cuts_of(x[:, j], 40) for j in range(4)]
    codes = np.stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(cuts)], 1)
    grown = B._Tree(codes, 40, g, h, np.arange(300), B.Growth(leaves=8, min_leaf=10))
    leaves = [np.arange(300)]
    for _ in range(7):  # plain best-first growth
        options = [(B.best_split(grown._sums(rows), 10, 0.0), i) for i, rows in enumerate(leaves) if len(rows) >= 20]
        (gain, column, cut), i = max(options, key=lambda o: o[0][0])
        rows = leaves.pop(i)
        goes = codes[rows, column] <= cut
        leaves += [rows[goes], rows[~goes]]
    got = sorted(tuple(n[4]) for n in grown.nodes if n[2] < 0)
    assert got == sorted(tuple(rows) for rows in leaves)


def test_cuts_are_quantiles():
    assert B.cuts_of(np.array([1.0, 1, 2, 4])).tolist() == [1.5, 3.0]
    assert len(B.cuts_of(np.random.default_rng(1).random(10_000))) == B.BINS - 1
    assert B.cuts_of(np.ones(4)).tolist() == []


def test_learning_and_early_stopping():
    r = np.random.default_rng(2)
    x = r.normal(size=(2000, 6))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (r.random(2000) < 0.05)).astype(float)
    watched = np.arange(2000) % 4 == 0
    how = B.Growth(leaves=15, rounds=400, learning_rate=0.1, patience=20)
    model = B.boost(x, y, np.ones(2000), how, 1, watched)
    new = r.normal(size=(1000, 6))
    assert ((model.raw(new) > 0) == (new[:, 0] * new[:, 1] > 0)).mean() > 0.9
    assert 0 < len(model.roots) < 400
    whole = B.boost(x, y, np.ones(2000), B.Growth(leaves=15, rounds=60, learning_rate=0.1), 1)
    assert len(whole.roots) == 60
    l2 = B.boost(x, y, np.ones(2000), B.Growth(leaves=15, rounds=60, learning_rate=0.1, l2=50.0), 1)
    assert np.abs(l2.raw(new)).mean() < np.abs(whole.raw(new)).mean()


def test_degenerate_tables():
    for x, y in ((np.ones((5, 2)), np.array([0, 1, 0, 1, 1.0])), (np.random.default_rng(0).random((5, 2)), np.ones(5))):
        model = B.boost(x, y, np.ones(5), B.Growth(rounds=3, min_leaf=1), 0)
        assert np.isfinite(model.raw(x)).all()


def table(spark, n=240):
    r = np.random.default_rng(5)
    rows = [(f"p{i % 4}", f"s{i % 8}", i, int(i % 3 == 0), float(r.normal() + (i % 3 == 0)), float(r.normal()) if i % 7 else None, float(r.random())) for i in range(n)]
    return spark.createDataFrame(rows, "patient string, seizure_id string, node_index int, is_soz int, a double, b double, c double")


def test_folds_side_by_side_equal_fits_one_by_one(spark):
    df = table(spark).withColumn("fold", F.substring("patient", 2, 1).cast("int") + 1).cache()
    exp = M.Experiment("t", leaves=6, rounds=12, min_leaf=5, learning_rate=0.3, patience=0)
    cols, group = ["a", "b", "c"], ["patient", "seizure_id"]
    together = M.fit_all(df, cols, exp, 4, group, calibrate=0.5)
    scores = {r.node_index: r.y_score for r in M.score(df, together).collect()}
    assert sorted(together) == [1, 2, 3, 4] and len(scores) == 240
    for f in (1, 3):
        alone = M.fit(df.where(F.col("fold") != f), cols, exp, group, calibrate=0.5)
        assert alone.delta == together[f].delta
        for r in M.score(df.where(F.col("fold") == f).withColumn("fold", F.lit(1)), {1: alone}).collect():
            assert scores[r.node_index] == pytest.approx(r.y_score, abs=1e-12)


def test_the_fit_is_bounded_and_scoring_is_not(spark):
    df = table(spark, 600)
    part = B.bounded_rows(df, ["node_index", "a"], 200)
    assert 120 < part.count() < 280 and B.bounded_rows(df, ["node_index"], 600).count() == 600
    empty = M.leave_one_out_predictions(df.limit(0), ["a", "b", "c"], M.Experiment("t", rounds=2), ["patient", "seizure_id"])
    assert empty.count() == 0


def test_l1_choice_agrees_with_the_plain_solver(spark):
    """Spark's solution against accelerated proximal steps on the same problem."""
    r = np.random.default_rng(3)
    x = r.normal(size=(300, 6)) * [1, 1, 1, 1, 1, 3]
    y = (x[:, 0] - 0.7 * x[:, 3] + 0.3 * r.normal(size=300) > 0.4).astype(int)
    cols = [f"f{i}" for i in range(6)]
    df = spark.createDataFrame([(*map(float, row), int(t)) for row, t in zip(x, y)], ", ".join(f"{c} double" for c in cols) + ", is_soz int")
    for c in (0.02, 0.05, 0.2):
        b = B.l1_weights(x, y.astype(float), B.balanced(y), c)
        assert M.l1_features(df, cols, C=c) == [n for n, v in zip(cols, b) if abs(v) > 1e-6]
        # the solution's own optimality: no gradient beyond the penalty
        p = lambda b, b0: 1 / (1 + np.exp(-x @ b - b0))
        w = B.balanced(y)
        b0 = min(np.linspace(-5, 5, 4001), key=lambda k: abs((w * (p(b, k) - y)).sum()))
        slope = x.T @ (w * (p(b, b0) - y)) * c
        assert (np.abs(slope) <= 1 + 2e-2).all() and np.allclose(slope[b != 0], -np.sign(b[b != 0]), atol=2e-2)
