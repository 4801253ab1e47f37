"""Components, nearest neighbours and separation of labels against brute force."""

import numpy as np
import pandas as pd
import pytest

from onsetry.operators import cohort as C, embedding as E


def brute(rows, k):
    """(silhouette, purity) of (id, x, y, label) rows from all distances."""
    rows = sorted(rows)
    xy = np.array([r[1:3] for r in rows], dtype=float)
    lab = np.array([r[3] for r in rows])
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(axis=2))
    sil, pure = [], []
    for i in range(len(rows)):
        others = [j for j in np.argsort(np.round(d[i], 9), kind="stable") if j != i][:k]
        pure.append(np.mean(lab[others] == lab[i]))
        means = {g: d[i][(lab == g) & (np.arange(len(rows)) != i)] for g in set(lab)}
        if not len(means[lab[i]]):
            sil.append(0.0)
            continue
        a = means[lab[i]].mean()
        b = min(v.mean() for g, v in means.items() if g != lab[i])
        sil.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return np.mean(sil), np.mean(pure)


def cloud(kind):
    rng = np.random.default_rng(5)
    n = 300
    if kind == "clusters":
        g = rng.integers(0, 3, n)
        xy = rng.normal(size=(n, 2)) + 3 * np.column_stack([g, g % 2])
    elif kind == "lattice":  # equal distances everywhere
        g, xy = rng.integers(0, 4, n), rng.integers(0, 12, (n, 2)).astype(float)
    elif kind == "copies":  # a third of all points at one place, two far away
        g, xy = rng.integers(0, 2, n), rng.normal(size=(n, 2))
        xy[:100], xy[-2:] = [0.0, 0.0], [[1e6, 0.0], [0.0, -1e7]]
    else:  # one line, one label of a single point
        g, xy = np.where(np.arange(n) == 7, 1, 0), np.column_stack([np.zeros(n), rng.normal(size=n)])
    return [(int(i), float(a), float(b), f"g{c}") for i, ((a, b), c) in enumerate(zip(xy, g))]


@pytest.mark.parametrize("kind", ["clusters", "lattice", "copies", "line"])
@pytest.mark.parametrize("tiny", [False, True])
def test_separation_equals_all_distances(spark, kind, tiny, monkeypatch):
    if tiny:
        monkeypatch.setattr(E, "VISITORS", 5)
        monkeypatch.setattr(E, "AT_ONCE", 50)
    rows = cloud(kind)
    df = spark.createDataFrame(rows, "id long, x double, y double, g string")
    got = E.separation(df, "id", "x", "y", "g", k=5, block=40 if tiny else 4096, cell=12 if tiny else 1024).first()
    sil, pure = brute(rows, 5)
    assert (got["n"], got["n_groups"]) == (300, len({r[3] for r in rows}))
    assert got["silhouette"] == pytest.approx(sil, abs=1e-9)
    assert got["knn_purity"] == pytest.approx(pure, abs=1e-12)


def test_large_places_are_split(tiny_splits):
    rows = cloud("copies")[:120]
    df = tiny_splits.createDataFrame(rows, "id long, x double, y double, g string")
    got = E.separation(df, "id", "x", "y", "g", k=3, cell=8, block=30).first()
    assert (got["silhouette"], got["knn_purity"]) == pytest.approx(brute(rows, 3), abs=1e-9)


def test_only_near_cells_are_searched(spark, monkeypatch):
    """The distances looked at grow far more slowly than the square of the points."""
    seen = spark.sparkContext.accumulator(0)
    plain = E._distances

    def counted(ax, ay, bx, by):
        seen.add(len(ax) * len(bx))
        return plain(ax, ay, bx, by)

    monkeypatch.setattr(E, "_distances", counted)
    xy = np.random.default_rng(1).random((6000, 2))
    df = spark.createDataFrame(pd.DataFrame({"i": range(6000), "x": xy[:, 0], "y": xy[:, 1], "l": "a"}))
    assert E.nearest(df, 6, cell=32).count() == 6000
    assert 0 < seen.value < 6000 * 6000 / 20


def test_unusable_rows_and_small_tables(spark):
    schema = "id long, x double, y double, g string"
    nan = float("nan")
    rows = [(1, 0.0, 0.0, "a"), (1, 0.0, 0.0, "a"), (2, 1.0, 0.0, "a"), (3, 5.0, 0.0, "b"), (4, None, 0.0, "b"),
            (5, nan, 1.0, "a"), (6, 1.0, float("inf"), "a"), (7, 1.0, 1.0, None), (8, 1.0, 1.0, "unknown"), (None, 1.0, 1.0, "a")]
    got = E.separation(spark.createDataFrame(rows, schema), "id", "x", "y", "g").first()
    assert (got["n"], got["n_groups"]) == (3, 2)
    assert (got["silhouette"], got["knn_purity"]) == pytest.approx(brute([rows[0], rows[2], rows[3]], 5))
    for few in ([], rows[:2], rows[:3]):
        got = E.separation(spark.createDataFrame(few, schema), "id", "x", "y", "g").first()
        assert got["silhouette"] is None and got["knn_purity"] is None


def test_components_equal_a_singular_value_decomposition(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(200, 6)) * [9, 5, 1, 1, 0.5, 0.1] + 40
    bad = [[None] + [1.0] * 5, [float("nan")] * 6, [1.0] * 5, [], None]
    rows = [(i, v) for i, v in enumerate(m.tolist() + bad)]
    df = spark.createDataFrame(rows, "`a.b` long, v array<double>")
    got = E.principal_components(df, "v", 6, ["a.b"]).toPandas().sort_values("a.b")
    assert list(got["a.b"]) == list(range(200))
    centred = m - m.mean(axis=0)
    _, _, vt = np.linalg.svd(centred, full_matrices=False)
    for j in (0, 1):
        load = vt[j] * np.sign(vt[j][np.argmax(np.abs(vt[j]))])
        assert np.allclose(got[f"pc{j + 1}"], centred @ load, atol=1e-8)
    assert E.principal_components(df.where("false"), "v", 6, ["a.b"]).columns == ["a.b", "pc1", "pc2"]


def test_patient_components_of_columns(spark):
    df = spark.createDataFrame([(p, float(p), 2.0 * p + (p % 2), 1.0) for p in range(6)], "patient long, a double, b double, c double")
    got = C.pca_2d(df, ["a", "b", "c"], ["patient"]).toPandas()
    assert len(got) == 6 and abs(got["pc1"].mean()) < 1e-9 and got["pc1"].std() > got["pc2"].std()
