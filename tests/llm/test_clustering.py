"""Centroid clustering against a plain restatement, and on awkward tables."""

import hashlib
import math
import random

import numpy as np

from onsetry.llm.clustering import LIMIT, cluster_vectors, nearest, occurring


def brute(rows, k, rounds, dims, scale=256, salt="2:"):
    kept = [(i, [max(-LIMIT, min(LIMIT, math.floor(scale * x))) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    seeds = sorted((hashlib.sha256(f"{salt}{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centroids = [v for _, v in seeds]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    label = lambda v: min(range(len(centroids)), key=lambda c: (far(v, centroids[c]), c))
    for _ in range(rounds):
        held = {}
        for _, v in kept:
            held.setdefault(label(v), []).append(v)
        centroids = [[sum(x) // len(held[c]) for x in zip(*held[c])] if c in held else m for c, m in enumerate(centroids)]
    return sorted(((i, label(v), far(v, centroids[label(v)])) for i, v in kept), key=str), centroids


def test_tables_give_exact_distances():
    r = np.random.default_rng(0)
    for high in (3, 300, 1 << 20, LIMIT):
        v, c = r.integers(-high, high + 1, (500, 7)), r.integers(-high, high + 1, (9, 7))
        want = ((v[:, None, :] - c[None]) ** 2).sum(2)
        label, distance = nearest(v, c)
        assert (label == want.argmin(1)).all() and (distance == want.min(1)).all()
        known, code = occurring(v[:, 0])
        assert (known[code] == v[:, 0]).all() and (np.unique(v[:, 0]) == known).all()
    assert nearest(np.array([[0], [5]]), np.array([[1], [-1], [1]]))[0].tolist() == [0, 0]  # ties: smaller number


def test_awkward_rows(spark):
    r = random.Random(3)
    point = lambda: [r.choice([-1, 0, 1]) * r.random() for _ in range(4)]
    rows = [(i, point()) for i in range(60)] + [(5, [0.1] * 4), (5, [0.1] * 4), (None, point()), (None, point())]
    rows += [(900, None), (901, []), (902, [1.0] * 3), (903, [1.0, None, 0.0, 0.0]), (904, [math.nan] * 4), (905, [math.inf, 0.0, 0.0, 0.0])]
    rows += [(906, [1e300, -1e300, 0.0, 0.5])]
    extra = [(i, v, f"c{n}", "mine", n, "x") for n, (i, v) in enumerate(rows)]
    df = spark.createDataFrame(extra, "vec_id long, embedding array<double>, cluster string, `a.b` string, _v int, Distance string")
    out = cluster_vectors(df.repartition(5), k=6, rounds=3, dims=4)
    assert {"a.b", "_v"} < set(out.columns) and "Distance" not in out.columns and dict(out.dtypes)["cluster"] == "int"
    got = out.collect()
    want, centroids = brute(rows, 6, 3, 4)
    assert sorted(((x["vec_id"], x["cluster"], x["distance"]) for x in got), key=str) == want
    for x in got:
        assert x["centroid"] == centroids[x["cluster"]] and x["a.b"] == "mine"
        assert x["centroid_sha256"] == hashlib.sha256(",".join(map(str, x["centroid"])).encode()).hexdigest()
        assert x["cluster_inertia"] == sum(d for _, c, d in want if c == x["cluster"])
        assert x["inertia"] == sum(d for _, _, d in want)


def test_empty_and_few(spark):
    schema = "vec_id long, embedding array<float>"
    names = ["cluster", "distance", "cluster_inertia", "inertia", "centroid", "centroid_sha256"]
    for rows in ([], [(1, None)], [(None, [0.5, 0.5])]):
        out = cluster_vectors(spark.createDataFrame(rows, schema), dims=2)
        assert out.columns == ["vec_id", "embedding", *names] and out.count() == 0
    out = cluster_vectors(spark.createDataFrame([(1, [0.5, 0.5]), (2, [0.0, 0.0])], schema), dims=2).collect()
    assert sorted(x["distance"] for x in out) == [0, 0] and len({x["cluster"] for x in out}) == 2
