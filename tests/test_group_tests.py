"""Group statistics against enumeration: permutation draws, exact U distribution, pairwise tests in one pass."""

import math
from collections import Counter
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from onsetry.operators import cohort as C, permutation as P


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 1000])
def test_every_draw_is_a_permutation_and_places_need_no_neighbours(n):
    draws = np.arange(50)
    whole = P.shuffled(np.arange(n), draws, n, 3)
    assert all(sorted(row) == list(range(n)) for row in whole.tolist())
    part = P.shuffled(np.arange(n)[n // 2 :], draws[10:20], n, 3)
    assert (part == whole[10:20, n // 2 :]).all()


def test_all_orders_are_about_equally_frequent():
    many = Counter(map(tuple, P.shuffled(np.arange(4), np.arange(24_000), 4, 1).tolist()))
    assert len(many) == 24
    chi2 = sum((c - 1000) ** 2 / 1000 for c in many.values())
    assert chi2 < 60  # 23 degrees of freedom; 60 is beyond the 1 in 20,000 tail


@pytest.fixture()
def small_chunks(monkeypatch):
    monkeypatch.setattr(P, "CHUNK_ROWS", 3)
    monkeypatch.setattr(P, "BLOCK_DRAWS", 7)


VALUES = [3.0, 3.0, 8.5, -1.0, 4.0, 9.0, 2.5, 7.0, 7.0, 1.0, 6.0]
GROUPS = ["a", "b", "a", "b", "a", "a", "b", "a", "a", "b", "b"]


@pytest.mark.parametrize("statistic", ["group_variance", "mean_difference", "median_difference"])
def test_draws_against_plain_python(spark, small_chunks, statistic):
    rows = [(i, g, v) for i, (g, v) in enumerate(zip(GROUPS, VALUES))] + [(90, None, 1.0), (91, "a", None)]
    df = spark.createDataFrame(rows, "id long, g string, v double").repartition(3)

    def stat(a, b):
        if statistic == "median_difference":
            return abs(np.median(a) - np.median(b))
        if statistic == "mean_difference":
            return abs(np.mean(a) - np.mean(b))
        m = np.mean([*a, *b])
        return (len(a) * (np.mean(a) - m) ** 2 + len(b) * (np.mean(b) - m) ** 2) / 11

    v = np.array(sorted(VALUES))
    place = P.shuffled(np.arange(11), np.arange(500), 11, 5)
    draws = [stat(v[row < 6], v[row >= 6]) for row in place]
    v, in_a = np.array(VALUES), np.array(GROUPS) == "a"
    observed = stat(v[in_a], v[~in_a])
    got = P.permutation_test(df, "id", "g", "v", 500, 5, statistic).first()
    assert got.observed == pytest.approx(observed) and got.n_perm == 500
    assert got.p == pytest.approx((sum(s >= observed - 1e-9 for s in draws) + 1) / 501)
    # and near the share among all 462 relabellings
    every = [stat(v[list(c)], v[[i for i in range(11) if i not in c]]) for c in combinations(range(11), 6)]
    share = sum(s >= observed - 1e-9 for s in every) / len(every)
    assert abs(got.p - share) < 5 * math.sqrt(share * (1 - share) / 500) + 1 / 500


def test_no_rows_and_one_group(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (2, "a", 3.0)], "id long, g string, v double")
    assert P.permutation_test(df.limit(0), "id", "g", "v", 10, 1).count() == 0
    assert P.permutation_test(df, "id", "g", "v", 10, 1).first().p == 1.0


@pytest.mark.parametrize("n1,n2", [(1, 1), (2, 3), (3, 4), (5, 5)])
def test_exact_distribution_of_u_is_the_enumeration(n1, n2):
    us = [sum(c) - n1 * (n1 - 1) // 2 for c in combinations(range(n1 + n2), n1)]
    want = [sum(x >= u for x in us) / len(us) for u in range(n1 * n2 + 1)]
    assert C.u_tail(n1, n2) == pytest.approx(want)


def test_pairs_in_one_pass_equal_each_pair_alone(spark):
    rng = np.random.default_rng(4)
    rows = [(str(rng.choice(list("abcd"))), float(np.round(rng.normal(), 1))) for _ in range(200)]
    rows += [("e", 1.5), ("f", None), (None, 2.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {(r.ga, r.gb): r for r in C.pairwise_mann_whitney(df, "g", "v").collect()}
    assert set(got) == set(combinations("abcdef", 2))
    for (a, b), r in got.items():
        want = C.mann_whitney(df, [], "g", "v", a, b).first()
        for c in ("n1", "n2", "u", "z"):
            assert getattr(r, c) == pytest.approx(getattr(want, c)) if getattr(want, c) is not None else getattr(r, c) is None
    plan = C.pairwise_mann_whitney(df, "g", "v")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_p_values_exact_without_ties_and_normal_with(spark):
    x, y = [1.0, 4.0, 6.0], [2.0, 3.0, 7.0, 8.0]
    df = spark.createDataFrame([("x", v) for v in x] + [("y", v) for v in y] + [("t", v) for v in [1.0, 1.0, 9.0]], "g string, v double")
    got = {(r.ga, r.gb): r for r in C.pairwise_p_values(df, "g", "v").collect()}
    both = sorted(x + y)
    u = lambda a, b: sum((i > j) + (i == j) / 2 for i in a for j in b)
    top = max(u(x, y), u(y, x))
    every = [u(c, [v for v in both if v not in c]) for c in combinations(both, 3)]
    assert got["x", "y"].p == pytest.approx(min(1.0, 2 * sum(e >= top for e in every) / len(every)))
    assert got["t", "x"].p == pytest.approx(math.erfc(got["t", "x"].z / math.sqrt(2)) if got["t", "x"].z > 0 else 1.0)


def test_work_is_dealt_by_cells_and_counts_are_made_once(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], float(i)) for i in range(5000)], "id long, g string, v double")
    packed = P._packed(df, "id", "v")
    draws = P._by_draw(packed, [2500, 2500], 1000, 3, weigh=True)
    # two packed chunks are a few KB; five million cells must not end in one task
    assert draws.rdd.getNumPartitions() == 5
    plan = P._medians(packed, [2500, 2500], 1000, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 2
