"""The model queries take the published configuration, all features, and a bounded number of fits."""

import numpy as np
from conftest import SF

from onsetry.operators import boosting as B
from onsetry.operators import modelling as M
from onsetry.plans import q_modelling as Q


def test_published_configuration_and_all_features(spark):
    assert (Q.EXP.rounds, Q.EXP.leaves) == (800, 63)
    columns = set(Q._all_features(spark, SF).columns)
    assert columns == {*Q.ALL, *Q.GROUP, "node_index", "is_soz", "is_flat_zero"} and len(Q.ALL) == 68


def test_many_patients_share_folds(spark):
    rng = np.random.default_rng(1)
    rows = [(f"p{i % 8}", "s", i, int(i % 16 < 8), float(rng.normal() + (i % 16 < 8) * 2)) for i in range(160)]
    df = spark.createDataFrame(rows, "patient string, seizure_id string, node_index int, is_soz int, a double")
    exp = M.Experiment("t", leaves=2, rounds=1, min_leaf=2, learning_rate=0.3)
    got = M.leave_one_out_predictions(df, ["a"], exp, ["patient", "seizure_id"], max_fits=3).collect()
    assert len(got) == len({r.node_index for r in got}) == 160
    assert len({r.fold for r in got}) <= 3 and len({(r.patient, r.fold) for r in got}) == 8


def test_every_row_is_fitted(spark, monkeypatch):
    seen, real = [], M.fit_folds
    monkeypatch.setattr(M, "fit_folds", lambda rows, *a, **k: (seen.append(rows.count()), real(rows, *a, **k))[1])
    df = spark.range(20_400).selectExpr("concat('p', id % 3) patient", "'s' seizure_id", "cast(id as int) node_index", "cast(id % 2 as int) is_soz", "rand(1) + id % 2 a")
    exp = M.Experiment("t", leaves=2, rounds=1, min_leaf=2)
    assert M.fit(df, ["a"], exp, ["patient", "seizure_id"]).rounds == 1 and seen == [20_400]


def test_slices_of_rows_change_no_model(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(f"p{i % 5}" if i % 31 else None, f"s{i % 10}", i, int(i % 3 == 0), float(rng.normal() + (i % 3 == 0)), float(rng.normal()) if i % 7 else None, None, i % 5 + 1) for i in range(300)]
    df = spark.createDataFrame(rows, "patient string, seizure_id string, node_index int, is_soz int, a double, b double, c double, fold int").cache()
    exp = M.Experiment("t", leaves=6, rounds=12, min_leaf=5, learning_rate=0.3, patience=4)

    def fitted():
        return {k: (f.model, f.delta, f.rounds) for k, f in M.fit_all(df, ["a", "b", "c"], exp, 5, ["patient", "seizure_id"], calibrate=0.5).items()}

    whole = fitted()
    monkeypatch.setattr(B, "SLICE_ROWS", 40)
    monkeypatch.setattr(B, "LARGE_SUMS", 100)
    assert whole == fitted() and sorted(whole) == [1, 2, 3, 4, 5]
