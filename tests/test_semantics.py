"""Literal fixtures for rules that a statement in SQL could repeat wrongly."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from onsetry.operators import cohort as C
from onsetry.operators import edges as E
from onsetry.operators import modelling as M
from onsetry.operators import normalize as N
from onsetry.operators import ranking as R
from onsetry.operators import selection as SEL
from onsetry.operators import sequences as Q
from onsetry.operators import signal as S
from onsetry.operators import traces as T

P = "patient string, seizure_id string, seq_idx int, node_index int, y_score double, is_soz int"


def preds(spark, scores, labels, patient="p", rec="0"):
    return [(patient, rec, 0, i, s, y) for i, (s, y) in enumerate(zip(scores, labels))]


def test_recall_conventions_and_one_class_groups(spark):
    df = spark.createDataFrame(
        preds(spark, [0.9, 0.1, 0.5], [0, 0, 0], "none") + preds(spark, [0.9, 0.1], [1, 1], "all")
        + preds(spark, [0.7], [1], "one") + preds(spark, [0.9, None, 0.2], [0, 1, 1], "nul"), P)
    got = {r.patient: r for r in R.patient_metrics(df).collect()}
    assert got["none"].recall_top10 == 0.0 and got["none"].auc_group_mean is None
    assert got["all"].auc_group_mean is None and got["all"].precision_top10 == 1.0
    assert got["one"].f1_top10 == 1.0 and got["one"].mean_score_neg is None
    assert got["nul"].auc_group_mean == 0.0  # the row without a score is gone
    level = {r.patient: r for r in R.level_metrics(df, ["patient"]).collect()}
    assert level["none"].recall_top10 == 1.0 and level["none"].enrichment_top10 is None


def test_false_positive_modes(spark):
    # top 5 of 10: labels 0 1 0 0 0 -> before_last counts one negative, classic four
    labels = [0, 1, 0, 0, 0, 1, 0, 0, 0, 0]
    df = spark.createDataFrame(preds(spark, [1 - i / 10 for i in range(10)], labels), P)
    gm = R.group_metrics(df, fracs=(0.5,))
    a = gm.withColumns(R.topk_scores(gm, 50, "before_last")).first()
    b = gm.withColumns(R.topk_scores(gm, 50, "classic")).first()
    assert a.precision50 == 0.5 and b.precision50 == 0.2 and a.recall50 == b.recall50 == 0.5


def test_ties_at_the_border_go_to_the_lower_node_and_auc_counts_half(spark):
    df = spark.createDataFrame(preds(spark, [0.5, 0.5, 0.5, 0.5], [0, 1, 0, 1]), P)
    assert R.group_metrics(df).first().auc == 0.5
    top = R.top_flags(df, (0.25,)).where("in_top25").collect()
    assert [r.node_index for r in top] == [0]


def test_auc_of_negated_scores_sums_to_one(spark):
    rng = np.random.default_rng(3)
    s, y = rng.integers(0, 6, 40) / 6.0, rng.integers(0, 2, 40)
    up = R.group_metrics(spark.createDataFrame(preds(spark, s.tolist(), y.tolist()), P)).first().auc
    dn = R.group_metrics(spark.createDataFrame(preds(spark, (-s).tolist(), y.tolist()), P)).first().auc
    assert math.isclose(up + dn, 1.0)


def test_gate_needs_every_recording(spark):
    df = spark.createDataFrame(
        preds(spark, [1.0] * 3, [1, 1, 0], "ok", "0") + preds(spark, [1.0] * 3, [1, 1, 1], "ok", "1")
        + preds(spark, [1.0] * 3, [1, 1, 0], "no", "0") + preds(spark, [1.0] * 3, [0, 0, 1], "no", "1"), P)
    assert [r.patient for r in SEL.min_positive_gate(df, 2).collect()] == ["ok"]


def test_unknown_recordings_keep_zero(spark):
    df = spark.createDataFrame([("0", 1, 0.5), ("?", 1, 0.5), ("1", None, 0.5), ("2", 1, None)], "seizure_id string, is_soz int, y_score double")
    assert [r.seizure_id for r in N.known_rows(df).collect()] == ["0"]


def test_best_model_keeps_the_first_of_equals(spark):
    df = spark.createDataFrame([("p", "b", 1, 0.5), ("p", "a", 2, 0.5), ("p", "a", 1, None)], "patient string, run string, experiment int, f1 double")
    best = SEL.best_by_metric(df, "f1").first()
    assert (best.run, best.experiment) == ("a", 2)


def test_baseline_falls_back_to_ictal(spark):
    df = spark.createDataFrame(
        [("c", "ictal", i, v) for i, v in enumerate([1.0, 2.0, 4.0])] + [("d", "preictal", 0, 1.0), ("d", "ictal", 1, 1.0 + 1e-9)],
        "ch string, phase string, epoch int, value double")
    got = {(r.ch, r.epoch): r.z for r in N.robust_baseline_z(df, ["ch"]).collect()}
    assert math.isclose(got["c", 2], 2.0 / 1.4826)
    assert math.isclose(got["d", 1], 1.0, rel_tol=1e-6)  # sigma floor 1e-9
    no_pre = {(r.ch, r.epoch): r.z for r in N.robust_baseline_z_std(df, ["ch"]).collect()}
    assert no_pre["c", 2] is None


def test_burst_with_decay(spark):
    x = [1.0, 1.0, 1.0, 5.0, 1.0, 9.0]
    df = spark.createDataFrame([("c", "preictal" if i < 3 else "ictal", i, v) for i, v in enumerate(x)], "ch string, phase string, epoch int, value double")
    got = [r.burst for r in N.persistent_burst(df, ["ch"], thr_k=0.0, decay=0.5).orderBy("epoch").collect()]
    assert np.allclose(got, [0, 0, 0, 4, 2, 9])
    plain = [r.burst for r in N.persistent_burst(df, ["ch"], thr_k=0.0).orderBy("epoch").collect()]
    assert np.allclose(plain, [0, 0, 0, 4, 4, 12])


def test_constant_column_is_dropped_after_imputation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (float("nan"), 3.0), (1.0, float("inf"))], "a double, b double")
    filled, varying, med = N.clean_matrix(df, ["a", "b"])
    assert varying == ["b"] and med == {"a": 1.0, "b": 2.5}
    assert sorted(r.b for r in filled.collect()) == [2.0, 2.5, 3.0]


def test_three_valued_label(spark):
    nodes = spark.createDataFrame([("p", "A1"), ("p", "A2"), ("q", "A1")], "patient string, name string")
    files = spark.createDataFrame([("p",)], "patient string")
    pos = spark.createDataFrame([("p", "A1")], "patient string, name string")
    got = {(r.patient, r.name): r.is_soz for r in N.three_valued_label(nodes, files, pos, ["patient"]).collect()}
    assert got == {("p", "A1"): True, ("p", "A2"): False, ("q", "A1"): None}


def test_boundary_sample_is_in_both_segments(spark):
    s = spark.createDataFrame([("r", t) for t in (0.0, 1.0, 2.0, 3.0)], "rec string, t double")
    b = spark.createDataFrame([("r", 1.0, 2.0), ("bad", 2.0, 1.0)], "rec string, onset double, offset double")
    got = sorted((r.t, r.phase) for r in S.split_at_onset(s, b, ["rec"]).collect())
    assert got == [(0.0, "preictal"), (1.0, "ictal"), (1.0, "preictal"), (2.0, "ictal")]


def test_moving_average_pads_with_zero(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([3, 6, 9, 12])], "t int, p double").withColumn("k", F.lit(1))
    for width in (3, 4):
        got = [r.smooth for r in S.moving_average(df, ["k"], "t", "p", width).orderBy("t").collect()]
        assert np.allclose(got, np.convolve([3, 6, 9, 12], np.ones(width) / width, "same"))


def trace(spark, x):
    return spark.createDataFrame([("k", i, float(v)) for i, v in enumerate(x)], "k string, t int, p double")


def adaptive(x, pre=5, k=2.0, lo=0.55, hi=0.85, frac=0.6, m=3, dmin=0.02):
    """The rule as a plain state machine."""
    base = x[: max(5, pre)]
    h = min(max(base.mean() + k * base.std(), np.percentile(base, 95), lo), hi, x.min() + frac * max(1e-6, x.max() - x.min()))
    run = 0
    for t, v in enumerate(x):
        good = v >= h and not (t >= 2 and (v - x[t - 2]) / 2 < dmin)
        run = run + 1 if good else 0
        if run >= m and (x[t - m + 1 : t - m + 4] >= 0.8 * h).all():
            return t - m + 1
    return int(np.argmax(np.diff(x))) + 1 if len(x) > 1 else -1


@pytest.mark.parametrize("seed", range(6))
def test_adaptive_onset_is_the_state_machine(spark, seed):
    rng = np.random.default_rng(seed)
    x = np.clip(np.linspace(-0.2, 1, 24) ** 3 + rng.normal(0, 0.08, 24), 0, 1) if seed % 2 else rng.random(24)
    for m in (1, 2, 3, 4):
        got = T.onset_adaptive(trace(spark, x), ["k"], pre_window=5, min_stable=m).first().t_onset
        assert got == adaptive(x, m=m)


def test_simple_onset(spark):
    assert T.onset_simple(trace(spark, [0.6, 0.4, 0.6, 0.6, 0.6]), ["k"]).first().t_onset == 2
    assert T.onset_simple(trace(spark, [0.6, 0.6]), ["k"]).first().t_onset == -1
    assert T.onset_simple(trace(spark, [0.1, 0.7, 0.7]), ["k"], fallback=True).first().t_onset == 1


def gate(p, kmax, knew, alpha, floor):
    """Persistent gate of a channels x steps matrix, ties to the lower channel."""
    n, steps = p.shape
    best = lambda idx, v, k: sorted(idx, key=lambda i: (-v[i], i))[:k]
    out = np.zeros_like(p)
    active: list[int] = []
    for t in range(steps):
        v = p[:, t]
        on = set(best(range(n), v, kmax))
        if t:
            stay = {i for i in active if v[i] >= max(alpha * p[i, t - 1], floor)}
            room = min(knew, max(0, kmax - len(stay)))
            keep = stay | set(best([i for i in range(n) if i not in stay and v[i] >= floor], v, room))
            keep |= set(best([i for i in range(n) if i not in keep], v, max(0, kmax - len(keep))))
            on |= keep
        for i in on:
            out[i, t] = v[i]
        active = [i for i in range(n) if out[i, t] > 0]
    return out


@pytest.mark.parametrize("floor", [0.0, 0.4])
def test_persistent_gate_is_the_recursion(spark, floor):
    rng = np.random.default_rng(5)
    p = rng.random((9, 6))
    df = spark.createDataFrame([("s", t, i, float(p[i, t])) for i in range(9) for t in range(6)], "s string, t int, node_index int, p double")
    want = gate(p, 3, 1, 0.8, floor)
    for r in T.persistent_gate(df, ["s"], k_max=3, k_new=1, abs_min=floor).collect():
        assert math.isclose(r.p_gated, want[r.node_index, r.t], abs_tol=1e-12)


def spans(spark, n_pre, n_ict, col):
    rows = [("r", "preictal", i) for i in range(n_pre)] + [("r", "ictal", 100 + i) for i in range(n_ict)]
    tl = Q.relative_time(spark.createDataFrame(rows, "r string, phase string, epoch int"), ["r"])
    it = Q.items(tl, col()).groupBy("seq_id").agg(F.min("pos").alias("lo"), F.count(F.lit(1)).alias("n"))
    return sorted((r.lo, r.n) for r in it.collect())


def test_adaptive_sequence_borrows(spark):
    # onset at 3: only 3 before, so 2 more after
    assert spans(spark, 3, 20, lambda: Q.adaptive_spans(5, 4, 6)) == [(0, 10)]
    assert spans(spark, 20, 2, lambda: Q.adaptive_spans(5, 4, 6)) == [(12, 10)]
    assert spans(spark, 2, 2, lambda: Q.adaptive_spans(5, 4, 6)) == []
    assert spans(spark, 9, 0, lambda: Q.adaptive_spans(5, 4, 6)) == []


def test_short_recordings(spark):
    assert spans(spark, 2, 2, lambda: Q.sliding_spans(6, 2, True, 3)) == [(0, 4)]
    assert spans(spark, 2, 2, lambda: Q.sliding_spans(6, 2)) == []
    assert spans(spark, 4, 0, lambda: Q.sliding_spans(6, 2, True, 3)) == []


def test_every_sliding_sequence_holds_both_phases(spark):
    rows = [("r", "preictal", i) for i in range(11)] + [("r", "ictal", 50 + i) for i in range(7)]
    df = spark.createDataFrame(rows, "r string, phase string, epoch int").withColumn("path", F.concat_ws("/", "phase", F.col("epoch").cast("string")))
    seqs = Q.path_arrays(Q.items(Q.relative_time(df, ["r"]), Q.sliding_spans(6, 3)), ["r"])
    assert seqs.count() > 0 and seqs.where(~Q.has_both()).count() == 0


def test_path_segment_is_exact(spark):
    df = spark.createDataFrame([("a/preictal/x",), ("a\\ICTAL\\x",)], "p string")
    assert [r[0] for r in df.select(Q.path_has_phase(F.col("p"), "ictal")).collect()] == [False, True]


def test_knn_in_degree_cap(spark):
    edges = spark.createDataFrame([("g", s, "hub", w) for s, w in zip("abcd", (0.9, 0.8, 0.7, 0.6))] + [("g", "a", "a", 1.0), ("g", "a", "b", 0.1)], "g string, src string, dst string, w double")
    kept = {(r.src, r.dst) for r in E.knn_edges(edges, ["g"], 1, 2).collect()}
    assert kept == {("a", "hub"), ("b", "hub")}  # the self loop takes no slot


def test_laplacian_of_symmetric_adjacency_is_symmetric(spark):
    a = np.array([[0, 1, 0.5], [1, 0, 0], [0.5, 0, 0]])
    rows = [("g", i, j, float(a[i, j])) for i in range(3) for j in range(3) if a[i, j]]
    got = np.zeros((3, 3))
    for r in E.normalized_laplacian(spark.createDataFrame(rows, "g string, src int, dst int, w double"), ["g"]).collect():
        got[r.src, r.dst] = r.w
    d = 1 / np.sqrt(a.sum(axis=1) + 1e-9)
    assert np.allclose(got, np.eye(3) - d[:, None] * a * d[None]) and np.allclose(got, got.T)


def test_label_words(spark):
    df = spark.createDataFrame([("Yes",), (" false ",), ("1",), ("maybe",), (None,)], "v string")
    assert [r[0] for r in df.select(E.label_code("v")).collect()] == [1, 0, 1, -1, -1]


def test_scores_need_three_points(spark):
    df = spark.createDataFrame([("p", "f", s, float(v)) for s, v in enumerate([1, -2])] + [("p", "g", s, float(v)) for s, v in enumerate([1, 1, -1])], "patient string, feature string, seizure int, y double")
    got = {r.feature: r for r in C.feature_scores(df, ["patient"]).collect()}
    assert got["f"].final_score is None and got["f"].n_points == 2
    assert math.isclose(got["g"].sign_term, 1 / 3) and math.isclose(got["g"].final_score, math.log(2) / 3, rel_tol=1e-9)


def test_holm_is_monotone(spark):
    p = [0.01, 0.04, 0.03, 0.005]
    df = spark.createDataFrame([(str(i), "x", v) for i, v in enumerate(p)], "ga string, gb string, p double")
    got = {r.ga: round(r.p_adj, 9) for r in C.holm(df).collect()}
    assert got == {"3": 0.02, "0": 0.03, "2": 0.06, "1": 0.06}


def test_tails(spark):
    df = spark.createDataFrame([(1.959963985, 5.991464547, 2), (0.0, 7.814727903, 3), (0.0, 3.841458821, 1)], "z double, x double, k int")
    rows = df.select(C.normal_two_sided(F.col("z")).alias("a"), C.chi_square_tail(F.col("x"), F.col("k")).alias("b")).collect()
    assert math.isclose(rows[0].a, 0.05, abs_tol=1e-8) and rows[1].a == 1.0
    assert all(math.isclose(r.b, 0.05, abs_tol=1e-8) for r in rows)


def test_permutation_of_identical_values_has_p_one(spark):
    df = spark.createDataFrame([(i, "a" if i < 4 else "b", 1.0) for i in range(8)], "id int, g string, v double")
    assert C.permutation_test(df, "id", "g", "v", 20, 1).first().p == 1.0


def test_permutation_of_separated_groups_is_small(spark):
    df = spark.createDataFrame([(i, "a" if i < 8 else "b", float(i // 8 * 10 + i % 8)) for i in range(16)], "id int, g string, v double")
    assert C.permutation_test(df, "id", "g", "v", 100, 1).first().p < 0.05


def test_no_shift_without_both_classes(spark):
    df = spark.createDataFrame([(0.3, 1), (0.4, 1)], "raw double, is_soz int")
    assert M.choose_shift(df).first().delta == 0.0


def test_least_violation_when_no_shift_is_feasible(spark):
    df = spark.createDataFrame([(8.0, 0), (8.0, 1)], "raw double, is_soz int")
    got = M.choose_shift(df).first()
    assert got.delta == -2.0 and not got.feasible


def test_leave_one_out_covers_every_row_once(spark):
    rng = np.random.default_rng(1)
    rows = [(f"p{i % 3}", f"s{i % 2}", i, int(i % 4 == 0), float(rng.normal() + (i % 4 == 0) * 2), float(rng.random()), 1.0) for i in range(120)]
    df = spark.createDataFrame(rows, "patient string, seizure_id string, node_index int, is_soz int, a double, b double, c double")
    exp = M.Experiment("t", leaves=4, rounds=2, min_leaf=2, learning_rate=0.3)
    out = M.leave_one_out_predictions(df, ["a", "b", "c"], exp, ["patient", "seizure_id"], l1_c=1.0)
    rows = out.collect()
    assert len(rows) == 120 and len({r.node_index for r in rows}) == 120
    assert {(r.patient, r.fold) for r in rows} == {("p0", 1), ("p1", 2), ("p2", 3)}
    assert R.level_metrics(out, [], ["patient", "seizure_id"]).first().auc_group_mean > 0.8
