"""Change metrics, patient scores, stability and group statistics of a cohort."""

from __future__ import annotations

import math
import sys
from functools import cache

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from onsetry.operators.embedding import principal_components, separation  # noqa: F401  (C21)
from onsetry.operators.grouped import (
    MOST, average_ranks, correlation, down, numbered, ordered, pair_blocks, quantiles, split_rows, with_totals,
)
from onsetry.operators.permutation import permutation_test  # noqa: F401  (C18 belongs to this module's interface)

cloudpickle.register_pickle_by_value(sys.modules[__name__])

EPS = 1e-12
MOST_ARRANGED = 100_000  # values of U up to which an exact distribution is counted
MEASURES = ["change_global_abs", "change_soz_abs", "change_nonsoz_abs", "change_soz_amp_abs"]


# -------------------------------------------------------------------- changes
def first_label(df, keys: list[str], order: list[str], label="is_soz") -> DataFrame:
    """First non-null label in a stated order; none gives 0."""
    pick = F.min_by(F.col(label), F.when(F.col(label).isNotNull(), F.struct(*order)))
    return df.groupBy(*keys).agg(F.coalesce(pick.cast("int"), F.lit(0)).alias(label))


def change_metrics(long, recording: list[str], channel="electrode", feature="feature", value="value",
                   phase="phase", label="is_soz") -> DataFrame:
    """Mean |ictal mean - preictal mean| over all, positive and negative channels, and their contrast.

    Recordings without one of the phases are left out.
    """
    pre, ict = F.col(phase) == "preictal", F.col(phase) == "ictal"
    per = long.groupBy(*recording, feature, channel).agg(
        F.abs(F.avg(F.when(ict, F.col(value))) - F.avg(F.when(pre, F.col(value)))).alias("_d"),
        F.max(label).alias("_y"), F.bool_or(pre).alias("_hp"), F.bool_or(ict).alias("_hi"),
    )
    out = per.groupBy(*recording, feature).agg(
        F.avg("_d").alias("change_global_abs"),
        F.avg(F.when(F.col("_y") == 1, F.col("_d"))).alias("change_soz_abs"),
        F.avg(F.when(F.coalesce(F.col("_y"), F.lit(0)) == 0, F.col("_d"))).alias("change_nonsoz_abs"),
        F.bool_or("_hp").alias("_hp"), F.bool_or("_hi").alias("_hi"),
    ).where("_hp and _hi and change_global_abs is not null").drop("_hp", "_hi")
    return out.withColumn("change_soz_amp_abs", F.col("change_soz_abs") - F.col("change_nonsoz_abs"))


def measures_long(changes: DataFrame, keys: list[str], measures=tuple(MEASURES)) -> DataFrame:
    return changes.unpivot(keys, list(measures), "measure", "y")


# --------------------------------------------------------------------- scores
def feature_scores(long, by: list[str], feature="feature", y="y", zero_rel=0.05, zero_abs=1e-8,
                   stability_alpha=1.0, amp_alpha=1.0, active_frac=0.4) -> DataFrame:
    """Amplitude, stability and sign agreement of a feature over a patient's recordings.

    ``by`` is the patient (and measure).  Fewer than three points give no score.
    """
    rows = long.withColumn("_a", F.abs(y))
    amp = quantiles(rows, [*by, feature], {"_med": ("_a", 0.5)}, {"_n": F.count(y)})
    amp = amp.withColumn("_med", F.when(F.col("_n") >= 3, F.col("_med")))
    # a patient has one amplitude per feature, so this group is bounded by the feature list
    ref = quantiles(amp, by, {"_ref": ("_med", 0.5)}, hot=[]).withColumn("_ref", F.coalesce("_ref", F.lit(0.0)))
    rows = rows.join(ref, by)
    thr = F.greatest(F.lit(zero_abs), zero_rel * F.col("_ref"))
    big = F.col("_a") > thr
    agg = rows.groupBy(*by, feature).agg(
        F.count(y).alias("n_points"), F.first("_ref").alias("amp_ref_patient"), F.avg("_a").alias("_mean"),
        F.stddev_pop("_a").alias("_std"), F.coalesce(F.avg(big.cast("double")), F.lit(0.0)).alias("frac_nonzero"),
        F.coalesce(F.abs(F.avg(F.when(big, F.signum(y)))), F.lit(0.0)).alias("_sign"),
    )
    out = agg.join(amp.select(*by, feature, F.col("_med").alias("amplitude_score")), [*by, feature])
    ok = F.col("amplitude_score").isNotNull()
    norm = F.when(F.col("amp_ref_patient") > 0, F.col("amplitude_score") / (F.col("amp_ref_patient") + EPS)).otherwise(0.0)
    out = out.withColumns({
        "amp_norm": F.when(ok, norm),
        "amp_term": F.when(ok, F.pow(F.log1p(norm), F.lit(float(amp_alpha)))),
        "stability": F.when(ok, F.pow(1 / (1 + F.col("_std") / (F.col("_mean") + EPS)), F.lit(float(stability_alpha)))),
        "sign_term": F.when(ok, F.col("_sign")),
        "movement_consistency": F.log1p(1 / (F.col("_std") + EPS)),
        "zero_threshold_used": F.greatest(F.lit(zero_abs), zero_rel * F.col("amp_ref_patient")),
        "is_active": (F.col("frac_nonzero") >= active_frac).cast("int"),
    })
    return out.withColumn("final_score", F.col("amp_term") * F.col("stability") * F.col("sign_term")).drop(
        "_mean", "_std", "_sign")


def settled(values: Column) -> Column:
    """Aggregate of a text column that must agree, else ``unknown``."""
    return F.when(F.count_distinct(values) == 1, F.min(values)).otherwise("unknown")


def cohort_scores(changes, patient="patient", recording="seizure", outcome="outcome", aggregate="sum", k=15,
                  min_recordings=3, keep_top: int | None = None, multiply_by_n=False, measures=tuple(MEASURES),
                  **score_args) -> DataFrame:
    """One score per patient and measure, and their maximum."""
    args = {"stability_alpha": 1.5, "amp_alpha": 0.7, **score_args}
    base = changes.where(F.col(recording).isNotNull()).groupBy(patient).agg(
        F.count_distinct(recording).alias("n_seizures"), settled(F.col(outcome)).alias(outcome)
    ).where(F.col("n_seizures") >= min_recordings)
    kept = changes.join(base.select(patient), patient, "left_semi")
    long = measures_long(kept, [patient, recording, "feature"], measures)
    scores = feature_scores(long, [patient, "measure"], **args).where("final_score is not null")
    if keep_top:
        w = Window.partitionBy("measure", "feature").orderBy(F.desc("final_score"))
        # rank <= N is cut per group before the shuffle
        scores = scores.withColumn("_r", F.rank().over(w)).where(F.col("_r") <= keep_top).drop("_r")
    if aggregate == "topk":
        scores = numbered(scores, [patient, "measure"], [down("final_score"), "feature"], "_r", hot=[])
        value = F.avg(F.when(F.col("_r") <= max(1, k), F.col("final_score")))
    else:
        value = {"sum": F.sum, "max": F.max, "mean": F.avg}[aggregate]("final_score")
    n = F.count(F.lit(1))
    per = scores.groupBy(patient, "measure").agg((value * n if multiply_by_n else value).alias("_v"), n.alias("_n"))
    wide = per.groupBy(patient).agg(*[
        F.max(F.when(F.col("measure") == m, F.col(c))).alias(f"{a}__{m}")
        for m in measures for c, a in (("_v", "patient_score"), ("_n", "n_selected"))
    ])
    out = base.join(wide, patient, "left")
    cols = [F.col(f"patient_score__{m}") for m in measures]
    return out.withColumn("overall_score", F.greatest(*cols) if len(cols) > 1 else cols[0])


def chosen_features(scores, n: int, how="most_common", patient="patient") -> list[str]:
    """Feature names by number of scored patients or by median score; ties by name."""
    ok = scores.where("final_score is not null")
    if how == "most_common":
        order = ok.groupBy("feature").agg(F.count_distinct(patient).alias("_v"))
    elif how == "top_global_score":
        order = quantiles(ok, ["feature"], {"_v": ("final_score", 0.5)})
    else:
        raise ValueError("how must be 'most_common' or 'top_global_score'")
    return [r["feature"] for r in order.orderBy(F.desc("_v"), "feature").limit(n).collect()]


def patient_feature_matrix(scores, features: list[str], impute="zero", standardize=True, patient="patient") -> DataFrame:
    """Patients by chosen features, imputed and standardised."""
    from onsetry.operators.normalize import column_medians, standardize as scale

    cells = quantiles(scores.where(F.col("feature").isin(features)), [patient, "feature"], {"_v": ("final_score", 0.5)})
    mat = cells.groupBy(patient).pivot("feature", features).agg(F.max("_v"))
    fill = dict.fromkeys(features, 0.0) if impute == "zero" else column_medians(mat, features).first().asDict()
    mat = mat.fillna({k: v for k, v in fill.items() if v is not None})
    return scale(mat, mat, features) if standardize else mat


def top_features_by_region(scores, region="region", patient="patient", min_patients=1) -> DataFrame:
    """Median score, share above zero, patients and importance per region and feature."""
    ok = scores.where("final_score is not null")
    out = quantiles(ok, [region, "feature"], {"median_score": ("final_score", 0.5)}, {
        "support": F.avg((F.col("final_score") > 0).cast("double")), "n_patients": F.count_distinct(patient),
    })
    return out.withColumn("importance", F.col("median_score") * F.col("support")).where(F.col("n_patients") >= min_patients)


def per_patient(df, value: str, how: str, patient="patient_key", outcome="outcome") -> DataFrame:
    """One value per patient; outcomes that disagree become unknown."""
    rest = {"n_rows": F.count(F.lit(1)), "outcome": settled(F.col(outcome))}
    rows = df.where(F.col(value).isNotNull())
    if how == "median":
        return quantiles(rows, [patient], {"value": (value, 0.5)}, rest)
    fn = {"mean": F.avg, "min": F.min, "max": F.max}[how]
    return rows.groupBy(patient).agg(fn(value).alias("value"), *[a.alias(n) for n, a in rest.items()])


def score_with_quality(scores, quality, patient="patient_key", score="overall_score", value="value", log_axis=False) -> DataFrame:
    """Inner join on the canonical patient key; a log axis keeps positive scores only."""
    out = scores.join(quality, patient)
    return out.where((F.col(score) > 0) & (F.col(value) > 0)) if log_axis else out


# --------------------------------------------------------- matrices, stability
def feature_matrix(changes, rows: list[str], features: list[str], value: str) -> DataFrame:
    """C14: mean value with one row per patient or recording and one column per feature."""
    return changes.groupBy(*rows).pivot("feature", features).agg(F.avg(value))


def recording_vectors(changes, patient: list[str], recording: str, value: str, normalize=True) -> DataFrame:
    """Mean value per recording and feature, optionally divided by the recording's sum.

    A vector has one row per feature, so its group is bounded by the feature list.
    """
    from onsetry.operators.normalize import l1_normalize

    v = changes.where(F.col(value).isNotNull()).groupBy(*patient, recording, "feature").agg(F.avg(value).alias("v"))
    return l1_normalize(v, [*patient, recording], "v", hot=[]) if normalize else v


def many_pairs(changes, patient: list[str], recording: str) -> list:
    """Patients with more recording pairs than one task should hold, counted on the input rows."""
    n = changes.groupBy(*patient).agg(F.count_distinct(recording).alias("_r"))
    pairs = n.select(*patient, (F.col("_r") * (F.col("_r") - 1) / 2).cast("long").alias("_n"))
    return pairs.where(F.col("_n") > split_rows(changes)).orderBy(F.desc("_n")).limit(MOST).collect()


def recording_pairs(vectors, patient: list[str], recording: str, hot: list | None = None) -> DataFrame:
    """Values of two recordings a < b of a patient on shared features."""
    hot = many_pairs(vectors, patient, recording) if hot is None else hot
    return pair_blocks(vectors.where("v is not null"), patient, recording, ["v"], 8 if hot else 1, on=["feature"])


def stability(changes, patient: list[str], recording: str, value: str, top_n=10) -> DataFrame:
    """Pairwise rank correlation (three shared features or more) and overlap of the top features.

    Pairs without a common top feature add 0, so only overlapping pairs are formed
    and the number of pairs is counted.
    """
    # values equal up to summation noise must rank as ties
    vec = recording_vectors(changes, patient, recording, value).withColumn("v", F.round("v", 12))
    a, b = f"{recording}_a", f"{recording}_b"
    pair = [*patient, a, b]
    hot = many_pairs(changes, patient, recording)
    shared = recording_pairs(vec, patient, recording, hot)
    # one pair holds at most one row per feature, so a window partition is bounded by the feature list
    w = Window.partitionBy(*pair)

    def mid_rank(c):
        return F.rank().over(w.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(*pair, c)) - 1) / 2

    ranked = shared.withColumns({"_ra": mid_rank("v_a"), "_rb": mid_rank("v_b")})
    corr = ranked.groupBy(*pair).agg(correlation("_ra", "_rb").alias("_c"), F.count(F.lit(1)).alias("_n"))
    corr = corr.where((F.col("_n") >= 3) & F.col("_c").isNotNull())
    stats = quantiles(corr, patient, {"stability_corr_median": ("_c", 0.5)}, {"stability_corr_mean": F.avg("_c")}, hot)
    top = numbered(vec.where("v is not null"), [*patient, recording], [down("v"), "feature"], "_r", hot=[]).where(F.col("_r") <= top_n)
    top = with_totals(top.drop("_r"), [*patient, recording], {"_k": F.count(F.lit(1))}, hot=[])  # top_n rows at most
    both = pair_blocks(top, patient, recording, ["_k"], 8 if hot else 1, on=["feature"]).groupBy(*pair).agg(
        F.count(F.lit(1)).alias("_i"), F.first("_k_a").alias("_ka"), F.first("_k_b").alias("_kb"))
    jac = both.groupBy(*patient).agg(F.sum(F.col("_i") / (F.col("_ka") + F.col("_kb") - F.col("_i"))).alias("_j"))
    size = vec.groupBy(*patient, recording).agg(F.count("v").alias("_f")).groupBy(*patient).agg(
        F.count(F.lit(1)).alias("n_seizures"), F.count(F.when(F.col("_f") == 0, 1)).alias("_empty"))
    pairs = (F.col("n_seizures") * (F.col("n_seizures") - 1) - F.col("_empty") * (F.col("_empty") - 1)) / 2
    out = size.join(stats, patient, "left").join(jac, patient, "left")
    return out.withColumn(
        "stability_jaccard_mean", F.coalesce("_j", F.lit(0.0)) / F.nullif(pairs, F.lit(0.0))
    ).drop("_j", "_empty")


def patient_profile(changes, patient: list[str], recording: str, value: str, normalize_patient=True) -> DataFrame:
    """C11: mean of the recordings' normalised vectors, normalised again."""
    from onsetry.operators.normalize import l1_normalize

    prof = recording_vectors(changes, patient, recording, value).groupBy(*patient, "feature").agg(F.avg("v").alias("v"))
    return l1_normalize(prof, patient, "v", hot=[]) if normalize_patient else prof


def constant_change(changes, patient: list[str], recording: str, value: str, tau_quantile=0.1, eps=EPS) -> DataFrame:
    """Mean pairwise cosine of the recordings' shapes times a saturating amplitude term.

    With u the unit vectors, the sum over pairs of u_i . u_j is
    (|sum u|^2 - sum |u_i|^2) / 2, so no pair is formed.
    """
    key = [*patient, recording]
    vec = changes.groupBy(*key, "feature").agg(F.avg(value).alias("v"))
    norms = vec.groupBy(*key).agg(
        F.sqrt(F.coalesce(F.sum(F.col("v") * F.col("v")), F.lit(0.0))).alias("_l2"),
        F.coalesce(F.sum(F.abs("v")), F.lit(0.0)).alias("_l1"),
    )
    tau = quantiles(norms.where("_l2 > 0"), [], {"t": ("_l2", tau_quantile)}).first()
    tau = max(tau["t"], 1e-6) if tau and tau["t"] is not None else 1.0
    # u = x / (|x|_1 + eps); unit = u / (|u|_2 + eps)
    scale = F.col("_l1") + eps
    unit = F.col("v") / scale / (F.col("_l2") / scale + eps)
    units = vec.join(norms, key).withColumn("_u", unit)
    sums = units.groupBy(*patient, "feature").agg(F.sum("_u").alias("_s"), F.sum(F.col("_u") * F.col("_u")).alias("_q"))
    dots = sums.groupBy(*patient).agg(((F.sum(F.col("_s") * F.col("_s")) - F.sum("_q")) / 2).alias("_dot"))
    amp = quantiles(norms, patient, {"median_amplitude": ("_l2", 0.5)}, {"n_seizures": F.count(F.lit(1))})
    n = F.col("n_seizures")
    out = amp.join(dots, patient, "left").withColumns({
        "pattern_stability": F.when(n >= 2, F.col("_dot") / F.nullif(n * (n - 1) / 2, F.lit(0.0))),
        "nontriviality": F.when(n >= 2, 1 - F.exp(-F.col("median_amplitude") / tau)),
        "median_amplitude": F.when(n >= 2, F.col("median_amplitude")),
    }).drop("_dot")
    return out.withColumn("constant_change_score", F.col("pattern_stability") * F.col("nontriviality"))


def consistent_change(changes, patient: list[str], recording: str, value: str) -> DataFrame:
    """Length of the mean change vector, and its ratio to the mean length."""
    key = [*patient, recording]
    vec = changes.where(F.col(value).isNotNull()).groupBy(*key, "feature").agg(F.avg(value).alias("v"))
    amp = vec.groupBy(*key).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("_l2")).groupBy(*patient).agg(
        F.count(F.lit(1)).alias("n_seizures"), F.avg("_l2").alias("_amp"))
    # a feature missing in a recording counts as 0
    mean = vec.groupBy(*patient, "feature").agg(F.sum("v").alias("_s")).groupBy(*patient).agg(
        F.sqrt(F.sum(F.col("_s") * F.col("_s"))).alias("_len"))
    out = amp.join(mean, patient)
    many = F.col("n_seizures") >= 2
    return out.select(
        *patient, "n_seizures", F.when(many, F.col("_len") / F.col("n_seizures")).alias("consistent_change"),
        F.when(many & (F.col("_amp") > 0), F.col("_len") / F.col("n_seizures") / F.nullif(F.col("_amp"), F.lit(0.0))).alias("consistency_index"),
        F.when(many, F.col("_amp")).alias("mean_amplitude"),
    )


# ------------------------------------------------------------------ statistics
def normal_two_sided(z: Column) -> Column:
    """Two-sided normal tail of a few test rows."""

    @F.pandas_udf("double")
    def tail(col: pd.Series) -> pd.Series:
        return col.map(lambda v: None if pd.isna(v) else min(1.0, math.erfc(v / math.sqrt(2))))

    return tail(z)


def chi_square_tail(x: Column, dof: Column) -> Column:
    """Upper chi-square tail by its finite sums for integer degrees of freedom."""

    def one(v, k):
        if pd.isna(v) or pd.isna(k) or k < 1:
            return None
        h, k = v / 2, int(k)
        term, total = (1.0, 1.0) if k % 2 == 0 else (0.0, 0.0)
        if k % 2 == 0:
            for i in range(1, k // 2):
                term *= h / i
                total += term
            return math.exp(-h) * total
        term = math.sqrt(h) / math.gamma(1.5)
        for i in range((k - 1) // 2):
            total += term
            term *= h / (i + 1.5)
        return math.erfc(math.sqrt(h)) + math.exp(-h) * total

    @F.pandas_udf("double")
    def tail(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([one(v, k) for v, k in zip(a, b)], dtype="float64")

    return tail(x, dof.cast("double"))


def correlations(df, by: list[str], x: str, y: str) -> DataFrame:
    """Pearson and Spearman correlation; fewer than three complete pairs give null."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    key = by or ["_all"]
    rows = rows if by else rows.withColumn("_all", F.lit(0))
    ranked = average_ranks(average_ranks(rows, key, x, "_rx"), key, y, "_ry")
    n = F.count(F.lit(1))
    out = ranked.groupBy(*key).agg(
        n.alias("n"), F.when(n >= 3, correlation(x, y)).alias("pearson_r"), F.when(n >= 3, correlation("_rx", "_ry")).alias("spearman_rho"))
    return out if by else out.drop("_all")


def outcome_table(patients, region="region", outcome="outcome", patient="patient_key") -> DataFrame:
    """Patients per region and outcome, and shares of the region."""
    ct = patients.groupBy(region, outcome).agg(F.count_distinct(patient).alias("n"))
    return with_totals(ct, [region], {"_t": F.sum("n")}).withColumn("share", F.col("n") / F.col("_t")).drop("_t")


def chi_square(patients, region="region", outcome="outcome", patient="patient_key") -> DataFrame:
    """Chi-square statistic of the contingency table, from its margins.

    sum (o - e)^2 / e equals sum o^2 / e - n, so empty cells need no rows.
    """
    cells = patients.groupBy(region, outcome).agg(F.count_distinct(patient).alias("o"))
    rows = cells.groupBy(region).agg(F.sum("o").alias("_r"))
    cols = cells.groupBy(outcome).agg(F.sum("o").alias("_c"))
    m = cells.join(rows, region).join(cols, outcome)
    return m.agg(
        F.sum(F.col("o") * F.col("o") / (F.col("_r") * F.col("_c"))).alias("_q"), F.sum("o").alias("n"),
        ((F.count_distinct(region) - 1) * (F.count_distinct(outcome) - 1)).alias("dof"),
    ).select("n", "dof", (F.col("_q") * F.col("n") - F.col("n")).alias("chi2"))


def _rank_sums(df, by: list[str], group: str, value: str) -> tuple[DataFrame, DataFrame]:
    rows = df.where(F.col(value).isNotNull() & F.col(group).isNotNull())
    ranked = average_ranks(rows, by, value, "_rk", ties="_t")
    per = ranked.groupBy(*by, group).agg(F.sum("_rk").alias("_rs"), F.count(F.lit(1)).alias("_n"))
    # each of t equal rows adds t^2 - 1, together t^3 - t
    ties = ranked.groupBy(*by).agg(
        F.sum(F.col("_t").cast("double") * F.col("_t") - 1).alias("_ties"), F.count(F.lit(1)).cast("double").alias("_all_n"))
    return per, ties


def mann_whitney(df, by: list[str], group: str, value: str, first, second) -> DataFrame:
    """U of ``first``, and z with tie and continuity correction; groups under two rows give null."""
    keys = by or ["_k"]
    rows = (df if by else df.withColumn("_k", F.lit(0))).where(F.col(group).isin(first, second))
    per, ties = _rank_sums(rows, keys, group, value)
    pick = lambda g, c: F.sum(F.when(F.col(group) == g, F.col(c))).cast("double")
    j = per.groupBy(*keys).agg(
        pick(first, "_rs").alias("_r1"), F.coalesce(pick(first, "_n"), F.lit(0.0)).alias("n1"),
        F.coalesce(pick(second, "_n"), F.lit(0.0)).alias("n2"),
    ).join(ties, keys)
    out = _mann_whitney_z(j).select(*by, "n1", "n2", "u", "z")
    return out


def _mann_whitney_z(j: DataFrame) -> DataFrame:
    n1, n2, n = F.col("n1"), F.col("n2"), F.col("_all_n")
    ok = (n1 >= 2) & (n2 >= 2)
    u = F.when(ok, F.col("_r1") - n1 * (n1 + 1) / 2)
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("_ties") / F.nullif(n * (n - 1), F.lit(0.0))))
    z = (F.greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / F.nullif(sd, F.lit(0.0))
    return j.withColumns({"u": u, "z": z})


def kruskal(df, by: list[str], group: str, value: str) -> DataFrame:
    """C17: H over k groups with tie correction."""
    keys = by or ["_k"]
    per, ties = _rank_sums(df if by else df.withColumn("_k", F.lit(0)), keys, group, value)
    n = F.col("_all_n")
    j = per.groupBy(*keys).agg(F.sum(F.col("_rs") * F.col("_rs") / F.col("_n")).alias("_s"), (F.count(F.lit(1)) - 1).alias("dof")).join(ties, keys)
    h = (12 / (n * (n + 1)) * F.col("_s") - 3 * (n + 1)) / F.nullif(1 - F.col("_ties") / F.nullif(n * n * n - n, F.lit(0.0)), F.lit(0.0))
    return j.select(*by, n.cast("long").alias("n"), "dof", h.alias("h"))


def _pairwise(df, group: str, value: str) -> DataFrame:
    names = [r[0] for r in df.where(F.col(group).isNotNull()).select(group).distinct().orderBy(group).collect()]
    k, kind = len(names), df.schema[group].dataType.simpleString()
    if k < 2:
        return df.sparkSession.createDataFrame([], f"ga {kind}, gb {kind}, n1 double, n2 double, u double, z double, ties double")
    rows = df.where(F.col(value).isNotNull() & F.col(group).isNotNull())
    counts = rows.groupBy(F.col(value).alias("_v")).agg(*[F.count_if(F.col(group) == g).alias(f"n{i}") for i, g in enumerate(names)])
    run = ordered(counts.withColumn("_k", F.lit(0)), ["_k"], ["_v"], running={f"c{i}": F.col(f"n{i}") for i in range(k)})
    a, b = np.triu_indices(k, 1)

    def add(batches):
        wins, ties, size = np.zeros((k, k)), np.zeros((k, k)), np.zeros(k)
        for pdf in batches:
            n = pdf[[f"n{i}" for i in range(k)]].to_numpy(float)
            below = pdf[[f"c{i}" for i in range(k)]].to_numpy(float) - n
            wins += n.T @ (below + n / 2)
            # t = n_a + n_b equal values of a pair add t^3 - t
            own, cross = (n**3 - n).sum(axis=0), (n**2).T @ n
            ties += own[:, None] + own[None] + 3 * (cross + cross.T)
            size += n.sum(axis=0)
        yield pd.DataFrame({"a": a, "b": b, "n1": size[a], "n2": size[b], "u": wins[a, b], "ties": ties[a, b]})

    parts = run.drop("_k", "_v").mapInPandas(add, "a int, b int, n1 double, n2 double, u double, ties double")
    sums = parts.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n1", "n2", "u", "ties")]).where("n1 + n2 > 0")
    name = F.array(*[F.lit(g) for g in names])
    j = sums.select(name[F.col("a")].alias("ga"), name[F.col("b")].alias("gb"), "n1", "n2", (F.col("n1") + F.col("n2")).alias("_all_n"),
                    (F.col("u") + F.col("n1") * (F.col("n1") + 1) / 2).alias("_r1"), F.col("ties").alias("_ties"))
    return _mann_whitney_z(j).select("ga", "gb", "n1", "n2", "u", "z", F.col("_ties").alias("ties"))


def pairwise_mann_whitney(df, group: str, value: str) -> DataFrame:
    """Every pair of groups tested against each other; one row per pair.

    The table is read for its group names, then once for all pairs: rows become counts by value and group, the counts are summed up along the values, and all
    pairs follow from products of count columns, one small matrix a task. The group names reach the driver; they
    are as many as the root of the result's rows.
    """
    return _pairwise(df, group, value).drop("ties")


def pairwise_p_values(df, group: str, value: str) -> DataFrame:
    """The same with two-sided ``p``: exact for small groups without ties, the normal tail for all others."""
    t = _pairwise(df, group, value)
    return t.withColumn("p", two_sided_p(F.col("u"), F.col("n1"), F.col("n2"), F.col("ties"), F.col("z"))).drop("ties")


@cache
def u_tail(n1: int, n2: int) -> list[float]:
    """P(U >= u) for u = 0 .. n1 n2 without ties, from the numbers of arrangements.

    Their generating function is the Gaussian binomial coefficient: for each i up to n1 one factor 1 - x^(n2 + i) is
    multiplied and one factor 1 - x^i divided out, in whole numbers.
    """
    ways = [1] + [0] * (n1 * n2)
    for i in range(1, n1 + 1):
        for u in range(n1 * n2, n2 + i - 1, -1):
            ways[u] -= ways[u - n2 - i]
        for u in range(i, n1 * n2 + 1):
            ways[u] += ways[u - i]
    above, out = 0, []
    for w in reversed(ways):
        above += w
        out.append(above)
    return [x / above for x in reversed(out)]


def two_sided_p(u: Column, n1: Column, n2: Column, ties: Column, z: Column) -> Column:
    """P of a few test rows: exact if there are no ties and one group has at most 8 rows (and the table of
    arrangements at most ``MOST_ARRANGED`` entries), else the normal tail of ``z``."""

    def one(u, a, b, t, z):
        if pd.isna(u):
            return None
        a, b = int(min(a, b)), int(max(a, b))
        if t == 0 and a <= 8 and a * b <= MOST_ARRANGED:
            return min(1.0, 2 * u_tail(a, b)[int(max(u, a * b - u))])
        return None if pd.isna(z) else min(1.0, math.erfc(z / math.sqrt(2)))

    @F.pandas_udf("double")
    def p(u: pd.Series, a: pd.Series, b: pd.Series, t: pd.Series, z: pd.Series) -> pd.Series:
        return pd.Series([one(*x) for x in zip(u, a, b, t, z)], dtype=float)

    return p(u, n1, n2, ties, z)


def holm(tests: DataFrame, p="p", ident=("ga", "gb"), family: list[str] | None = None) -> DataFrame:
    """Step-down correction: running maximum of (m - i + 1) p, at most 1."""
    fam = family or ["_f"]
    rows = (tests if family else tests.withColumn("_f", F.lit(0))).where(F.col(p).isNotNull())
    rows = ordered(rows, fam, [p, *ident], number="_i", totals={"_m": F.count(F.lit(1))})
    w = Window.partitionBy(*fam).orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    adj = F.least(F.lit(1.0), F.max((F.col("_m") - F.col("_i") + 1) * F.col(p)).over(w))
    out = rows.withColumn("p_adj", adj).drop("_i", "_m")
    return out if family else out.drop("_f")


# ------------------------------------------------------------------ embeddings
def pca_2d(matrix: DataFrame, cols: list[str], keep: list[str]) -> DataFrame:
    """C20: first two principal components of columns, centred; see :func:`principal_components`."""
    rows = matrix.withColumn("_cols", F.array(*[F.col(f"`{c}`").cast("double") for c in cols]))
    return principal_components(rows, "_cols", len(cols), keep)


def value_field(points, x: str, y: str, v: str, gridsize=250, sigma=0.25, padding=0.06, low_support=0.02) -> DataFrame:
    """Gaussian-weighted mean of ``v`` on a grid; cells in the lowest support percentile are null.

    The kernel factors into x and y, so a batch of points adds two small matrix
    products to its partition's grid; one grid per partition is summed by cell.
    """
    clean = points.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(v).isNotNull()).select(
        F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(v).cast("double").alias("v"))
    box = clean.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if box[0] is None:
        return points.sparkSession.createDataFrame([], "ix int, iy int, x double, y double, value double, support double")
    dx, dy = (box[1] - box[0]) * padding, (box[3] - box[2]) * padding
    xs = np.linspace(box[0] - dx, box[1] + dx, gridsize)
    ys = np.linspace(box[2] - dy, box[3] + dy, gridsize)
    var = sigma**2 if sigma > 0 else 1e-6

    def run(batches):
        num, den = np.zeros((gridsize, gridsize)), np.zeros((gridsize, gridsize))
        for pdf in batches:
            a = np.exp(-0.5 * (xs[None] - pdf["x"].to_numpy()[:, None]) ** 2 / var)
            b = np.exp(-0.5 * (ys[None] - pdf["y"].to_numpy()[:, None]) ** 2 / var)
            num += (a * pdf["v"].to_numpy()[:, None]).T @ b
            den += a.T @ b
        i, j = np.meshgrid(np.arange(gridsize), np.arange(gridsize), indexing="ij")
        yield pd.DataFrame({"ix": i.ravel().astype("int32"), "iy": j.ravel().astype("int32"), "num": num.ravel(), "den": den.ravel()})

    cells = clean.mapInPandas(run, "ix int, iy int, num double, den double").groupBy("ix", "iy").agg(
        F.sum("num").alias("_num"), F.sum("den").alias("support"))
    cut = quantiles(cells, [], {"_thr": ("support", low_support)}).first()["_thr"]
    return cells.select(
        "ix", "iy",
        (F.lit(float(xs[0])) + F.col("ix") * float(xs[1] - xs[0])).alias("x"),
        (F.lit(float(ys[0])) + F.col("iy") * float(ys[1] - ys[0])).alias("y"),
        F.when(F.col("support") >= cut, F.col("_num") / F.greatest(F.col("support"), F.lit(1e-12))).alias("value"), "support",
    )
