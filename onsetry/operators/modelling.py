"""Training and applying the channel classifier: folds, weights, selection, calibration."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, functions as F

from onsetry.functions.scalars import seeded, seeded_number, sigmoid
from onsetry.operators import normalize as N
from onsetry.operators.boosting import Growth, fit_folds, raw_scores
from onsetry.operators.grouped import numbered
from onsetry.operators.lineage import durable
from onsetry.operators.ranking import GROUP, rank_rows

# fixed values: calibration grid and cap
DELTA_MIN, DELTA_MAX, DELTA_STEPS, NEG_MEAN_CAP = -2.0, 6.0, 81, 0.05


@dataclass(frozen=True)
class Experiment:
    """M9: settings of one classifier run."""

    name: str
    group_zscore: bool = True
    groups_with_positive_only: bool = True
    leaves: int = 63
    learning_rate: float = 0.05
    rounds: int = 800
    row_share: float = 0.9
    column_share: float = 0.9
    min_leaf: int = 20
    l2: float = 0.0
    patience: int = 80

    def growth(self) -> Growth:
        return Growth(self.leaves, self.learning_rate, self.rounds, self.row_share, self.column_share, self.min_leaf, self.l2, self.patience)


# fixed values: names and settings of the five published configurations
EXPERIMENTS = (
    Experiment("exp1_binary_groupnorm_baseline"),
    Experiment("exp2_binary_deeper_lowlr", leaves=127, learning_rate=0.03, rounds=1200),
    Experiment("exp3_binary_more_reg", row_share=0.8, column_share=0.8, min_leaf=40, l2=0.2),
    Experiment("exp4_binary_no_norm_keep_all_groups", group_zscore=False, groups_with_positive_only=False),
    Experiment("exp5_binary_small_model_heavy_dropout", leaves=31, row_share=0.7, column_share=0.4, min_leaf=60),
)


def leave_one_out(df: DataFrame, patient="patient") -> DataFrame:
    """M6: fold number of every patient, from 1."""
    out = numbered(df.select(patient).distinct().withColumn("_k", F.lit(0)), ["_k"], [patient], "fold")
    return out.select(patient, "fold")


def calibration_patients(df: DataFrame, share: float, seed: int, patient="patient") -> DataFrame:
    """M7: a seeded choice of ceil(share * n) patients."""
    people = df.select(patient).distinct().withColumn("_k", F.lit(0))
    k = math.ceil(share * people.count())
    return numbered(people, ["_k"], [seeded(patient, seed=seed), patient], "_r").where(F.col("_r") <= k).select(patient)


def class_weights(df: DataFrame, label="is_soz", name="_w") -> DataFrame:
    """M8: n / (2 n_class) per row."""
    n = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(n.values())
    w = F.lit(None).cast("double")
    for cls, count in n.items():
        w = F.when(F.col(label) == cls, F.lit(total / (2.0 * count))).otherwise(w)
    return df.withColumn(name, w)


def _vectors(df: DataFrame, cols: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=cols, outputCol="_x", handleInvalid="keep").transform(df)


def l1_features(df: DataFrame, cols: list[str], label="is_soz", C=0.05, max_features: int | None = None) -> list[str]:
    """Columns with a non-zero L1 coefficient, capped by size; all if none is left."""
    filled, varying, _ = N.clean_matrix(df, cols)
    rows = class_weights(filled, label).withColumn("_y", F.col(label).cast("double"))
    total = rows.agg(F.sum("_w")).first()[0] or 1.0
    fit = LogisticRegression(
        featuresCol="_x", labelCol="_y", weightCol="_w", elasticNetParam=1.0, standardization=False,
        regParam=1.0 / (C * total), maxIter=200,
    ).fit(_vectors(rows, varying))
    size = sorted(zip(varying, map(abs, fit.coefficients.toArray())), key=lambda p: (-p[1], p[0]))
    picked = [c for c, s in size if s > 1e-12]
    if not picked:
        return varying
    chosen = set(picked[:max_features] if max_features else picked)
    return [c for c in varying if c in chosen]


def choose_shift(df: DataFrame, by: list[str] | None = None, raw="raw", label="is_soz", cap=NEG_MEAN_CAP,
                 lo=DELTA_MIN, hi=DELTA_MAX, steps=DELTA_STEPS) -> DataFrame:
    """The shift delta of sigmoid(raw + delta).

    Among shifts whose mean negative score is within the cap: highest mean
    positive score, then lowest mean negative, then smallest delta.  If none is,
    the least violation first.  Without both classes delta is 0.
    """
    by = by or []
    grid = [lo + i * (hi - lo) / (steps - 1) for i in range(steps)]
    rows = df.select(*by, raw, label).withColumn("delta", F.explode(F.array(*[F.lit(g) for g in grid])))
    p = sigmoid(F.col(raw) + F.col("delta"))
    means = rows.groupBy(*by, "delta").agg(
        F.avg(F.when(F.col(label) == 1, p)).alias("mean_pos"), F.avg(F.when(F.col(label) == 0, p)).alias("mean_neg"))
    over = F.greatest(F.lit(0.0), F.col("mean_neg") - cap)
    key = F.struct(
        (F.col("mean_neg") > cap).alias("a"), F.round(over, 12).alias("b"), (-F.col("mean_pos")).alias("c"),
        F.col("mean_neg").alias("d"), F.col("delta").alias("e"),
    )
    best = means.groupBy(*by).agg(F.min(F.when(F.col("mean_pos").isNotNull() & F.col("mean_neg").isNotNull(), key)).alias("_b"))
    return best.select(
        *by, F.coalesce(F.col("_b.e"), F.lit(0.0)).alias("delta"), (-F.col("_b.c")).alias("mean_pos"),
        F.col("_b.d").alias("mean_neg"), (~F.col("_b.a")).alias("feasible"),
    )


@dataclass
class Fitted:
    """Everything needed to score new patients."""

    model: bytes
    columns: list[str]
    delta: float
    group_zscore: bool
    rounds: int


def prepare(df: DataFrame, cols: list[str], exp: Experiment, group=GROUP, label="is_soz") -> DataFrame:
    """F4 and B8 once for all folds: both depend on the row's own group only."""
    out = N.drop_flat_positives(df, label) if "is_flat_zero" in df.columns else df
    out = out.withColumns({c: N.finite(c) for c in cols})
    return N.group_zscore(out, group, cols) if exp.group_zscore else out


def fit_all(table: DataFrame, cols: list[str], exp: Experiment, folds: int, group=GROUP, label="is_soz", rounds=None, seed=42,
            l1_c: float | None = None, max_features=None, selected: list[str] | None = None, calibrate=0.1, patient="patient") -> dict[int, Fitted]:
    """M8-M11 for every fold at once, on all prepared rows, which have a ``fold``.

    Models and shifts, ``folds`` rows, come to the driver.
    """
    rows = N.groups_with_positive(table, group, label) if exp.groups_with_positive_only else table
    rows = rows.withColumns({"_watch": F.abs(F.hash(*group)), "_order": seeded(patient, seed=seed)})
    use = selected or cols
    how = exp.growth() if rounds is None else replace(exp.growth(), rounds=rounds)
    out = durable(fit_folds(rows, use, how, folds=folds, fold="fold", label=label, watch="_watch", patient=patient, order="_order",
                            calibrate=calibrate, seed=seed, l1_c=None if selected else l1_c, max_features=max_features))
    shifts = {}
    if calibrate:
        shifts = {r["fold"]: r["delta"] for r in choose_shift(out.where("model is null"), ["fold"], label="label").collect()}
    return {r["fold"]: Fitted(bytes(r["model"]), use, shifts.get(r["fold"], 0.0), exp.group_zscore, r["rounds"])
            for r in out.where("model is not null").select("fold", "model", "rounds").collect()}


def fit(train: DataFrame, cols: list[str], exp: Experiment, group=GROUP, label="is_soz", **fit_args) -> Fitted | None:
    """M8-M11 on prepared training rows; None without any."""
    return fit_all(train.withColumn("fold", F.lit(None).cast("int")), cols, exp, 1, group, label, **fit_args).get(1)


def score(df: DataFrame, fitted: dict[int, Fitted], fold="fold") -> DataFrame:
    """Impute with the fitted medians, score, shift, each row by the model of its ``fold``."""
    if not fitted:
        return df.withColumns({"raw": F.lit(None).cast("double"), "y_score": F.lit(None).cast("double")})
    cols = next(iter(fitted.values())).columns
    out = raw_scores(df, {k: f.model for k, f in fitted.items()}, cols, fold)
    delta = F.create_map(*[F.lit(x) for k, f in fitted.items() for x in (k, f.delta)])
    return out.withColumn("y_score", sigmoid(F.col("raw") + F.try_element_at(delta, F.col(fold).cast("int"))))


def leave_one_out_predictions(df: DataFrame, cols: list[str], exp: Experiment, group=GROUP, label="is_soz",
                              keep=("node_index",), select_on_all=False, l1_c=None, max_fits: int = 20,
                              **fit_args) -> DataFrame:
    """Every patient scored by a model trained on the others, ranked in its groups.

    With more than ``max_fits`` patients, patients are dealt by hash to that many folds, and every row is scored by a
    model trained on the other folds: so many models are fitted at most, side by side, and no list of patients reaches
    the driver.

    The prepared table is cut from its lineage once and read by all folds.
    ``select_on_all`` repeats the published order, in which features are selected
    before the folds; the default selects inside each fold.
    """
    table = durable(prepare(df, cols, exp, group, label))
    folds = leave_one_out(table)
    n = folds.count()
    if n > max_fits:
        folds = folds.withColumn("fold", (seeded_number("patient", seed=42, below=max_fits) + 1).cast("int"))
    table = durable(table.join(folds, "patient"))
    chosen = l1_features(table, cols, label, l1_c) if select_on_all and l1_c else None
    fitted = fit_all(table, cols, exp, max(1, min(n, max_fits)), group, label, l1_c=l1_c, selected=chosen, **fit_args)
    # ranking counts its rows first; rows are scored once
    return rank_rows(durable(score(table, fitted).select(*group, *keep, label, "y_score", "fold")), group)


def apply_to_new(df: DataFrame, fitted: Fitted, exp: Experiment, cols: list[str], group=GROUP, label="is_soz",
                 keep=("node_index",)) -> DataFrame:
    """Prepare, score and rank patients the model has not seen."""
    for c in cols:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("double"))
    rows = prepare(df, cols, exp, group, label).withColumn("fold", F.lit(1))
    return rank_rows(durable(score(rows, {1: fitted} if fitted else {}).select(*group, *keep, label, "y_score")), group)
