"""Model selection over experiment predictions, patient gates and feature votes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from onsetry.operators import ranking as R


def min_positive_gate(df, n: int, patient="patient", recording="seizure_id", node="node_index",
                      label="is_soz") -> DataFrame:
    """patients whose every recording has at least ``n`` distinct positive channels."""
    per = df.groupBy(patient, recording).agg(
        F.count_distinct(F.when(F.coalesce(F.col(label).cast("int"), F.lit(0)) == 1, F.col(node))).alias("_n")
    )
    return per.groupBy(patient).agg(F.min("_n").alias("min_positive")).where(F.col("min_positive") >= n)


def min_recordings_gate(df, n: int, patient="patient", recording="seizure_id") -> DataFrame:
    """patients with at least ``n`` recordings."""
    return df.groupBy(patient).agg(F.count_distinct(recording).alias("n_seizures")).where(F.col("n_seizures") >= n)


def keep_patients(df: DataFrame, gate: DataFrame, patient="patient") -> DataFrame:
    return df.join(gate.select(patient), patient, "left_semi")


def best_by_metric(metrics: DataFrame, metric: str, by=("patient",), model=("run", "experiment"),
                   mode: str = "max") -> DataFrame:
    """Best row per patient; equal values keep the first model in (run, experiment) order.

    One aggregate over a struct, so it is combined before the shuffle.
    """
    if mode not in ("max", "min"):
        raise ValueError("mode must be 'max' or 'min'")
    key = -F.col(metric) if mode == "max" else F.col(metric)
    rest = [c for c in metrics.columns if c not in (*by, *model)]
    best = (
        metrics.where(F.col(metric).isNotNull())
        .groupBy(*by)
        .agg(F.min(F.struct(key.alias("_k"), *model, *rest)).alias("_b"))
    )
    return best.select(*by, *[F.col(f"_b.{c}").alias(c) for c in (*model, *rest)])


def best_model_by_f1(preds: DataFrame, pct: int = 10, model=("run", "experiment")) -> DataFrame:
    """M1: metrics of every (patient, run, experiment), then the best F1 per patient."""
    by = ["patient", *model]
    metrics = R.patient_metrics(preds, by=by, group=R.GROUP)
    return best_by_metric(metrics, f"f1_top{pct}", model=model)


def best_by_fold_metric(folds: DataFrame, metric: str, mode="max", gate: DataFrame | None = None,
                        patients="val_patients") -> DataFrame:
    """M2: fold rows list their validation patients as comma text; best fold per patient."""
    rows = folds.withColumn("patient", F.explode(F.split(F.col(patients), ","))).withColumn(
        "patient", F.trim("patient")
    ).where("patient <> ''").drop(patients)
    if gate is not None:
        rows = rows.join(gate, "patient", "left_semi")
    return best_by_metric(rows, metric, mode=mode)


def most_frequent_model(best: DataFrame, model=("run", "experiment")) -> DataFrame:
    """M3: the combination chosen for most patients."""
    counts = best.groupBy(*model).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), *model).limit(1)


def selected_predictions(preds, best, model=("run", "experiment"), collapsed=False) -> DataFrame:
    """M4: prediction rows of each patient's best model, raw or one per node."""
    keys = ["patient", *model]
    rows = preds.join(best.select(*keys), keys)
    return R.collapse_nodes(rows, [*R.GROUP, *model]) if collapsed else rows


def feature_votes(selected: DataFrame, by=(), feature="feature", patient="patient", top: int | None = None) -> DataFrame:
    """M5: distinct patients that selected a feature."""
    votes = selected.groupBy(*by, feature).agg(F.count_distinct(patient).alias("n_patients"))
    return votes.orderBy(F.desc("n_patients"), feature).limit(top) if top else votes


def prediction_output(preds: DataFrame, fold: str, level: str, **kw) -> DataFrame:
    """Ranked predictions of all folds measured per fold, per patient or overall."""
    keys = {"fold": [fold], "patient": ["patient"], "global": []}[level]
    return R.level_metrics(preds, keys, **kw)
