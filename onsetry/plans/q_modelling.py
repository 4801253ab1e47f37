"""Queries for training, calibration and scoring."""

from pyspark.sql import functions as F

from onsetry.operators import modelling as M
from onsetry.operators import traces as T
from onsetry.plans.bindings import NODE, PRED, TRACE, predictions, traces
from onsetry.plans.registry import query, r

GROUP = ["patient", "seizure_id"]
COLS = ["mean", "std", "median", "max", "range", "iqr", "slope_mean", "area", "time_to_peak", "fft_energy", "spectral_entropy"]
# every base feature, and three relative ones of each
BASE = ["n_steps", "mean", "std", "min", "max", "median", "range", "iqr", "slope_mean", "slope_std", "area", "time_to_peak", "rise_time",
        "decay_time", "fft_peak_freq", "fft_energy", "spectral_entropy"]
ALL = [f"{c}{s}" for c in BASE for s in ("", "_rel", "_z", "_rank")]
EXP = M.EXPERIMENTS[0]
MAX_FITS = 20  # up to so many patients each is held out alone; more share folds by hash


def _features(spark, d):
    return T.trace_features(traces(spark, d), NODE)


def _all_features(spark, d):
    f = M.durable(_features(spark, d))  # several branches read it; the plans of the later steps start here
    f = f.withColumns({c: F.col(c).cast("double") for c in BASE})
    return M.N.relative_features(f, GROUP, ["node_index", "is_soz", "is_flat_zero"], BASE)


@query("M6_lopo_folds", f"WITH {PRED}, f AS (SELECT patient, dense_rank() OVER (ORDER BY patient) AS fold FROM (SELECT DISTINCT patient FROM pred)), c AS (SELECT patient, count(*) AS n_val FROM pred GROUP BY ALL) SELECT patient, fold, n_val, (SELECT count(*) FROM pred) - n_val AS n_train FROM f JOIN c USING (patient)")
def m6(spark, d):
    p = predictions(spark, d)
    n = p.groupBy("patient").agg(F.count(F.lit(1)).alias("n_val"))
    return M.leave_one_out(p).join(n, "patient").withColumn("n_train", F.lit(p.count()) - F.col("n_val"))


@query("M7_calibration_patients", f"""WITH {PRED}, q AS (SELECT DISTINCT patient FROM pred)
SELECT patient FROM q QUALIFY row_number() OVER (ORDER BY md5(concat_ws('|', patient, 42)), patient) <= ceil(0.1::DOUBLE * (SELECT count(*) FROM q))""")
def m7(spark, d):
    return M.calibration_patients(predictions(spark, d), 0.1, 42)


@query("M8_class_weights", f"WITH {PRED}, c AS (SELECT is_soz, count(*) AS n FROM pred GROUP BY ALL) SELECT is_soz, n, {r('(SELECT sum(n) FROM c) / (2.0 * n)', 'w')} FROM c")
def m8(spark, d):
    return M.class_weights(predictions(spark, d), name="w").groupBy("is_soz").agg(F.count(F.lit(1)).alias("n"), F.max("w").alias("w"))


@query("M9_M13_lopo_predictions")
def m9(spark, d):
    return M.leave_one_out_predictions(_all_features(spark, d), ALL, EXP, GROUP, max_fits=MAX_FITS).select(
        *GROUP, "node_index", "is_soz", "y_score", "fold", "rank")


@query("M10_l1_features")
def m10(spark, d):
    f = M.N.group_zscore(M.durable(_features(spark, d)), GROUP, COLS)
    picked = M.l1_features(f, COLS, C=0.05, max_features=6)
    return f.agg(*[F.avg(c).alias(c) for c in picked]).unpivot([], picked, "feature", "mean")


@query("M11_logit_shift", f"""WITH {PRED}, rw AS (SELECT run, is_soz, 6 * y_score - 5 AS raw FROM pred), g AS (SELECT -2 + i * 0.1::DOUBLE AS delta FROM range(0, 81) t(i)),
m AS (SELECT run, delta, avg(1 / (1 + exp(-(raw + delta)))) FILTER (is_soz = 1) AS mp, avg(1 / (1 + exp(-(raw + delta)))) FILTER (is_soz = 0) AS mn FROM rw, g GROUP BY ALL)
SELECT run, {r('delta')}, {r('mp', 'mean_pos')}, {r('mn', 'mean_neg')}, mn <= 0.3 AS feasible FROM m
QUALIFY row_number() OVER (PARTITION BY run ORDER BY mn > 0.3, round(greatest(0, mn - 0.3), 12), mp DESC, mn, delta) = 1""")
def m11(spark, d):
    p = predictions(spark, d).withColumn("raw", 6 * F.col("y_score") - 5)
    return M.choose_shift(p, ["run"], cap=0.3)


@query("M12_score_new_patients")
def m12(spark, d):
    f = M.durable(_all_features(spark, d))
    fitted = M.fit(M.prepare(f.where("patient < 5"), ALL, EXP, GROUP), ALL, EXP, GROUP, calibrate=0.2)
    return M.apply_to_new(f.where("patient >= 5"), fitted, EXP, ALL, GROUP)
