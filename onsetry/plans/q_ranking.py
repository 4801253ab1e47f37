"""Queries for ranking metrics (R), model selection (M1-M5, M13) and their joins."""

from pyspark.sql import functions as F

from onsetry.operators import ranking as R
from onsetry.operators import selection as M
from onsetry.operators.grouped import hot_groups
from onsetry.operators.lineage import durable
from onsetry.plans.bindings import (
    FEATS, GROUP, NODES, PANEL_LONG, PANEL, PRED, RANKED, panel_long, predictions, table,
)
from onsetry.plans.registry import query, r

G = "patient, seizure_id, seq_idx"


def gm_sql(src: str, keys: str = G, tie: str = "node_index", name: str = "gm") -> str:
    """Per-group metrics: areas by rank sums, top fractions by row numbers."""
    return f"""{name}0 AS (
 SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY y_score DESC, {tie}) AS rk,
  count(*) OVER (PARTITION BY {keys}) AS n,
  rank() OVER (PARTITION BY {keys} ORDER BY y_score) AS rlo,
  count(*) OVER (PARTITION BY {keys}, y_score) AS ties FROM {src} WHERE y_score IS NOT NULL),
{name}1 AS (
 SELECT *, greatest(1, ceil(CAST(0.1 AS DOUBLE) * n)) AS k10, greatest(1, ceil(CAST(0.2 AS DOUBLE) * n)) AS k20 FROM {name}0),
{name}2 AS (
 SELECT {keys}, max(n) AS n, sum(is_soz) AS p, max(n) - sum(is_soz) AS q, max(k10) AS k10, max(k20) AS k20,
  sum(CASE WHEN rk <= k10 THEN is_soz ELSE 0 END) AS tp10, sum(CASE WHEN rk <= k20 THEN is_soz ELSE 0 END) AS tp20,
  max(CASE WHEN rk <= k10 AND is_soz = 1 THEN rk END) AS last10, max(CASE WHEN rk <= k20 AND is_soz = 1 THEN rk END) AS last20,
  min(CASE WHEN is_soz = 1 THEN rk END) AS first_rank,
  avg(CASE WHEN is_soz = 1 THEN y_score END) AS mp, avg(CASE WHEN is_soz = 0 THEN y_score END) AS mn,
  sum(CASE WHEN is_soz = 1 THEN rlo + (ties - 1) / 2.0 ELSE 0 END) AS ranksum,
  sum((is_soz - y_score) * (is_soz - y_score)) AS sq
 FROM {name}1 GROUP BY {keys}),
{name}3 AS (
 SELECT *, CASE WHEN p > 0 AND q > 0 THEN (ranksum - p * (p + 1) / 2.0) / (p * q) END AS auc, mp - mn AS gap,
  CASE WHEN tp10 = 0 THEN 0.0 ELSE tp10 * 1.0 / last10 END AS p10, CASE WHEN p > 0 THEN tp10 * 1.0 / p ELSE 0.0 END AS r10,
  CASE WHEN tp20 = 0 THEN 0.0 ELSE tp20 * 1.0 / last20 END AS p20, CASE WHEN p > 0 THEN tp20 * 1.0 / p ELSE 0.0 END AS r20
 FROM {name}2),
{name} AS (
 SELECT *, CASE WHEN p10 + r10 > 0 THEN 2 * p10 * r10 / (p10 + r10) ELSE 0 END AS f10,
  CASE WHEN p20 + r20 > 0 THEN 2 * p20 * r20 / (p20 + r20) ELSE 0 END AS f20 FROM {name}3)"""


PATIENT_COLS = ", ".join([
    r("avg(mp)", "mean_score_pos"), r("avg(mn)", "mean_score_neg"), r("avg(gap)", "confidence_gap"),
    r("avg(p10)", "precision_top10"), r("avg(r10)", "recall_top10"), r("avg(f10)", "f1_top10"),
    r("avg(p20)", "precision_top20"), r("avg(r20)", "recall_top20"), r("avg(f20)", "f1_top20"),
    r("avg(auc)", "auc_group_mean"), "count(*) AS num_groups_used", "count(auc) AS num_auc_groups_used",
])
BASE = f"WITH {PRED}, {NODES}, {RANKED}"
GATE = """gate AS (SELECT patient FROM (
 SELECT patient, seizure_id, count(DISTINCT CASE WHEN is_soz = 1 THEN node_index END) AS c FROM pred GROUP BY ALL)
 GROUP BY patient HAVING min(c) >= {n})"""


def _hot(spark, d):
    return hot_groups(predictions(spark, d), GROUP)


def _hot_patients(spark, d):
    return hot_groups(predictions(spark, d), ["patient"])


def _nodes(spark, d):
    return R.collapse_nodes(predictions(spark, d))


def _ranked(spark, d):
    return R.rank_rows(_nodes(spark, d), hot=_hot(spark, d))


# ------------------------------------------------------------------- flagship
@query("flagship_patient_audit", f"""{BASE}, {gm_sql('nodes')}, {GATE.format(n=2)},
rng AS (SELECT patient, {r('min(mp)', 'min_score_pos')}, {r('min(mn)', 'min_score_neg')}, {r('min(gap)', 'min_gap')},
 {r('max(mp)', 'max_score_pos')}, {r('max(mn)', 'max_score_neg')}, {r('max(gap)', 'max_gap')} FROM gm GROUP BY patient),
m AS (SELECT patient, {PATIENT_COLS} FROM gm GROUP BY patient)
SELECT * FROM m JOIN rng USING (patient) JOIN gate USING (patient)""")
def flagship(spark, d):
    # one scan: the gate and the sizes of groups follow from the nodes
    nodes = durable(_nodes(spark, d))
    kept = M.keep_patients(nodes, M.min_positive_gate(nodes, 2))
    gm = R.with_topk_scores(R.group_metrics(kept, hot=hot_groups(nodes, GROUP)))
    return gm.groupBy("patient").agg(*[
        F.avg(c).alias(a) for c, a in [
            ("mean_pos", "mean_score_pos"), ("mean_neg", "mean_score_neg"), ("gap", "confidence_gap"),
            ("precision10", "precision_top10"), ("recall10", "recall_top10"), ("f1_10", "f1_top10"),
            ("precision20", "precision_top20"), ("recall20", "recall_top20"), ("f1_20", "f1_top20"),
            ("auc", "auc_group_mean"),
        ]
    ], F.count(F.lit(1)).alias("num_groups_used"), F.count("auc").alias("num_auc_groups_used"), *[
        fn(c).alias(f"{p}_{a}") for p, fn in (("min", F.min), ("max", F.max))
        for c, a in (("mean_pos", "score_pos"), ("mean_neg", "score_neg"), ("gap", "gap"))
    ])


# ------------------------------------------------------------------------- R
@query("R1_rank", f"WITH {PRED} SELECT patient, seizure_id, seq_idx, node_index, row_id, {r('y_score')}, "
       f"row_number() OVER (PARTITION BY {G} ORDER BY y_score DESC, node_index, row_id) AS rank FROM pred")
def r1(spark, d):
    return R.rank_rows(predictions(spark, d), tie=("row_id",)).select(
        *GROUP, "node_index", "row_id", "y_score", "rank")


@query("R2_collapse", f"WITH {PRED}, {NODES} SELECT {G}, node_index, {r('y_score')}, is_soz FROM nodes")
def r2(spark, d):
    return _nodes(spark, d)


@query("R3_topk_flags", f"""{BASE}, f AS (SELECT *, greatest(1, ceil(CAST(0.1 AS DOUBLE) * n)) AS k10,
 greatest(1, ceil(CAST(0.2 AS DOUBLE) * n)) AS k20 FROM ranked)
SELECT {G}, node_index, {r('y_score')}, is_soz, rank, n, CAST(k10 AS BIGINT) AS k10, CAST(k20 AS BIGINT) AS k20,
 rank <= k10 AS in_top10, rank <= k20 AS in_top20 FROM f""")
def r3(spark, d):
    return R.top_flags(_nodes(spark, d), hot=_hot(spark, d))


@query("R4_prf_topk", f"""{BASE}, {gm_sql('nodes')}, c AS (
 SELECT *, tp10 / k10 AS cp10, tp20 / k20 AS cp20 FROM gm)
SELECT {G}, {r('p10', 'precision10')}, {r('r10', 'recall10')}, {r('f10', 'f1_10')}, {r('p20', 'precision20')},
 {r('r20', 'recall20')}, {r('f20', 'f1_20')}, {r('cp10', 'classic_precision10')},
 {r('CASE WHEN cp10 + r10 > 0 THEN 2 * cp10 * r10 / (cp10 + r10) ELSE 0 END', 'classic_f1_10')} FROM c""")
def r4(spark, d):
    gm = R.with_topk_scores(R.group_metrics(_nodes(spark, d), hot=_hot(spark, d)))
    classic = R.topk_scores(gm, 10, "classic")
    return gm.select(*GROUP, "precision10", "recall10", "f1_10", "precision20", "recall20", "f1_20",
                     classic["precision10"].alias("classic_precision10"), classic["f1_10"].alias("classic_f1_10"))


@query("R5_auc_group", f"{BASE}, {gm_sql('nodes')} SELECT {G}, {r('auc')}, CAST(p AS BIGINT) AS n_pos, CAST(q AS BIGINT) AS n_neg FROM gm")
def r5(spark, d):
    return R.group_metrics(_nodes(spark, d), fracs=(), hot=_hot(spark, d)).select(*GROUP, "auc", "n_pos", "n_neg")


@query("R6_patient_metrics", f"{BASE}, {gm_sql('nodes')} SELECT patient, {PATIENT_COLS} FROM gm GROUP BY patient")
def r6(spark, d):
    return R.patient_metrics(predictions(spark, d))


def level_sql(level: str, keys: str = G, pred: str = PRED) -> str:
    lead = f"{level}, " if level else ""
    group = f"GROUP BY {level}" if level else ""
    return f"""WITH {pred}, {gm_sql('pred', keys, 'node_index, row_id')}
SELECT {lead}{r('avg(tp10 / k10)', 'precision_top10')}, {r('avg(CASE WHEN p > 0 THEN tp10 * 1.0 / p ELSE 1.0 END)', 'recall_top10')},
 {r('avg(CASE WHEN p > 0 THEN (tp10 / k10) / (p * 1.0 / n) END)', 'enrichment_top10')},
 {r('avg(tp20 / k20)', 'precision_top20')}, {r('avg(CASE WHEN p > 0 THEN tp20 * 1.0 / p ELSE 1.0 END)', 'recall_top20')},
 {r('avg(CASE WHEN p > 0 THEN (tp20 / k20) / (p * 1.0 / n) END)', 'enrichment_top20')},
 {r('avg(auc)', 'auc_group_mean')}, count(*) AS num_groups_eval, {r('sum(sq) / sum(n)', 'brier')},
 {r('sum(mp * p) / sum(CASE WHEN p > 0 THEN p END)', 'mean_score_pos_global')}, {r('sum(mn * q) / sum(CASE WHEN q > 0 THEN q END)', 'mean_score_neg_global')},
 {r('sum(mp * p) / sum(CASE WHEN p > 0 THEN p END) - sum(mn * q) / sum(CASE WHEN q > 0 THEN q END)', 'gap_global')},
 {r('avg(gap)', 'gap_group_mean')}, {r('median(gap)', 'gap_group_median')}, {r('min(gap)', 'gap_group_min')},
 {r('max(gap)', 'gap_group_max')}, count(gap) AS gap_num_groups FROM gm {group}"""


@query("R7_level_metrics_global", level_sql(""))
def r7(spark, d):
    return R.level_metrics(predictions(spark, d), [], tie=("row_id",))


@query("M13_metrics_per_patient", level_sql("patient"))
def m13_patient(spark, d):
    return M.prediction_output(predictions(spark, d), "fold", "patient", tie=("row_id",))


@query("M13_metrics_per_fold", level_sql("fold", "fold, " + G, PRED.replace("AS run,", "AS fold,")))
def m13_fold(spark, d):
    return M.prediction_output(predictions(spark, d).withColumnRenamed("run", "fold"), "fold", "fold", tie=("row_id",))


@query("R8_topk_retrieval", f"""{BASE}, h AS (
 SELECT *, sum(is_soz) OVER (PARTITION BY {G}) AS p,
  sum(is_soz) OVER (PARTITION BY {G} ORDER BY rank) AS hits FROM ranked),
ks AS (SELECT unnest([1, 3, 5, 10, 20]) AS k),
a AS (SELECT {G}, k, max(n) AS n, max(p) AS p, max(n) - max(p) AS q, least(k, max(n)) AS ke,
  sum(CASE WHEN rank <= k THEN is_soz ELSE 0 END) AS tp,
  sum(CASE WHEN rank <= k THEN is_soz / log2(rank + 1) ELSE 0 END) AS dcg,
  sum(CASE WHEN rank <= k THEN is_soz * hits / rank ELSE 0 END) AS ap
  FROM h CROSS JOIN ks GROUP BY {G}, k),
ideals AS (SELECT {G}, k, sum(1 / log2(i + 1)) AS ideal FROM a, range(1, 21) t(i) WHERE i <= least(a.k, a.p) GROUP BY ALL),
misses AS (SELECT {G}, k, exp(sum(ln((q - i) * 1.0 / (n - i)))) AS miss FROM a, range(0, 20) t(i) WHERE i < ke AND ke <= q GROUP BY ALL),
b AS (SELECT *, 1 - coalesce(miss, 0) AS he, tp * 1.0 / ke AS prec, CASE WHEN q > 0 THEN (ke - tp) * 1.0 / q END AS fp, p * 1.0 / n AS pe,
  CASE WHEN tp > 0 THEN 1.0 ELSE 0.0 END AS ht FROM a LEFT JOIN ideals USING ({G}, k) LEFT JOIN misses USING ({G}, k)),
c AS (SELECT *, CASE WHEN p > 0 THEN he ELSE 0 END AS hexp, CASE WHEN q > 0 THEN ke * 1.0 / n END AS fe FROM b)
SELECT k, {r('avg(coalesce(dcg / ideal, 0))', 'ndcg')}, {r('avg(ap / greatest(1, tp))', 'map')},
 {r('avg(CASE WHEN p > 0 THEN tp * 1.0 / p ELSE 1.0 END)', 'recall')}, {r('avg(ht)', 'hit')}, {r('avg(prec)', 'precision')},
 {r('avg(fp)', 'fpr')}, {r('avg(1 - fp)', 'specificity')},
 {r('avg(CASE WHEN hexp < 1 THEN (ht - hexp) / (1 - hexp) END)', 'hit_corrected')},
 {r('avg(CASE WHEN pe < 1 THEN (prec - pe) / (1 - pe) END)', 'precision_corrected')},
 {r('avg(CASE WHEN fe < 1 THEN (fp - fe) / (1 - fe) END)', 'fpr_corrected')},
 {r('avg(CASE WHEN fe < 1 THEN 1 - (fp - fe) / (1 - fe) END)', 'specificity_corrected')}, count(*) AS num_groups
FROM c GROUP BY k""")
def r8(spark, d):
    return R.retrieval_summary(_nodes(spark, d))


def rank_stats_sql(pre=""):
    return (f"{r('avg(x)', 'mean_rank')}, {r('median(x)', 'median_rank')}, {r('quantile_cont(x, 0.25)', 'q25_rank')}, "
            f"{r('quantile_cont(x, 0.75)', 'q75_rank')}, {r('quantile_cont(x, 0.75) - quantile_cont(x, 0.25)', 'iqr_rank')}")


@query("R9_first_positive_rank", f"""{BASE}, f AS (SELECT {G}, CAST(min(CASE WHEN is_soz = 1 THEN rank END) AS DOUBLE) AS x,
 count(DISTINCT node_index) AS e FROM ranked GROUP BY ALL)
SELECT patient, {rank_stats_sql()}, count(x) AS num_groups_with_soz, count(DISTINCT seizure_id) AS num_seizures,
 max(e) AS max_electrodes FROM f GROUP BY patient""")
def r9(spark, d):
    return R.first_positive_ranks(_ranked(spark, d), hot=_hot_patients(spark, d))


@query("R10_all_positive_ranks", f"""{BASE}, g AS (SELECT {G}, count(DISTINCT node_index) AS e,
 count(DISTINCT CASE WHEN is_soz = 1 THEN node_index END) AS s FROM ranked GROUP BY ALL),
z AS (SELECT patient, count(CASE WHEN s > 0 THEN 1 END) AS num_groups_with_soz, count(DISTINCT seizure_id) AS num_seizures,
 max(e) AS max_electrodes, max(s) AS max_soz_electrodes FROM g GROUP BY patient),
x AS (SELECT patient, {rank_stats_sql()} FROM (SELECT patient, CAST(rank AS DOUBLE) AS x FROM ranked WHERE is_soz = 1) GROUP BY patient)
SELECT * FROM z LEFT JOIN x USING (patient)""")
def r10(spark, d):
    return R.all_positive_ranks(_ranked(spark, d), hot=_hot_patients(spark, d))


@query("R11_positive_ranks", f"{BASE} SELECT {G}, node_index, rank FROM ranked WHERE is_soz = 1")
def r11(spark, d):
    return R.positive_ranks(_ranked(spark, d))


REC_NODES = """rn AS (SELECT patient, seizure_id, node_index, max(y_score) AS y_score, max(is_soz) AS is_soz FROM pred GROUP BY ALL)"""


def gap_sql(src, cond="TRUE", keys="patient, seizure_id", suffix=""):
    return f"""SELECT patient, {r('avg(p)', 'mean_score_pos' + suffix)}, {r('avg(q)', 'mean_score_neg' + suffix)},
 {r('avg(p - q)', 'confidence_gap' + suffix)} FROM (SELECT {keys}, avg(CASE WHEN is_soz = 1 THEN y_score END) AS p,
 avg(CASE WHEN is_soz = 0 THEN y_score END) AS q FROM {src} WHERE {cond} GROUP BY {keys}) GROUP BY patient"""


@query("R12_recording_gap", f"WITH {PRED}, {REC_NODES} {gap_sql('rn')}")
def r12(spark, d):
    return R.recording_gap(predictions(spark, d))


@query("R13_top_gap_recording", f"""WITH {PRED}, {REC_NODES}, f AS (SELECT *,
 row_number() OVER (PARTITION BY patient, seizure_id ORDER BY y_score DESC, node_index) AS rk,
 count(*) OVER (PARTITION BY patient, seizure_id) AS n FROM rn)
{gap_sql('f', 'rk <= greatest(1, ceil(CAST(0.1 AS DOUBLE) * n))', suffix='_top10')}""")
def r13(spark, d):
    return R.top_gap(predictions(spark, d))


@query("R13_top_gap_group", f"""{BASE} {gap_sql('ranked', 'rank <= greatest(1, ceil(CAST(0.1 AS DOUBLE) * n))', G, '_top10')}""")
def r13g(spark, d):
    return R.top_gap(predictions(spark, d), group=GROUP)


@query("R14_gap_range", f"""{BASE}, {gm_sql('nodes')} SELECT patient, {r('min(mp)', 'min_score_pos')}, {r('min(mn)', 'min_score_neg')},
 {r('min(gap)', 'min_gap')}, {r('max(mp)', 'max_score_pos')}, {r('max(mn)', 'max_score_neg')}, {r('max(gap)', 'max_gap')} FROM gm GROUP BY patient""")
def r14(spark, d):
    return R.gap_range(R.group_metrics(_nodes(spark, d), fracs=(), hot=_hot(spark, d)))


@query("R15_pointwise_gap", f"""WITH {PRED}, m AS (SELECT *, avg(CASE WHEN is_soz = 1 THEN y_score END) OVER w AS mp,
 avg(CASE WHEN is_soz = 0 THEN y_score END) OVER w AS mn FROM pred WINDOW w AS (PARTITION BY {G}))
SELECT {G}, node_index, row_id, {r('CASE WHEN is_soz = 1 THEN y_score END', 'pos_score')},
 {r('CASE WHEN is_soz = 0 THEN y_score END', 'neg_score')},
 {r('CASE WHEN is_soz = 1 THEN y_score - mn WHEN is_soz = 0 THEN mp - y_score END', 'gap')} FROM m""")
def r15(spark, d):
    return R.pointwise_gap(predictions(spark, d)).select(
        *GROUP, "node_index", "row_id", "pos_score", "neg_score", "gap")


@query("R16_top_scores", f"""{BASE} SELECT {G}, node_index, {r('y_score')}, is_soz FROM ranked
 WHERE rank <= greatest(1, ceil(CAST(0.1 AS DOUBLE) * n))""")
def r16(spark, d):
    return R.top_scores(_nodes(spark, d), hot=_hot(spark, d)).select(*GROUP, "node_index", "y_score", "is_soz")


@query("R17_recording_scores", f"""WITH {PRED} SELECT patient, seizure_id, node_index, {r('max(y_score)', 'y_score')},
 max(is_soz) AS is_soz, count(*) AS n_rows FROM pred GROUP BY ALL""")
def r17(spark, d):
    return R.recording_scores(predictions(spark, d))


@query("R18_macro_micro", f"""{BASE}, {gm_sql('nodes')}, p AS (SELECT patient, avg(auc) AS v, count(*) AS w FROM gm GROUP BY patient)
SELECT {r('avg(v)', 'macro')}, {r('sum(v * w) / sum(CASE WHEN v IS NOT NULL THEN w END)', 'micro')}, count(v) AS n_patients FROM p""")
def r18(spark, d):
    per = R.group_metrics(_nodes(spark, d), fracs=(), hot=_hot(spark, d)).groupBy("patient").agg(
        F.avg("auc").alias("v"), F.count(F.lit(1)).alias("w"))
    return R.macro_micro(per, "v", "w")


@query("R19_auc_histogram", f"""{BASE}, {gm_sql('nodes')} SELECT patient,
 CAST(least(greatest(floor((auc - 0) / 0.1::DOUBLE), 0), 9) AS INTEGER) AS bin, count(*) AS n FROM gm WHERE auc IS NOT NULL GROUP BY ALL""")
def r19(spark, d):
    return R.histogram(R.group_metrics(_nodes(spark, d), fracs=(), hot=_hot(spark, d)), "auc", ["patient"], 0.0, 1.0, 10)


@query("R20_separability", f"""WITH {PANEL}, {PANEL_LONG}, s AS (SELECT patient, seizure, feature,
 (avg(value) FILTER (is_soz = 1) - avg(value) FILTER (is_soz = 0)) /
  nullif(sqrt((var_pop(value) FILTER (is_soz = 1) + var_pop(value) FILTER (is_soz = 0)) / 2), 0) AS dprime
 FROM plong GROUP BY ALL)
SELECT patient, seizure, feature, {r('dprime')}, rank FROM (SELECT *, row_number() OVER
 (PARTITION BY patient, seizure ORDER BY abs(dprime) DESC, feature) AS rank FROM s WHERE dprime IS NOT NULL) WHERE rank <= 2""")
def r20(spark, d):
    return R.top_features(R.separability(panel_long(spark, d), ["patient", "seizure"]), ["patient", "seizure"], 2)


# ------------------------------------------------------------------ selection
MODEL_GM = f"WITH {PRED}, mnodes AS (SELECT {G}, run, experiment, node_index, max(y_score) AS y_score, max(is_soz) AS is_soz FROM pred GROUP BY ALL), {gm_sql('mnodes', G + ', run, experiment')}, pm AS (SELECT patient, run, experiment, avg(f10) AS f1, avg(auc) AS auc, count(*) AS groups FROM gm GROUP BY ALL), best AS (SELECT * FROM pm QUALIFY row_number() OVER (PARTITION BY patient ORDER BY round(f1, 12) DESC, run, experiment) = 1)"


def _best(spark, d):
    pm = R.patient_metrics(predictions(spark, d), by=["patient", "run", "experiment"])
    pm = pm.withColumn("f1_top10", F.round("f1_top10", 12))  # equal means must tie exactly
    return M.best_by_metric(pm, "f1_top10")


@query("M1_best_model_f1", f"{MODEL_GM} SELECT patient, run, experiment, {r('f1')}, {r('auc')}, groups FROM best")
def m1(spark, d):
    return _best(spark, d).select("patient", "run", "experiment", F.col("f1_top10").alias("f1"),
                                  F.col("auc_group_mean").alias("auc"), F.col("num_groups_used").alias("groups"))


@query("M3_most_frequent_model", f"{MODEL_GM} SELECT run, experiment, count(*) AS n FROM best GROUP BY ALL ORDER BY n DESC, run, experiment LIMIT 1")
def m3(spark, d):
    return M.most_frequent_model(_best(spark, d))


@query("M4_selected_predictions", f"""{MODEL_GM} SELECT {G}, run, experiment, node_index, {r('max(y_score)', 'y_score')},
 max(pred.is_soz) AS is_soz FROM pred JOIN best USING (patient, run, experiment) GROUP BY ALL""")
def m4(spark, d):
    return M.selected_predictions(predictions(spark, d), _best(spark, d), collapsed=True)


@query("M2_best_fold_metric", f"""WITH {PRED}, folds AS (
 SELECT run, experiment, patient % 5 AS fold, string_agg(DISTINCT CAST(patient AS VARCHAR), ',') AS vals,
  avg((is_soz - y_score) * (is_soz - y_score)) AS brier FROM pred GROUP BY ALL), {GATE.format(n=19)},
e AS (SELECT unnest(string_split(vals, ',')) AS patient, run, experiment, fold, brier FROM folds)
SELECT patient, run, experiment, fold, {r('brier')} FROM e WHERE CAST(patient AS BIGINT) IN (SELECT patient FROM gate)
QUALIFY row_number() OVER (PARTITION BY patient ORDER BY brier, run, experiment, fold) = 1""")
def m2(spark, d):
    p = predictions(spark, d)
    folds = p.groupBy("run", "experiment", (F.col("patient") % 5).alias("fold")).agg(
        F.array_join(F.collect_set(F.col("patient").cast("string")), ",").alias("val_patients"),
        F.avg(F.pow(F.col("is_soz") - F.col("y_score"), 2)).alias("brier"))
    gate = M.min_positive_gate(p, 19).select(F.col("patient").cast("string").alias("patient"))
    return M.best_by_fold_metric(folds, "brier", "min", gate)


@query("M5_feature_votes", f"""WITH {PANEL}, {PANEL_LONG}, s AS (SELECT patient, seizure, feature,
 (avg(value) FILTER (is_soz = 1) - avg(value) FILTER (is_soz = 0)) /
  nullif(sqrt((var_pop(value) FILTER (is_soz = 1) + var_pop(value) FILTER (is_soz = 0)) / 2), 0) AS dprime FROM plong GROUP BY ALL)
SELECT feature, count(DISTINCT patient) AS n_patients FROM (SELECT *, row_number() OVER
 (PARTITION BY patient, seizure ORDER BY abs(dprime) DESC, feature) AS rank FROM s WHERE dprime IS NOT NULL) WHERE rank <= 2
 GROUP BY feature ORDER BY n_patients DESC, feature LIMIT 3""")
def m5(spark, d):
    return M.feature_votes(r20(spark, d), top=3)


# ------------------------------------------------------------- filters, joins
@query("F6_min_positive_gate", f"WITH {PRED}, {GATE.format(n=19)} SELECT patient FROM gate")
def f6(spark, d):
    return M.min_positive_gate(predictions(spark, d), 19).select("patient")


@query("F7_min_recordings", f"WITH {PRED} SELECT patient, count(DISTINCT seizure_id) AS n_seizures FROM pred GROUP BY patient HAVING count(DISTINCT seizure_id) >= 3")
def f7(spark, d):
    return M.min_recordings_gate(predictions(spark, d), 3)


@query("J7_audit_join", f"""{BASE}, {gm_sql('nodes')}, m AS (SELECT patient, {PATIENT_COLS} FROM gm GROUP BY patient),
rng AS (SELECT patient, {r('min(gap)', 'min_gap')}, {r('max(gap)', 'max_gap')} FROM gm GROUP BY patient),
t AS ({gap_sql('ranked', 'rank <= greatest(1, ceil(CAST(0.1 AS DOUBLE) * n))', G, '_top10')})
SELECT * FROM m LEFT JOIN rng USING (patient) LEFT JOIN t USING (patient)""")
def j7(spark, d):
    gm = R.with_topk_scores(R.group_metrics(_nodes(spark, d), hot=_hot(spark, d)))
    return (
        R.patient_metrics(predictions(spark, d))
        .join(R.gap_range(gm).select("patient", "min_gap", "max_gap"), "patient", "left")
        .join(R.top_gap(predictions(spark, d), group=GROUP), "patient", "left")
    )


@query("J9_first_all_ranks", f"""{BASE}, f AS (SELECT {G}, min(CASE WHEN is_soz = 1 THEN rank END) AS x FROM ranked GROUP BY ALL),
a AS (SELECT patient, avg(x) AS first_mean, count(x) AS groups_first FROM f GROUP BY patient),
b AS (SELECT patient, avg(rank) AS all_mean FROM ranked WHERE is_soz = 1 GROUP BY patient)
SELECT patient, {r('first_mean', 'mean_rank_first')}, {r('all_mean', 'mean_rank_all')}, groups_first FROM a JOIN b USING (patient)""")
def j9(spark, d):
    ranked = _ranked(spark, d)
    first = R.first_positive_ranks(ranked, hot=_hot_patients(spark, d)).select(
        "patient", F.col("mean_rank").alias("mean_rank_first"), F.col("num_groups_with_soz").alias("groups_first"))
    every = R.all_positive_ranks(ranked, hot=_hot_patients(spark, d)).select("patient", F.col("mean_rank").alias("mean_rank_all"))
    return first.join(every, "patient")
