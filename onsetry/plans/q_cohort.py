"""Queries for change metrics, cohort scores, stability and group statistics (C, J8, J12)."""

from pyspark.sql import functions as F

from onsetry.operators import cohort as C
from onsetry.operators import normalize as N, permutation as P
from onsetry.plans.bindings import FEATS, PANEL, PANEL_LONG, panel, panel_long, table
from onsetry.plans.registry import query, r

REC = ["patient", "seizure"]
M = C.MEASURES

CM = f"""{PANEL}, {PANEL_LONG}, dl AS (SELECT patient, seizure, feature, electrode, max(is_soz) AS is_soz,
 abs(avg(value) FILTER (phase = 'ictal') - avg(value) FILTER (phase = 'preictal')) AS d FROM plong GROUP BY ALL),
cm0 AS (SELECT patient, seizure, feature, avg(d) AS change_global_abs, avg(d) FILTER (is_soz = 1) AS change_soz_abs,
 avg(d) FILTER (is_soz = 0) AS change_nonsoz_abs FROM dl GROUP BY ALL),
cm AS (SELECT *, change_soz_abs - change_nonsoz_abs AS change_soz_amp_abs FROM cm0 WHERE change_global_abs IS NOT NULL)"""
DIM = """dm AS (SELECT s_suppkey AS patient, CASE WHEN s_acctbal >= 0 THEN 'good' ELSE 'bad' END AS outcome, coalesce(r_name, 'unknown') AS region
 FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey)"""
CHG = ", ".join(r(m) for m in M)


def _changes(spark, d):
    return C.change_metrics(panel_long(spark, d), REC)


def _dims(spark, d):
    nat = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select(
        F.col("n_nationkey").alias("s_nationkey"), F.col("r_name").alias("region"))
    sup = table(spark, d, "supplier").withColumn("outcome", F.when(F.col("s_acctbal") >= 0, "good").otherwise("bad"))
    return N.lookup(sup, nat, ["s_nationkey"], ["region"]).select(
        F.col("s_suppkey").alias("patient"), "outcome", "region", F.col("s_acctbal").alias("value"))


@query("C1_change_metrics", f"WITH {CM} SELECT patient, seizure, feature, {CHG} FROM cm")
def c1(spark, d):
    return _changes(spark, d)


@query("C2_first_label", f"""WITH {PANEL}, n AS (SELECT *, CASE WHEN epoch % 3 = 0 THEN is_soz WHEN epoch % 3 = 1 THEN 1 - is_soz END AS lab FROM panel)
SELECT patient, electrode, coalesce(min_by(lab, epoch * 10 + CASE seizure WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END) FILTER (lab IS NOT NULL AND seizure IN ('click', 'error', 'purchase')), 0) AS is_soz
 FROM n GROUP BY ALL""")
def c2(spark, d):
    lab = F.when(F.col("epoch") % 3 == 0, F.col("is_soz")).when(F.col("epoch") % 3 == 1, 1 - F.col("is_soz"))
    p = panel(spark, d).withColumn("lab", F.when(F.col("seizure").isin("click", "error", "purchase"), lab))
    return C.first_label(p, ["patient", "electrode"], ["epoch", "seizure"], "lab").withColumnRenamed("lab", "is_soz")


def score_sql(measures: list[str], sa: float, aa: float, src: str = "cm") -> str:
    union = " UNION ALL ".join(f"SELECT patient, seizure, feature, '{m}' AS measure, {m} AS y FROM {src}" for m in measures)
    return f"""ml AS ({union}),
am AS (SELECT patient, measure, feature, median(abs(y)) AS med, count(y) AS n FROM ml GROUP BY ALL),
rf AS (SELECT patient, measure, coalesce(median(CASE WHEN n >= 3 THEN med END), 0) AS ref FROM am GROUP BY ALL),
ag AS (SELECT ml.patient, ml.measure, ml.feature, count(y) AS n_points, max(ref) AS amp_ref_patient, avg(abs(y)) AS mu, stddev_pop(abs(y)) AS sd,
 coalesce(avg(CASE WHEN abs(y) > greatest(1e-8, 0.05 * ref) THEN 1.0 WHEN y IS NOT NULL THEN 0.0 END), 0) AS frac_nonzero,
 coalesce(abs(avg(CASE WHEN abs(y) > greatest(1e-8, 0.05 * ref) THEN sign(y) END)), 0) AS sg FROM ml JOIN rf USING (patient, measure) GROUP BY ALL),
s0 AS (SELECT ag.*, CASE WHEN n >= 3 THEN med END AS amplitude_score,
 CASE WHEN n < 3 THEN NULL WHEN amp_ref_patient > 0 THEN med / (amp_ref_patient + 1e-12) ELSE 0 END AS amp_norm FROM ag JOIN am USING (patient, measure, feature)),
fs AS (SELECT *, pow(ln(1 + amp_norm), {aa}) AS amp_term, CASE WHEN amp_norm IS NOT NULL THEN pow(1 / (1 + sd / (mu + 1e-12)), {sa}) END AS stability,
 CASE WHEN amp_norm IS NOT NULL THEN sg END AS sign_term FROM s0),
fin AS (SELECT *, amp_term * stability * sign_term AS final_score FROM fs)"""


@query("C3_feature_scores", f"""WITH {CM}, {score_sql(['change_soz_amp_abs'], 1.0, 1.0)} SELECT patient, feature, n_points, {r('amplitude_score')}, {r('amp_ref_patient')}, {r('amp_norm')},
 {r('amp_term')}, {r('stability')}, {r('sign_term')}, {r('ln(1 + 1 / (sd + 1e-12))', 'movement_consistency')}, {r('final_score')},
 {r('greatest(1e-8, 0.05 * amp_ref_patient)', 'zero_threshold_used')}, {r('frac_nonzero')}, CASE WHEN frac_nonzero >= 0.4 THEN 1 ELSE 0 END AS is_active FROM fin""")
def c3(spark, d):
    return C.feature_scores(C.measures_long(_changes(spark, d), [*REC, "feature"], ["change_soz_amp_abs"]), ["patient"])


@query("C4_score_table", f"""WITH {CM}, {DIM}, {score_sql(['change_soz_amp_abs'], 1.5, 0.7)} SELECT patient, outcome, feature, {r('amp_norm')}, {r('amp_term')}, {r('stability')}, {r('sign_term')}, {r('final_score')}
 FROM fin JOIN dm USING (patient)""")
def c4(spark, d):
    return _scores(spark, d).select("patient", "outcome", "feature", "amp_norm", "amp_term", "stability", "sign_term", "final_score")


def _scores(spark, d):
    long = C.measures_long(_changes(spark, d), [*REC, "feature"], ["change_soz_amp_abs"])
    s = C.feature_scores(long, ["patient"], stability_alpha=1.5, amp_alpha=0.7)
    return s.join(_dims(spark, d).drop("value"), "patient")


COHORT = f"""WITH {CM}, {DIM}, {score_sql(M, 1.5, 0.7)},
kp AS (SELECT * FROM fin WHERE final_score IS NOT NULL QUALIFY rank() OVER (PARTITION BY measure, feature ORDER BY final_score DESC) <= 6),
tk AS (SELECT *, row_number() OVER (PARTITION BY patient, measure ORDER BY final_score DESC, feature) AS rk FROM kp)"""
SC = ", ".join(f"max(CASE WHEN measure = '{m}' THEN v END) AS s{i}, max(CASE WHEN measure = '{m}' THEN c END) AS c{i}" for i, m in enumerate(M))
SO = ", ".join(f"{r(f's{i}', 'patient_score__' + m)}, c{i} AS n_selected__{m}" for i, m in enumerate(M))


def cohort_sql(value: str) -> str:
    return f"""{COHORT}, pv AS (SELECT patient, {SC} FROM (SELECT patient, measure, {value} AS v, count(*) AS c FROM tk GROUP BY ALL) GROUP BY patient),
bs AS (SELECT patient, count(DISTINCT seizure) AS n_seizures FROM cm GROUP BY patient HAVING count(DISTINCT seizure) >= 3)
SELECT patient, n_seizures, outcome, {SO}, {r('greatest(s0, s1, s2, s3)', 'overall_score')} FROM bs JOIN dm USING (patient) LEFT JOIN pv USING (patient)"""


def _with_outcome(spark, d):
    return _changes(spark, d).join(_dims(spark, d).select("patient", "outcome"), "patient")


@query("C5_cohort_scores", cohort_sql("sum(final_score)"))
def c5(spark, d):
    return C.cohort_scores(_with_outcome(spark, d), keep_top=6)


@query("C5_cohort_topk", cohort_sql("avg(CASE WHEN rk <= 2 THEN final_score END) * count(*)"))
def c5k(spark, d):
    return C.cohort_scores(_with_outcome(spark, d), keep_top=6, aggregate="topk", k=2, multiply_by_n=True)


MAT = f"""WITH {CM}, {score_sql(['change_soz_amp_abs'], 1.5, 0.7)}, ch AS (SELECT feature FROM fin WHERE final_score IS NOT NULL GROUP BY feature ORDER BY count(DISTINCT patient) DESC, feature LIMIT 3),
ct AS (SELECT patient, f.feature, coalesce(median(final_score), 0) AS v FROM (SELECT DISTINCT patient FROM fin WHERE feature IN (FROM ch)) p CROSS JOIN ch f LEFT JOIN fin USING (patient, feature) GROUP BY ALL),
sd AS (SELECT patient, feature, (v - avg(v) OVER (PARTITION BY feature)) / CASE WHEN stddev_pop(v) OVER (PARTITION BY feature) = 0 THEN 1 ELSE stddev_pop(v) OVER (PARTITION BY feature) END AS z FROM ct)"""


@query("C6_patient_feature_matrix", f"{MAT} SELECT patient, feature, {r('z')} FROM sd")
def c6(spark, d):
    s = _scores(spark, d)
    chosen = C.chosen_features(s, 3)
    return C.patient_feature_matrix(s, chosen).unpivot("patient", chosen, "feature", "z")


@query("C7_top_features_by_region", f"""WITH {CM}, {DIM}, {score_sql(['change_soz_amp_abs'], 1.5, 0.7)} SELECT region, feature, {r('median(final_score)', 'median_score')},
 {r('avg(CASE WHEN final_score > 0 THEN 1.0 ELSE 0 END)', 'support')}, count(DISTINCT patient) AS n_patients,
 {r('median(final_score) * avg(CASE WHEN final_score > 0 THEN 1.0 ELSE 0 END)', 'importance')} FROM fin JOIN dm USING (patient) WHERE final_score IS NOT NULL
 GROUP BY region, feature HAVING count(DISTINCT patient) >= 2""")
def c7(spark, d):
    return C.top_features_by_region(_scores(spark, d), min_patients=2)


BCE = f"""bc AS (SELECT user_id AS patient_key, event_type, avg(-ln(greatest(1e-7, least(1 - 1e-7, value / (1 + value))))) AS bce, max(CASE WHEN user_id % 5 = 0 AND event_type = 'click' THEN 'bad' ELSE 'good' END) AS outcome FROM events GROUP BY ALL)"""


def _bce(spark, d):
    ev = table(spark, d, "events")
    p = F.col("value") / (1 + F.col("value"))
    return ev.groupBy(F.col("user_id").alias("patient_key"), "event_type").agg(
        F.avg(-F.log(F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), p)))).alias("bce"),
        F.max(F.when((F.col("user_id") % 5 == 0) & (F.col("event_type") == "click"), "bad").otherwise("good")).alias("outcome"))


@query("C8_per_patient", f"WITH {BCE} SELECT patient_key, {r('median(bce)', 'value')}, count(*) AS n_rows, CASE WHEN count(DISTINCT outcome) = 1 THEN min(outcome) ELSE 'unknown' END AS outcome FROM bc GROUP BY patient_key")
def c8(spark, d):
    return C.per_patient(_bce(spark, d), "bce", "median")


QUAL = f"""{BCE}, ql AS (SELECT patient_key, max(bce) AS q FROM bc GROUP BY patient_key),
sc AS (SELECT user_id AS patient_key, avg(value) - 40 AS overall FROM events GROUP BY ALL)"""


def _quality(spark, d):
    sc = table(spark, d, "events").groupBy(F.col("user_id").alias("patient_key")).agg((F.avg("value") - 40).alias("overall_score"))
    return C.score_with_quality(sc, C.per_patient(_bce(spark, d), "bce", "max").select("patient_key", "value"), log_axis=True)


@query("J8_score_quality_join", f"WITH {QUAL} SELECT patient_key, {r('overall', 'overall_score')}, {r('q', 'value')} FROM sc JOIN ql USING (patient_key) WHERE overall > 0 AND q > 0")
def j8(spark, d):
    return _quality(spark, d)


@query("C9_correlations", f"""WITH {PANEL}, k AS (SELECT patient, round(f_sum, 2) AS x, f_cnt AS y FROM panel), rk AS (SELECT *, rank() OVER (PARTITION BY patient ORDER BY x) + (count(*) OVER (PARTITION BY patient, x) - 1) / 2.0 AS rx,
 rank() OVER (PARTITION BY patient ORDER BY y) + (count(*) OVER (PARTITION BY patient, y) - 1) / 2.0 AS ry FROM k)
SELECT patient, count(*) AS n, {r('corr(x, y)', 'pearson_r')}, {r('corr(rx, ry)', 'spearman_rho')} FROM rk GROUP BY patient""")
def c9(spark, d):
    p = panel(spark, d).select("patient", F.round("f_sum", 2).alias("x"), F.col("f_cnt").alias("y"))
    return C.correlations(p, ["patient"], "x", "y")


# recordings of one channel give gaps in the feature set: (electrode, seizure) with a feature per phase and value
VEC = f"""{PANEL}, {PANEL_LONG}, ch AS (SELECT electrode AS patient, seizure, feature || '_' || (epoch // 6) AS feature, value AS v0 FROM plong),
v1 AS (SELECT patient, seizure, feature, avg(v0) AS v FROM ch GROUP BY ALL),
vn AS (SELECT patient, seizure, feature, v / nullif(sum(v) OVER (PARTITION BY patient, seizure), 0) AS v FROM v1)"""


def _vectors(spark, d):
    return panel_long(spark, d).select(
        F.col("electrode").alias("patient"), "seizure",
        F.concat_ws("_", "feature", F.floor(F.col("epoch") / 6).cast("string")).alias("feature"), F.col("value").alias("v0"))


@query("C10_stability", f"""WITH {VEC}, vr AS (SELECT patient, seizure, feature, round(v, 12) AS v FROM vn), pr AS (SELECT a.patient, a.seizure AS sa, b.seizure AS sb, a.feature, a.v AS va, b.v AS vb FROM vr a JOIN vr b ON a.patient = b.patient AND a.feature = b.feature AND a.seizure < b.seizure),
rk AS (SELECT patient, sa, sb, rank() OVER (PARTITION BY patient, sa, sb ORDER BY va) + (count(*) OVER (PARTITION BY patient, sa, sb, va) - 1) / 2.0 AS ra,
 rank() OVER (PARTITION BY patient, sa, sb ORDER BY vb) + (count(*) OVER (PARTITION BY patient, sa, sb, vb) - 1) / 2.0 AS rb FROM pr),
cc AS (SELECT patient, sa, sb, corr(ra, rb) AS c FROM rk GROUP BY ALL HAVING count(*) >= 3),
st AS (SELECT patient, avg(c) AS cmean, median(c) AS cmed FROM cc WHERE NOT isnan(c) GROUP BY ALL),
tp AS (SELECT patient, seizure, list(feature ORDER BY v DESC, feature)[1:3] AS fs FROM vr GROUP BY ALL),
jc AS (SELECT a.patient, avg(len(list_intersect(a.fs, b.fs)) * 1.0 / len(list_distinct(list_concat(a.fs, b.fs)))) AS j FROM tp a JOIN tp b ON a.patient = b.patient AND a.seizure < b.seizure GROUP BY ALL),
ns AS (SELECT patient, count(DISTINCT seizure) AS n_seizures FROM vn GROUP BY ALL)
SELECT patient, n_seizures, {r('cmean', 'stability_corr_mean')}, {r('cmed', 'stability_corr_median')}, {r('j', 'stability_jaccard_mean')} FROM ns LEFT JOIN st USING (patient) LEFT JOIN jc USING (patient)""")
def c10(spark, d):
    return C.stability(_vectors(spark, d), ["patient"], "seizure", "v0", top_n=3)


@query("J12_recording_pairs", f"""WITH {VEC} SELECT a.patient, a.seizure AS seizure_a, b.seizure AS seizure_b, count(*) AS n_shared, {r('sum(a.v * b.v)', 'dot')} FROM vn a JOIN vn b
 ON a.patient = b.patient AND a.feature = b.feature AND a.seizure < b.seizure GROUP BY ALL""")
def j12(spark, d):
    v = C.recording_vectors(_vectors(spark, d), ["patient"], "seizure", "v0")
    return C.recording_pairs(v, ["patient"], "seizure").groupBy("patient", "seizure_a", "seizure_b").agg(
        F.count(F.lit(1)).alias("n_shared"), F.sum(F.col("v_a") * F.col("v_b")).alias("dot"))


@query("C11_patient_profile", f"""WITH {VEC}, m AS (SELECT patient, feature, avg(v) AS v FROM vn GROUP BY ALL) SELECT patient, feature, {r('v / nullif(sum(v) OVER (PARTITION BY patient), 0)', 'v')} FROM m""")
def c11(spark, d):
    return C.patient_profile(_vectors(spark, d), ["patient"], "seizure", "v0")


@query("C12_constant_change", f"""WITH {VEC}, l AS (SELECT patient, seizure, sqrt(sum(v * v)) AS l2 FROM v1 GROUP BY ALL),
t AS (SELECT greatest(quantile_cont(l2, 0.1), 1e-6) AS tau FROM l WHERE l2 > 0),
cs AS (SELECT a.patient, la.seizure AS sa, lb.seizure AS sb, max(la.l2) AS na, max(lb.l2) AS nb FROM l a JOIN l la ON a.patient = la.patient JOIN l lb ON a.patient = lb.patient AND la.seizure < lb.seizure GROUP BY ALL),
dt AS (SELECT a.patient, a.seizure AS sa, b.seizure AS sb, sum(a.v * b.v) AS dot FROM v1 a JOIN v1 b ON a.patient = b.patient AND a.feature = b.feature AND a.seizure < b.seizure GROUP BY ALL),
pt AS (SELECT patient, avg(coalesce(dot, 0) / (na * nb)) AS ps FROM cs LEFT JOIN dt USING (patient, sa, sb) GROUP BY ALL),
am AS (SELECT patient, count(*) AS n, median(l2) AS a FROM l GROUP BY ALL)
SELECT patient, n AS n_seizures, {r('CASE WHEN n >= 2 THEN a END', 'median_amplitude')}, {r('ps', 'pattern_stability')}, {r('CASE WHEN n >= 2 THEN 1 - exp(-a / tau) END', 'nontriviality')},
 {r('ps * (1 - exp(-a / tau))', 'constant_change_score')} FROM am LEFT JOIN pt USING (patient), t""")
def c12(spark, d):
    return C.constant_change(_vectors(spark, d), ["patient"], "seizure", "v0")


@query("C13_consistent_change", f"""WITH {VEC}, l AS (SELECT patient, seizure, sqrt(sum(v * v)) AS l2 FROM v1 GROUP BY ALL), a AS (SELECT patient, count(*) AS n, avg(l2) AS amp FROM l GROUP BY ALL),
m AS (SELECT patient, sqrt(sum(s * s)) AS len FROM (SELECT patient, feature, sum(v) AS s FROM v1 GROUP BY ALL) GROUP BY ALL)
SELECT patient, n AS n_seizures, {r('CASE WHEN n >= 2 THEN len / n END', 'consistent_change')}, {r('CASE WHEN n >= 2 AND amp > 0 THEN len / n / amp END', 'consistency_index')}, {r('CASE WHEN n >= 2 THEN amp END', 'mean_amplitude')} FROM a JOIN m USING (patient)""")
def c13(spark, d):
    return C.consistent_change(_vectors(spark, d), ["patient"], "seizure", "v0")


CELLS = ", ".join(r(f"avg(change_global_abs) FILTER (feature = '{f}')", f) for f in FEATS)


@query("C14_patient_matrix", f"WITH {CM} SELECT patient, {CELLS} FROM cm GROUP BY patient")
def c14(spark, d):
    return C.feature_matrix(_changes(spark, d), ["patient"], FEATS, "change_global_abs")


@query("C14_recording_matrix", f"WITH {CM} SELECT patient, seizure, {CELLS} FROM cm GROUP BY patient, seizure")
def c14r(spark, d):
    return C.feature_matrix(_changes(spark, d), REC, FEATS, "change_global_abs")


def _patients(spark, d):
    return _dims(spark, d).withColumnRenamed("patient", "patient_key")


@query("C15_outcome_table", f"WITH {DIM}, c AS (SELECT region, outcome, count(DISTINCT patient) AS n FROM dm GROUP BY ALL) SELECT region, outcome, n, {r('n / sum(n) OVER (PARTITION BY region)', 'share')} FROM c")
def c15(spark, d):
    return C.outcome_table(_patients(spark, d))


@query("C15_chi_square", f"""WITH {DIM}, c AS (SELECT region, outcome, count(*) AS n FROM dm GROUP BY ALL), rr AS (SELECT region, sum(n) AS a FROM c GROUP BY ALL), cc AS (SELECT outcome, sum(n) AS b FROM c GROUP BY ALL),
f AS (SELECT region, outcome, a * b / (SELECT sum(n) FROM c) AS e FROM rr CROSS JOIN cc), g AS (SELECT f.*, coalesce(n, 0) AS o FROM f LEFT JOIN c USING (region, outcome))
SELECT CAST(sum(o) AS BIGINT) AS n, (count(DISTINCT region) - 1) * (count(DISTINCT outcome) - 1) AS dof, {r('sum((o - e) * (o - e) / e)', 'chi2')} FROM g""")
def c15c(spark, d):
    return C.chi_square(_patients(spark, d))


SUP = "sp AS (SELECT s_suppkey AS patient_key, CASE WHEN s_acctbal >= 0 THEN 'good' ELSE 'bad' END AS outcome, region, round(s_acctbal, -2) AS value FROM supplier JOIN dm ON s_suppkey = patient)"
RANKS = """rk AS (SELECT *, rank() OVER (PARTITION BY {p} ORDER BY value) + (count(*) OVER (PARTITION BY {p}, value) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY {p}, value) AS t FROM {src})"""
Z = "(greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1))))"


def _values(spark, d):
    return _patients(spark, d).withColumn("value", F.round("value", -2))


@query("C16_mann_whitney", f"""WITH {DIM}, {SUP}, {RANKS.format(p='patient_key % 2', src='sp')},
g AS (SELECT patient_key % 2 AS part, CAST(count(*) FILTER (region = 'ASIA') AS DOUBLE) AS n1, CAST(count(*) FILTER (region <> 'ASIA') AS DOUBLE) AS n2,
 sum(rk) FILTER (region = 'ASIA') - count(*) FILTER (region = 'ASIA') * (count(*) FILTER (region = 'ASIA') + 1) / 2.0 AS u, sum(t * t - 1.0) AS ties FROM rk GROUP BY ALL)
SELECT part, n1, n2, {r('CASE WHEN least(n1, n2) >= 2 THEN u END', 'u')}, {r(f'CASE WHEN least(n1, n2) >= 2 THEN {Z} END', 'z')} FROM g""")
def c16(spark, d):
    v = _values(spark, d).withColumns({"part": F.col("patient_key") % 2, "side": F.when(F.col("region") == "ASIA", "in").otherwise("out")})
    return C.mann_whitney(v, ["part"], "side", "value", "in", "out")


@query("C17_kruskal", f"""WITH {DIM}, {SUP}, {RANKS.format(p='1', src='sp')}, g AS (SELECT region, sum(rk) AS s, count(*) AS m FROM rk GROUP BY ALL), t AS (SELECT sum(t * t - 1.0) AS ties, CAST(count(*) AS DOUBLE) AS n FROM rk)
SELECT CAST(max(n) AS BIGINT) AS n, count(*) - 1 AS dof, {r('(12 / (max(n) * (max(n) + 1)) * sum(s * s / m) - 3 * (max(n) + 1)) / (1 - max(ties) / (pow(max(n), 3) - max(n)))', 'h')} FROM g, t""")
def c17(spark, d):
    return C.kruskal(_values(spark, d), [], "region", "value")


DRAWS = 20_000


@query("C18_permutation_means")
def c18(spark, d):
    return P.permutation_test(_values(spark, d), "patient_key", "region", "value", DRAWS, 7)


@query("C18_permutation_medians")
def c18m(spark, d):
    v = _values(spark, d).withColumn("side", F.when(F.col("region") == "ASIA", "in").otherwise("out"))
    return P.permutation_test(v, "patient_key", "side", "value", DRAWS, 7, "median_difference")


PAIRS = f"""pr AS (SELECT a.region AS ga, b.region AS gb FROM (SELECT DISTINCT region FROM sp) a, (SELECT DISTINCT region FROM sp) b WHERE a.region < b.region),
bo AS (SELECT ga, gb, region = ga AS isa, value FROM pr JOIN sp ON region = ga OR region = gb),
{RANKS.format(p='ga, gb', src='bo')},
g AS (SELECT ga, gb, CAST(count(*) FILTER (isa) AS DOUBLE) AS n1, CAST(count(*) FILTER (NOT isa) AS DOUBLE) AS n2,
 sum(rk) FILTER (isa) - count(*) FILTER (isa) * (count(*) FILTER (isa) + 1) / 2.0 AS u, sum(t * t - 1.0) AS ties FROM rk GROUP BY ALL),
z AS (SELECT ga, gb, n1, n2, CASE WHEN least(n1, n2) >= 2 THEN u END AS u, CASE WHEN least(n1, n2) >= 2 THEN {Z} END AS z FROM g)"""


@query("C19_pairwise_tests", f"WITH {DIM}, {SUP}, {PAIRS} SELECT ga, gb, n1, n2, {r('u')}, {r('z')} FROM z")
def c19p(spark, d):
    return C.pairwise_mann_whitney(_values(spark, d), "region", "value")


# any decreasing map of |z| into (0, 1] serves as p in the statement of the correction
@query("C19_holm", f"""WITH {DIM}, {SUP}, {PAIRS}, p AS (SELECT ga, gb, round(exp(-z), 9) AS p FROM z WHERE z IS NOT NULL), o AS (SELECT *, row_number() OVER (ORDER BY p, ga, gb) AS i, count(*) OVER () AS m FROM p)
SELECT ga, gb, {r('p')}, {r('least(1.0, max((m - i + 1) * p) OVER (ORDER BY i))', 'p_adj')} FROM o""")
def c19(spark, d):
    t = C.pairwise_mann_whitney(_values(spark, d), "region", "value").withColumn("p", F.round(F.exp(-F.col("z")), 9))
    return C.holm(t.select("ga", "gb", "p"))


@query("C16_C19_p_values")
def c19pv(spark, d):
    t = C.pairwise_p_values(_values(spark, d), "region", "value")
    k = C.kruskal(_values(spark, d), [], "region", "value")
    return C.holm(t.select("ga", "gb", "p")).unionByName(
        k.select(F.lit("all").alias("ga"), F.lit("all").alias("gb"), C.chi_square_tail(F.col("h"), F.col("dof")).alias("p"),
                 F.lit(None).cast("double").alias("p_adj")))


@query("C20_pca")
def c20(spark, d):
    s = _scores(spark, d)
    chosen = C.chosen_features(s, len(FEATS))
    return C.pca_2d(C.patient_feature_matrix(s, chosen), chosen, ["patient"])


PTS = "pt AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(label AS VARCHAR) AS g FROM embeddings)"


def _points(spark, d):
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"),
        F.col("label").cast("string").alias("g"))


@query("C21_separation", f"""WITH {PTS}, ds AS (SELECT a.id, a.g, b.id AS o, b.g AS og, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d FROM pt a JOIN pt b ON a.id <> b.id),
m AS (SELECT id, g, og, avg(d) AS d FROM ds GROUP BY ALL), s AS (SELECT id, min(d) FILTER (g = og) AS a, min(d) FILTER (g <> og) AS b FROM m GROUP BY ALL),
k AS (SELECT * FROM ds QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(d, 9), o) <= 5), u AS (SELECT id, avg(CASE WHEN g = og THEN 1.0 ELSE 0 END) AS u FROM k GROUP BY ALL)
SELECT (SELECT count(*) FROM pt) AS n, (SELECT count(DISTINCT g) FROM pt) AS n_groups, {r('avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END)', 'silhouette')}, {r('avg(u)', 'knn_purity')} FROM s JOIN u USING (id)""")
def c21(spark, d):
    return C.separation(_points(spark, d), "id", "x", "y", "g")


@query("C22_value_field", f"""WITH {PTS}, bx AS (SELECT min(x) - (max(x) - min(x)) * 0.06 AS x0, max(x) + (max(x) - min(x)) * 0.06 AS x1, min(y) - (max(y) - min(y)) * 0.06 AS y0, max(y) + (max(y) - min(y)) * 0.06 AS y1 FROM pt),
gr AS (SELECT i, j, x0 + (x1 - x0) * i / 249 AS gx, y0 + (y1 - y0) * j / 249 AS gy FROM bx, range(0, 250) a(i), range(0, 250) b(j)),
w AS (SELECT i, j, gx, gy, sum(exp(-0.5 * (pow(gx - x, 2) + pow(gy - y, 2)) / 0.01) * CAST(g AS DOUBLE)) AS num, sum(exp(-0.5 * (pow(gx - x, 2) + pow(gy - y, 2)) / 0.01)) AS den FROM gr, pt GROUP BY ALL),
t AS (SELECT quantile_cont(den, 0.02) AS thr FROM w)
SELECT CAST(i AS INTEGER) AS ix, CAST(j AS INTEGER) AS iy, {r('gx', 'x')}, {r('gy', 'y')}, {r('CASE WHEN den >= thr THEN num / greatest(den, 1e-12) END', 'value')}, {r('den', 'support')} FROM w, t""")
def c22(spark, d):
    p = _points(spark, d).withColumn("v", F.col("g").cast("double"))
    return C.value_field(p, "x", "y", "v", gridsize=250, sigma=0.1)


def _components(spark, d):
    return C.principal_components(table(spark, d, "embeddings"), "embedding", 64, ["vec_id", "label"])


@query("C20_embedding_components")
def c20e(spark, d):
    return _components(spark, d)


@query("C20_C21_embedding_separation")
def c20_21(spark, d):
    return C.separation(_components(spark, d), "vec_id", "pc1", "pc2", "label")


@query("C20_C22_embedding_field")
def c20_22(spark, d):
    p = _components(spark, d).withColumn("v", F.col("label").cast("double"))
    return C.value_field(p, "pc1", "pc2", "v", gridsize=250, sigma=0.1)
