"""Queries for cleaning (F), normalisation (B), segmentation (G) and time-domain features (N)."""

from pyspark.sql import functions as F

from onsetry.operators import normalize as N
from onsetry.operators import signal as S
from onsetry.plans.bindings import (
    FEATS, GROUP, PANEL, PANEL_LONG, PRED, SIGNAL, TRACE, panel, panel_long, predictions, signal, table, traces,
    windows_sql,
)
from onsetry.plans.registry import query, r

CH = ["patient", "seizure", "electrode", "feature"]
CHS = "patient, seizure, electrode, feature"
G = "patient, seizure_id, seq_idx"
RP = ", ".join(r(f) for f in FEATS)


# -------------------------------------------------------------------- filters
@query("F1_numeric_features", f"WITH {PANEL} SELECT patient, seizure, electrode, epoch, {r('f_sum')}, {r('f_cnt')} FROM panel")
def f1(spark, d):
    p = panel(spark, d)
    return p.select("patient", "seizure", "electrode", "epoch", *N.numeric_features(p, ["f_sum", "phase", "f_cnt", "absent"]))


@query("F2_drop_average_rows", f"WITH {PANEL} SELECT patient, seizure, electrode, epoch, {r('f_sum')} FROM panel")
def f2(spark, d):
    p = panel(spark, d).select("patient", "seizure", "electrode", "phase", "epoch", "f_sum")
    both = N.phase_averages(p, ["patient", "seizure", "electrode", "phase"], ["f_sum"])
    return N.drop_average_rows(both).select("patient", "seizure", "electrode", "epoch", "f_sum")


@query("F3_groups_with_positive", f"WITH {PRED} SELECT {G}, node_index, row_id, is_soz FROM pred QUALIFY sum(is_soz) OVER (PARTITION BY {G}) > 0")
def f3(spark, d):
    return N.groups_with_positive(predictions(spark, d), GROUP).select(*GROUP, "node_index", "row_id", "is_soz")


FLAT = f"""fz AS (SELECT patient, seizure_id, node_index, max(is_soz) AS is_soz, max(abs(value)) <= 0.5 AND max(is_soz) = 1 AS is_flat_zero
 FROM trace GROUP BY ALL)"""


@query("F4_drop_flat_positives", f"WITH {TRACE}, {FLAT} SELECT * FROM fz WHERE NOT (is_soz = 1 AND is_flat_zero)")
def f4(spark, d):
    flat = traces(spark, d).groupBy("patient", "seizure_id", "node_index").agg(
        F.max("is_soz").alias("is_soz"),
        ((F.max(F.abs("value")) <= 0.5) & (F.max("is_soz") == 1)).alias("is_flat_zero"))
    return N.drop_flat_positives(flat)


ZERO = """zc AS (SELECT patient, seizure_id, node_index FROM trace GROUP BY ALL HAVING max(abs(value)) <= 0.95)"""


@query("F5_zero_channels", f"WITH {TRACE}, {ZERO} SELECT patient, seizure_id, node_index, t, {r('value')} FROM trace ANTI JOIN zc USING (patient, seizure_id, node_index)")
def f5(spark, d):
    t = traces(spark, d)
    keys = ["patient", "seizure_id", "node_index"]
    return N.drop_channels(t, N.zero_channels(t, keys, atol=0.95), keys).select(*keys, "t", "value")


@query("J13_label_conditional_anti", f"""WITH {TRACE}, {ZERO} SELECT patient, seizure_id, node_index, is_soz, t, {r('value')} FROM trace
 WHERE NOT (is_soz = 1 AND (patient, seizure_id, node_index) IN (SELECT (patient, seizure_id, node_index) FROM zc))""")
def j13(spark, d):
    t = traces(spark, d)
    keys = ["patient", "seizure_id", "node_index"]
    return N.drop_channels(t, N.zero_channels(t, keys, atol=0.95), keys, label="is_soz").select(*keys, "is_soz", "t", "value")


GAPPY = "gappy AS (SELECT patient, seizure, electrode, epoch, CASE WHEN f_sum > 60 THEN NULL ELSE f_sum END AS a, f_avg AS b, 1.0 AS c FROM panel)"


def _gappy(spark, d):
    return panel(spark, d).select(
        "patient", "seizure", "electrode", "epoch",
        F.when(F.col("f_sum") > 60, F.lit(float("nan"))).otherwise(F.col("f_sum")).alias("a"),
        F.col("f_avg").alias("b"), F.lit(1.0).alias("c"))


@query("F8_impute_drop_constant", f"WITH {PANEL}, {GAPPY} SELECT patient, seizure, electrode, epoch, {r('coalesce(a, (SELECT median(a) FROM gappy))', 'a')}, {r('b')} FROM gappy")
def f8(spark, d):
    filled, varying, _ = N.clean_matrix(_gappy(spark, d), ["a", "b", "c"])
    return filled.select("patient", "seizure", "electrode", "epoch", *varying)


@query("F9_known_rows", f"WITH {PRED} SELECT {G}, node_index, row_id, {r('y_score')} FROM pred WHERE seizure_id <> 'R'")
def f9(spark, d):
    p = predictions(spark, d).withColumn("seizure_id", F.when(F.col("seizure_id") == "R", "?").otherwise(F.col("seizure_id")))
    return N.known_rows(p).select(*GROUP, "node_index", "row_id", "y_score")


@query("F10_missing_columns", f"WITH {PANEL}, {GAPPY} SELECT patient, seizure, electrode, epoch, {r('(SELECT median(a) FROM gappy)', 'a')}, {r('b')} FROM gappy")
def f10(spark, d):
    g = _gappy(spark, d)
    med = N.column_medians(g, ["a", "b"]).first().asDict()
    return N.impute(g.drop("a"), ["a", "b"], med).select("patient", "seizure", "electrode", "epoch", "a", "b")


# ---------------------------------------------------------------------- joins
@query("J3_outcome_lookup", """SELECT s_suppkey AS patient, CASE WHEN s_acctbal >= 0 THEN 'good' ELSE 'bad' END AS outcome,
 coalesce(r_name, 'unknown') AS region FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def j3(spark, d):
    dim = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select(
        F.col("n_nationkey").alias("s_nationkey"), F.col("r_name").alias("region"))
    sup = table(spark, d, "supplier").withColumn("outcome", F.when(F.col("s_acctbal") >= 0, "good").otherwise("bad"))
    return N.lookup(sup, dim, ["s_nationkey"], ["region"]).select(F.col("s_suppkey").alias("patient"), "outcome", "region")


@query("J4_first_ictal", f"""WITH {PANEL}, m AS (SELECT *, min(CASE WHEN phase = 'ictal' THEN epoch END) OVER (PARTITION BY patient, seizure, electrode) AS f FROM panel)
SELECT patient, seizure, electrode, epoch, coalesce(phase = 'ictal' AND epoch = f, FALSE) AS first_ictal_epoch FROM m""")
def j4(spark, d):
    return N.first_ictal_flag(panel(spark, d), ["patient", "seizure", "electrode"]).select(
        "patient", "seizure", "electrode", "epoch", "first_ictal_epoch")


@query("J10_group_means", f"WITH {PANEL} SELECT patient, seizure, electrode, epoch, {r('f_sum - avg(f_sum) OVER (PARTITION BY patient, seizure)', 'centred')} FROM panel")
def j10(spark, d):
    out = N.with_totals(panel(spark, d), ["patient", "seizure"], {"_m": F.avg("f_sum")})
    return out.select("patient", "seizure", "electrode", "epoch", (F.col("f_sum") - F.col("_m")).alias("centred"))


# ------------------------------------------------------------------ baselines
def base_sql(fallback=True) -> str:
    cond = "phase = 'preictal' OR NOT has_pre" if fallback else "phase = 'preictal'"
    return f"""WITH {PANEL}, {PANEL_LONG}, hp AS (SELECT *, bool_or(phase = 'preictal') OVER (PARTITION BY {CHS}) AS has_pre FROM plong),
md AS (SELECT {CHS}, median(value) AS med, avg(value) AS mu, stddev_pop(value) AS sp, stddev_samp(value) AS ss FROM hp WHERE {cond} GROUP BY ALL),
ad AS (SELECT {CHS}, median(abs(value - med)) AS mad FROM hp JOIN md USING ({CHS}) WHERE {cond} GROUP BY ALL),
st AS (SELECT * FROM md JOIN ad USING ({CHS})),
zz AS (SELECT p.*, st.med, st.mad, st.mu, st.sp, st.ss FROM plong p LEFT JOIN st USING ({CHS}))"""


Z1 = "(value - med) / greatest(1.4826 * mad, 1e-9)"


@query("B1_robust_baseline_z", f"{base_sql()} SELECT {CHS}, epoch, {r(Z1, 'z')} FROM zz")
def b1(spark, d):
    return N.robust_baseline_z(panel_long(spark, d), CH).select(*CH, "epoch", "z")


@query("B2_baseline_z_std_fallback", f"{base_sql(False)}, s AS (SELECT *, CASE WHEN 1.4826 * mad < 1e-9 THEN sp + 1e-9 ELSE 1.4826 * mad END AS sg FROM zz) SELECT {CHS}, epoch, {r('(value - med) / (sg + 1e-9)', 'z')} FROM s")
def b2(spark, d):
    return N.robust_baseline_z_std(panel_long(spark, d), CH).select(*CH, "epoch", "z")


@query("B3_clipped_baseline_z", f"{base_sql()} SELECT {CHS}, epoch, {r(f'greatest(-20, least(20, {Z1}))', 'z')} FROM zz")
def b3(spark, d):
    return N.robust_baseline_z(panel_long(spark, d), CH, clip=N.CLIP).select(*CH, "epoch", "z")


@query("B4_spatial_z", f"""WITH {PANEL}, {PANEL_LONG}, w AS (SELECT *, median(value) OVER (PARTITION BY patient, seizure, epoch, feature) AS med FROM plong),
m AS (SELECT *, median(abs(value - med)) OVER (PARTITION BY patient, seizure, epoch, feature) AS mad FROM w)
SELECT {CHS}, epoch, {r('CASE WHEN mad > 0 THEN (value - med) / (1.4826 * mad) ELSE 0 END', 'z')} FROM m""")
def b4(spark, d):
    return N.spatial_robust_z(panel_long(spark, d), ["patient", "seizure", "epoch", "feature"]).select(*CH, "epoch", "z")


INST = "CASE WHEN ss IS NOT NULL THEN greatest(0, value - (mu + 1.0 * greatest(ss, 1e-9))) END"


@query("B5_persistent_burst", f"{base_sql()} SELECT {CHS}, epoch, {r(f'sum({INST}) OVER (PARTITION BY {CHS} ORDER BY epoch)', 'burst')} FROM zz")
def b5(spark, d):
    return N.persistent_burst(panel_long(spark, d), CH, thr_k=1.0).select(*CH, "epoch", "burst")


@query("B5_decayed_burst", f"""{base_sql()}, i AS (SELECT {CHS}, epoch, {INST} AS inst,
 row_number() OVER (PARTITION BY {CHS} ORDER BY epoch) AS pos FROM zz)
SELECT a.patient, a.seizure, a.electrode, a.feature, a.epoch,
 {r('CASE WHEN bool_or(b.inst IS NULL) THEN NULL ELSE sum(b.inst * pow(0.5::DOUBLE, a.pos - b.pos)) END', 'burst')}
FROM i a JOIN i b USING ({CHS}) WHERE b.pos <= a.pos GROUP BY ALL""")
def b5d(spark, d):
    return N.persistent_burst(panel_long(spark, d), CH, thr_k=1.0, decay=0.5).select(*CH, "epoch", "burst")


@query("B6_phase_averages", f"""{base_sql()}, b AS (SELECT *, sum({INST}) OVER (PARTITION BY {CHS} ORDER BY epoch) AS burst FROM zz)
SELECT {CHS}, phase, epoch, FALSE AS is_avg, {r('value')}, {r('burst')} FROM b
UNION ALL SELECT {CHS}, phase, -1, TRUE, {r('avg(value)', 'value')}, {r('avg(burst)', 'burst')} FROM b GROUP BY {CHS}, phase""")
def b6(spark, d):
    rows = N.persistent_burst(panel_long(spark, d), CH, thr_k=1.0)
    return N.phase_averages(rows, [*CH, "phase"], ["value", "burst"])


MM = ", ".join(r(f"(CASE WHEN max({f}) OVER () > min({f}) OVER () THEN ({f} - min({f}) OVER ()) / (max({f}) OVER () - min({f}) OVER ()) ELSE 0 END)", f) for f in FEATS)


@query("B7_global_minmax", f"WITH {PANEL} SELECT patient, seizure, electrode, epoch, {MM} FROM panel")
def b7(spark, d):
    return N.minmax_columns(panel(spark, d), FEATS).select("patient", "seizure", "electrode", "epoch", *FEATS)


@query("B8_group_zscore", f"""WITH {PANEL} SELECT patient, seizure, electrode, epoch,
 {r("(f_sum - avg(f_sum) OVER w) / (CASE WHEN stddev_samp(f_sum) OVER w = 0 THEN 1 ELSE stddev_samp(f_sum) OVER w END)", 'f_sum')},
 {r("(f_max - avg(f_max) OVER w) / (CASE WHEN stddev_samp(f_max) OVER w = 0 THEN 1 ELSE stddev_samp(f_max) OVER w END)", 'f_max')}
 FROM panel WINDOW w AS (PARTITION BY patient, seizure, epoch)""")
def b8(spark, d):
    return N.group_zscore(panel(spark, d), ["patient", "seizure", "epoch"], ["f_sum", "f_max"]).select(
        "patient", "seizure", "electrode", "epoch", "f_sum", "f_max")


@query("B9_standardize_train", f"""WITH {PANEL}, tr AS (SELECT * FROM panel WHERE patient <> 0) SELECT patient, seizure, electrode, epoch,
 {r('(f_sum - (SELECT avg(f_sum) FROM tr)) / (SELECT stddev_pop(f_sum) FROM tr)', 'f_sum')},
 {r('(f_avg - (SELECT avg(f_avg) FROM tr)) / (SELECT stddev_pop(f_avg) FROM tr)', 'f_avg')} FROM panel""")
def b9(spark, d):
    p = panel(spark, d)
    return N.standardize(p.where("patient <> 0"), p, ["f_sum", "f_avg"]).select(
        "patient", "seizure", "electrode", "epoch", "f_sum", "f_avg")


REL = ", ".join(
    f"{r(f)}, {r(f'{f} - avg({f}) OVER w', f + '_rel')}, "
    f"{r(f'({f} - avg({f}) OVER w) / (nullif(stddev_samp({f}) OVER w, 0) + 1e-6)', f + '_z')}, "
    f"{r(f'((rank() OVER (PARTITION BY patient, seizure ORDER BY {f})) + (count(*) OVER (PARTITION BY patient, seizure, {f}) - 1) / 2.0) / count({f}) OVER w', f + '_rank')}"
    for f in ("f_sum", "f_cnt"))


@query("B10_relative_features", f"WITH {PANEL} SELECT patient, seizure, electrode, epoch, {REL} FROM panel WINDOW w AS (PARTITION BY patient, seizure)")
def b10(spark, d):
    return N.relative_features(panel(spark, d), ["patient", "seizure"], ["electrode", "epoch"], ["f_sum", "f_cnt"])


@query("B11_display_minmax", f"""WITH {PANEL} SELECT patient, seizure, electrode, epoch,
 {r("CASE WHEN max(f_sum) OVER w = min(f_sum) OVER w THEN 0.5 ELSE (f_sum - min(f_sum) OVER w) / (max(f_sum) OVER w - min(f_sum) OVER w) END", 'f_sum')}
 FROM panel WINDOW w AS (PARTITION BY patient, seizure, electrode)""")
def b11(spark, d):
    return N.minmax_by_group(panel(spark, d), ["patient", "seizure", "electrode"], ["f_sum"], 0.5).select(
        "patient", "seizure", "electrode", "epoch", "f_sum")


@query("B12_l1_normalize", f"WITH {PANEL}, {PANEL_LONG} SELECT {CHS}, epoch, {r('value / nullif(sum(value) OVER (PARTITION BY patient, seizure, electrode, epoch), 0)', 'value')} FROM plong")
def b12(spark, d):
    return N.l1_normalize(panel_long(spark, d), ["patient", "seizure", "electrode", "epoch"]).select(*CH, "epoch", "value")


# --------------------------------------------------------------- segmentation
BOUNDS = "bd AS (SELECT recording, 10 + recording AS onset, 40 + recording AS offs FROM (SELECT DISTINCT recording FROM sig))"


@query("G1_split_at_onset", f"""WITH {SIGNAL}, {BOUNDS} SELECT channel, n, 'preictal' AS phase, {r('x')} FROM sig JOIN bd USING (recording) WHERE n <= onset
UNION ALL SELECT channel, n, 'ictal', {r('x')} FROM sig JOIN bd USING (recording) WHERE n >= onset AND n <= offs""")
def g1(spark, d):
    s = signal(spark, d)
    bounds = s.select("recording").distinct().select(
        "recording", (F.col("recording") + 10).alias("onset"), (F.col("recording") + 40).alias("offset"))
    return S.split_at_onset(s, bounds, ["recording"], time="n").select("channel", "n", "phase", "x")


@query("G2_average_reference", f"WITH {SIGNAL} SELECT channel, n, {r('x - avg(x) OVER (PARTITION BY recording, n)', 'x')} FROM sig")
def g2(spark, d):
    return S.average_reference(signal(spark, d), ["recording"]).select("channel", "n", "x")


WIN10 = f"WITH {SIGNAL}, {windows_sql(10)}"


def _win(spark, d, size=10):
    return S.fixed_windows(signal(spark, d), ["recording", "channel"], size)


@query("G3_fixed_windows", f"{WIN10} SELECT channel, epoch, count(*) AS size, {r('sum(x)', 'total')}, {r('min_by(x, i)', 'first')} FROM win GROUP BY ALL")
def g3(spark, d):
    return _win(spark, d).select("channel", "epoch", F.size("samples").cast("long").alias("size"),
                                 S.array_sum(F.col("samples")).alias("total"), F.col("samples")[0].alias("first"))


@query("G4_zscore_windows", f"{WIN10} SELECT channel, epoch, i, {r('(x - avg(x) OVER w) / greatest(stddev_pop(x) OVER w, 1e-12)', 'z')} FROM win WINDOW w AS (PARTITION BY channel, epoch)")
def g4(spark, d):
    return S.zscore_windows(_win(spark, d)).select("channel", "epoch", F.posexplode("samples").alias("i", "z"))


@query("G5_boundary_epochs", f"""WITH {PANEL} SELECT patient, seizure, electrode, phase, epoch, {r('f_sum')} FROM panel
QUALIFY CASE WHEN phase = 'preictal' THEN row_number() OVER (PARTITION BY patient, seizure, electrode, phase ORDER BY epoch DESC) <= 4
 ELSE row_number() OVER (PARTITION BY patient, seizure, electrode, phase ORDER BY epoch) <= 2 END""")
def g5(spark, d):
    return S.boundary_epochs(panel(spark, d), ["patient", "seizure", "electrode"], 4, 2).select(
        "patient", "seizure", "electrode", "phase", "epoch", "f_sum")


GK = "patient, seizure, electrode, phase"


@query("G6_random_epochs", f"""WITH {PANEL} SELECT {GK}, epoch, {r('f_sum')} FROM panel
QUALIFY row_number() OVER (PARTITION BY {GK} ORDER BY md5(concat_ws('|', {GK}, epoch, 7)), epoch)
 <= 2 + cast('0x' || substr(md5(concat_ws('|', {GK}, 7)), 1, 7) AS bigint) % 3""")
def g6(spark, d):
    return S.random_epochs(panel(spark, d), ["patient", "seizure", "electrode"], 7, 2, 4).select(
        "patient", "seizure", "electrode", "phase", "epoch", "f_sum")


@query("G7_narrow_epochs", f"""WITH {PANEL} SELECT patient, seizure, phase, epoch FROM (SELECT DISTINCT patient, seizure, phase, epoch FROM panel)
QUALIFY CASE WHEN phase = 'preictal' THEN row_number() OVER (PARTITION BY patient, seizure, phase ORDER BY epoch DESC) <= 5
 ELSE row_number() OVER (PARTITION BY patient, seizure, phase ORDER BY epoch) <= 5 END""")
def g7(spark, d):
    days = panel(spark, d).select("patient", "seizure", "phase", "epoch").distinct()
    return S.boundary_epochs(days, ["patient", "seizure"], 5, 5)


# ------------------------------------------------------- time-domain features
TD = f"""{WIN10}, lg AS (SELECT *, lag(x) OVER w AS xp, lead(x) OVER w AS xn FROM win WINDOW w AS (PARTITION BY channel, epoch ORDER BY i)),
df AS (SELECT *, x - xp AS dx, CASE WHEN xp IS NOT NULL AND xn IS NOT NULL THEN x * x - xp * xn END AS tk,
 CASE WHEN xp IS NOT NULL AND xn IS NOT NULL THEN xn - 2 * x + xp END AS ddx FROM lg),
mu AS (SELECT *, avg(x) OVER (PARTITION BY channel, epoch) AS m FROM df),
td AS (SELECT recording, channel, epoch, avg(x) FILTER (i >= 5) - avg(x) FILTER (i < 5) AS dc_shift, sum(abs(dx)) AS line_length,
 avg(tk) AS tkeo_energy, sqrt(avg(x * x)) AS rms, var_pop(x) AS v0, var_pop(dx) AS v1, var_pop(ddx) AS v2,
 avg(pow(x - m, 3)) AS m3, avg(pow(x - m, 4)) AS m4 FROM mu GROUP BY ALL)"""


@query("N6_N10_time_features", f"{TD} SELECT channel, epoch, {r('dc_shift')}, {r('line_length')}, {r('tkeo_energy')}, {r('rms')} FROM td")
def n6(spark, d):
    return S.time_features(_win(spark, d), ["channel", "epoch"]).select(
        "channel", "epoch", "dc_shift", "line_length", "tkeo_energy", "rms")


@query("N13_hjorth", f"""{TD} SELECT channel, epoch, {r('v0', 'hjorth_activity')}, {r('sqrt(v1 / (v0 + 1e-12))', 'hjorth_mobility')},
 {r('sqrt(v2 / (v1 + 1e-12)) / (sqrt(v1 / (v0 + 1e-12)) + 1e-12)', 'hjorth_complexity')} FROM td""")
def n13(spark, d):
    return S.time_features(_win(spark, d), ["channel", "epoch"]).select(
        "channel", "epoch", "hjorth_activity", "hjorth_mobility", "hjorth_complexity")


@query("N14_skew_kurtosis", f"""{TD} SELECT channel, epoch, {r('sqrt(90.0) / 8 * m3 / nullif(pow(v0, 1.5), 0)', 'skewness')},
 {r('(99 * m4 / nullif(v0 * v0, 0) - 3 * 81) / 56', 'kurtosis')} FROM td""")
def n14(spark, d):
    return S.time_features(_win(spark, d), ["channel", "epoch"]).select("channel", "epoch", "skewness", "kurtosis")


@query("N4_across_channel_scores", f"""{TD}, q AS (SELECT recording, epoch, quantile_cont(rms, 0.3) AS lo, quantile_cont(rms, 0.7) AS hi FROM td GROUP BY ALL)
SELECT channel, epoch, {r('line_length / (line_length + 1e-9) * CAST(rms < lo AS INTEGER)', 'lvfa_score')},
 {r('tkeo_energy / (tkeo_energy + 1e-9) * CAST(rms > hi AS INTEGER)', 'hafa_score')} FROM td JOIN q USING (recording, epoch)""")
def n4(spark, d):
    f = S.time_features(_win(spark, d), ["recording", "channel", "epoch"])
    return S.across_channel_scores(f, ["recording", "epoch"], low="line_length", high="tkeo_energy").select(
        "channel", "epoch", "lvfa_score", "hafa_score")


@query("X8_moving_average", f"WITH {SIGNAL} SELECT channel, n, {r('sum(x) OVER (PARTITION BY channel ORDER BY n ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5', 'smooth')} FROM sig")
def x8(spark, d):
    return S.moving_average(signal(spark, d), ["channel"], "n", "x", 5).select("channel", "n", "smooth")


@query("X9_step_vector", f"""WITH {TRACE}, o AS (SELECT patient, seizure_id, node_index, min(CASE WHEN value >= 0.95 THEN t END) AS onset FROM trace GROUP BY ALL)
SELECT patient, seizure_id, node_index, t, CASE WHEN t >= onset THEN 1 ELSE 0 END AS y FROM trace JOIN o USING (patient, seizure_id, node_index)""")
def x9(spark, d):
    t = N.with_totals(traces(spark, d), ["patient", "seizure_id", "node_index"], {"onset": F.min(F.when(F.col("value") >= 0.95, F.col("t")))})
    return t.select("patient", "seizure_id", "node_index", "t", S.step_vector("t", "onset").alias("y"))
