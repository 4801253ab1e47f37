"""Queries for onset detection and trace features (T)."""

from pyspark.sql import functions as F

from onsetry.functions import scalars as X
from onsetry.operators import traces as T
from onsetry.plans.bindings import NODE, TRACE, traces
from onsetry.plans.registry import query, r

K = "patient, seizure_id, node_index, is_soz"
KEYS = ["patient", "seizure_id", "node_index"]
KS = "patient, seizure_id, node_index"
STEP = ["patient", "seizure_id", "t"]


@query("T1_onset_simple", f"""WITH {TRACE}, ok AS (SELECT *, min(value) OVER w >= 0.9 AND count(*) OVER w = 3 AS ok FROM trace
 WINDOW w AS (PARTITION BY {KS} ORDER BY t ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING))
SELECT {KS}, coalesce(min(CASE WHEN ok THEN t END), -1) AS t_onset FROM ok GROUP BY ALL""")
def t1(spark, d):
    return T.onset_simple(traces(spark, d), KEYS, p="value", thr=0.9)


@query("T1_onset_argmax_fallback", f"""WITH {TRACE}, ok AS (SELECT *, min(value) OVER w >= 0.9 AND count(*) OVER w = 3 AS ok FROM trace
 WINDOW w AS (PARTITION BY {KS} ORDER BY t ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
pk AS (SELECT {KS}, t AS tp FROM trace QUALIFY row_number() OVER (PARTITION BY {KS} ORDER BY value DESC, t) = 1)
SELECT {KS}, coalesce(min(CASE WHEN ok THEN t END), max(tp)) AS t_onset FROM ok JOIN pk USING ({KS}) GROUP BY {KS}""")
def t1f(spark, d):
    return T.onset_simple(traces(spark, d), KEYS, p="value", thr=0.9, fallback=True)


# the state machine as a recursive query: one row per step carries the run length
@query("T2_onset_adaptive", f"""WITH RECURSIVE {TRACE},
st AS (SELECT {KS}, least(greatest(avg(value) FILTER (t < 5) + 2 * stddev_pop(value) FILTER (t < 5),
  quantile_cont(value, 0.95) FILTER (t < 5), 0.55), 0.85, min(value) + 0.6 * greatest(1e-6, max(value) - min(value))) AS h FROM trace GROUP BY ALL),
x AS (SELECT trace.*, h, lag(value, 2) OVER w AS x2, lag(value, 1) OVER w AS x1,
  lead(value, 1) OVER w AS n1, lag(value, 1) OVER w AS p1, lag(value, 2) OVER w AS p2
  FROM trace JOIN st USING ({KS}) WINDOW w AS (PARTITION BY {KS} ORDER BY t)),
run AS (
 SELECT {KS}, 0 AS t, CASE WHEN value >= h THEN 1 ELSE 0 END AS c FROM x WHERE t = 0
 UNION ALL
 SELECT x.patient, x.seizure_id, x.node_index, x.t, CASE WHEN x.value < x.h THEN 0
   WHEN x.t >= 2 AND (x.value - x.x2) / 2 < 0.02 THEN 0 ELSE run.c + 1 END
 FROM run JOIN x ON x.patient = run.patient AND x.seizure_id = run.seizure_id AND x.node_index = run.node_index AND x.t = run.t + 1),
hit AS (SELECT {KS}, min(x.t - 2) AS t0 FROM run JOIN x USING ({KS}, t) WHERE c >= 3 AND value >= 0.8 * h AND p1 >= 0.8 * h AND p2 >= 0.8 * h GROUP BY ALL),
rise AS (SELECT {KS}, t FROM x WHERE x1 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {KS} ORDER BY value - x1 DESC, t) = 1)
SELECT st.patient, st.seizure_id, st.node_index, coalesce(hit.t0, rise.t, -1) AS t_onset FROM st
 LEFT JOIN hit USING ({KS}) LEFT JOIN rise USING ({KS})""")
def t2(spark, d):
    return T.onset_adaptive(traces(spark, d), KEYS, p="value", pre_window=5)


ONSETS = f"""tt AS (SELECT patient, seizure_id, node_index, min(CASE WHEN t >= 4 THEN t END) AS t_true FROM trace GROUP BY ALL)"""


def _phased(spark, d):
    return traces(spark, d).withColumn("phase", F.when(F.col("t") >= 4, "ictal").otherwise("preictal"))


@query("T3_true_onset_delay", f"""WITH {TRACE}, {ONSETS}, ok AS (SELECT *, min(value) OVER w >= 0.9 AND count(*) OVER w = 3 AS ok FROM trace
 WINDOW w AS (PARTITION BY {KS} ORDER BY t ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
p AS (SELECT {KS}, coalesce(min(CASE WHEN ok THEN t END), -1) AS t_onset FROM ok GROUP BY ALL)
SELECT {KS}, t_onset, t_true, CASE WHEN t_onset >= 0 THEN t_onset - t_true END AS delay FROM p JOIN tt USING ({KS})""")
def t3(spark, d):
    t = _phased(spark, d)
    return T.onset_delay(T.onset_simple(t, KEYS, p="value", thr=0.9), T.true_onset(t, KEYS), KEYS)


CL = "greatest(1e-7, least(1 - 1e-7, value))"


@query("T4_sequence_quality", f"""WITH {TRACE}, y AS (SELECT *, CASE WHEN t >= 4 THEN 1 ELSE 0 END AS y FROM trace),
k AS (SELECT *, rank() OVER (PARTITION BY {KS} ORDER BY value) + (count(*) OVER (PARTITION BY {KS}, value) - 1) / 2.0 AS rk FROM y)
SELECT {KS}, {r(f'avg(-(y * ln({CL}) + (1 - y) * ln(1 - {CL})))', 'bce')},
 {r('(sum(rk * y) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * (count(*) - sum(y)), 0)', 'auc')}, count(*) AS n_steps FROM k GROUP BY ALL""")
def t4(spark, d):
    t = traces(spark, d).withColumn("y", (F.col("t") >= 4).cast("int"))
    return T.sequence_quality(t, KEYS, p="value")


@query("T5_onset_bce", f"""WITH {TRACE}, {ONSETS} SELECT {KS}, {r(f'avg(CASE WHEN t >= t_true THEN -ln({CL}) ELSE -ln(1 - {CL}) END)', 'bce_onset')},
 max(t_true) AS t_true FROM trace JOIN tt USING ({KS}) WHERE t_true IS NOT NULL GROUP BY {KS}""")
def t5(spark, d):
    t = _phased(spark, d)
    return T.onset_bce(t.join(T.true_onset(t, KEYS), KEYS), KEYS, p="value")


SUMMARY = f"""lg AS (SELECT *, lag(value) OVER w AS pv, lag(t) OVER w AS pt FROM trace WINDOW w AS (PARTITION BY {KS} ORDER BY t)),
sm AS (SELECT {K}, count(*) AS n_steps, avg(value) AS mean, stddev_pop(value) AS std, median(value) AS median, min(value) AS min, max(value) AS max,
 max(value) - min(value) AS range, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr, avg(value - pv) AS slope_mean,
 stddev_pop(value - pv) AS slope_std, sum((value + pv) / 2 * (t - pt)) AS area, max(abs(value)) = 0 AND max(is_soz) = 1 AS is_flat_zero
 FROM lg GROUP BY ALL HAVING count(*) >= 3),
pk AS (SELECT {K}, CAST(t AS DOUBLE) AS time_to_peak, value AS top FROM trace QUALIFY row_number() OVER (PARTITION BY {KS} ORDER BY value DESC, t) = 1)"""


@query("T6_T7_trace_summary", f"""WITH {TRACE}, {SUMMARY} SELECT {K}, n_steps, {r('mean')}, {r('std')}, {r('median')}, {r('sm.min', 'min')}, {r('sm.max', 'max')},
 {r('range')}, {r('iqr')}, {r('slope_mean')}, {r('slope_std')}, {r('area')}, time_to_peak, is_flat_zero FROM sm JOIN pk USING ({K})""")
def t6(spark, d):
    return T.trace_summary(traces(spark, d), NODE)


@query("T8_rise_decay", f"""WITH {TRACE}, {SUMMARY} SELECT {K}, CAST(min(CASE WHEN value >= 0.9 * top THEN t END) - min(CASE WHEN value >= 0.1 * top THEN t END) AS DOUBLE) AS rise_time,
 CAST(min(CASE WHEN t >= time_to_peak AND value <= 0.5 * top THEN t END) - min(CASE WHEN t >= time_to_peak AND value <= 0.9 * top THEN t END) AS DOUBLE) AS decay_time
 FROM trace JOIN pk USING ({K}) GROUP BY ALL""")
def t8(spark, d):
    return T.rise_and_decay(traces(spark, d), NODE)


@query("T9_trace_spectrum", f"""WITH {TRACE}, c AS (SELECT *, value - avg(value) OVER (PARTITION BY {KS}) AS v, count(*) OVER (PARTITION BY {KS}) AS n FROM trace),
b AS (SELECT {K}, k, max(n) AS n, sqrt(pow(sum(v * cos(2 * pi() * k * t / n)), 2) + pow(sum(v * sin(2 * pi() * k * t / n)), 2)) AS a
 FROM (SELECT *, unnest(range(0, n // 2 + 1)) AS k FROM c WHERE n >= 3) GROUP BY {K}, k),
q AS (SELECT *, a / (sum(a) OVER w + 1e-12) + 1e-12 AS q FROM b WINDOW w AS (PARTITION BY {KS})),
z AS (SELECT *, q / sum(q) OVER (PARTITION BY {KS}) AS z FROM q)
SELECT {K}, {r("max_by(k / n, round(a, 9) * 1000 - k / 1000000.0)", 'fft_peak_freq')}, {r('sum(a * a)', 'fft_energy')}, {r('sum(-z * ln(z))', 'spectral_entropy')}
 FROM z GROUP BY {K}""")
def t9(spark, d):
    return T.trace_spectrum(traces(spark, d), NODE)


@query("T10_flat_zero", f"WITH {TRACE} SELECT {K}, max(abs(value)) = 0 AND max(is_soz) = 1 AS is_flat_zero FROM trace GROUP BY ALL HAVING count(*) >= 3")
def t10(spark, d):
    return T.trace_summary(traces(spark, d), NODE).select(*NODE, "is_flat_zero")


ATT = """attn AS (SELECT *, exp(value * 3) / sum(exp(value * 3)) OVER (PARTITION BY patient, seizure_id, t) AS att FROM trace)"""


@query("T11_pool_nodes", f"""WITH {TRACE}, {ATT}, g AS (SELECT *, row_number() OVER (PARTITION BY patient, seizure_id, t ORDER BY value DESC, node_index) AS rk,
 count(*) OVER (PARTITION BY patient, seizure_id, t) AS n, sum(att) OVER (PARTITION BY patient, seizure_id, t) AS s FROM attn)
SELECT patient, seizure_id, t, {r('avg(value)', 'mean')}, {r('max(value)', 'max')}, {r('sum(att * value) / sum(att)', 'att_mean')},
 {r('coalesce(avg(CASE WHEN value > 0 THEN value END), 0)', 'active_mean')},
 {r('avg(CASE WHEN rk <= greatest(1, ceil(0.2::DOUBLE * n)) THEN value END)', 'topk_mean')},
 {r('1 - exp(sum(ln(greatest(1e-6, least(1, 1 - att / (s + 1e-12) * value)))))', 'noisy_or')} FROM g GROUP BY ALL""")
def t11(spark, d):
    att = T.attention_weights(traces(spark, d).withColumn("logit", F.col("value") * 3), STEP)
    return T.pool_nodes(att, STEP, "value", att="att")


@query("T13_attention", f"WITH {TRACE}, {ATT} SELECT patient, seizure_id, t, node_index, {r("att")} FROM attn")
def t13(spark, d):
    att = T.attention_weights(traces(spark, d).withColumn("logit", F.col("value") * 3), STEP)
    return att.select(*STEP, "node_index", "att")


# the walk over the steps as a recursive query: a row holds one channel of one step and its gated value
GATE = "greatest(0.8::DOUBLE * prev.p_gated, 0)"


@query("T12_persistent_gate", f"""WITH RECURSIVE {TRACE}, x AS (SELECT patient, seizure_id, t, node_index, greatest(0, least(1, value)) AS p,
  row_number() OVER (PARTITION BY patient, seizure_id, t ORDER BY value DESC, node_index) AS rk,
  count(*) OVER (PARTITION BY patient, seizure_id, t) AS n FROM trace),
y AS (SELECT *, greatest(1, ceil(0.2::DOUBLE * n)) AS k, least(ceil(0.1::DOUBLE * n), greatest(1, ceil(0.2::DOUBLE * n))) AS kn FROM x),
g AS (SELECT patient, seizure_id, t, node_index, CASE WHEN rk <= k THEN p ELSE 0 END AS p_gated FROM y WHERE t = 0
 UNION ALL
 SELECT patient, seizure_id, t, node_index, CASE WHEN keep OR r2 <= k - nk OR rk <= k THEN p ELSE 0 END FROM (
  SELECT *, sum(keep::INT) OVER (PARTITION BY patient, seizure_id, t) AS nk,
    row_number() OVER (PARTITION BY patient, seizure_id, t, keep ORDER BY rk) AS r2 FROM (
   SELECT *, stay OR r1 <= least(kn, greatest(0, k - ns)) AS keep FROM (
    SELECT *, sum(stay::INT) OVER (PARTITION BY patient, seizure_id, t) AS ns,
      row_number() OVER (PARTITION BY patient, seizure_id, t, stay ORDER BY rk) AS r1 FROM (
     SELECT y.*, prev.p_gated > 0 AND y.p >= {GATE} AS stay FROM y JOIN g prev ON y.patient = prev.patient
      AND y.seizure_id = prev.seizure_id AND y.node_index = prev.node_index AND y.t = prev.t + 1)))))
SELECT patient, seizure_id, t, node_index, {r('p_gated')}, p_gated > 0 AS active FROM g""")
def t12(spark, d):
    return T.persistent_gate(traces(spark, d), ["patient", "seizure_id"], p="value")


@query("X7_sigmoid_logit", f"""WITH {TRACE} SELECT {KS}, t, {r('1 / (1 + exp(-(4 * value - 2)))', 'sigmoid')},
 {r('ln(greatest(1e-12, least(1 - 1e-12, value)) / (1 - greatest(1e-12, least(1 - 1e-12, value))))', 'logit')} FROM trace""")
def x7(spark, d):
    return traces(spark, d).select(*KEYS, "t", X.sigmoid(4 * F.col("value") - 2).alias("sigmoid"), X.logit(F.col("value")).alias("logit"))
