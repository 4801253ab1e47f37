"""Queries for onset-aligned sequences (Q)."""

from pyspark.sql import functions as F

from onsetry.operators import sequences as Q
from onsetry.operators.traces import onset_simple
from onsetry.plans.bindings import PANEL, panel
from onsetry.plans.registry import query, r

REC = ["patient", "seizure", "electrode"]
RC = "patient, seizure, electrode"
TL = f"""{PANEL}, tl AS (SELECT {RC}, phase, epoch, patient || '/' || seizure || '/' || phase || '/' || epoch AS path,
 CAST(count(*) OVER (PARTITION BY {RC}) AS INTEGER) AS n,
 CAST(count(*) FILTER (phase = 'preictal') OVER (PARTITION BY {RC}) AS INTEGER) AS n_pre,
 CAST(row_number() OVER (PARTITION BY {RC} ORDER BY epoch) - 1 AS INTEGER) AS pos FROM panel),
rec AS (SELECT DISTINCT {RC}, n, n_pre FROM tl)"""


def _timeline(spark, d):
    p = panel(spark, d).select(*REC, "phase", "epoch")
    path = F.concat_ws("/", "patient", "seizure", "phase", "epoch")
    return Q.relative_time(p.withColumn("path", path), REC)


def items_sql(spans: str) -> str:
    """Brute force: list every candidate span of every recording, then join the rows it covers."""
    return f"""WITH {TL}, spans AS ({spans}),
it AS (SELECT tl.*, seq_id, lo, len, pos - lo AS step FROM tl JOIN spans USING ({RC}) WHERE pos >= lo AND pos < lo + len)"""


OUT = f"SELECT {RC}, CAST(seq_id AS INTEGER) AS seq_id, CAST(len AS INTEGER) AS len, CAST(step AS INTEGER) AS step, path FROM it"
COLS = [*REC, "seq_id", "len", "step", "path"]
CROSS = "i < n_pre AND i + {L} > n_pre AND n > n_pre AND i + {L} <= n AND i % {S} = 0"


@query("Q1_relative_time", f"WITH {TL} SELECT {RC}, phase, epoch, pos, pos - n_pre AS t_rel FROM tl")
def q1(spark, d):
    return _timeline(spark, d).select(*REC, "phase", "epoch", "pos", "t_rel")


SLIDE = f"""SELECT {RC}, i // 2 AS seq_id, i AS lo, 6 AS len FROM rec, range(0, 40) t(i) WHERE n >= 6 AND {CROSS.format(L=6, S=2)}
 UNION ALL SELECT {RC}, 0, 0, n FROM rec WHERE n < 6 AND n >= 3 AND n_pre > 0 AND n > n_pre"""


@query("Q2_sliding_sequences", f"{items_sql(SLIDE)} {OUT}")
def q2(spark, d):
    return Q.items(_timeline(spark, d), Q.sliding_spans(6, 2, True, 3)).select(*COLS)


@query("Q3_sliding_bounded_ictal", f"""{items_sql(f'''SELECT {RC}, i // 2 AS seq_id, i AS lo, 8 AS len FROM rec, range(0, 40) t(i)
 WHERE {CROSS.format(L=8, S=2)} AND i + 8 - n_pre BETWEEN 1 AND 3''')} {OUT}""")
def q3(spark, d):
    return Q.items(_timeline(spark, d), Q.sliding_spans(8, 2, ictal=(1, 3))).select(*COLS)


# lack and surplus spelled out: take what is there, then lend the rest
ADAPT = f"""SELECT {RC}, 0 AS seq_id, lo, hi - lo AS len FROM (
 SELECT *, greatest(0, n_pre - p2) AS lo, least(n, n_pre + q2 + 1) AS hi FROM (
 SELECT *, least(n_pre, p + greatest(0, 4 - q)) AS p2, least(n - 1 - n_pre, q + greatest(0, 5 - p)) AS q2 FROM (
 SELECT *, least(5, n_pre) AS p, least(4, n - 1 - n_pre) AS q FROM rec WHERE n > n_pre AND n_pre > 0))) WHERE hi - lo >= 6"""


@query("Q4_onset_adaptive", f"{items_sql(ADAPT)} {OUT}")
def q4(spark, d):
    return Q.items(_timeline(spark, d), Q.adaptive_spans(5, 4, 6)).select(*COLS)


@query("Q5_centered_longest", f"""{items_sql(f'''SELECT {RC}, 0 AS seq_id, n_pre - k AS lo, 2 * k + 1 AS len FROM (
 SELECT {RC}, n_pre, max(k) AS k FROM rec, range(1, 40) t(k) WHERE n_pre - k >= 0 AND n_pre + k < n GROUP BY ALL)''')} {OUT}""")
def q5(spark, d):
    return Q.items(_timeline(spark, d), Q.centered_spans()).select(*COLS)


@query("Q5_centered_controlled", f"""{items_sql(f'SELECT {RC}, 0 AS seq_id, n_pre - 4 AS lo, 7 AS len FROM rec WHERE n_pre >= 4 AND n_pre + 3 <= n')} {OUT}""")
def q5c(spark, d):
    return Q.items(_timeline(spark, d), Q.centered_spans((4, 3))).select(*COLS)


@query("Q6_three_offsets", f"""{items_sql(f'''SELECT {RC}, j AS seq_id, n_pre - [CAST(floor(0.25 * (l - 1)) AS INTEGER), (l - 1) // 2, CAST(floor(0.75 * (l - 1)) AS INTEGER)][j + 1] AS lo, l AS len FROM (
 SELECT {RC}, n, n_pre, CAST(max(l) AS INTEGER) AS l FROM rec, range(3, 60) t(l)
  WHERE n_pre > 0 AND n - n_pre > 1 AND l <= 2 * least(n_pre, n - n_pre - 1) + 1
  AND floor(0.25 * (l - 1)) >= 1 AND floor(0.75 * (l - 1)) <= l - 2 AND floor(0.75 * (l - 1)) <= n_pre AND (l - 1) // 2 <= n_pre
  AND l - floor(0.25 * (l - 1)) <= n - n_pre AND l - (l - 1) // 2 <= n - n_pre AND l - floor(0.75 * (l - 1)) <= n - n_pre GROUP BY ALL), range(0, 3) u(j)''')} {OUT}""")
def q6(spark, d):
    return Q.items(_timeline(spark, d), Q.offset_spans()).select(*COLS)


def _split_sequences(spark, d):
    """Sliding sequences as train, the longest centred ones bounded to 7 windows as test."""
    tl = _timeline(spark, d)
    train = Q.path_arrays(Q.items(tl, Q.sliding_spans(6, 2)), REC).withColumn("split", F.lit("train"))
    onset = Q.path_arrays(Q.items(tl, Q.adaptive_spans(3, 2, 6, seq_id=1000)), REC).withColumn("split", F.lit("train"))
    test = Q.path_arrays(Q.items(tl, Q.centered_spans((4, 3))), REC).withColumn("split", F.lit("test"))
    return train.unionByName(onset).unionByName(test)


SPLITS = f"""{items_sql(f'''SELECT {RC}, 'train' AS split, i // 2 AS seq_id, i AS lo, 6 AS len FROM rec, range(0, 40) t(i) WHERE n >= 6 AND {CROSS.format(L=6, S=2)}
 UNION ALL SELECT {RC}, 'train', 1000, lo, hi - lo AS len FROM (
 SELECT *, greatest(0, n_pre - p2) AS lo, least(n, n_pre + q2 + 1) AS hi FROM (
 SELECT *, least(n_pre, p + greatest(0, 2 - q)) AS p2, least(n - 1 - n_pre, q + greatest(0, 3 - p)) AS q2 FROM (
 SELECT *, least(3, n_pre) AS p, least(2, n - 1 - n_pre) AS q FROM rec WHERE n > n_pre AND n_pre > 0))) WHERE hi - lo >= 6
 UNION ALL SELECT {RC}, 'test', 0, n_pre - 4, 7 FROM rec WHERE n_pre >= 4 AND n_pre + 3 <= n''').replace('seq_id, lo, len,', 'split, seq_id, lo, len,')},
sq AS (SELECT {RC}, split, seq_id, string_agg(path, '|' ORDER BY step) AS paths, bool_or(phase = 'preictal') AS pre, bool_or(phase = 'ictal') AS ict FROM it GROUP BY ALL)"""


@query("Q7_split_both_phases", f"""{items_sql(SLIDE)} SELECT {RC}, bool_or(phase = 'preictal') AND bool_or(phase = 'ictal') AS both_phases FROM it GROUP BY ALL""")
def q7(spark, d):
    return Q.split_has_both(Q.items(_timeline(spark, d), Q.sliding_spans(6, 2, True, 3)), REC)


@query("Q7_path_phase", f"WITH {TL} SELECT {RC}, path, phase = 'ictal' AS is_ictal FROM tl")
def q7p(spark, d):
    return _timeline(spark, d).select(*REC, "path", Q.path_has_phase(F.col("path"), "ictal").alias("is_ictal"))


@query("Q8_deduplicate", f"{SPLITS} SELECT {RC}, split, paths, CAST(min(seq_id) AS INTEGER) AS seq_id FROM sq GROUP BY ALL")
def q8(spark, d):
    u = Q.deduplicate(_split_sequences(spark, d), [*REC, "split"])
    return u.select(*REC, "split", F.array_join("paths", "|").alias("paths"), "seq_id")


@query("Q9_patient_summary", f"""{SPLITS}, ns AS (SELECT electrode, count(DISTINCT seizure) AS n_seizures FROM tl GROUP BY ALL),
u AS (SELECT electrode, split, pre, ict, paths, seizure FROM sq GROUP BY ALL),
c AS (SELECT electrode, count(*) FILTER (split = 'train') AS n_train_seqs, count(*) FILTER (split = 'test') AS n_test_seqs,
 bool_or(pre) FILTER (split = 'train') AND bool_or(ict) FILTER (split = 'train') AND bool_or(pre) FILTER (split = 'test') AND bool_or(ict) FILTER (split = 'test') AS ok FROM u GROUP BY ALL)
SELECT electrode, n_seizures, n_train_seqs, n_test_seqs FROM ns JOIN c USING (electrode) WHERE ok AND n_seizures >= 4""")
def q9(spark, d):
    u = Q.deduplicate(_split_sequences(spark, d), [*REC, "split"])
    return Q.patient_summary(u, panel(spark, d).select("electrode", "seizure"), 4, patient="electrode")


@query("Q10_all_in_train", f"{SPLITS} SELECT DISTINCT {RC}, 'train' AS split, paths FROM sq")
def q10(spark, d):
    u = Q.all_in_train(_split_sequences(spark, d), REC)
    return u.select(*REC, "split", F.array_join("paths", "|").alias("paths"))


SEQ_KEYS = f"sk AS (SELECT DISTINCT {RC}, CAST(seq_id AS INTEGER) AS seq_id FROM it)"


def _seq_keys(spark, d):
    return Q.items(_timeline(spark, d), Q.sliding_spans(6, 2, True, 3)).select(*REC, "seq_id").distinct()


@query("Q11_middle_sequences", f"""{items_sql(SLIDE)}, {SEQ_KEYS}, k AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY {RC}) AS c FROM sk
 WINDOW w AS (PARTITION BY {RC} ORDER BY seq_id)) SELECT {RC}, seq_id FROM k WHERE CASE WHEN c % 3 = 0 THEN i % 3 = 1 ELSE i = c // 2 END""")
def q11(spark, d):
    return Q.middle_sequences(_seq_keys(spark, d), REC)


@query("Q11_middle_half", f"""{items_sql(SLIDE)}, {SEQ_KEYS}, k AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY {RC}) AS c FROM sk
 WINDOW w AS (PARTITION BY {RC} ORDER BY seq_id)) SELECT {RC}, seq_id FROM k WHERE i = c // 2""")
def q11h(spark, d):
    return Q.middle_sequences(_seq_keys(spark, d), REC, chunks_of_three=False)


@query("Q12_first_sequences", f"{items_sql(SLIDE)}, {SEQ_KEYS} SELECT {RC}, min(seq_id) AS seq_id FROM sk GROUP BY ALL")
def q12(spark, d):
    return Q.first_sequences(_seq_keys(spark, d), REC)


@query("Q13_random_sequence", f"""{items_sql(SLIDE)}, {SEQ_KEYS} SELECT {RC}, seq_id FROM sk
QUALIFY row_number() OVER (PARTITION BY {RC} ORDER BY md5(concat_ws('|', {RC}, seq_id, 42)), seq_id) = 1""")
def q13(spark, d):
    return Q.random_sequence(_seq_keys(spark, d), REC, 42)


INFO = f"si AS (SELECT {RC}, CAST(seq_id AS INTEGER) AS seq_id, CAST(len AS INTEGER) AS len, min(CASE WHEN phase = 'ictal' THEN CAST(step AS INTEGER) END) AS t_true FROM it GROUP BY ALL)"
COVER = f"""bc AS (SELECT *, greatest(0, t_true - 2) AS t0, least(len - 1, t_true + 2) AS t1 FROM si WHERE t_true IS NOT NULL),
bw AS (SELECT * FROM bc WHERE t1 > t0 QUALIFY row_number() OVER (PARTITION BY {RC} ORDER BY t1 - t0 DESC, seq_id) = 1)"""


def _items_values(spark, d):
    p = panel(spark, d).withColumn("p", F.col("f_avg") / (1 + F.col("f_avg")))
    tl = Q.relative_time(p.select(*REC, "phase", "epoch", "p"), REC)
    return Q.items(tl, Q.sliding_spans(6, 2, True, 3)).withColumnRenamed("step", "t")


def _seq_info(items):
    return items.groupBy(*REC, "seq_id").agg(
        F.max("len").alias("len"), F.min(F.when(F.col("phase") == "ictal", F.col("t"))).alias("t_true"))


@query("Q14_covering_window", f"{items_sql(SLIDE)}, {INFO}, {COVER} SELECT {RC}, seq_id, t0, t1, t_true FROM bw")
def q14(spark, d):
    return Q.covering_windows(_seq_info(_items_values(spark, d)), REC, 2, 2)


ITV = items_sql(SLIDE).replace("|| epoch AS path,", "|| epoch AS path, f_avg / (1 + f_avg) AS p,")


@query("Q14_centered_rows", f"""{ITV}, {INFO}, {COVER}, wr AS (SELECT it.*, t0, t1, t_true FROM it JOIN bw USING ({RC}, seq_id) WHERE step BETWEEN t0 AND t1),
ok AS (SELECT *, min(p) OVER w >= 0.9 AND count(*) OVER w = 2 AS ok FROM wr WINDOW w AS (PARTITION BY {RC} ORDER BY step ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING)),
o AS (SELECT {RC}, coalesce(min(CASE WHEN ok THEN step - t0 END), -1) AS t_onset FROM ok GROUP BY ALL)
SELECT {RC}, CAST(seq_id AS INTEGER) AS seq_id, CAST(step AS INTEGER) AS t, CAST(step - t_true AS INTEGER) AS t_rel, {r('p')}, CASE WHEN step >= t_true THEN 1 ELSE 0 END AS true_ictal,
 CASE WHEN t_onset >= 0 AND step - t0 >= t_onset THEN 1 ELSE 0 END AS pred_ictal FROM wr JOIN o USING ({RC})""")
def q14r(spark, d):
    it = _items_values(spark, d)
    info = _seq_info(it)
    best = Q.covering_windows(info, REC, 2, 2)
    inside = it.join(best, [*REC, "seq_id"]).where("t between t0 and t1").withColumn("u", F.col("t") - F.col("t0"))
    onsets = onset_simple(inside, [*REC, "seq_id"], "u", "p", 0.9, 2)
    return Q.centered_window_rows(it, info, onsets, REC, 2, 2).select(
        *REC, "seq_id", "t", "t_rel", "p", "true_ictal", "pred_ictal")


@query("Q15_align_steps", f"""{items_sql(SLIDE)} SELECT electrode, seizure, CAST(step AS INTEGER) AS step, CAST(seq_id AS INTEGER) AS seq_id, CAST(phase = 'ictal' AS INTEGER) AS y,
 count(*) OVER (PARTITION BY electrode, seizure, step) AS n_present FROM it""")
def q15(spark, d):
    it = Q.items(_timeline(spark, d), Q.sliding_spans(6, 2, True, 3))
    return Q.align_steps(it, ["electrode", "seizure"])


@query("Q16_report", f"""{items_sql(SLIDE)} SELECT {RC}, CAST(seq_id AS INTEGER) AS seq_id, count(*) AS length, min(CASE WHEN phase = 'ictal' THEN CAST(step AS INTEGER) END) AS onset_idx,
 {r("100.0 * min(CASE WHEN phase = 'ictal' THEN step END) / greatest(1, count(*) - 1)", 'onset_pct')} FROM it GROUP BY {RC}, seq_id""")
def q16(spark, d):
    return Q.report(Q.items(_timeline(spark, d), Q.sliding_spans(6, 2, True, 3)), REC)
