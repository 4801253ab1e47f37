"""Queries for layout parsing, sources and sinks (S), names (X) and label joins."""

import uuid

from pyspark.sql import functions as F

from onsetry.functions import scalars as SC
from onsetry.functions import strings as X
from onsetry.operators import normalize as N
from onsetry.operators.lineage import shared_dir, stored
from onsetry.plans.bindings import FEATS, PANEL, PRED, TRACE, panel, predictions, table, traces
from onsetry.plans.registry import query, r
from onsetry.sources import readers as S
from onsetry.sources import sinks

KEYS = ["patient", "seizure", "electrode", "epoch"]
ROOT = "/data"


def work_dir(spark) -> str:
    """A fresh folder under the cluster's shared checkpoint folder."""
    return f"{shared_dir(spark)}/onsetry-{uuid.uuid4().hex}"


# ------------------------------------------------------------- paths and names
NODE_PATH = """np AS (SELECT *, CASE WHEN patient % 2 = 0 THEN 'CHUM' ELSE 'ds004100' END AS ds, CASE WHEN patient % 4 = 1 THEN 'good outcome' ELSE 'bad outcome' END AS oc FROM panel)"""


def _node_paths(spark, d):
    """One file path per panel row: half the patients in a layout with outcome folders."""
    p = panel(spark, d)
    phase, pat = F.col("phase"), F.concat(F.lit("P"), F.col("patient").cast("string"))
    odd = F.col("patient") % 2 == 1
    folder = F.when(odd, F.concat(
        F.lit(f"{ROOT}/ds004100/sc_fc/"), F.when(F.col("patient") % 4 == 1, "good outcome").otherwise("bad outcome"), F.lit("/"), phase,
    )).otherwise(F.concat(F.lit(f"{ROOT}/CHUM/sc_fc/"), phase))
    tail = F.when(F.col("epoch") == 30, "avg_over_epochs_znorm.csv").otherwise(F.concat(F.lit("epoch_"), F.col("epoch").cast("string"), F.lit("_znorm.csv")))
    run = F.when(F.col("electrode") % 3 == 0, F.concat(F.lit("_task_seizure-"), F.col("electrode").cast("string"), F.lit("_x_NODEfeatures_"))).when(
        F.col("electrode") % 3 == 1, F.concat(F.lit("_task_run-"), F.col("electrode").cast("string"), F.lit("_x_NODE_features_"))).otherwise(
        F.concat(F.lit("_"), F.col("electrode").cast("string"), F.lit("_NODE-features_")))
    return p.withColumn("file_path", F.concat(folder, F.lit("/NODE_features_SOZ/"), pat, F.lit("/"), pat, F.lit("_"), phase, run, tail))


@query("S1_S3_S4_node_paths", f"""WITH {PANEL}, {NODE_PATH} SELECT ds AS dataset, CASE WHEN patient % 2 = 1 THEN oc END AS outcome, phase, 'P' || patient AS patient,
 CAST(electrode AS INTEGER) AS seizure, CASE WHEN epoch = 30 THEN -1 ELSE epoch END AS epoch, epoch = 30 AS is_avg, {r('f_sum')} FROM np""")
def s1(spark, d):
    paths = _node_paths(spark, d).select("file_path", "f_sum")
    return S.tag_node_files(paths, ROOT).drop("file_path").select(
        "dataset", "outcome", "phase", "patient", "seizure", "epoch", "is_avg", "f_sum")


@query("S2_S4_edge_names", f"""WITH {PANEL} SELECT 'P' || patient AS patient, phase, CAST(electrode AS INTEGER) AS seizure, CASE WHEN electrode % 2 = 0 THEN 'corr' ELSE 'psi1245' END AS feature,
 CASE WHEN epoch % 5 = 0 THEN -1 ELSE epoch END AS epoch, epoch % 5 = 0 AS is_avg FROM panel WHERE epoch % 7 <> 3""")
def s2(spark, d):
    p = panel(spark, d)
    name = F.concat(
        F.lit("P"), F.col("patient").cast("string"), F.lit("_"), F.col("phase"), F.lit("_"), F.col("electrode").cast("string"),
        F.when(F.col("epoch") % 7 == 3, "_EDGE_corr_matrix_").when(F.col("electrode") % 2 == 0, "_EDGE_corr_").otherwise("_EDGE_psi1245_"),
        F.when(F.col("epoch") % 5 == 0, "avg_over_epochs").otherwise(F.concat(F.lit("epoch_"), F.col("epoch").cast("string"))), F.lit(".csv"))
    named = p.select(name.alias("name")).where(~X.ignored_edge_file(F.col("name")))
    m = X.file_metadata(F.col("_parts"), edge=True)
    return named.withColumn("_parts", X.edge_name_parts(F.col("name"))).select(*[c.alias(n) for n, c in m.items()])


TREE = "tr AS (SELECT *, epoch % 2 AS rec, epoch % 3 AS ep, patient % 2 = 0 AS even FROM panel)"


def _tree(spark, d):
    """The panel with the columns of a tree, made once for all its tables, and its number of rows."""
    p = stored(panel(spark, d).withColumns({"rec": F.col("epoch") % 2, "ep": F.col("epoch") % 3, "even": F.col("patient") % 2 == 0}))
    return p, p.count()


def _folders(p, kind, name, dataset, outcome=None):
    """Folder columns of the layout: dataset / sc_fc / (outcome) / phase / features folder / patient / table."""
    folders = {"l0": F.lit(dataset), "l1": F.lit("sc_fc")} | ({"l2": outcome} if outcome is not None else {}) | {
        "l3": F.col("phase"), "l4": F.lit(f"{kind}_features_SOZ"), "l5": F.concat(F.lit("P"), F.col("patient").cast("string")), "l6": name}
    return p.withColumns(folders), list(folders)


def _name(middle, epoch):
    return F.concat(F.lit("P"), F.col("patient").cast("string"), F.lit("_"), F.col("phase"), F.lit("_"), F.col("rec").cast("string"), middle, epoch)


@query("S1_node_tree", f"""WITH {PANEL}, {TREE} SELECT CASE WHEN even THEN 'CHUM' ELSE 'ds004100' END AS dataset, CASE WHEN NOT even THEN CASE WHEN patient % 4 = 1 THEN 'good outcome' ELSE 'bad outcome' END END AS outcome,
 phase, 'P' || patient AS patient, CAST(rec AS INTEGER) AS seizure, CAST(CASE WHEN ep = 2 THEN -1 ELSE ep END AS INTEGER) AS epoch, ep = 2 AS is_avg,
 concat_ws('-', seizure, electrode, epoch) AS electrode, {r('f_sum')}, {r('f_avg')}, {r('CASE WHEN even THEN f_max END', 'f_max')}, {r('CASE WHEN NOT even THEN f_cnt END', 'f_cnt')}, 0 AS rejected FROM tr
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'P' || patient, NULL, NULL, NULL, NULL, 1 FROM (SELECT DISTINCT patient FROM tr WHERE NOT even)""")
def s1_tree(spark, d):
    """The whole panel as a tree of CSV tables, headers and separators differing by dataset; misnamed tables come back as rejects."""
    root, (p, n) = work_dir(spark), _tree(spark, d)
    p = p.withColumn("_c0", F.concat_ws("-", "seizure", "electrode", "epoch"))
    epoch = F.when(F.col("ep") == 2, "avg_over_epochs_znorm.csv").otherwise(F.concat(F.lit("epoch_"), F.col("ep").cast("string"), F.lit("_znorm.csv")))
    one, folders = _folders(p.where("even"), "NODE", _name(F.lit("_NODEfeatures_"), epoch), "CHUM")
    sinks.write_tree(one.select(*folders, "_c0", "f_sum", "f_avg", "f_max"), root, folders, rows=n)
    outcome = F.when(F.col("patient") % 4 == 1, "good outcome").otherwise("bad outcome")
    two, folders = _folders(p.where("not even"), "NODE", _name(F.lit("_NODE_features_"), epoch), "ds004100", outcome)
    sinks.write_tree(two.select(*folders, "_c0", "f_cnt", "f_avg", "f_sum"), root, folders, ";", rows=n)
    odd, folders = _folders(p.where("not even"), "NODE", F.lit("notes_znorm.csv"), "ds004100", outcome)
    sinks.write_tree(odd.select(*folders, "f_cnt"), root, folders, rows=n)
    nodes, rejects = S.collect_node_features(spark, root)
    got = nodes.select("dataset", "outcome", "phase", "patient", "seizure", "epoch", "is_avg", "electrode", *FEATS, F.lit(0).alias("rejected"))
    bad = rejects.select(F.regexp_extract("file_path", "/l5=([^/]+)/", 1).alias("electrode"), F.lit(1).alias("rejected")).distinct()
    return got.unionByName(bad, allowMissingColumns=True)


@query("S2_S5_edge_tree", f"""WITH {PANEL}, {TREE}, k AS (SELECT *, CASE WHEN even THEN 'corr' WHEN rec = 0 THEN 'coh1245' ELSE 'psi1245' END AS m FROM tr)
SELECT phase, 'P' || patient AS patient, CAST(rec AS INTEGER) AS seizure, CAST(ep AS INTEGER) AS epoch, seizure || '-' || electrode AS source, 'E' || epoch AS target,
 CASE m WHEN 'corr' THEN 'pearson_r' WHEN 'coh1245' THEN 'coh_12_45' ELSE 'psi_12_45' END AS feature, {r('f_avg', 'value')}, 0 AS rejected FROM k WHERE patient <> 9
UNION ALL SELECT NULL, 'P9', NULL, NULL, NULL, NULL, NULL, NULL, 1 FROM (SELECT 1 FROM tr WHERE patient = 9 LIMIT 1)""")
def s2_tree(spark, d):
    """The whole panel as edge tables; the value column goes by another name in each dataset, or is only known by its numbers."""
    root = work_dir(spark)
    p, n = _tree(spark, d)
    p = p.withColumns({
        "source": F.concat_ws("-", "seizure", "electrode"), "target": F.concat(F.lit("E"), F.col("epoch").cast("string")), "note": F.concat(F.lit("n"), F.col("epoch").cast("string"))})
    epoch = F.concat(F.lit("epoch_"), F.col("ep").cast("string"), F.lit(".csv"))
    one, folders = _folders(p.where("even"), "EDGE", _name(F.lit("_EDGE_corr_"), epoch), "CHUM")
    sinks.write_tree(one.select(*folders, F.col("f_sum").alias("p_value"), "target", F.col("f_avg").alias("r"), "source"), root, folders, ";", rows=n)
    metric = F.when(F.col("rec") == 0, "_EDGE_coh1245_").otherwise("_EDGE_psi1245_")
    two, folders = _folders(p.where("not even and patient <> 9"), "EDGE", _name(metric, epoch), "ds004100", F.lit("bad outcome"))
    sinks.write_tree(two.select(*folders, "source", "note", "target", F.col("f_avg").alias("score"), "f_sum"), root, folders, rows=n)
    bad, folders = _folders(p.where("patient = 9"), "EDGE", _name(metric, epoch), "ds004100", F.lit("bad outcome"))
    sinks.write_tree(bad.select(*folders, F.col("source").alias("from"), "target", "f_avg"), root, folders, rows=n)
    skip, folders = _folders(p.where("even"), "EDGE", _name(F.lit("_EDGE_corr_matrix_"), epoch), "CHUM")
    sinks.write_tree(skip.select(*folders, "f_sum"), root, folders, rows=n)
    edges, rejects = S.collect_edge_features(spark, root)
    got = edges.select("phase", "patient", "seizure", "epoch", "source", "target", "feature", "value", F.lit(0).alias("rejected"))
    lost = rejects.select(F.regexp_extract("file_path", "/l5=([^/]+)/", 1).alias("patient"), F.lit(1).alias("rejected")).distinct()
    return got.unionByName(lost, allowMissingColumns=True)


@query("S5_value_column", f"WITH {PANEL} SELECT patient, seizure, electrode, epoch, {r('f_avg', 'value')} FROM panel")
def s5(spark, d):
    p = panel(spark, d).select(*KEYS, F.col("f_avg").alias("coh"), F.col("f_sum").alias("other"))
    return p.select(*KEYS, F.col(S.value_column(p, S.EDGE_VALUES["coh1245"][0])).alias("value"))


KINDS = "kd AS (SELECT DISTINCT 'sub-U' || user_id AS subject, lpad(CAST(extract(day FROM ts) AS VARCHAR), 2, '0') AS run, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 3 END AS kind FROM events)"


def _paths(spark, d):
    ev = table(spark, d, "events")
    sub = F.concat(F.lit("sub-U"), F.col("user_id").cast("string"))
    end = F.when(F.col("event_type") == "click", "ieeg.edf").when(F.col("event_type") == "view", "events.tsv").otherwise("channels.tsv")
    return ev.select(F.concat(
        F.lit("/bids/"), sub, F.lit("/ieeg/"), sub, F.lit("_task-x_run-"), F.lpad(F.dayofmonth("ts").cast("string"), 2, "0"), F.lit("_"), end).alias("path")).distinct()


@query("S6_recording_triplets", f"""WITH {KINDS}, g AS (SELECT subject, run, count(DISTINCT kind) AS c FROM kd GROUP BY ALL) SELECT subject, run, c = 3 AS complete FROM g""")
def s6(spark, d):
    whole, rest = S.recording_triplets(_paths(spark, d))
    return whole.select("subject", "run", F.lit(True).alias("complete")).unionByName(rest.select("subject", "run", F.lit(False).alias("complete")))


@query("S7_participants", """SELECT CAST(s_suppkey AS VARCHAR) AS participant_id, CASE WHEN s_nationkey % 3 = 0 THEN 'good outcome' WHEN s_nationkey % 3 = 1 THEN 'bad outcome' END AS outcome FROM supplier WHERE s_suppkey NOT IN (3, 5)""")
def s7(spark, d):
    raw = table(spark, d, "supplier").select(
        F.concat(F.lit(" "), F.col("s_suppkey").cast("string"), F.lit(" ")).alias("participant_id"),
        F.when(F.col("s_nationkey") % 3 == 0, "S").when(F.col("s_nationkey") % 3 == 1, " f").otherwise("n/a").alias("outcome"))
    return S.participants(raw, exclude=["3", "5"])


@query("S8_recording_bounds", f"""WITH b AS (SELECT user_id AS recording, min_by(value, event_id) FILTER (event_type = 'click') AS a, min_by(value, event_id) FILTER (event_type = 'view') AS z FROM events GROUP BY ALL)
SELECT recording, {r('CASE WHEN z > a THEN a END', 'onset')}, {r('CASE WHEN z > a THEN z END', '"offset"')} FROM b""")
def s8(spark, d):
    ev = table(spark, d, "events").select(
        F.col("user_id").alias("recording"), F.col("value").alias("onset"), "event_id",
        F.when(F.col("event_type") == "click", "SZ onset ").when(F.col("event_type") == "view", "sz OFFSET").otherwise("other").alias("trial_type"))
    return S.recording_bounds(ev, order="event_id")


@query("S9_good_channels", """SELECT DISTINCT user_id % 10 AS recording, user_id AS name FROM events WHERE user_id % 4 <> 1 AND user_id % 6 <> 0""")
def s9(spark, d):
    rec = table(spark, d, "events").select((F.col("user_id") % 10).alias("recording"), F.col("user_id").alias("name")).distinct()
    status = rec.withColumn("status", F.when(F.col("name") % 4 == 1, "bad").otherwise(" Good"))
    keep = S.good_channels(status, rec, ["recording", "name"])
    return S.without_bad_channels(keep, rec.where("name % 6 = 0"), ["recording", "name"])


@query("S10_recordings_of_phase", f"WITH {PANEL} SELECT DISTINCT CAST(electrode AS INTEGER) AS seizure FROM panel WHERE phase = 'ictal'")
def s10(spark, d):
    p = panel(spark, d).select(F.concat(F.lit("/x/P1_"), F.col("phase"), F.lit("_"), F.col("electrode").cast("string"), F.lit("_epo.fif")).alias("path"))
    return S.recordings_of_phase(p, "ictal")


@query("S11_S19_csv_round_trip", f"WITH {PANEL} SELECT patient, seizure, electrode, epoch, {', '.join(r(f) for f in FEATS)} FROM panel")
def s11(spark, d):
    path = sinks.write_table(panel(spark, d).select(*KEYS, *FEATS), work_dir(spark) + "/nodes.csv", "csv", "patient", ";")
    back = S.load_table(spark, path, sep=";")
    return back.select(F.col("patient").cast("bigint").alias("patient"), "seizure", F.col("electrode").cast("bigint").alias("electrode"), "epoch", *FEATS)


@query("S11_S19_parquet_round_trip", f"WITH {PRED} SELECT patient, seizure_id, seq_idx, node_index, row_id, {r('y_score')} FROM pred")
def s11p(spark, d):
    p = predictions(spark, d).select("patient", "seizure_id", "seq_idx", "node_index", "row_id", "y_score")
    path = sinks.write_table(p, work_dir(spark) + "/pred.parquet", "parquet")
    return S.load_table(spark, path)


@query("S19_json_metrics", f"WITH {PRED} SELECT run, experiment, count(*) AS n, {r('avg(y_score)', 'mean_score')} FROM pred GROUP BY ALL")
def s19(spark, d):
    m = predictions(spark, d).groupBy("run", "experiment").agg(F.count(F.lit(1)).alias("n"), F.avg("y_score").alias("mean_score"))
    back = S.load_table(spark, sinks.write_table(m, work_dir(spark) + "/metrics.json", "json"))
    return back.select("run", F.col("experiment").cast("int").alias("experiment"), "n", "mean_score")


@query("S12_clean_keys", "SELECT s_suppkey, s_name AS name FROM supplier")
def s12(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("  "), F.col("s_name"), F.lit(" ")).alias("name"))
    return S.clean_keys(s, ["name", "s_suppkey"])


@query("S13_series_files", f"""WITH {PANEL} SELECT '/s/' || electrode AS folder, seizure AS seizure_id, epoch AS seq_idx, epoch % 2 = 0 AS has_map FROM panel""")
def s13(spark, d):
    p = panel(spark, d)
    stem = F.concat(F.lit("/s/"), F.col("electrode").cast("string"), F.lit("/seiz_"), F.col("seizure"), F.lit("_seq_"), F.lpad(F.col("epoch").cast("string"), 3, "0"))
    files = p.select(F.concat(stem, F.lit(".csv")).alias("path")).unionByName(p.where("epoch % 2 = 0").select(F.concat(stem, F.lit("_nodes.csv")).alias("path")))
    return S.series_files(files).select("folder", "seizure_id", "seq_idx", F.col("nodes_path").isNotNull().alias("has_map"))


@query("S13_series_tree", f"""WITH {TRACE}, q AS (SELECT *, 'P' || patient AS p FROM trace)
SELECT p AS patient, seizure_id, CAST(node_index % 4 AS INTEGER) AS seq_idx, t, CAST(i AS INTEGER) AS node_index, 'N' || i AS electrode_name, {r('CASE i WHEN 0 THEN value WHEN 1 THEN node_index * 1.0 WHEN 2 THEN CASE WHEN t % 2 = 0 THEN t * 1.0 END END', 'value')}
FROM q, (SELECT unnest(range(3)) AS i) WHERE i < 2 OR patient % 2 = 0""")
def s13_tree(spark, d):
    """All traces as series files, wide, with two or three node columns; text that is no number reads as null."""
    root, tr = work_dir(spark), traces(spark, d)
    tr = tr.withColumns({
        "l0": F.concat(F.lit("P"), F.col("patient").cast("string")), "l1": F.lit("series"),
        "l2": F.concat(F.lit("seiz_"), F.col("seizure_id"), F.lit("_seq_00"), (F.col("node_index") % 4).cast("string"), F.lit(".csv"))})
    folders, two = ["l0", "l1", "l2"], [F.col("node_index").cast("double").alias("node_001:N1"), F.col("value").alias("node_000:N0")]
    third = F.when(F.col("t") % 2 == 0, F.col("t").cast("string")).otherwise("n/a").alias("node_002:N2")
    sinks.write_tree(tr.where("patient % 2 = 1").select(*folders, "t", *two), root, folders)
    sinks.write_tree(tr.where("patient % 2 = 0").select(*folders, third, "t", *two), root, folders, ";")
    out = S.read_series(spark, root)
    return out.select(F.regexp_extract("file_path", "/l0=([^/]+)/", 1).alias("patient"), "seizure_id", "seq_idx", "t", "node_index", "electrode_name", "value")


def _wide(spark, d):
    """Value columns named like series columns; the third one is text and partly not a number."""
    return panel(spark, d).select(
        *KEYS, F.col("f_sum").alias("node_000:A1"), F.col("f_avg").alias("node_001:A2"),
        F.when(F.col("epoch") % 2 == 0, F.col("f_cnt").cast("string")).otherwise("n/a").alias("node_002:B'1"))


@query("S14_X6_wide_to_long", f"""WITH {PANEL}, w AS (SELECT patient, seizure, electrode, epoch, u.node_index, u.electrode_name, u.value FROM panel,
 LATERAL (VALUES (0, 'A1', f_sum), (1, 'A2x', f_avg), (2, 'B''1', CASE WHEN epoch % 2 = 0 THEN f_cnt END)) u(node_index, electrode_name, value))
SELECT patient, seizure, electrode, epoch, node_index, electrode_name, {r('value')}, CASE WHEN node_index = 1 THEN electrode % 2 END AS is_soz FROM w""")
def s14(spark, d):
    raw = panel(spark, d).select("electrode").distinct().select(
        "electrode", F.lit("1").alias("electrode_id"), F.lit("A2x").alias("name"), (F.col("electrode") % 2).cast("string").alias("soz"))
    m = S.node_map(raw, ["electrode"])
    return S.wide_to_long(_wide(spark, d), KEYS, m, ["electrode"])


@query("S15_node_map", "SELECT CAST(p_partkey AS INTEGER) AS node_index, p_name AS electrode_name, CASE WHEN p_size % 3 <> 0 THEN CAST(p_size % 2 AS INTEGER) END AS is_soz FROM part WHERE p_partkey % 10 <> 0")
def s15(spark, d):
    raw = table(spark, d, "part").select(
        F.when(F.col("p_partkey") % 10 == 0, "x").otherwise(F.col("p_partkey").cast("string")).alias("electrode_id"), F.col("p_name").alias("electrode_name"),
        F.when(F.col("p_size") % 3 == 0, "").otherwise((F.col("p_size") % 2).cast("string")).alias("is_SOZ"))
    return S.node_map(raw)


@query("S16_header_metadata", "SELECT s_suppkey AS file, s_name AS patient, CAST(s_nationkey AS VARCHAR) AS seizure FROM supplier")
def s16(spark, d):
    lines = table(spark, d, "supplier").select(F.col("s_suppkey").alias("file"), F.explode(F.array(
        F.concat(F.lit("#patient,"), F.col("s_name")), F.concat(F.lit("# seizure, "), F.col("s_nationkey").cast("string")), F.lit("t,p_graph"), F.lit("0,0.5"))).alias("value"))
    return S.header_metadata(lines, ["file"], ["patient", "seizure"])


@query("S17_outcome_conflict", """WITH k AS (SELECT user_id AS patient_key, count(*) AS n FROM events GROUP BY ALL)
SELECT patient_key, n, CASE WHEN patient_key % 15 = 0 THEN 'unknown' WHEN patient_key % 3 = 0 THEN 'good' ELSE 'bad' END AS outcome FROM k WHERE patient_key % 3 = 0 OR patient_key % 5 = 0
UNION ALL SELECT patient_key, n, 'unknown' FROM k WHERE patient_key % 15 = 0""")
def s17(spark, d):
    k = table(spark, d, "events").groupBy(F.col("user_id").alias("patient_key")).agg(F.count(F.lit(1)).alias("n"))
    return S.with_outcomes({"good": k.where("patient_key % 3 = 0"), "bad": k.where("patient_key % 5 = 0")}, "patient_key").select("patient_key", "n", "outcome")


@query("S18_experiment_paths", f"WITH {PRED} SELECT 'results_' || run AS run, 'exp' || experiment AS experiment, count(*) AS n FROM pred GROUP BY ALL")
def s18(spark, d):
    path = F.concat(F.lit("/r/results_"), F.col("run"), F.lit("/big/exp"), F.col("experiment").cast("string"), F.lit("/cv_val_predictions_ranked.csv"))
    run, exp = X.experiment_path(F.col("file_path"))
    return predictions(spark, d).withColumn("file_path", path).groupBy(run.alias("run"), exp.alias("experiment")).agg(F.count(F.lit(1)).alias("n"))


@query("S18_prediction_tree", f"""WITH {PRED} SELECT 'results_' || run AS run, 'exp' || experiment AS experiment, CAST(patient AS VARCHAR) AS patient, seizure_id, CAST(seq_idx AS INTEGER) AS seq_idx, CAST(node_index AS INTEGER) AS node_index,
 {r('y_score')}, CASE WHEN experiment = 1 THEN CAST(row_id % 7 AS INTEGER) END AS fold FROM pred""")
def s18_tree(spark, d):
    """All predictions as the result files of their run and experiment; the experiments' headers differ."""
    root, p = work_dir(spark), predictions(spark, d)
    p = p.withColumns({
        "l0": F.concat(F.lit("results_"), F.col("run")), "l1": F.concat(F.lit("exp"), F.col("experiment").cast("string")), "l2": F.lit("cv_val_predictions_ranked.csv")})
    folders, n = ["l0", "l1", "l2"], p.count()
    keys = ["patient", "seizure_id", "seq_idx", "node_index"]
    sinks.write_tree(p.where("experiment = 0").select(*folders, *keys, "y_score"), root, folders, rows=n)
    sinks.write_tree(p.where("experiment = 1").select(*folders, (F.col("row_id") % 7).alias("fold"), "y_score", *keys[::-1]), root, folders, rows=n)
    return S.read_predictions(spark, root).select("run", "experiment", *keys, "y_score", "fold")


@query("S20_X10_selected_epochs", f"""WITH {PANEL}, m AS (SELECT electrode, min(epoch) AS a, max(epoch) AS b FROM panel GROUP BY ALL)
SELECT patient, seizure, electrode, epoch, {r('f_sum')} FROM panel JOIN m USING (electrode) WHERE electrode % 3 = 0 OR epoch IN (a, b)""")
def s20(spark, d):
    p = panel(spark, d)
    man = p.groupBy("electrode").agg(SC.write_ids(F.array(F.min("epoch"), F.max("epoch"))).alias("selected_epoch_ids")).withColumn(
        "status", F.when(F.col("electrode") % 3 == 0, "failed").otherwise("ok"))
    return S.selected_epochs(man, p.select(*KEYS, "f_sum"), ["electrode"]).select(*KEYS, "f_sum")


@query("S21_selected_features", "SELECT p_partkey % 20 AS patient, p_name AS feature FROM part WHERE p_partkey % 6 <> 0")
def s21(spark, d):
    lines = table(spark, d, "part").select((F.col("p_partkey") % 20).alias("patient"), F.when(F.col("p_partkey") % 6 == 0, "   ").otherwise(F.concat(F.lit(" "), F.col("p_name"), F.lit("  "))).alias("value"))
    return S.selected_feature_lines(lines, ["patient"])


# ---------------------------------------------------------------------- names
RAW = "nm AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'SEEG  ' || p_name WHEN 1 THEN p_name || ' ECoG' WHEN 2 THEN '(' || p_name || ')_1' ELSE ' eeg ' || p_name || chr(9) || '2' END AS raw FROM part)"


@query("X1_channel_names", f"""WITH {RAW}, t AS (SELECT *, trim(regexp_replace(raw, '\\s+', ' ', 'g')) AS one,
 trim(regexp_replace(regexp_replace(upper(raw), '[()]+', '', 'g'), '\\s+', ' ', 'g')) AS up FROM nm)
SELECT p_partkey, upper(regexp_replace(raw, '\\s+', '', 'g')) AS basic,
 upper(regexp_replace(regexp_replace(one, '^(EEG|ECOG|SEEG|EKG|EMG|DBS|LFP)\\s+', '', 'i'), '\\s+', '', 'g')) AS without_prefix,
 regexp_replace(regexp_replace(regexp_replace(up, '\\s+(EEG|ECOG|SEEG|EKG|EMG|DBS|LFP)$', ''), '^(EEG|ECOG|SEEG|EKG|EMG|DBS|LFP)\\s+', ''), '[\\s_]+', '', 'g') AS bare,
 trim(regexp_replace(replace(raw, 'SEEG', ''), '\\s+', ' ', 'g')) AS display FROM t""")
def x1(spark, d):
    k = F.col("p_partkey") % 4
    raw = F.when(k == 0, F.concat(F.lit("SEEG  "), "p_name")).when(k == 1, F.concat("p_name", F.lit(" ECoG"))).when(
        k == 2, F.concat(F.lit("("), "p_name", F.lit(")_1"))).otherwise(F.concat(F.lit(" eeg "), "p_name", F.lit("\t2")))
    n = table(spark, d, "part").select("p_partkey", raw.alias("raw"))
    c = F.col("raw")
    return n.select("p_partkey", X.channel_basic(c).alias("basic"), X.channel_without_prefix(c).alias("without_prefix"),
                    X.channel_bare(c).alias("bare"), X.channel_display(c).alias("display"))


@query("X2_patient_ids", """SELECT s_suppkey, CAST(s_suppkey AS INTEGER) AS number, 'Patient_' || CASE WHEN s_suppkey < 10 THEN '0' ELSE '' END || s_suppkey AS padded FROM supplier""")
def x2(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("pat "), F.col("s_suppkey").cast("string"), F.lit("b3")).alias("raw"))
    return s.select("s_suppkey", X.patient_number(F.col("raw")).alias("number"), X.padded_patient(F.col("raw")).alias("padded"))


@query("X3_canonical_patient", """WITH w AS (SELECT s_suppkey, s_suppkey % 5 AS k, CAST(s_suppkey AS VARCHAR) AS v FROM supplier)
SELECT s_suppkey, CASE k WHEN 0 THEN 'CHUM_Patient_' || v WHEN 1 THEN 'ds004100_sub-HUP' || v WHEN 2 THEN 'CHUM_Patient_' || v WHEN 3 THEN 'ds004100_CHUM_Patient_' || v ELSE 'sub-HUP' || v END AS canonical,
 CASE WHEN k IN (1, 4) THEN 'HUP' || v ELSE 'Patient_' || v END AS bare, CASE WHEN k IN (1, 4) THEN 'ds004100' ELSE 'CHUM' END AS dataset FROM w""")
def x3(spark, d):
    v, k = F.col("s_suppkey").cast("string"), F.col("s_suppkey") % 5
    raw = F.when(k == 0, F.concat(F.lit("CHUM::Patient_"), v)).when(k == 1, F.concat(F.lit("ds004100::sub-HUP"), v)).when(
        k == 2, F.concat(F.lit("CHUM__Patient_"), v)).when(k == 3, F.concat(F.lit("ds004100_CHUM_Patient_"), v)).otherwise(F.concat(F.lit("sub-HUP"), v))
    s = table(spark, d, "supplier").select("s_suppkey", raw.alias("raw"))
    c = F.col("raw")
    return s.select("s_suppkey", X.canonical_patient(c).alias("canonical"), X.bare_patient(c).alias("bare"), X.dataset_of(c).alias("dataset"))


@query("X4_X11_number_parsing", f"""SELECT event_id, TRY_CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) AS number, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS as_int,
 {r("TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)", 'as_float')} FROM events""")
def x4(spark, d):
    ev = table(spark, d, "events").select("event_id", "props", F.get_json_object("props", "$.k").alias("k"))
    return ev.select("event_id", X.recording_number(F.col("props")).alias("number"), SC.to_int(F.col("k")).alias("as_int"), SC.to_float(F.col("k")).alias("as_float"))


@query("X5_numeric_first_order", """WITH k AS (SELECT DISTINCT CASE WHEN user_id % 3 = 0 THEN event_type || user_id ELSE CAST(user_id AS VARCHAR) END AS id FROM events)
SELECT id, row_number() OVER (ORDER BY TRY_CAST(id AS DOUBLE) IS NULL, TRY_CAST(id AS DOUBLE), id) AS pos FROM k""")
def x5(spark, d):
    ids = table(spark, d, "events").select(
        F.when(F.col("user_id") % 3 == 0, F.concat("event_type", F.col("user_id").cast("string"))).otherwise(F.col("user_id").cast("string")).alias("id")).distinct()
    from onsetry.operators.grouped import numbered

    # numbers come first as a class of their own, so text and numbers are ordered apart
    return numbered(ids.withColumn("_k", F.lit(0)), ["_k"], X.numeric_first(F.col("id")), "pos").select("id", "pos")


@query("J2_three_valued_label", f"""WITH {PANEL} SELECT DISTINCT patient, 'E' || electrode AS name, CASE WHEN patient % 3 <> 2 THEN electrode % 4 = 0 END AS is_soz FROM panel""")
def j2(spark, d):
    n = panel(spark, d).select("patient", F.concat(F.lit("E"), F.col("electrode").cast("string")).alias("name"), "electrode").distinct()
    files = n.where("patient % 3 <> 2").select("patient")
    raw = n.where("electrode % 4 = 0 and patient % 3 <> 2").select("patient", F.concat(F.lit("SEEG e"), F.col("electrode").cast("string")).alias("raw"))
    pos = raw.select("patient", X.channel_without_prefix(F.col("raw")).alias("name"))
    return N.three_valued_label(n, files, pos, ["patient"]).select("patient", "name", "is_soz")
