"""Readers over CSV trees in the expected layouts."""

import pytest
from pyspark.sql import functions as F

from onsetry.functions import scalars as SC
from onsetry.sources import readers as S
from onsetry.sources import sinks


def write(root, path, text):
    f = root / path
    f.parent.mkdir(parents=True, exist_ok=True)
    f.write_text(text)


def test_node_tree(spark, tmp_path):
    a = "CHUM/sc_fc/preictal/NODE_features_SOZ/Patient_01"
    write(tmp_path, f"{a}/Patient_01_preictal_0_NODEfeatures_epoch_3_znorm.csv", ",ll,rms\nSEEG A1,1.5,NaN\nA2,2,0.5\n")
    write(tmp_path, f"{a}/Patient_01_preictal_0_NODEfeatures_avg_over_epochs_znorm.csv", ",ll,rms\nA1,1,1\n")
    write(tmp_path, f"{a}/Patient_01_preictal_0_NODEfeatures_epoch_3_raw.csv", ",ll,rms\nA1,9,9\n")
    b = "ds004100/sc_fc/good outcome/ictal/NODE_features_SOZ/sub-HUP1"
    write(tmp_path, f"{b}/sub-HUP1_ictal_run-02_x_NODE_features_epoch_0_normpre.csv", ",ll,kurt\nB+1,3,4\n")
    write(tmp_path, f"{b}/other_znorm.csv", ",ll\nx,1\n")
    df, rejected = S.collect_node_features(spark, str(tmp_path))
    assert [r.file_path.rsplit("/", 1)[1] for r in rejected.collect()] == ["other_znorm.csv"]
    got = {(r.patient, r.electrode, r.epoch): r for r in df.collect()}
    assert set(got) == {("Patient_01", "SEEG A1", 3), ("Patient_01", "A2", 3), ("Patient_01", "A1", -1), ("sub-HUP1", "B+1", 0)}
    r = got["Patient_01", "SEEG A1", 3]
    assert (r.dataset, r.outcome, r.phase, r.seizure, r.is_avg, r.rms, r.kurt) == ("CHUM", None, "preictal", 0, False, None, None)
    r = got["sub-HUP1", "B+1", 0]
    assert (r.dataset, r.outcome, r.phase, r.seizure, r.kurt, r.rms) == ("ds004100", "good outcome", "ictal", 2, 4.0, None)
    assert got["Patient_01", "A1", -1].is_avg


def test_edge_tree(spark, tmp_path):
    a = "CHUM/sc_fc/ictal/EDGE_features_SOZ/Patient_02"
    write(tmp_path, f"{a}/Patient_02_ictal_5_EDGE_coh1245_epoch_1.csv", "source,target,coh\nA,B,0.5\nB,A,inf\n")
    write(tmp_path, f"{a}/Patient_02_ictal_5_EDGE_coh1245_matrix_epoch_1.csv", "x,A\nA,1\n")
    write(tmp_path, f"{a}/Patient_02_ictal_5_EDGE_psi1245_epoch_1.csv", "source,target,score\nA,B,-0.25\n")
    write(tmp_path, f"{a}/Patient_02_ictal_5_EDGE_corr_epoch_1.csv", "source,target,pearson_r\nA,B,0.9\n")
    write(tmp_path, f"{a}/Patient_02_ictal_6_EDGE_corr_epoch_1.csv", "target;p_value;r;source\nD;0.01;0.7;C\n")
    write(tmp_path, f"{a}/Patient_02_ictal_7_EDGE_corr_epoch_1.csv", "from,target,r\nD,C,0.7\n")
    edges, rejected = S.collect_edge_features(spark, str(tmp_path))
    assert [r.file_path.rsplit("_EDGE_", 1)[0][-1] for r in rejected.collect()] == ["7"]
    corr = {(r.source, r.target): (r.value, r.seizure) for r in edges.where("feature = 'pearson_r'").collect()}
    assert corr == {("A", "B"): (0.9, 5), ("C", "D"): (0.7, 6)}
    rows = edges.where("feature <> 'pearson_r'").collect()
    got = {(r.source, r.target, r.feature): r.value for r in rows}
    assert got == {("A", "B", "coh_12_45"): 0.5, ("B", "A", "coh_12_45"): None, ("A", "B", "psi_12_45"): -0.25}
    assert {(r.patient, r.seizure, r.epoch, r.phase) for r in rows} == {("Patient_02", 5, 1, "ictal")}


def test_triplets_and_listing(spark, tmp_path):
    for n in ("run-01_ieeg.edf", "run-01_events.tsv", "run-01_channels.tsv", "run-02_ieeg.edf"):
        write(tmp_path, f"sub-H1/ieeg/sub-H1_task_{n}", "x")
    whole, rest = S.recording_triplets(S.list_paths(spark, str(tmp_path)))
    assert [r.run for r in whole.collect()] == ["01"] and [r.run for r in rest.collect()] == ["02"]


def test_bounds_need_order_and_finite_values(spark):
    ev = spark.createDataFrame(
        [("a", " SZ onset", 5.0), ("a", "sz offset", 9.0), ("b", "sz onset", 5.0), ("b", "sz offset", 5.0), ("c", "sz onset", 1.0), ("d", "sz onset", float("nan")), ("d", "sz offset", 3.0)],
        "recording string, trial_type string, onset double")
    got = {r.recording: (r.onset, r.offset) for r in S.recording_bounds(ev).collect()}
    assert got == {"a": (5.0, 9.0), "b": (None, None), "c": (None, None), "d": (None, None)}


def test_series_with_header_lines(spark, tmp_path):
    write(tmp_path, "P1/series/seiz_0_seq_004.csv", "#patient,P1\n#thr,0.5\nt,p_graph,node_000:A1,node_001:B'2\n0,0.1,0.2,nan\n1,0.3,0.4,0.5\n")
    write(tmp_path, "P1/series/seiz_0_seq_004_nodes.csv", "node_index,electrode_name,is_SOZ\n0,A1,1\n")
    write(tmp_path, "P2/series/seiz_1_seq_000.csv", "#x\nt;node_000:B9;node_001:B8;node_002:B7\n0;1;2;3\n")
    rows = S.read_series(spark, str(tmp_path)).collect()
    assert {(r.electrode_name, r.value) for r in rows if r.seizure_id == "1"} == {("B9", 1.0), ("B8", 2.0), ("B7", 3.0)}
    rows = [r for r in rows if r.seizure_id == "0"]
    got = {(r.seizure_id, r.seq_idx, r.node_index, r.electrode_name, r.t): r.value for r in rows}
    assert got["0", 4, 0, "A1", 1] == 0.4 and got["0", 4, 1, "B'2", 0] is None and len(got) == 4
    lines = spark.read.text(str(tmp_path / "P1/series/seiz_0_seq_004.csv")).withColumn("f", F.lit(1))
    meta = S.header_metadata(lines, ["f"], ["patient", "thr"]).first()
    assert (meta.patient, meta.thr) == ("P1", "0.5")


def test_predictions_are_tagged(spark, tmp_path):
    for run, exp in (("results_1", "exp1"), ("results_2", "exp3")):
        head = "patient,y_score\np,0.5\n" if exp == "exp1" else "y_score,fold,patient\n0.25,3,p\n"
        write(tmp_path, f"{run}/big/{exp}/cv_val_predictions_ranked.csv", head)
    got = {(r.run, r.experiment, r.patient, r.y_score, r.fold) for r in S.read_predictions(spark, str(tmp_path)).collect()}
    assert got == {("results_1", "exp1", "p", 0.5, None), ("results_2", "exp3", "p", 0.25, 3)}


def test_node_map_names(spark):
    df = spark.createDataFrame([("3", "A1"), ("x", "A2")], "electrode_id string, name string")
    assert [tuple(r) for r in S.node_map(df).collect()] == [(3, "A1", None)]
    with pytest.raises(ValueError, match="electrode_name"):
        S.node_map(df.select("electrode_id"))


def test_manifest_falls_back_to_all_epochs(spark):
    man = spark.createDataFrame([("a", "ok", "[1,3]"), ("b", "failed", "[1]"), ("c", "ok", "[]")], "rec string, status string, selected_epoch_ids string")
    ep = spark.createDataFrame([(r, e) for r in "abc" for e in (1, 2, 3)], "rec string, epoch int")
    got = sorted((r.rec, r.epoch) for r in S.selected_epochs(man, ep, ["rec"]).collect())
    assert got == [("a", 1), ("a", 3)] + [(r, e) for r in "bc" for e in (1, 2, 3)]


def test_partitioned_output(spark, tmp_path):
    df = spark.createDataFrame([("p1", 1.5), ("p2", 2.5)], "patient string, v double")
    path = sinks.write_table(df, str(tmp_path / "out"), "csv", "patient", ";")
    assert sorted(p.name for p in (tmp_path / "out").glob("patient=*")) == ["patient=p1", "patient=p2"]
    assert sorted(r.v for r in S.load_table(spark, path, sep=";").collect()) == [1.5, 2.5]


def test_safe_parsing(spark):
    df = spark.createDataFrame([("7",), ("7.9",), ("x",), ("nan",), ("",)], "s string")
    rows = df.select(SC.to_int(F.col("s")).alias("i"), SC.to_float(F.col("s")).alias("f")).collect()
    assert [r.i for r in rows] == [7, 7, None, None, None] and [r.f for r in rows] == [7.0, 7.9, None, None, None]


def test_files_are_split_anywhere(spark, tmp_path):
    """Byte ranges smaller than a line: each row comes once, under its file's own header."""
    a = "CHUM/sc_fc/preictal/NODE_features_SOZ/P1"
    write(tmp_path, f"{a}/P1_preictal_0_NODEfeatures_epoch_3_znorm.csv", "\n,ll,rms\n" + "".join(f"A{i},{i},{i / 2}\n" for i in range(300)))
    write(tmp_path, f"{a}/P1_preictal_1_NODEfeatures_epoch_3_znorm.csv", ',rms;x,"ll"\r\n' + "".join(f'"B{i}, b",{i},{-i}\r\n' for i in range(300)) + ',rms;x,"ll"\r\n')
    write(tmp_path, f"{a}/P1_preictal_2_NODEfeatures_epoch_3_znorm.csv", "")
    sizes = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    for k in sizes:
        spark.conf.set(k, "48")
    try:
        df, rejected = S.collect_node_features(spark, str(tmp_path))
        lines, _ = S.csv_rows(spark, str(tmp_path), "*_znorm.csv")
        assert lines.rdd.getNumPartitions() > 20 and rejected.count() == 0
        rows = {(r.seizure, r.electrode): r for r in df.collect()}
    finally:
        for k in sizes:
            spark.conf.unset(k)
    assert len(rows) == 600
    assert all(rows[0, f"A{i}"].ll == i and rows[0, f"A{i}"].rms == i / 2 for i in range(300))
    assert all(rows[1, f"B{i}, b"].ll == -i and rows[1, f"B{i}, b"]["rms;x"] == i for i in range(300))


def test_value_column_is_the_first_with_numbers_only_in_every_row(spark, tmp_path):
    a = "CHUM/sc_fc/ictal/EDGE_features_SOZ/P2/P2_ictal_5_EDGE_psi1245_epoch_1.csv"
    write(tmp_path, a, "source,note,target,w\n" + "".join(f"A,{i},B{i},{i}.5\n" for i in range(50)) + "A,text,B,7\n")
    edges, rejected = S.collect_edge_features(spark, str(tmp_path))
    assert {r.value for r in edges.collect()} == {i + 0.5 for i in range(50)} | {7.0} and rejected.count() == 0


def test_glob_patterns():
    import re

    for glob, yes, no in (("*{znorm,normpre}.csv", "a_znorm.csv", "a_znorm.csv.gz"), ("seiz_*_seq_*[0-9].csv", "seiz_1_seq_004.csv", "seiz_1_seq_4_nodes.csv"), ("?.csv", "a.csv", "ab.csv")):
        assert re.match(S.name_pattern(glob), yes) and not re.match(S.name_pattern(glob), no)
