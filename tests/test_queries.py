"""Every registered query against its SQL statement, and again with all groups split."""

import pytest
from compare import diff
from conftest import SF

from onsetry.plans import catalog

SPLIT = [
    "R1_rank", "R3_topk_flags", "R4_prf_topk", "R5_auc_group", "R9_first_positive_rank", "R15_pointwise_gap",
    "B1_robust_baseline_z", "B5_persistent_burst", "B8_group_zscore", "B10_relative_features", "J4_first_ictal",
    "J11_channel_pairs", "E9_node_index", "E11_percentile", "Q1_relative_time", "Q2_sliding_sequences",
    "Q11_middle_sequences", "T4_sequence_quality", "T6_T7_trace_summary", "T8_rise_decay", "T9_trace_spectrum", "T11_pool_nodes", "C9_correlations", "C17_kruskal",
    "C12_constant_change", "X5_numeric_first_order",
]
ROWS_ONLY = sorted(set(catalog.QUERIES) - set(catalog.ORACLES))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, duck, name):
    assert diff(spark, SF, duck, catalog.QUERIES[name], catalog.ORACLES[name]) is None


@pytest.mark.parametrize("name", SPLIT)
def test_split_groups_give_the_same(tiny_splits, duck, name):
    assert diff(tiny_splits, SF, duck, catalog.QUERIES[name], catalog.ORACLES[name]) is None


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_rows_only(spark, name):
    rows = catalog.QUERIES[name](spark, SF)
    assert rows.columns and rows.count() > 0


def test_names_cover_the_inventory():
    ids = {p for n in catalog.QUERIES for p in n.split("_") if p[0].isalpha() and p[1:].isdigit()}
    wanted = {
        "S": 21, "F": 10, "J": 13, "G": 7, "N": 14, "B": 12, "E": 15, "Q": 16, "X": 11, "T": 13, "R": 20, "M": 13, "C": 22,
    }
    missing = [f"{k}{i}" for k, n in wanted.items() for i in range(1, n + 1) if f"{k}{i}" not in ids]
    assert missing == []
