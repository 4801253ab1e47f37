"""Stages of the corpus pipeline on awkward tables: repeats, nulls, clashing columns, nothing at all."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from conftest import SF

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ["kept", "size", "n_words", "n_hit", "target", "copies", "log_ratio", "component_id", "_id", "_key", "a.b", "whole", "arc", "n", "to", "first"]


def words(seed, n=60):
    r = random.Random(seed)
    return [f"w{r.randrange(9999)}" for _ in range(n)]


def shingle_sets(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_groups(rows):
    """Indexes of the rows that stay: of every group tied by links the smallest (id, nulls last)."""
    sets = [shingle_sets(t) for _, t, *_ in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if o and 5 * o >= 4 * (len(sets[i]) + len(sets[j]) - o):
                group = [group[j] if g == group[i] else g for g in group]
    return sets, group


@pytest.fixture(scope="module")
def rows():
    base = [words(s) for s in range(12)]
    out = [(i, " ".join(base[i]), "en", "a", 1) for i in range(12)]
    out += [(100 + i, " ".join([*base[i][:-1], "changed"]), "en", "a", 1) for i in range(4)]  # near copies
    out += [(i, " ".join(base[i]), "en", "b", 2) for i in (0, 0, 5)]  # the same row again
    out += [(5, " ".join(words(77)), "en", None, 3), (None, " ".join(base[3]), None, None, None)]  # another text, no id
    out += [(None, " ".join(words(88)), "en", "a", 1)] * 2 + [(200, None, "en", "a", 1), (201, "", "en", "a", 1), (202, " ", None, "a", 1), (200, None, "en", "a", 1)]
    return out + [(300, "long " + " ".join(words(5, 30_000)), "en", "a", 1)]


def test_one_row_of_each_group_stays(spark, rows):
    docs = spark.createDataFrame([(*r, *[f"mine {n}" for n in EXTRA]) for r in rows], SCHEMA + "".join(f", `{c}` string" for c in EXTRA)).repartition(3)
    out = P.one_of_each_group(spark, docs, SF)
    assert out.columns == docs.columns
    got = [tuple(r) for r in out.collect()]
    assert all(r[5:] == tuple(f"mine {n}" for n in EXTRA) for r in got)
    sets, group = brute_groups(rows)
    want = Counter()
    for g in set(group):
        held = [rows[i] for i in range(len(rows)) if group[i] == g]
        if not sets[g]:
            want.update((r[0], r[1]) for r in held)  # without words: no group
        else:
            first = min(held, key=lambda r: (r[0] is None, r[0] or 0))
            want[first[:2]] += 1
    assert Counter(r[:2] for r in got) == want


def test_doubled_rows_are_halved(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(50)
    once = P.one_of_each_group(spark, docs, SF).count()
    assert P.one_of_each_group(spark, docs.union(docs), SF).count() == once <= 50


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES])
def test_stages_keep_the_users_columns(spark, rows, name):
    stage = dict(P.STAGES)[name]
    docs = spark.createDataFrame([(*r, *[f"mine {n}" for n in EXTRA]) for r in rows], SCHEMA + "".join(f", `{c}` string" for c in EXTRA))
    out = stage(spark, docs, SF)
    added = ["shard", "slot"] if name == "sharding" else []
    assert out.columns == [*docs.columns, *added]
    for r in out.collect():
        assert [r[c] for c in EXTRA] == [f"mine {n}" for n in EXTRA] and tuple(r[:2]) in {x[:2] for x in rows}
    assert stage(spark, docs.limit(0), SF).count() == 0


def test_mixing_and_shards_by_plain_counts(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    taken = Counter(r["doc_id"] for r in P.mixed(spark, docs.where("doc_id >= 100 and length(text) > 1"), SF).collect())
    assert max(taken.values()) <= 3
    out = P.sharded(spark, docs, SF).collect()
    assert len(out) == len(rows)
    sizes = Counter(r["shard"] for r in out)
    assert max(sizes.values()) - min(sizes[s] for s in range(8)) <= 1
    for s in sizes:
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sizes[s]))


def test_decontamination_stage_by_plain_windows(spark):
    """A document goes if 20 times its words in benchmark windows reach its words."""
    import re

    import pyarrow.parquet as pq

    items = [r["text"] for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    split = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = set()
    for t in items:
        w = split(t)
        windows |= {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12))} if w else set()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = set()
    for r in docs.collect():
        w, hit = split(r["text"]), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
        if not (hit and 20 * len(hit) >= len(w)):
            want.add(r["doc_id"])
    got = [r["doc_id"] for r in P.without_benchmark(spark, docs, SF).select("doc_id").collect()]
    assert set(got) == want and len(got) == len(want) < docs.count()
