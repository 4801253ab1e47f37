"""Operators on tables whose other columns bear any names, and on rows without usable ids."""

import time

import pytest

from onsetry.llm.contamination import decontaminate
from onsetry.llm.lines import drop_common_lines
from onsetry.llm.mixing import mix, n_words
from onsetry.llm.quality import resample
from onsetry.llm.sharding import assign
from onsetry.llm.substrings import drop_repeats
from pyspark.sql import functions as F

# names that the operators use inside, added columns, names with dots, quotes and other cases
NAMES = (
    "n to first arc cell _at _arc _cell _n _r _a _c _before slot0 whole threshold _s _p rest weight target size hash _hash copies "
    "mass upto prefix below _id _k k id h lo m r _spans _common _kept common left gone a b x y _good _label _words _hit _items "
    "n_words n_hit hit_items contaminated n_lines n_dropped kept log_ratio gumbel_key shard slot source_size n_removed u0 u1 u2 "
    "tie0 position bucket Kept dotted.name back`quote"
).split()
OTHERS = sorted({n.lower(): n for n in NAMES}.values())
SHARED = "menu line\n" + " ".join(f"w{i}" for i in range(40))


def table(spark, rows=12):
    docs = spark.createDataFrame([(i, f"s{i % 2}", f"{SHARED} own{i} text{i}") for i in range(rows)], "doc_id long, source string, text string")
    return docs.select("*", *[F.concat(F.lit(f"{i}:"), F.col("doc_id").cast("string")).alias(n) for i, n in enumerate(OTHERS)])


def labels(spark):
    return spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int")


def benchmark(spark):
    return spark.createDataFrame([("q", " ".join(f"w{i}" for i in range(20)))], "item_id string, text string")


OPERATORS = {
    "drop_repeats": (lambda s, d: drop_repeats(d), ["n_words", "n_removed", "kept"]),
    "mix": (lambda s, d: mix(d, n_words(F.col("text")), ["doc_id"]), ["size", "source_size", "target", "copies"]),
    "resample": (lambda s, d: resample(d, labels(s)), ["log_ratio", "gumbel_key", "kept"]),
    "drop_common_lines": (lambda s, d: drop_common_lines(d), ["n_lines", "n_dropped", "kept"]),
    "assign": (lambda s, d: assign(d, ["doc_id"], 3, ties=["doc_id", "dotted.name"]), ["shard", "slot"]),
    "decontaminate": (lambda s, d: decontaminate(d, benchmark(s)), ["n_words", "n_hit", "hit_items", "contaminated"]),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_other_columns_stay_and_change_nothing(spark, name):
    work, added = OPERATORS[name]
    docs = table(spark)
    out = work(spark, docs)
    stay = [c for c in docs.columns if c.lower() not in added]
    assert out.columns == [*stay, *added]
    got = {r["doc_id"]: r for r in out.collect()}
    assert len(got) == 12
    at = {n: i for i, n in enumerate(OTHERS)}
    for i, r in got.items():
        assert all(r[c] == f"{at[c]}:{i}" for c in stay if c in at)
    if name != "assign":  # its ties name one of the other columns
        plain = {r["doc_id"]: r for r in work(spark, docs.select("doc_id", "source", "text")).collect()}
        assert all(got[i][c] == plain[i][c] for i in got for c in added)
    assert work(spark, docs.limit(0)).count() == 0


def test_rows_without_integer_ids_keep_their_own_spans(spark):
    def rows(ids):
        texts = [SHARED, SHARED + " tail", *[" ".join(f"d{i}x{j}" for j in range(50)) for i in range(20)], None, ""]
        kind = "long" if ids is None or isinstance(ids(0), int) else "string"
        docs = spark.createDataFrame([(ids and ids(i), t) for i, t in enumerate(texts)], f"doc_id {kind}, text string")
        return sorted((r["text"] or "", r["n_words"], r["n_removed"]) for r in drop_repeats(docs).collect())

    want = rows(lambda i: i)
    assert sum(r[2] for r in want) == 84
    assert rows(None) == rows(lambda i: 7) == rows(lambda i: f"doc {i}") == want


def test_common_lines_without_ids_and_in_a_very_long_text(spark):
    long = "\n".join(f"line {i}" for i in range(200_000))
    texts = [long] * 10 + [f" LINE 7\t\nmine {i}\n\nline 7" for i in range(5)] + [None, ""]
    docs = spark.createDataFrame([(None, t) for t in texts], "doc_id string, text string")
    began = time.time()
    got = drop_common_lines(docs).select("n_lines", "n_dropped", F.length("kept").alias("k")).collect()
    assert time.time() - began < 60
    assert sorted(map(tuple, got)) == sorted([(200_000, 200_000, 0)] * 10 + [(4, 2, 7)] * 5 + [(1, 0, 0)] * 2)
