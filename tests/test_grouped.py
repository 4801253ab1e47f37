"""The split layout gives exactly the plain window's result."""

import random

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from onsetry.operators import grouped as G
from onsetry.operators.normalize import decayed_sum


def rows(n, seed, ties=False):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        # group a holds most of the rows, group c one row, one key is null
        k = rnd.choice(["a", "a", "a", "a", "b", None])
        v = rnd.choice([0.0, 0.5, 1.0]) if ties else rnd.random()
        out.append((k, i, None if rnd.random() < 0.05 else v))
    return out + [("c", n, 1.0)]


@pytest.mark.parametrize("ties", [False, True])
def test_ordered_equals_plain_window(tiny_splits, ties):
    df = tiny_splits.createDataFrame(rows(120, 1, ties), "k string, i int, v double")
    got = G.ordered(
        df, ["k"], [G.down("v"), "i"], number="rn", running={"s": F.col("i")}, lag={"p": F.col("i")},
        lead={"q": F.col("i")}, totals={"n": F.count(F.lit(1)), "m": F.avg("v")},
    )
    part = Window.partitionBy("k")
    w = part.orderBy(F.col("v").isNull(), -F.col("v"), "i")
    want = df.withColumns({
        "rn": F.row_number().over(w), "s": F.sum("i").over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "p": F.lag("i").over(w), "q": F.lead("i").over(w), "n": F.count(F.lit(1)).over(part), "m": F.avg("v").over(part),
    })

    def canon(d):
        return sorted([tuple(None if x is None else round(x, 9) if isinstance(x, float) else x for x in r) for r in d.collect()], key=str)

    assert got.columns == want.columns
    assert canon(got) == canon(want)


@pytest.mark.parametrize("split", [False, True])
def test_rows_are_dealt_by_their_number(spark, split):
    """Groups spread over tasks by rows, not by compressed bytes, which AQE would merge into one."""
    spark.conf.set("onsetry.taskRows", "25")
    spark.conf.set("onsetry.splitRows", "300" if split else "1000000")
    try:
        df = spark.range(2000).select((F.col("id") % 200 * (F.col("id") % 4 > 0).cast("int")).alias("k"), (-F.col("id")).alias("i"))
        out = G.ordered(df, ["k"], ["i"], number="rn", totals={"n": F.count(F.lit(1))})
        largest = out.groupBy("k", F.spark_partition_id().alias("p")).count().groupBy("p").agg(F.sum("count").alias("n"), F.max("count").alias("m")).collect()
        assert len(largest) > 40
        w = Window.partitionBy("k")
        want = df.withColumns({"rn": F.row_number().over(w.orderBy("i")), "n": F.count(F.lit(1)).over(w)})
        assert sorted(out.collect()) == sorted(want.collect())
    finally:
        spark.conf.unset("onsetry.taskRows")
        spark.conf.unset("onsetry.splitRows")


def test_totals_without_order(tiny_splits):
    df = tiny_splits.createDataFrame(rows(60, 2), "k string, i int, v double")
    got = {(r.k, r.i): r.m for r in G.with_totals(df, ["k"], {"m": F.max("v")}).collect()}
    want = {(r.k, r.i): r.m for r in df.withColumn("m", F.max("v").over(Window.partitionBy("k"))).collect()}
    assert got == want


@pytest.mark.parametrize("keys", [["k"], []])
def test_quantiles_equal_percentile(tiny_splits, keys):
    df = tiny_splits.createDataFrame(rows(150, 3, True), "k string, i int, v double")
    got = G.quantiles(df, keys, {"q": ("v", 0.3), "m": ("v", 0.5)}, {"n": F.count("v")})
    want = df.groupBy(*keys).agg(F.percentile("v", 0.3).alias("q"), F.percentile("v", 0.5).alias("m"), F.count("v").alias("n"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_average_ranks(tiny_splits):
    df = tiny_splits.createDataFrame([("a", x) for x in (3.0, 1.0, 3.0, 2.0, None, 3.0)], "k string, v double")
    got = sorted((r.v, r.r) for r in G.average_ranks(df, ["k"], "v", "r").where("v is not null").collect())
    assert got == [(1.0, 1.0), (2.0, 2.0), (3.0, 4.0), (3.0, 4.0), (3.0, 4.0)]


@pytest.mark.parametrize("chunk", [1, 5, 7, 100])
@pytest.mark.parametrize(("before", "after"), [(2, 1), (11, 0), (0, 13)])
def test_framed_borders(tiny_splits, chunk, before, after):
    """Frames shorter and longer than a chunk, over positions with gaps."""
    df = tiny_splits.createDataFrame([("a", i * i % 101 + 200 * i, float(i * i % 7)) for i in range(40)], "k string, t int, v double")
    build = lambda w: {"s": F.sum("v").over(w.rowsBetween(-before, after)), "l": F.lag("v", before).over(w)}
    got = {r.t: (r.s, r.l) for r in G.framed(df, ["k"], "t", before, after, build, chunk).collect()}
    w = Window.partitionBy("k").orderBy("t")
    want = {r.t: (r.s, r.l) for r in df.withColumns(build(w)).collect()}
    assert got == want


@pytest.mark.parametrize("blocks", [1, 3])
def test_pairs_once_each(spark, blocks):
    df = spark.createDataFrame([("g", f"c{i}", i) for i in range(12)], "g string, c string, v int")
    got = [(r.c_a, r.c_b) for r in G.pair_blocks(df, ["g"], "c", ["v"], blocks).collect()]
    names = sorted(f"c{i}" for i in range(12))
    assert sorted(got) == [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]


@pytest.mark.parametrize("decay", [0.5, 0.9, 0.01, 1e-150])
def test_decayed_sum_is_the_recurrence(spark, decay):
    n = 5000 if decay == 0.9 else 900
    x = np.random.default_rng(0).random(n)
    want, acc = [], 0.0
    for v in x:
        acc = decay * acc + v
        want.append(acc)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "k string, p long, x double")
    got = [r.s for r in decayed_sum(df, ["k"], "p", "x", decay, "s").orderBy("p").collect()]
    assert np.allclose(got, want, rtol=1e-9)


def test_correlation_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, 4.0)], "a double, b double")
    assert df.agg(G.correlation("a", "b")).first()[0] is None
