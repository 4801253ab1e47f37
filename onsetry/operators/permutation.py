"""Permutation tests with many draws (C18): rows are never copied per draw."""

from __future__ import annotations

import sys
from math import ceil, log2

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

from onsetry.operators.grouped import numbered, quantiles

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK_ROWS = 4096  # rows of one packed chunk
BLOCK_DRAWS = 256  # draws of one item of work
TILE = 65536  # cells worked on at once
TASK_CELLS = 1 << 20  # rows times draws of one task
STEP, MIX1, MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB  # the SplitMix64 constants


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX2)
    return x ^ (x >> np.uint64(31))


def shuffled(places: np.ndarray, draws: np.ndarray, n: int, seed: int) -> np.ndarray:
    """(draw, place): where each draw's permutation of 0 .. n-1 sends the places; every draw is a bijection.

    A swap-or-not network: each round pairs a place with its mirror image about a keyed point, and one hashed bit
    of the pair decides for both whether they change places.  A place is sent on without knowledge of the others,
    so a permutation needs no sort and no shuffle.
    """
    rounds = 4 * ceil(log2(n + 1)) + 8
    out = np.empty((len(draws), len(places)), np.uint64)
    key = _mix(draws.astype(np.uint64) * np.uint64(STEP) + np.uint64(seed + 1))
    high = max(1, TILE // max(1, len(places)))
    for top in range(0, len(draws), high):
        _send(out[top : top + high], places.astype(np.uint64), key[top : top + high, None], rounds, np.uint64(n))
    return out.view(np.int64)


def _send(at: np.ndarray, places: np.ndarray, key: np.ndarray, rounds: int, n: np.uint64) -> None:
    """``shuffled`` for some draws, in place: all its arrays stay in the processor's cache."""
    at[:] = places
    mirror, x, y = np.empty_like(at), np.empty_like(at), np.empty_like(at)
    for _ in range(rounds):
        key = _mix(key + np.uint64(STEP))
        np.subtract(key % n, at, out=mirror)
        np.add(mirror, n, out=x)
        np.minimum(mirror, x, out=mirror)  # below 0 the first wraps to a huge number
        np.maximum(at, mirror, out=x)
        x *= np.uint64(STEP)
        x += key
        for shift, factor in ((30, MIX1), (27, MIX2)):
            np.right_shift(x, np.uint64(shift), out=y)
            x ^= y
            x *= np.uint64(factor)
        # the last step of the mix leaves the highest bit as it is; shifted with its sign it is a mask
        np.right_shift(x.view(np.int64), 63, out=x.view(np.int64))
        mirror ^= at
        mirror &= x
        at ^= mirror


def _packed(df: DataFrame, ident: str, value: str) -> DataFrame:
    """(chunk, first, values): rows in value order, so that a chunk holds one stretch of the values."""
    rows = df.select(F.lit(0).alias("_k"), F.col(value).cast("double").alias("v"), F.col(ident).alias("_i"))
    at = numbered(rows, ["_k"], ["v", "_i"], "_pos").withColumn("_pos", F.col("_pos") - 1)
    packed = at.groupBy(F.floor(F.col("_pos") / CHUNK_ROWS).cast("long").alias("chunk")).agg(F.sort_array(F.collect_list("v")).alias("values"))
    return packed.withColumn("first", F.col("chunk") * CHUNK_ROWS)


def _dealt(items: DataFrame, cells: int) -> DataFrame:
    """Tasks by the work, not by the bytes: packed values are few, and a number of its own keeps tasks from being joined."""
    return items.repartition(min(4096, ceil(cells / TASK_CELLS)), "chunk", "block")


def _by_draw(packed: DataFrame, sizes: list[int], n_perm: int, seed: int, weigh: bool) -> DataFrame:
    """(draw, chunk, g0, g1, ...): sum of values (or number of rows) that each group gets from the chunk."""
    n, ends, k = sum(sizes), np.cumsum(sizes), len(sizes)
    items = packed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit((n_perm - 1) // BLOCK_DRAWS))))

    def add(batches):
        for pdf in batches:
            for first, chunk, values, block in zip(pdf["first"], pdf["chunk"], pdf["values"], pdf["block"]):
                draws = np.arange(block * BLOCK_DRAWS, min(n_perm, (block + 1) * BLOCK_DRAWS))
                v = np.asarray(values, float)
                label = np.searchsorted(ends, shuffled(first + np.arange(len(v)), draws, n, seed), side="right")
                cell = (label + k * np.arange(len(draws))[:, None]).ravel()
                out = np.bincount(cell, np.tile(v, len(draws)) if weigh else None, minlength=k * len(draws)).reshape(-1, k)
                yield pd.DataFrame({"draw": draws + 1, "chunk": chunk, **{f"g{j}": out[:, j].astype(float) for j in range(k)}})

    groups = ", ".join(f"g{j} double" for j in range(k))
    return _dealt(items, n * n_perm).mapInPandas(add, f"draw long, chunk long, {groups}")


def _medians(packed: DataFrame, sizes: list[int], n_perm: int, seed: int) -> DataFrame:
    """(draw, g0, g1, ...): each group's median. Counts by chunk tell which chunk holds a middle row; only there,
    and only for the draws that ask, are rows dealt out again."""
    n, ends, k = sum(sizes), np.cumsum(sizes), len(sizes)
    counts = _by_draw(packed, sizes, n_perm, seed, weigh=False)
    upto = Window.partitionBy("draw").orderBy("chunk")  # one row a chunk
    run = counts.withColumns({f"u{j}": F.sum(f"g{j}").over(upto) for j in range(k)})
    # one pass over the counts for all groups and ranks: they are not made again for each
    ranks = [F.struct(F.lit(j).alias("g"), F.lit(rank).alias("rank"), F.col(f"u{j}").alias("upto"), (F.col(f"u{j}") - F.col(f"g{j}")).alias("before"))
             for j, size in enumerate(sizes) for rank in ((size - 1) // 2, size // 2)]
    asked = run.select("draw", "chunk", F.explode(F.array(*ranks)).alias("_a")).select("draw", "chunk", "_a.*").where(
        "before <= rank and upto > rank").withColumn("rank", (F.col("rank") - F.col("before")).cast("long"))
    asked = asked.groupBy("chunk", F.floor((F.col("draw") - 1) / BLOCK_DRAWS).alias("block")).agg(
        F.collect_list("draw").alias("draws"), F.collect_list("g").alias("gs"), F.collect_list("rank").alias("ranks"))

    def pick(batches):
        for pdf in batches:
            for first, values, draws, gs, ranks in zip(pdf["first"], pdf["values"], pdf["draws"], pdf["gs"], pdf["ranks"]):
                v, some, row = np.asarray(values, float), *np.unique(np.asarray(draws), return_inverse=True)
                label = np.searchsorted(ends, shuffled(first + np.arange(len(v)), some - 1, n, seed), side="right")
                got = [v[np.flatnonzero(label[r] == g)[q]] for r, g, q in zip(row, gs, ranks)]
                yield pd.DataFrame({"draw": draws, "g": gs, "v": got})

    # about two chunks a draw and group hold the middle rows
    found = _dealt(asked.join(packed, "chunk"), 2 * k * CHUNK_ROWS * n_perm).mapInPandas(pick, "draw long, g int, v double")
    return found.groupBy("draw").agg(*[F.avg(F.when(F.col("g") == j, F.col("v"))).alias(f"g{j}") for j in range(k)])


def permutation_test(df, ident: str, group: str, value: str, n_perm: int, seed: int, statistic="group_variance") -> DataFrame:
    """Share of seeded relabellings whose statistic reaches the observed one.

    A draw is a keyed permutation of the rows; the labels stand in runs, so group sizes are kept. Rows are numbered
    once and packed into chunks; a task takes a chunk and a block of draws and returns one sum a draw and group, so
    no row is copied per draw. The statistic is the weighted variance of group means, or the difference of the largest
    and smallest mean or median. Sizes by group reach the driver: one row a group. Rows without value or group are
    left out; no rows give no row.
    """
    rows = df.where(F.col(value).isNotNull() & F.col(group).isNotNull())
    medians = statistic == "median_difference"
    per = quantiles(rows, [group], {"_m": (value, 0.5)}, {"_n": F.count(F.lit(1))}) if medians else rows.groupBy(group).agg(
        F.avg(value).alias("_m"), F.count(F.lit(1)).alias("_n"))
    seen = sorted((r[group], r["_m"], r["_n"]) for r in per.collect())
    if not seen:
        return df.sparkSession.createDataFrame([], "observed double, n_perm long, p double")
    sizes, total = [n for _, _, n in seen], sum(n for _, _, n in seen)
    packed = _packed(rows, ident, value)
    if medians:
        means = [F.col(f"g{j}") for j in range(len(sizes))]
        draws = _medians(packed, sizes, n_perm, seed)
    else:
        sums = _by_draw(packed, sizes, n_perm, seed, weigh=True)
        draws = sums.groupBy("draw").agg(*[F.sum(f"g{j}").alias(f"g{j}") for j in range(len(sizes))])
        means = [F.col(f"g{j}") / n for j, n in enumerate(sizes)]
    if statistic == "group_variance":
        grand = sum(n * m for _, m, n in seen) / total
        observed = sum(n * (m - grand) ** 2 for _, m, n in seen) / total
        stat = sum(((m - F.lit(grand)) * (m - F.lit(grand)) * n for m, n in zip(means, sizes)), F.lit(0.0)) / total
    else:
        observed = max(m for _, m, _ in seen) - min(m for _, m, _ in seen)
        stat = F.greatest(*means) - F.least(*means) if len(means) > 1 else F.lit(0.0)
    # a relabelling equal to the data must count despite rounding
    reached = stat >= F.lit(float(observed) - 1e-9 * max(1.0, abs(observed)))
    return draws.agg(
        F.lit(float(observed)).alias("observed"), F.count(F.lit(1)).alias("n_perm"),
        ((F.count(F.when(reached, 1)) + 1) / (F.count(F.lit(1)) + 1)).alias("p"),
    )
