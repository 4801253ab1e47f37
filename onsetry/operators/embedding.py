"""Planar embeddings of many columns, and how well labels part in them."""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from onsetry.operators.grouped import numbered, ordered
from onsetry.operators.lineage import durable

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CELL = 1024  # positions of a cell
BLOCK = 4096  # positions whose distance sums one task makes ...
BLOCKS_AGAINST = 64  # ... against this many blocks
VISITORS = 65_536  # positions that search one cell in one task
AT_ONCE = 4_000_000  # distances held at once
SLACK = 2e-9  # distances are compared to nine digits


# ----------------------------------------------------------------- components
def principal_components(df: DataFrame, vector: str, dims: int, keep: list[str], k: int = 2) -> DataFrame:
    """C20: the first ``k`` principal components ``pc1`` ... of an array column, centred.

    A component's sign is set so that its largest loading (the first of equal ones) is positive.  Rows whose array is
    null, has not ``dims`` elements, or holds a null or non-finite element are left out; no rows give none.
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    usable = (F.size(vector) == dims) & F.forall(vector, lambda e: F.coalesce(F.abs(e) < float("inf"), F.lit(False)))
    kept = [F.col(f"`{c}`") for c in keep]
    vec = df.where(usable).select(
        F.struct(*kept).alias("_keep"), array_to_vector(F.col(vector).cast("array<double>")).alias("_v"))
    if vec.isEmpty():
        none = [F.lit(None).cast("double").alias(f"pc{j + 1}") for j in range(k)]
        return df.where(F.lit(False)).select(*kept, *none)
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(vec)
    loads = model.pc.toArray()
    signs = [1.0 if loads[np.argmax(np.round(np.abs(loads[:, j]), 9)), j] >= 0 else -1.0 for j in range(k)]
    parts = model.transform(vec).select("_keep", vector_to_array("_p").alias("_p"))
    mean = parts.agg(*[F.avg(F.col("_p")[j]) for j in range(k)]).first()
    return parts.select(
        *[F.col("_keep").getField(c).alias(c) for c in keep],
        *[((F.col("_p")[j] - F.lit(mean[j])) * signs[j]).alias(f"pc{j + 1}") for j in range(k)])


# -------------------------------------------------------------------- labels
def labelled_points(points: DataFrame, ident: str, x: str, y: str, label: str, drop: str) -> DataFrame:
    """Points as (i, x, y, l); one row a point, finite coordinates, a label other than ``drop``."""
    text = F.col(label).cast("string")
    rows = points.where(
        (text != drop) & (F.abs(F.col(x)) < float("inf")) & (F.abs(F.col(y)) < float("inf")) & F.col(ident).isNotNull()
    ).select(F.col(ident).cast("long").alias("i"),
             F.struct((F.col(x).cast("double") + 0.0).alias("x"), (F.col(y).cast("double") + 0.0).alias("y"), text.alias("l")).alias("_p"))
    return rows.groupBy("i").agg(F.min("_p").alias("_p")).select("i", "_p.*")


def in_cells(pos: DataFrame, n: int, cell: int) -> DataFrame:
    """Cut positions into strips along x and strips into cells along y, by rank: about ``cell`` positions each."""
    strips = max(1, math.ceil(math.sqrt(n / cell)))
    rows = ordered(pos.withColumn("_f", F.lit(0)), ["_f"], ["x", "y"], number="_n")
    rows = rows.withColumn("s", F.floor((F.col("_n") - 1) * strips / F.lit(n)).cast("int")).drop("_f", "_n")
    rows = ordered(rows, ["s"], ["y", "x"], number="_n", totals={"_m": F.count(F.lit(1))})
    cells = F.ceil(F.col("_m") / F.lit(cell))
    return rows.withColumn("c", F.floor((F.col("_n") - 1) * cells / F.col("_m")).cast("int")).drop("_n", "_m")


def _distances(ax, ay, bx, by) -> np.ndarray:
    return np.sqrt((ax[:, None] - bx[None]) ** 2 + (ay[:, None] - by[None]) ** 2)


def _stretches(rows: int, width: int):
    step = max(1, AT_ONCE // max(1, width))
    return (slice(a, a + step) for a in range(0, rows, step))


def nearest(pts: DataFrame, k: int, cell: int = CELL) -> DataFrame:
    """The ``k`` points nearest to every distinct position, as (x, y, near): exact, without all distances.

    Points of one position are one row that keeps its ``k`` smallest ids, so copies cost nothing.  Within a position's
    own cell its k-th neighbour is at a distance r; only cells whose box comes within r of it are searched as well.
    A cell finds the strips it reaches from the strips' borders (about the root of the number of cells), then meets the
    cells of those strips in a join.  Equal distances (nine digits) rank by id.
    """
    first = numbered(pts, ["x", "y"], ["i"], "_n").where(F.col("_n") <= k)
    pos = durable(first.groupBy("x", "y").agg(F.sort_array(F.collect_list(F.struct("i", "l"))).alias("best")))
    placed = in_cells(pos, max(1, pos.count()), max(cell, 2 * k))

    def own(pdf: pd.DataFrame) -> pd.DataFrame:
        px, py = pdf["x"].to_numpy(), pdf["y"].to_numpy()
        count, r = pdf["best"].map(len).to_numpy(), np.full(len(pdf), np.inf)
        m = min(k, len(pdf))
        for part in _stretches(len(pdf), len(pdf)):
            d = _distances(px[part], py[part], px, py)
            at = np.argpartition(d, m - 1, axis=1)[:, :m]
            near = np.take_along_axis(d, at, axis=1)
            by = np.argsort(near, axis=1)
            full = np.cumsum(np.take_along_axis(count[at], by, axis=1), axis=1) >= k
            near = np.take_along_axis(near, by, axis=1)
            r[part] = np.where(full.any(axis=1), near[np.arange(len(near)), full.argmax(axis=1)], np.inf)
        return pdf.assign(r=r * (1 + 1e-9) + SLACK)

    placed = durable(placed.groupBy("s", "c").applyInPandas(
        own, "x double, y double, best array<struct<i:long,l:string>>, s int, c int, r double"))
    boxes = placed.groupBy("s", "c").agg(
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.max("r").alias("r"))
    borders = boxes.groupBy("s").agg(F.min("x0"), F.max("x1")).orderBy("s").collect()
    lows, highs = np.array([b[1] for b in borders]), np.array([b[2] for b in borders])

    def reached(batches):
        for pdf in batches:
            a = np.searchsorted(highs, pdf["x0"] - pdf["r"], side="left")
            b = np.searchsorted(lows, pdf["x1"] + pdf["r"], side="right")
            yield pdf.assign(to=[list(range(p, q)) for p, q in zip(a, b)])

    wide = boxes.mapInPandas(reached, "s int, c int, x0 double, x1 double, y0 double, y1 double, r double, to array<int>")
    wide = wide.select("s", "c", "x0", "x1", "y0", "y1", "r", F.explode("to").alias("s2"))
    other = boxes.select(F.col("s").alias("s2"), F.col("c").alias("c2"), *[F.col(b).alias(f"b{b}") for b in ("x0", "x1", "y0", "y1")])

    def gap(lo: Column, hi: Column, blo: str, bhi: str) -> Column:
        return F.greatest(F.lit(0.0), F.col(blo) - hi, lo - F.col(bhi))

    def within(dx: Column, dy: Column) -> Column:
        return F.hypot(dx, dy) <= F.col("r")

    opened = wide.join(other, "s2").where(within(
        gap(F.col("x0"), F.col("x1"), "bx0", "bx1"), gap(F.col("y0"), F.col("y1"), "by0", "by1")))
    visits = placed.select("s", "c", "x", "y", "r").join(
        opened.select("s", "c", "s2", "c2", "bx0", "bx1", "by0", "by1"), ["s", "c"]).where(within(
            gap(F.col("x"), F.col("x"), "bx0", "bx1"), gap(F.col("y"), F.col("y"), "by0", "by1")))
    visits = durable(visits.select("x", "y", F.col("s2").alias("s"), F.col("c2").alias("c")))
    parts = visits.groupBy("s", "c").agg(F.ceil(F.count(F.lit(1)) / F.lit(VISITORS)).cast("int").alias("parts"))
    left = visits.join(parts, ["s", "c"]).withColumn("part", F.pmod(F.xxhash64("x", "y"), F.col("parts")).cast("int")).drop("parts")
    right = placed.select(*[F.col(c).alias(c) for c in ("s", "c", "x", "y", "best")]).join(parts, ["s", "c"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def search(here: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        points = [(p["i"], p["l"], j) for j, best in enumerate(there["best"]) for p in best]
        points.sort()
        at = np.array([p[2] for p in points], dtype=int)
        bx, by = there["x"].to_numpy()[at], there["y"].to_numpy()[at]
        ax, ay, out = here["x"].to_numpy(), here["y"].to_numpy(), []
        for part in _stretches(len(here), len(points)):
            d = np.round(_distances(ax[part], ay[part], bx, by), 9)
            top = np.argsort(d, axis=1, kind="stable")[:, :k]  # points are in the order of their ids
            out += [[{"d": float(row[q]), "i": points[q][0], "l": points[q][1]} for q in t] for row, t in zip(d, top)]
        return pd.DataFrame({"x": ax, "y": ay, "near": pd.Series(out, dtype=object)})

    found = left.groupBy("s", "c", "part").cogroup(right.groupBy("s", "c", "part")).applyInPandas(
        search, "x double, y double, near array<struct<d:double,i:long,l:string>>")
    return found.groupBy("x", "y").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))


def purity(pts: DataFrame, k: int, cell: int = CELL) -> DataFrame:
    """Per point (i, l) the share ``pure`` of its ``k`` nearest other points that bear its label; null if it is alone."""
    near = nearest(pts, k + 1, cell)
    others = F.slice(F.filter("near", lambda q: q["i"] != F.col("i")), 1, k)
    hits = F.size(F.filter(others, lambda q: q["l"] == F.col("l")))
    return pts.join(near, ["x", "y"]).select("i", "l", (hits / F.nullif(F.size(others), F.lit(0))).alias("pure"))


def label_sums(pos: DataFrame, blocks: int, against: int = BLOCKS_AGAINST) -> DataFrame:
    """Sums ``total`` of the distances from every position to all points of each label ``l``.

    ``pos`` has (x, y, l, w) with ``w`` points a row.  An exact sum needs every distance: a task takes one block of
    positions against ``against`` blocks of points and adds up by label, so that neither distances nor blocks of them become rows.
    """
    at = F.pmod(F.xxhash64("x", "y"), F.lit(blocks)).cast("int")
    groups = math.ceil(blocks / against)
    own = pos.select(F.col("x").alias("x"), F.col("y").alias("y"))  # attributes of its own, as both sides meet again
    left = own.distinct().select("x", "y", at.alias("b")).withColumn(
        "g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = pos.withColumn("g", (at / F.lit(against)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def add(here: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        if here.empty or there.empty:
            return pd.DataFrame({"x": [], "y": [], "l": [], "total": []})
        there = there.sort_values("l", kind="stable")
        names, starts = np.unique(there["l"].to_numpy(dtype=str), return_index=True)
        bx, by, w = there["x"].to_numpy(), there["y"].to_numpy(), there["w"].to_numpy()
        ax, ay = here["x"].to_numpy(), here["y"].to_numpy()
        sums = np.concatenate([
            np.add.reduceat(_distances(ax[p], ay[p], bx, by) * w, starts, axis=1) for p in _stretches(len(here), len(there))])
        return pd.DataFrame({"x": np.repeat(ax, len(names)), "y": np.repeat(ay, len(names)),
                             "l": np.tile(names, len(ax)), "total": sums.ravel()})

    made = left.groupBy("b", "g").cogroup(right.groupBy("b", "g")).applyInPandas(add, "x double, y double, l string, total double")
    return made.groupBy("x", "y", "l").agg(F.sum("total").alias("total"))


def silhouettes(pts: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per (x, y, l) the silhouette ``s`` of its ``w`` points; 0 for a label of one point, as for equal means of 0."""
    pos = durable(pts.groupBy("x", "y", "l").agg(F.count(F.lit(1)).alias("w")))
    sizes = pos.groupBy("l").agg(F.sum("w").alias("m"))
    sums = label_sums(pos, max(1, math.ceil(pos.count() / block))).join(sizes, "l")
    rows = pos.withColumnRenamed("l", "own").join(sums, ["x", "y"])
    mine = F.col("l") == F.col("own")
    per = rows.groupBy("x", "y", "own", "w").agg(
        F.max(F.when(mine, F.col("m"))).alias("m"),
        F.max(F.when(mine, F.col("total") / F.nullif(F.col("m") - 1, F.lit(0)))).alias("a"),
        F.min(F.when(~mine, F.col("total") / F.col("m"))).alias("b"))
    s = (F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0))
    return per.select("x", "y", F.col("own").alias("l"), "w", F.when(F.col("b").isNotNull(), F.coalesce(s, F.lit(0.0))).alias("s"))


def separation(points, ident: str, x: str, y: str, label: str, k=5, block=BLOCK, cell=CELL, drop="unknown") -> DataFrame:
    """Number of points and labels, mean silhouette and mean purity of the ``k`` nearest neighbours, exact.

    Rows without an id, label or finite coordinates, and those labelled ``drop``, are left out; rows of one id are one
    point (the least of them).  With fewer than 3 points or 2 labels both measures are null.
    """
    pts = durable(labelled_points(points, ident, x, y, label, drop))
    size = pts.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l").alias("n_groups"))
    n, groups = size.first()
    if n < 3 or groups < 2:
        null = F.lit(None).cast("double")
        return size.withColumns({"silhouette": null, "knn_purity": null})
    sil = silhouettes(pts, block).agg((F.sum(F.col("s") * F.col("w")) / F.sum("w")).alias("silhouette"))
    pure = purity(pts, k, cell).agg(F.avg("pure").alias("knn_purity"))
    # three tables of one row
    one = F.lit(1).alias("_one")
    return size.select("*", one).join(sil.select("*", one), "_one").join(pure.select("*", one), "_one").drop("_one")
