"""Histogram gradient boosting on all labelled rows, one task per fold.

A fit works on quantile bins, one byte a value: the rows are put in order, cut into columns, and each column is binned for
every fold in a task of its own; a fold's task gets its columns of bytes, so it holds about a byte for each value and some
50 for each row. All folds are fitted side by side. Scoring needs the models only (bounded by rounds and leaves), so it
runs wherever the rows lie.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from onsetry.operators.lineage import durable

MAX_FIT_ROWS = 20_000  # default of ``bounded_rows``; fits take all rows
SLICE_ROWS = 50_000  # rows of a task that cuts rows into columns
LARGE_SUMS = 1 << 18  # values beyond which a node's sums are made column by column
BINS = 255  # codes of bins fit a byte
MIN_HESSIAN = 1e-3
EVAL_BUCKETS = 5  # of the groups one in so many is watched for early stopping


@dataclass(frozen=True)
class Growth:
    """How trees grow: leaves, shrinkage, rounds, shares of rows and columns, least rows of a leaf, L2 on leaf values."""

    leaves: int = 63
    learning_rate: float = 0.05
    rounds: int = 800
    row_share: float = 0.9
    column_share: float = 0.9
    min_leaf: int = 20
    l2: float = 0.0
    patience: int = 0  # rounds without progress on the watched rows after which growth stops; 0 never


@dataclass
class Ensemble:
    """Trees as flat arrays: node i splits ``feature[i]`` (negative: leaf) at ``cut[i]``; smaller or equal goes left."""

    start: float
    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for root in self.roots.tolist():
            at, live = np.full(len(x), root), rows
            while len(live):
                live = live[self.feature[at[live]] >= 0]
                node = at[live]
                at[live] = np.where(x[live, self.feature[node]] <= self.cut[node], self.left[node], self.right[node])
            out += self.value[at]
        return out


def cuts_of(column: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Cut points between quantile bins: midpoints of neighbouring values, at most ``bins - 1``."""
    known = np.unique(column)
    if len(known) > bins:
        known = np.unique(np.quantile(column, np.linspace(0, 1, bins), method="nearest"))
    return (known[1:] + known[:-1]) / 2


def best_split(sums: np.ndarray, min_leaf: int, l2: float) -> tuple[float, int, int]:
    """(gain, column, bin) of the best cut of a node with ``sums`` (gradient, hessian, rows) x columns x bins.

    Equal gains: first column, then first bin. Rows of a bin up to the given one go left.
    """
    g, h, n = np.cumsum(sums, axis=2)
    total_g, total_h, total_n = g[:, -1:], h[:, -1:], n[:, -1:]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = g * g / (h + l2) + (total_g - g) ** 2 / (total_h - h + l2) - total_g**2 / (total_h + l2)
    ok = (n >= min_leaf) & (total_n - n >= min_leaf) & (h >= MIN_HESSIAN) & (total_h - h >= MIN_HESSIAN)
    gain = np.where(ok, gain, -np.inf)
    at = int(gain.argmax())
    return float(gain.flat[at]), at // gain.shape[1], at % gain.shape[1]


class _Tree:
    """One tree, grown best leaf first; a split node's larger child is the node less the smaller child."""

    def __init__(self, codes: np.ndarray, width: int, g: np.ndarray, h: np.ndarray, rows: np.ndarray, how: Growth, columns: np.ndarray | None = None):
        self.by_column, self.width, self.g, self.h, self.how = codes.T, width, g, h, how
        self.columns = np.arange(codes.shape[1]) if columns is None else columns
        self.offset = np.arange(len(self.columns))[:, None] * width
        self.nodes: list[list] = []  # [feature, bin, left, right, rows]
        self.waiting: list[tuple] = []
        self._add(rows, self._sums(rows))
        leaves = 1
        while self.waiting and leaves < how.leaves:
            _, i, column, cut, sums = heapq.heappop(self.waiting)
            rows = self.nodes[i][4]
            goes = self.by_column[self.columns[column]][rows] <= cut
            left, right = rows[goes], rows[~goes]
            small = self._sums(left if len(left) <= len(right) else right)
            large = sums - small
            ls, rs = (small, large) if len(left) <= len(right) else (large, small)
            self.nodes[i] = [column, cut, self._add(left, ls), self._add(right, rs), None]
            leaves += 1

    def _sums(self, rows: np.ndarray) -> np.ndarray:
        shape, k = (len(self.columns), self.width), len(self.columns)
        g, h = self.g[rows], self.h[rows]
        if len(rows) * k > LARGE_SUMS:
            sums = np.empty((3, *shape))
            for i, j in enumerate(self.columns.tolist()):
                place = self.by_column[j][rows].astype(np.intp)
                for kind, weights in enumerate((g, h, None)):
                    sums[kind, i] = np.bincount(place, weights, minlength=self.width)
            return sums
        place = (self.by_column[np.ix_(self.columns, rows)] + self.offset).ravel()
        return np.stack([
            np.bincount(place, weights, minlength=shape[0] * shape[1]).reshape(shape)
            for weights in (np.tile(g, k), np.tile(h, k), None)
        ])

    def _add(self, rows: np.ndarray, sums: np.ndarray) -> int:
        i = len(self.nodes)
        self.nodes.append([-1, 0, -1, -1, rows])
        if len(rows) >= 2 * self.how.min_leaf:
            gain, column, cut = best_split(sums, self.how.min_leaf, self.how.l2)
            if gain > 1e-12:
                heapq.heappush(self.waiting, (-gain, i, column, cut, sums))
        return i


def parted(y: np.ndarray, watched: np.ndarray | None, how: Growth) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are watched, and the places of those that trees grow on."""
    watched = np.zeros(len(y), bool) if watched is None or not how.patience else watched
    own = np.flatnonzero(~watched)
    if len(np.unique(y[own])) < 2 or not watched.any():
        watched, own = np.zeros(len(y), bool), np.arange(len(y))
    return watched, own


def coded(column: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Bin of each value: the number of cuts below it."""
    return np.searchsorted(cuts, column, side="left").astype(np.uint8)


def boost(x: np.ndarray, y: np.ndarray, w: np.ndarray, how: Growth, seed: int, watched: np.ndarray | None = None) -> Ensemble:
    """Boosted trees on the log-loss of weighted binary labels; raw scores are log odds.

    ``watched`` marks rows kept out of growth; with ``patience`` the trees after the best log-loss on them are dropped.
    """
    watched, own = parted(y, watched, how)
    cuts = [cuts_of(x[own, j]) for j in range(x.shape[1])]
    codes = np.stack([coded(x[:, j], c) for j, c in enumerate(cuts)]) if cuts else np.zeros((0, len(y)), np.uint8)
    return boost_coded(codes, cuts, y, w, how, seed, watched, own)[0]


def _values(tree: Ensemble, bins: np.ndarray, codes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Leaf values of ``rows`` in one tree whose cuts are the numbers ``bins`` of bins."""
    out = np.zeros(codes.shape[1])
    waiting = [(0, rows)]
    while waiting:
        i, some = waiting.pop()
        if tree.feature[i] < 0:
            out[some] = tree.value[i]
        else:
            goes = codes[tree.feature[i]][some] <= bins[i]
            waiting += [(tree.left[i], some[goes]), (tree.right[i], some[~goes])]
    return out[rows]


def boost_coded(codes: np.ndarray, cuts: list[np.ndarray], y: np.ndarray, w: np.ndarray, how: Growth, seed: int, watched: np.ndarray,
                own: np.ndarray, asked: np.ndarray | None = None) -> tuple[Ensemble, np.ndarray]:
    """``boost`` on the bins of all rows, a row of ``codes`` for each column; also the raw scores of the rows ``asked``."""
    random = np.random.default_rng(seed)
    width = max((len(c) for c in cuts), default=0) + 1
    p = np.average(y[own], weights=w[own]) if w[own].sum() > 0 else 0.5
    start = float(np.log(np.clip(p, 1e-12, 1) / np.clip(1 - p, 1e-12, 1)))
    score, every = np.full(len(y), start), np.arange(len(y))
    useful = np.array([j for j, c in enumerate(cuts) if len(c)], np.int64)
    parts, best, since, kept = [], np.inf, 0, 0
    for _ in range(how.rounds if len(useful) else 0):
        odds = 1 / (1 + np.exp(-score))
        g, h = w * (odds - y), w * odds * (1 - odds)
        rows = np.sort(random.permutation(own)[: max(1, round(how.row_share * len(own)))])
        columns = np.sort(random.permutation(useful)[: max(1, round(how.column_share * len(useful)))])
        tree = _Tree(codes.T, width, g, h, rows, how, columns)
        feature = np.array([columns[n[0]] if n[2] >= 0 else -1 for n in tree.nodes], np.int16)
        bins = np.array([n[1] for n in tree.nodes])
        cut = np.array([cuts[f][b] if f >= 0 else 0.0 for f, b in zip(feature, bins)])
        value = np.array([0.0 if n[2] >= 0 else -how.learning_rate * g[n[4]].sum() / (h[n[4]].sum() + how.l2 + 1e-300) for n in tree.nodes])
        left, right = (np.array([n[k] for n in tree.nodes], np.int32) for k in (2, 3))
        one = Ensemble(0.0, np.zeros(1, np.int32), feature, cut, left, right, value)
        score += _values(one, bins, codes, every)
        parts.append((one, bins))
        if watched.any():
            z = score[watched]
            loss = float((w[watched] * np.logaddexp(0, np.where(y[watched] == 1, -z, z))).sum())
            best, since, kept = (loss, 0, len(parts)) if loss < best - 1e-12 else (best, since + 1, kept)
            if since >= how.patience:
                break
    parts = parts[:kept] if watched.any() else parts
    raw = np.full(0 if asked is None else len(asked), start)
    for one, bins in parts if len(raw) else []:
        raw += _values(one, bins, codes, asked)
    trees = [t for t, _ in parts]
    roots = np.concatenate([[0], np.cumsum([len(t.feature) for t in trees])]).astype(np.int32)[: len(trees)]
    join = lambda name, shift=False: np.concatenate([np.zeros(0, np.int32), *[getattr(t, name) + (r if shift else 0) for t, r in zip(trees, roots)]])
    return Ensemble(start, roots, join("feature").astype(np.int16), join("cut"), join("left", True).astype(np.int32), join("right", True).astype(np.int32), join("value")), raw


def l1_weights(x: np.ndarray, y: np.ndarray, w: np.ndarray, c: float, steps: int = 2000) -> np.ndarray:
    """Coefficients of the logistic model with penalty |b|_1 / (c sum w) and a free intercept, by accelerated proximal steps."""
    total = w.sum()
    a = np.hstack([x, np.ones((len(x), 1))])
    rate = 1 / (0.25 * np.linalg.eigvalsh(a.T @ (a * w[:, None]) / total)[-1] + 1e-12)
    shrink = rate / (c * total)
    b, z, t = np.zeros(a.shape[1]), np.zeros(a.shape[1]), 1.0
    for _ in range(steps):
        step = z - rate * a.T @ (w * (1 / (1 + np.exp(-a @ z)) - y)) / total
        new = np.sign(step) * np.maximum(np.abs(step) - shrink, 0)
        new[-1] = step[-1]
        again = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / again * (new - b)
        if np.abs(new - b).max() < 1e-10:
            return new[:-1]
        b, t = new, again
    return b[:-1]


def balanced(y: np.ndarray) -> np.ndarray:
    """n / (2 n_class) of each row's class."""
    have = np.bincount(y.astype(int), minlength=2)
    return len(y) / (2.0 * have[y.astype(int)])


def bounded_rows(df: DataFrame, keys: list[str], most: int = MAX_FIT_ROWS) -> DataFrame:
    """``df``, or beyond ``most`` rows those whose key's hash falls below the share that leaves about ``most``."""
    n = df.count()
    return df if n <= most else df.where(F.pmod(F.xxhash64(*keys), F.lit(1 << 40)) < F.lit(int((1 << 40) * most / n)))


MODEL = "fold int, model binary, rounds int, raw double, label int"
SLICES = "_key int, _col int, _part int, _facts binary, _data binary"
CODES = "_key int, _for int, _col int, _part int, _facts binary, _data binary"


def own_tasks(spark, n: int) -> list[int]:
    """Whole numbers of which a hash shuffle to ``n`` partitions sends one to each."""
    at = F.pmod(F.hash(F.col("id").cast("int")), F.lit(n))
    found = spark.range(60 * n + 60).groupBy(at.alias("p")).agg(F.min("id").alias("k")).collect()
    return [r["k"] for r in sorted(found)]


def _facts(table: pa.Table) -> tuple:
    """(label, fold, watched number, patient) of the rows of all slices in order; the patients of a slice are numbered from its names."""
    parts = [pickle.loads(b) for _, b in sorted(zip(table["_part"].to_pylist(), table["_facts"].to_pylist()))]
    y, fold, watch = (np.concatenate([p[i] for p in parts]) for i in range(3))
    return y, fold, watch, [(p[3], p[4]) for p in parts]


def fit_folds(rows: DataFrame, cols: list[str], how: Growth, *, folds: int, fold: str, label: str, watch: str, patient: str, order: str,
              calibrate: float, seed: int, l1_c: float | None = None, max_features: int | None = None) -> DataFrame:
    """Fit ``folds`` models side by side; model f is fitted on the rows whose ``fold`` is not f (null: on all of them).

    One row per fold carries the model with its columns and medians; further rows carry the raw scores of the
    calibration rows, those of the first ceil(``calibrate`` x patients) by ``order``. ``watch`` numbers the groups for
    early stopping. Rows without a label are left out. A fold without rows has no model.
    """
    spark, nan = rows.sparkSession, F.lit(float("nan"))
    lean = durable(rows.where(F.col(label).isNotNull()).select(
        F.array(*[F.coalesce(F.col(c).cast("double"), nan) for c in cols]).alias("_x"), F.col(label).cast("int").alias("_y"),
        F.coalesce(F.col(fold).cast("long"), F.lit(-1)).alias("_fold"), F.col(watch).cast("long").alias("_watch"),
        F.col(patient).cast("string").alias("_patient"), F.col(order).cast("string").alias("_order"),
    ))
    at = ["_order", "_watch", "_x"]
    parts = max(1, -(-lean.count() // SLICE_ROWS))
    lean = lean.repartitionByRange(parts, *at).sortWithinPartitions(*[F.col(c).asc_nulls_last() for c in at]).withColumn("_part", F.spark_partition_id())
    tasks, places = own_tasks(spark, len(cols)), own_tasks(spark, folds)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got)
        x = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table["_x"].chunks]).reshape(-1, len(cols))
        names = table["_patient"].combine_chunks().dictionary_encode()
        y, own, seen = (table[c].to_numpy() for c in ("_y", "_fold", "_watch"))
        some = (y.astype(np.int32), own.astype(np.int64), seen % EVAL_BUCKETS == 0)
        part = table["_part"][0].as_py()
        people = pickle.dumps((*some, names.indices.fill_null(len(names.dictionary)).to_numpy().astype(np.int32), [*names.dictionary.to_pylist(), None]))
        lean_facts = pickle.dumps((*some, None, None))
        rest = [(-1, None, people), *[(j, np.ascontiguousarray(x[:, j]).tobytes(), lean_facts) for j in range(len(cols))]]
        for j, data, facts in rest:
            yield pa.RecordBatch.from_pydict({"_key": pa.array([tasks[j]], pa.int32()), "_col": pa.array([j], pa.int32()), "_part": pa.array([part], pa.int32()),
                                              "_facts": pa.array([facts], pa.binary()), "_data": pa.array([data], pa.binary())})

    slices = lean.mapInArrow(cut, SLICES)

    def one(n: int, j: int, part: int, facts: bytes, data: bytes | None) -> dict:
        return {"_key": places[n - 1], "_for": n, "_col": j, "_part": part, "_facts": facts, "_data": data}

    def bins(table: pa.Table) -> pa.Table:
        out = []
        for j in sorted(set(table["_col"].to_pylist())):
            mine = table.filter(pc.equal(table["_col"], j))
            if j < 0:  # the facts of the rows go to every fold as they are
                out += [one(n, j, r["_part"], r["_facts"], None) for r in mine.to_pylist() for n in range(1, folds + 1)]
                continue
            y, fold_of, watch_of, _ = _facts(mine)
            x = np.concatenate([np.frombuffer(b) for _, b in sorted(zip(mine["_part"].to_pylist(), mine["_data"].to_pylist()))])
            x = np.where(np.isfinite(x), x, np.nan)
            for n in range(1, folds + 1):
                here = fold_of != n
                v = x[here]
                known = bool(len(v)) and not np.isnan(v).all()
                median = float(np.nanmedian(v)) if known else 0.0
                v = np.where(np.isnan(v), median, v)
                _, own = parted(y[here], watch_of[here], how)
                cuts = cuts_of(v[own])
                out.append(one(n, j, 0, pickle.dumps((known, median, cuts, v if l1_c else None)), coded(v, cuts).tobytes()))
        return pa.Table.from_pylist(out, pa.schema([("_key", pa.int32()), ("_for", pa.int32()), ("_col", pa.int32()), ("_part", pa.int32()), ("_facts", pa.binary()), ("_data", pa.binary())]))

    # a task for each column, then for each fold, whatever their bytes: the work is not in the bytes
    codes = slices.repartition(len(cols), "_key").groupBy("_key").applyInArrow(bins, CODES)

    def fit(table: pa.Table) -> pa.Table:
        number = table["_for"][0].as_py()
        y, fold_of, watch_of, people = _facts(table.filter(pc.less(table["_col"], 0)))
        here = fold_of != number
        who, names = np.empty(len(y), np.int64), {}
        end = 0
        for index, some in people:  # numbered in the order of ``order``
            places_of = np.array([names.setdefault(p, len(names)) for p in some[:-1]] + [-1])
            who[end : end + len(index)], end = places_of[index], end + len(index)
        y, who, watched = y[here].astype(float), who[here], watch_of[here]
        if not len(y):
            return pa.schema([("fold", pa.int32()), ("model", pa.binary()), ("rounds", pa.int32()), ("raw", pa.float64()), ("label", pa.int32())]).empty_table()
        columns = table.filter(pc.greater_equal(table["_col"], 0)).sort_by("_col")
        known, medians, cuts, values = zip(*[pickle.loads(b) for b in columns["_facts"].to_pylist()])
        w, use = balanced(y), np.flatnonzero(known)
        if l1_c:
            x = np.stack(values, axis=1)
            varying = np.flatnonzero(x.std(0) > 0)
            b = np.abs(l1_weights(x[:, varying], y, w, l1_c)) if len(varying) else np.zeros(0)
            picked = [i for i in sorted(range(len(varying)), key=lambda i: (-b[i], cols[varying[i]])) if b[i] > 1e-9]
            use = np.sort(varying[picked[:max_features] if max_features else picked]) if picked else varying
        coded_rows = np.empty((len(use), len(y)), np.uint8)
        for k, j in enumerate(use.tolist()):
            coded_rows[k] = np.frombuffer(columns["_data"][j].as_buffer(), np.uint8)
        # people in the order of their first row
        met, first = np.unique(who, return_index=True)
        met = met[np.argsort(first)]
        held = met[: int(np.ceil(calibrate * len(met) - 1e-9))] if calibrate else met[:0]
        rows = np.flatnonzero(np.isin(who, held))
        watched, own = parted(y, watched, how)
        model, raw = boost_coded(coded_rows, [cuts[j] for j in use], y, w, how, seed, watched, own, rows)
        data = pickle.dumps((model, [cols[i] for i in use], dict(zip(cols, medians))))
        n = len(raw)
        return pa.table({
            "fold": pa.array([number] * (n + 1), pa.int32()), "model": pa.array([data] + [None] * n, pa.binary()),
            "rounds": pa.array([len(model.roots)] + [None] * n, pa.int32()), "raw": pa.array([None, *raw.tolist()], pa.float64()),
            "label": pa.array([None, *y[rows].astype(int).tolist()], pa.int32()),
        })

    return codes.repartition(folds, "_key").groupBy("_key").applyInArrow(fit, MODEL)


def raw_scores(df: DataFrame, models: dict[int, bytes], cols: list[str], fold: str, name: str = "raw") -> DataFrame:
    """``df`` with the raw score of the model of each row's ``fold``; missing features take the fit's medians."""
    sent = df.sparkSession.sparkContext.broadcast(models)
    keep = df.columns
    values = F.array(*[F.col(c).cast("double") for c in cols])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {k: pickle.loads(v) for k, v in sent.value.items()}
        for batch in batches:
            x = batch["_values"].flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, len(cols))
            which, out = batch["_which"].to_numpy(zero_copy_only=False), np.full(batch.num_rows, np.nan)
            for k, (model, use, medians) in known.items():
                rows = np.flatnonzero(which == k)
                if len(rows):
                    part = x[np.ix_(rows, [cols.index(c) for c in use])]
                    out[rows] = model.raw(np.where(np.isfinite(part), part, [medians[c] for c in use]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(out, from_pandas=True)], names=[*keep, name])

    schema = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])
    return df.withColumn("_values", values).withColumn("_which", F.col(fold).cast("int")).mapInArrow(score, schema)
