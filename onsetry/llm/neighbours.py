"""Embedding near-dedup with a small-world graph per shard (operator 10)."""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from onsetry.llm.common import components, stored
from onsetry.llm.registry import query, read

LEAST_COSINE = 0.95
SHARD_ROWS = 8192  # vectors of one graph
BLOCK_ROWS = 16384  # queries that one task puts to one graph
DEGREE = 16  # links of a new node; twice as many at most in the lowest layer
BUILD_BEAM, FIRST_BEAM = 64, 64
RECALL = 0.99  # that an audit asks for
AUDIT = 256  # queries of an audit
AT_ONCE = 256  # queries that walk together


class Graph:
    """A hierarchical navigable small world over unit vectors; nodes of higher layers come first, so ids are shared."""

    def __init__(self, vectors: np.ndarray, seed: int = 0):
        rng = np.random.default_rng(seed)
        n = len(vectors)
        level = np.floor(-np.log(1 - rng.random(n)) / np.log(DEGREE)).astype(int)
        self.order = np.argsort(-level, kind="stable")
        self.v = vectors[self.order].astype(np.float32)
        level = level[self.order]
        self.layers: list[np.ndarray] = []  # neighbours by layer, the highest first, -1 where there is none
        for high in range(level.max(initial=0), -1, -1):
            self._build(int((level >= high).sum()), DEGREE if high else 2 * DEGREE)
        self.beam = FIRST_BEAM

    def _build(self, n: int, degree: int) -> None:
        links = np.full((n, degree), -1, np.int32)
        self.layers.append(links)
        have = 0
        while have < n:
            to = min(n, have + max(1, min(AT_ONCE, have)))
            new = np.arange(have, to)
            among = self.v[new] @ self.v[new].T
            np.fill_diagonal(among, -np.inf)
            among[np.triu_indices(len(new))] = -np.inf  # nodes before it
            ids, sims = np.broadcast_to(new, among.shape), among
            if have:
                old, old_sims = self._walk(self.v[new], BUILD_BEAM, have)
                ids, sims = np.concatenate([old, ids], 1), np.concatenate([old_sims, sims], 1)
            best = np.argsort(-sims, axis=1, kind="stable")[:, :BUILD_BEAM]
            ids, sims = np.take_along_axis(ids, best, 1), np.take_along_axis(sims, best, 1)
            chosen = self._spread(ids, sims, DEGREE)
            links[new, : chosen.shape[1]] = chosen
            self._link_back(links, new, chosen)
            have = to

    def _link_back(self, links: np.ndarray, new: np.ndarray, chosen: np.ndarray) -> None:
        to, source = chosen.ravel(), np.repeat(new, chosen.shape[1])
        to, source = to[to >= 0], source[to >= 0]
        order = np.argsort(to, kind="stable")
        to, source = to[order], source[order]
        nodes, first, many = np.unique(to, return_index=True, return_counts=True)
        wide = np.full((len(nodes), many.max(initial=0)), -1, np.int32)
        wide[np.repeat(np.arange(len(nodes)), many), np.arange(len(to)) - np.repeat(first, many)] = source
        ids = np.concatenate([links[nodes], wide], 1)
        sims = np.einsum("amd,ad->am", self.v[ids], self.v[nodes])
        sims[ids < 0] = -np.inf
        order = np.argsort(-sims, axis=1, kind="stable")
        links[nodes] = self._spread(np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1), links.shape[1])

    def _spread(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Of candidates in falling order those nearer to the node than to any one taken, then the nearest others."""
        real = np.isfinite(sims)
        near = np.einsum("aid,ajd->aij", self.v[ids], self.v[ids])
        taken = np.zeros(ids.shape, bool)
        for j in range(ids.shape[1]):
            clash = np.where(taken, near[:, j], -np.inf).max(1, initial=-np.inf)
            taken[:, j] = real[:, j] & (sims[:, j] > clash) & (taken.sum(1) < most)
        rank = np.where(taken, 0, np.where(real, 1, 2))
        order = np.argsort(rank, axis=1, kind="stable")[:, :most]
        out = np.where(np.take_along_axis(real, order, 1), np.take_along_axis(ids, order, 1), -1).astype(np.int32)
        return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)

    def _walk(self, queries: np.ndarray, beam: int, reach: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Descend the finished layers with a narrow beam, then search the lowest; ``reach``: nodes inserted so far."""
        ids = np.zeros((len(queries), 1), np.int32)
        for links in self.layers[:-1]:
            ids, _ = self._beam(links, queries, ids, 4, len(links))
        return self._beam(self.layers[-1], queries, ids, beam, reach or len(self.layers[-1]))

    def _beam(self, links: np.ndarray, queries: np.ndarray, start: np.ndarray, beam: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """Best-first search of many queries in step: each widens from its best nodes not yet seen into."""
        b = len(queries)
        seen = np.zeros((b, len(links)), bool)
        start = np.where(start < reach, start, -1)
        ids = np.full((b, beam), -1, np.int32)
        sims = np.full((b, beam), -np.inf, np.float32)
        width = min(start.shape[1], beam)
        ids[:, :width] = start[:, :width]
        sims[:, :width] = np.where(start[:, :width] >= 0, np.einsum("amd,ad->am", self.v[start[:, :width]], queries), -np.inf)
        rows = np.arange(b)
        seen[rows[:, None], np.maximum(ids[:, :width], 0)] |= ids[:, :width] >= 0
        done = ids < 0
        act = rows
        while len(act):
            open_sims = np.where(done[act], -np.inf, sims[act])
            pick = np.argpartition(-open_sims, min(3, beam - 1), axis=1)[:, :4]
            ok = np.isfinite(np.take_along_axis(open_sims, pick, 1))
            live = ok.any(1)
            act, pick, ok = act[live], pick[live], ok[live]
            if not len(act):
                break
            here = done[act]
            np.put_along_axis(here, pick, True, 1)
            done[act] = here
            nodes = np.take_along_axis(ids[act], pick, 1)
            near = links[nodes]
            near[~ok] = -1
            near = np.sort(near.reshape(len(act), -1), axis=1)
            fresh = (near >= 0) & (near < reach) & ~seen[act[:, None], near]
            fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
            r, c = np.nonzero(fresh)
            seen[act[r], near[r, c]] = True
            new = np.full(near.shape, -np.inf, np.float32)
            new[r, c] = np.einsum("rd,rd->r", self.v[near[r, c]], queries[act[r]])
            all_sims = np.concatenate([sims[act], new], 1)
            top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            sims[act] = np.take_along_axis(all_sims, top, 1)
            ids[act] = np.take_along_axis(np.concatenate([ids[act], near], 1), top, 1)
            done[act] = np.take_along_axis(np.concatenate([done[act], ~fresh], 1), top, 1)
        return ids, sims

    def within(self, queries: np.ndarray, least: float) -> list[np.ndarray]:
        """Nodes of at least that cosine for each unit query; a beam that holds nothing else is widened until it does."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(queries)
        left, beam, n = np.arange(len(queries)), min(self.beam, len(self.v)), len(self.v)
        while len(left):
            again = []
            for i in range(0, len(left), AT_ONCE):
                q = left[i : i + AT_ONCE]
                ids, sims = self._walk(queries[q], beam)
                for k, (a, s) in enumerate(zip(ids, sims)):
                    out[q[k]] = a[(s >= least) & (a >= 0)]
                again.append(q[(sims >= least).all(1)] if beam < n else q[:0])
            left, beam = np.concatenate(again), min(2 * beam, n)
        return out

    def audit(self, queries: np.ndarray, least: float) -> None:
        """Double the beam until the queries find ``RECALL`` of what comparing them with every vector finds."""
        truth = queries.astype(np.float32) @ self.v.T >= least
        while self.beam < len(self.v) and truth.any():
            found = sum(int(truth[i][ids].sum()) for i, ids in enumerate(self.within(queries.astype(np.float32), least)))
            if found >= RECALL * truth.sum():
                break
            self.beam *= 2


def unit(rows: pa.Array) -> np.ndarray:
    """Vectors of one length as unit rows in double precision."""
    flat = np.asarray(rows.flatten()).astype(np.float64).reshape(len(rows), -1)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def _planted(v: np.ndarray, least: float, seed: int) -> np.ndarray:
    """Vectors just inside the threshold of some of ``v``."""
    rng = np.random.default_rng(seed)
    some = v[rng.permutation(len(v))[:AUDIT]]
    noise = rng.standard_normal(some.shape)
    noise -= (noise * some).sum(1, keepdims=True) * some
    noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-12)
    c = min(1.0, least + (1 - least) / 10)
    return some * c + noise * np.sqrt(1 - c * c)


def build_graphs(vectors: DataFrame, least: float) -> DataFrame:
    """(shard, graph) from (shard, id, many, v); each graph's beam has passed an audit with planted near copies."""

    def build(table: pa.Table) -> pa.Table:
        v = unit(table.column("v").combine_chunks())
        graph = Graph(v)
        graph.audit(_planted(v, least, 1), least - 1e-6)
        ids, many = np.asarray(table.column("id"))[graph.order], np.asarray(table.column("many"))[graph.order]
        blob = pickle.dumps((graph, v[graph.order], ids, many), protocol=5)
        return pa.table({"shard": table.column("shard")[:1], "graph": pa.array([blob], pa.binary())})

    return vectors.groupBy("shard").applyInArrow(build, "shard long, graph binary")


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges enough to connect what the given ones connect."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        rx, ry = root(x), root(y)
        if rx != ry:
            parent[rx] = ry
            out.append((x, y))
    return out


def query_graphs(graphs: DataFrame, queries: DataFrame, least: float) -> DataFrame:
    """(a, b, n): numbers of vectors linked (b null), and edges that connect them (n null).

    A link within a shard is met from both sides, and each side counts its own; one between shards is met from the
    side that queries, which counts for both.
    """

    def ask(key, left: pa.Table, right: pa.Table) -> pa.Table:
        graph, v, ids, many = pickle.loads(left.column("graph")[0].as_py())
        q, names = unit(right.column("v").combine_chunks()), np.asarray(right.column("id"))
        graph.audit(q[np.random.default_rng(2).permutation(len(q))[:AUDIT]], least - 1e-6)
        found = graph.within(q.astype(np.float32), least - 1e-5)
        row = np.repeat(np.arange(len(q)), [len(f) for f in found])
        node = np.concatenate([np.zeros(0, np.int64), *found]).astype(np.int64)
        exact = np.concatenate([np.zeros(0), *[np.einsum("rd,rd->r", q[row[i : i + 65536]], v[node[i : i + 65536]]) for i in range(0, len(row), 65536)]])
        ok = (exact >= least) & (ids[node] != names[row])
        row, node = row[ok], node[ok]
        n = np.bincount(row, weights=many[node], minlength=len(q)).astype(np.int64)
        own, weight = np.asarray(right.column("own")), np.asarray(right.column("many"))
        across = ~own[row]
        back = np.bincount(node[across], weights=weight[row[across]], minlength=len(ids)).astype(np.int64)
        some, other = np.flatnonzero(n), np.flatnonzero(back)
        edges = _forest(names[row], ids[node])
        return pa.table({
            "a": pa.array([*names[some].tolist(), *ids[other].tolist(), *[x for x, _ in edges]], pa.int64()),
            "b": pa.array([*[None] * (len(some) + len(other)), *[y for _, y in edges]], pa.int64()),
            "n": pa.array([*n[some].tolist(), *back[other].tolist(), *[None] * len(edges)], pa.int64()),
        })

    return graphs.groupBy("shard", "block").cogroup(queries.groupBy("shard", "block")).applyInArrow(ask, "a long, b long, n long")


def usable(v: Column) -> Column:
    """Neither null nor empty nor zero, and no null or non-finite component."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0)


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", least: float = LEAST_COSINE,
                 shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept): vectors linked by a cosine of at least ``least``, as components.

    Equal vectors are one class, counted but never paired. The others are dealt by hash into shards of about
    ``shard_rows``, one graph each; every vector queries its own shard's graph, and for each other shard either it
    queries that graph or that shard's vectors query its own, in blocks of about ``block_rows``. A
    graph's beam is widened until it finds planted near copies and, in each block, what a sample of its queries finds by
    comparing all; a query whose beam holds links only is widened until it meets something else. Candidates are
    checked in double precision, so nothing below ``least`` links. A task returns counts and enough edges to connect
    what it found, not all pairs.

    Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing, and so do
    vectors of different length; rows without an id have no links and no component; rows of one id count as one
    place. No rows give no rows.
    """
    v = F.col(f"`{embedding}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), v.alias("v"))
    rows = rows.withColumn("ok", F.col("id").isNotNull() & F.coalesce(usable(F.col("v")), F.lit(False)))
    key = F.when(F.col("ok"), F.struct(F.xxhash64("v").alias("x"), F.xxhash64(F.lit(1), F.col("v")).alias("y")))
    members = stored(rows.select("id", key["x"].alias("x"), key["y"].alias("y")))
    good = rows.where("ok").select("id", "v", key["x"].alias("x"), key["y"].alias("y"))
    classes = stored(good.groupBy("x", "y").agg(F.min("id").alias("id"), F.count("*").alias("many"), F.first("v").alias("v")))
    sizes = classes.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"))
    parts = F.ceil(F.col("n") / shard_rows)
    shards = stored(sizes.select("d", parts.alias("shards"), F.ceil(F.col("n") / block_rows).alias("blocks")))
    dealt = classes.join(shards, F.size("v") == F.col("d"))
    name = lambda i: F.col("d").cast("long") * (1 << 40) + i  # noqa: E731  shards of one length only
    indexed = dealt.select(name(F.pmod(F.xxhash64("id"), F.col("shards"))).alias("shard"), "id", "many", "v")
    graphs = stored(build_graphs(indexed, least))
    blocks = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    asked = graphs.join(shards, F.floor(F.col("shard") / (1 << 40)) == F.col("d")).select("shard", "graph", blocks)
    every = F.explode(F.sequence(F.lit(0), F.col("shards") - 1))
    block = F.pmod(F.xxhash64(F.lit(2), F.col("id")), F.col("blocks")).alias("block")
    queries = dealt.select("id", "many", "v", "d", block, F.pmod(F.xxhash64("id"), F.col("shards")).alias("p"), every.alias("s"))
    # each pair of shards is searched from one side, taken in turn
    queries = queries.where("p = s or (p < s) = ((p + s) % 2 = 0)")
    queries = queries.select(name(F.col("s")).alias("shard"), "block", "id", "many", "v", (F.col("p") == F.col("s")).alias("own"))
    found = stored(query_graphs(asked, queries, least))
    counts = found.where("n is not null").groupBy("a").agg(F.sum("n").alias("n"))
    groups = components(found.where("b is not null"))
    known = classes.select("x", "y", F.col("id").alias("rep"), "many").join(counts, F.col("rep") == F.col("a"), "left")
    known = known.join(groups, F.col("rep") == groups["id"], "left").select(
        "x", "y", (F.coalesce("n", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")
    )
    out = members.join(known, ["x", "y"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").alias(vec_id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )


@query("op10_embedding_dedup")
def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))
