"""Shards by a consistent-hash ring with virtual nodes and bounded loads (operator 6)."""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from onsetry.llm.common import aside, back, bounded, col, hash60, stored
from onsetry.llm.registry import query, read

SPACE = 1 << 60
VIRTUAL_NODES = 64  # per shard
CELL_ROWS = 50_000  # rows aimed at in one stretch of the ring that is numbered by itself


def ring(shards: int, virtual_nodes: int = VIRTUAL_NODES) -> list[tuple[int, int]]:
    """(position, shard) of every virtual node, in ring order."""
    at = lambda s, v: int(hashlib.md5(f"shard {s} node {v}".encode()).hexdigest()[:15], 16)
    return sorted((at(s, v), s) for s in range(shards) for v in range(virtual_nodes))


def capacities(rows: int, shards: int) -> list[int]:
    """Loads at most one apart that hold all rows exactly."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def fill(nodes: list[tuple[int, int]], rows_by_arc: dict[int, int], capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Walk the ring: (arc, first rank, rows, shard, first slot) for each run of an arc's keys that lands in one shard.

    Arc ``i`` holds the keys up to node ``i``'s position; those beyond the last node belong to arc 0 and come last,
    as arc ``len(nodes)``. Keys that find their shard full go on clockwise to the next node whose shard has room.
    """
    used, runs, n = [0] * len(capacity), [], len(nodes)
    for arc in range(n + 1):
        rank, left, step = 0, rows_by_arc.get(arc, 0), 0
        while left:
            shard = nodes[(arc + step) % n][1]
            take = min(left, capacity[shard] - used[shard])
            if take:
                runs.append((arc, rank, take, shard, used[shard]))
                rank, left, used[shard] = rank + take, left - take, used[shard] + take
            step += 1
    return runs


def assign(docs: DataFrame, key: list[Column | str], shards: int = 8, ties: list[Column | str] = (),
           virtual_nodes: int = VIRTUAL_NODES) -> DataFrame:
    """``docs`` with ``shard`` and ``slot`` (0, 1, ... within the shard): row counts differ by one at most.

    A row belongs to the first virtual node clockwise from its key's hash. Rows enter in ring order, ``ties``
    deciding among equal keys; one that finds its shard full goes on clockwise to the next node whose shard has
    room. The walk needs row counts by arc only (shards x virtual nodes of them reach the driver); a row's place
    then follows from its rank within the arc, counted in short stretches of the ring. Null keys hash like any
    value; equal rows are told apart by nothing but their slot; no rows give no rows. Columns of ``docs`` called like
    an added one are replaced. Many rows with one and the same key share a stretch, and so a task.
    """
    spark, nodes = docs.sparkSession, ring(shards, virtual_nodes)
    names, users = aside(docs, ["shard", "slot"])
    order = [(col(c) if isinstance(c, str) else c).alias(f"tie{i}") for i, c in enumerate(ties)]
    rows = docs.count()
    cells = max(1, rows // CELL_ROWS)
    position = hash60(*key)
    starts = F.array(*[F.lit(p) for p, _ in nodes])
    base = docs.select(*users, *order, position.alias("_at"))
    base = base.withColumn("_arc", F.size(F.filter(starts, lambda p: p < F.col("_at"))))
    base = base.withColumn("_cell", F.floor(F.col("_at") / F.lit(SPACE / cells)).cast("long"))
    counts = stored(base.groupBy("_arc", "_cell").agg(F.count("*").alias("_n")))
    by_arc = {r["_arc"]: r["n"] for r in counts.groupBy("_arc").agg(F.sum("_n").alias("n")).collect()}
    runs = fill(nodes, by_arc, capacities(rows, shards))
    runs_df = spark.createDataFrame(runs or [(-1, 0, 0, 0, 0)], "arc int, first long, n long, to int, slot0 long")
    before = F.sum("_n").over(Window.partitionBy("_arc").orderBy("_cell")) - F.col("_n")
    offsets = counts.select(F.col("_arc").alias("_a"), F.col("_cell").alias("_c"), before.alias("_before"))
    order = ["_at", *[f"tie{i}" for i in range(len(ties))]]
    rank = F.row_number().over(Window.partitionBy("_arc", "_cell").orderBy(*order)).cast("long") - 1
    ranked = base.withColumn("_r", rank).join(bounded(offsets, 1_000_000), (F.col("_arc") == F.col("_a")) & (F.col("_cell") == F.col("_c")))
    ranked = ranked.withColumn("_r", F.col("_r") + F.col("_before"))
    # at most one run for each arc and shard: bounded by the ring
    inside = (F.col("_arc") == F.col("arc")) & (F.col("_r") >= F.col("first")) & (F.col("_r") < F.col("first") + F.col("n"))
    out = ranked.join(F.broadcast(runs_df), inside)
    return out.select(*back(names), F.col("to").alias("shard"), (F.col("slot0") + F.col("_r") - F.col("first")).alias("slot"))


def shard_of_keys(keys: list[int], shards: int, virtual_nodes: int = VIRTUAL_NODES) -> list[int]:
    """The plain walk, key by key, for ring positions in order: what ``assign`` must equal."""
    nodes, capacity = ring(shards, virtual_nodes), capacities(len(keys), shards)
    at, used, out = [p for p, _ in nodes], [0] * shards, []
    for k in keys:
        i = bisect_left(at, k)
        while used[nodes[i % len(nodes)][1]] >= capacity[nodes[i % len(nodes)][1]]:
            i += 1
        used[nodes[i % len(nodes)][1]] += 1
        out.append(nodes[i % len(nodes)][1])
    return out


@query("op6_sharding")
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = read(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    out = assign(docs, ["doc_id"], 8, ties=["doc_id", "size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
