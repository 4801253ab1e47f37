"""Centroid clustering of integer vectors by scalar lookup tables (operator 11)."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from onsetry.llm.common import col, fresh, in_arrow, stored
from onsetry.llm.registry import query, read

#: Scaled components are held within this, so that a squared distance fits 64 bits.
LIMIT = 1 << 27
BLOCK = 8192  # rows whose distances to all centroids are held at once
COMPACT = 1 << 16  # a range of values up to this is tabulated by counting, a wider one by sorting


def occurring(column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the distinct values of ``column`` in ascending order, the place of each entry's value among them)."""
    low, high = int(column.min()), int(column.max())
    if high - low > COMPACT:
        return np.unique(column, return_inverse=True)
    seen = np.zeros(high - low + 1, dtype=bool)
    seen[column - low] = True
    return np.flatnonzero(seen) + low, (np.cumsum(seen) - 1)[column - low]


def nearest(values: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance) of each row; of equal distances the smaller number.

    For every dimension the squared difference of each occurring value to each centroid is tabulated once; a row's
    distances are sums of table rows.
    """
    label, distance = np.zeros(len(values), np.int32), np.zeros(len(values), np.int64)
    for at in range(0, len(values), BLOCK):
        part = values[at : at + BLOCK]
        reach = max(int(np.abs(part).max(initial=0)), int(np.abs(centroids).max(initial=0))) * 2
        kind = np.int32 if reach * reach * part.shape[1] < 1 << 31 else np.int64
        total = np.zeros((len(part), len(centroids)), kind)
        for j in range(part.shape[1]):
            known, code = occurring(part[:, j])
            table = ((known[:, None] - centroids[None, :, j]) ** 2).astype(kind)
            total += table[code]
        label[at : at + BLOCK] = total.argmin(1)
        distance[at : at + BLOCK] = total.min(1)
    return label, distance


def matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    """A list column whose lists all have ``dims`` entries as rows of 64-bit integers."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def partial_sums(centroids: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For a task's rows: (cluster, dimension, sum), dimension -1 holding the count. One small table a task."""
    k, dims = centroids.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k, dims + 1), np.int64)
        for batch in batches:
            values = matrix(batch.column(0), dims)
            label, _ = nearest(values, centroids)
            order = np.argsort(label, kind="stable")
            held, first = np.unique(label[order], return_index=True)
            if len(held):
                sums[held, 1:] += np.add.reduceat(values[order], first, axis=0)
                sums[:, 0] += np.bincount(label, minlength=k)
        at, dim = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at.astype(np.int32)), pa.array((dim - 1).astype(np.int32)), pa.array(sums[at, dim])], ["c", "d", "s"]
        )

    return work


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: assign every vector, then the floor of each non-empty cluster's mean. k x (dims + 1) sums return."""
    sums = in_arrow(vectors, partial_sums(centroids), "c int, d int, s long")
    total = sums.groupBy("c", "d").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    got = {(r["c"], r["d"]): int(r["s"]) for r in total.collect()}
    out = centroids.copy()
    for c in range(len(out)):
        n = got.get((c, -1), 0)
        if n:
            out[c] = [got.get((c, d), 0) // n for d in range(out.shape[1])]
    return out


def cluster_vectors(
    df: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, salt: str = "2:",
    vec_id: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """The rows with a whole vector, with ``cluster``, ``distance``, ``cluster_inertia``, ``inertia``, ``centroid`` and ``centroid_sha256``.

    Kept are rows whose ``vector`` has exactly ``dims`` components, none null or non-finite; a component x becomes
    floor(scale * x), held within +-2 ** 27. The first centroids are the ``k`` rows with the smallest SHA-256 of salt
    and id (equal hashes: smaller vector; a null id is never one). Repeated rows are vectors of their own. With fewer
    than ``k`` ids there are fewer centroids; with none, or no rows, the result is empty. Columns of ``df`` called
    like an added one are replaced; others stay, whatever their names.

    Each round is one pass: centroids (k x dims) go to the tasks, k x (dims + 1) sums return. Vectors never move
    between tasks, so a cluster that holds most of them is no burden.
    """
    added = ["cluster", "distance", "cluster_inertia", "inertia", "centroid", "centroid_sha256"]
    base = df.drop(*[c for c in df.columns if c.lower() in added])
    (v, key) = fresh(base, "_v", "_key")
    whole = (F.size(col(vector)) == dims) & F.forall(col(vector), lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    scaled = F.transform(
        col(vector), lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(LIMIT))), F.lit(-float(LIMIT)))).cast("int")
    )
    kept = stored(base.where(F.coalesce(whole, F.lit(False))).withColumn(v, scaled))
    seeds = (
        kept.where(col(vec_id).isNotNull())
        .select(F.sha2(F.concat(F.lit(salt), col(vec_id).cast("string")), 256).alias(key), col(v))
        .orderBy(key, v).limit(k).collect()
    )
    centroids = np.array([r[v] for r in seeds], dtype=np.int64).reshape(-1, dims)
    fields = base.schema.fields + [T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())]
    summary = "cluster int, cluster_inertia long, inertia long, centroid array<long>, centroid_sha256 string"
    spark = df.sparkSession
    if not len(centroids):
        empty = kept.where(F.lit(False)).drop(v).withColumns({f.name: F.lit(None).cast(f.dataType) for f in fields[-2:]})
        return empty.join(spark.createDataFrame([], summary), "cluster").select(*[col(c) for c in base.columns], *added)
    vectors = kept.select(v)
    for _ in range(rounds):
        centroids = moved(vectors, centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, distance = nearest(matrix(batch.column(batch.num_columns - 1), dims), centroids)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(label), pa.array(distance)], names=[f.name for f in fields]
            )

    out = stored(in_arrow(kept, assign, T.StructType(fields)))
    inertia = {r["cluster"]: int(r["s"]) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    rows = []
    for c, at in enumerate(centroids.tolist()):
        digest = hashlib.sha256(",".join(map(str, at)).encode()).hexdigest()
        rows.append((c, inertia.get(c, 0), sum(inertia.values()), at, digest))
    return out.join(F.broadcast(spark.createDataFrame(rows, summary)), "cluster").select(*[col(c) for c in base.columns], *added)


def statement(k: int = 40, rounds: int = 5) -> str:
    """The same in SQL: one assignment and one mean a round."""
    parts = [
        """v AS MATERIALIZED (SELECT vec_id, unnest(range(64)) AS d, unnest(list_transform(embedding, lambda x: cast(floor(256 * cast(x AS double)) AS bigint))) AS x
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, vec_id FROM (SELECT DISTINCT vec_id, sha256('2:' || vec_id) AS h FROM v) ORDER BY h LIMIT {k})""",
        "k0 AS MATERIALIZED (SELECT c, d, x AS m FROM c0 JOIN v USING (vec_id))",
    ]
    for i in range(rounds + 1):
        parts.append(
            f"""a{i} AS MATERIALIZED (SELECT vec_id, arg_min(c, (s, c)) AS c, min(s) AS s FROM
  (SELECT vec_id, c, sum((x - m) * (x - m)) AS s FROM v JOIN k{i} USING (d) GROUP BY ALL) GROUP BY vec_id)"""
        )
        if i < rounds:
            parts.append(
                f"""k{i + 1} AS MATERIALIZED (SELECT c, d, coalesce(f, m) AS m FROM k{i} LEFT JOIN
  (SELECT c, d, cast((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) / count(*) AS bigint) AS f FROM v JOIN a{i} USING (vec_id) GROUP BY ALL) USING (c, d))"""
            )
    return f"""WITH {", ".join(parts)},
h AS (SELECT c, sha256(string_agg(cast(m AS varchar), ',' ORDER BY d)) AS centroid_sha256 FROM k{rounds} GROUP BY c)
SELECT vec_id, cast(c AS integer) AS cluster, cast(s AS bigint) AS distance, cast(sum(s) OVER (PARTITION BY c) AS bigint) AS cluster_inertia,
  cast(sum(s) OVER () AS bigint) AS inertia, centroid_sha256 FROM a{rounds} JOIN h USING (c)"""


@query("op11_centroid_clustering", statement())
def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(read(spark, sf_dir, "embeddings")).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
