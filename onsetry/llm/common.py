"""Helpers shared by the corpus operators: shared tables, word hashing, connected components, nested thresholds."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
SLICE_BYTES = 1 << 20  # text that is hashed at once inside a task; longer documents are taken alone


# --- tables shared by driver and executors ------------------------------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one only in local mode, where there is one machine."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="onsetry-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage is cut, lost executors do not matter."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows; beyond that Spark chooses and AQE splits skew."""
    return F.broadcast(df) if df.count() <= rows else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for working columns that no column of ``df`` has (Spark tells names apart without regard to case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def col(name: str) -> Column:
    """The column of exactly this name, dots and back quotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def aside(df: DataFrame, added: list[str]) -> tuple[list[str], list[Column]]:
    """(names, columns) of ``df`` but the ``added`` ones, called u0, u1, ... while an operator works with names of its own."""
    lost = {a.lower() for a in added}
    names = [c for c in df.columns if c.lower() not in lost]
    return names, [col(c).alias(f"u{i}") for i, c in enumerate(names)]


def back(names: list[str]) -> list[Column]:
    """The columns that ``aside`` put away, under their own names."""
    return [F.col(f"u{i}").alias(c) for i, c in enumerate(names)]


def aside_name(names: list[str], name: str) -> str:
    """How ``aside`` calls the column ``name``."""
    return f"u{[c.lower() for c in names].index(name.lower())}"


def in_arrow(df: DataFrame, work, schema) -> DataFrame:
    """``df.mapInArrow``, for column names of any form (dots break the plain call); batches bear the names of ``df``."""
    names = df.columns

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(b.rename_columns(names) for b in batches)

    return df.toDF(*[f"_{i}" for i in range(len(names))]).mapInArrow(renamed, schema)


def hash60(*cols: Column | str, seed: int = 0) -> Column:
    """60 bits of MD5 over the columns' text (null differs from empty); any SQL engine can compute it."""
    parts = [F.coalesce(F.concat(F.lit("v"), c.cast("string")), F.lit("n")) for c in (col(c) if isinstance(c, str) else c for c in cols)]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts, F.lit(str(seed)))), 1, 15), 16, 10).cast("long")


def hash60_sql(*cols: str, seed: int = 0) -> str:
    """The same in DuckDB."""
    parts = ", ".join(f"coalesce('v' || cast({c} as varchar), 'n')" for c in cols)
    return f"cast('0x' || substr(md5(concat_ws('|', {parts}, '{seed}')), 1, 15) as bigint)"


# --- words and their hashes ---------------------------------------------------------------------------------------


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the 64-bit finaliser of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _mask(allowed) -> np.ndarray:
    return np.array([bool(allowed(b)) for b in range(256)])


NOT_SPACE = _mask(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
WORD_BYTE = _mask(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)  # after lower-casing A-Z
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)
BASE, STEP = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93  # odd 64-bit multipliers
_BYTE_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base ** i`` and its inverse modulo 2 ** 64 for i up to ``n``; odd bases are invertible."""
    if base not in _powers or len(_powers[base][0]) <= n:
        size, out = max(n + 1, SLICE_BYTES + 1), []
        for x in (base, pow(base, -1, 1 << 64)):
            a = np.full(size, x, dtype=np.uint64)
            a[0] = 1
            out.append(np.cumprod(a, dtype=np.uint64))
        if size > 16 * SLICE_BYTES:
            return out[0], out[1]  # a single very long text: not kept
        _powers[base] = (out[0], out[1])
    return _powers[base]


class Words:
    """The words of consecutive texts: ``row`` (which text), ``start``/``end`` (bytes in ``data``), ``hash``."""

    def __init__(self, texts: pa.Array, word: np.ndarray = NOT_SPACE, lower: bool = False, hashed: bool = True):
        texts = texts.cast(pa.binary()).fill_null(b"")
        self.n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + self.n + 1].astype(np.int64)
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
        self.offsets = offsets - offsets[0]
        self.data = LOWER[data] if lower else data
        inside = word[self.data]
        first, last = inside.copy(), inside.copy()
        if len(inside):
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            edge = self.offsets[:-1][self.offsets[:-1] < self.offsets[1:]]
            first[edge] = inside[edge]
            last[edge[1:] - 1] = inside[edge[1:] - 1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.row = np.searchsorted(self.offsets, self.start, side="right") - 1
        self.count = np.bincount(self.row, minlength=self.n).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.count)])  # index of each text's first word
        if hashed:
            up, down = powers(BASE, len(self.data))
            total = np.zeros(len(self.data) + 1, dtype=np.uint64)
            np.cumsum(_BYTE_VALUE[self.data] * up[: len(self.data)], dtype=np.uint64, out=total[1:])
            self.hash = mix64((total[self.end] - total[self.start]) * down[self.start] ^ (self.end - self.start).astype(np.uint64))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash of the ``n`` words from each word on, whether they lie in one text); shorter by ``n - 1`` at the end."""
        if len(self.hash) < n:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        return gram_hash(self.hash, n), self.row[: len(self.row) - n + 1] == self.row[n - 1 :]


def gram_hash(values: np.ndarray, n: int) -> np.ndarray:
    """Order-sensitive hash of each run of ``n`` values."""
    if len(values) < n:
        return np.zeros(0, np.uint64)
    up, down = powers(STEP, len(values))
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], dtype=np.uint64, out=total[1:])
    return mix64((total[n:] - total[: len(total) - n]) * down[: len(total) - n] + np.uint64(n))


def span_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The same for runs of differing length."""
    up, down = powers(STEP, len(values))
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], dtype=np.uint64, out=total[1:])
    return mix64((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def slices(batch: pa.RecordBatch, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``SLICE_BYTES`` of text, one document at least."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0)).astype(np.int64)
    total, at = np.cumsum(size), 0
    while at < batch.num_rows:
        limit = (total[at - 1] if at else 0) + SLICE_BYTES
        to = max(at + 1, int(np.searchsorted(total, limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


# --- connected components -----------------------------------------------------------------------------------------


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 64) -> DataFrame:
    """Connected components of an undirected edge table: (id, component = smallest id reachable).

    Alternating large and small stars: each round hangs a node's neighbours under the smallest one, so the number
    of rounds grows with the logarithm of the longest path. Edges stay distributed; minima are combined before the
    shuffle, and the joins that hand them back may be split by AQE, so a hub needs no task of its own. Nulls and
    loops are dropped; no edges give an empty table.
    """
    edges = stored(
        links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
        .where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    before = None
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # each node's own smallest neighbour is kept by the small star below
        large = large.union(least.where("u <> m").select("u", F.col("m").alias("v"))).distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.union(small_least.select("u", F.col("m").alias("v"))).distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
