"""Benchmark decontamination by winnowed fingerprints (operator 7)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from onsetry.llm.common import (
    ASCII_LOWER, ASCII_UPPER, WORD_BYTE, Words, aside, aside_name, back, col, gram_hash, sliding_min, slices, stored,
)
from onsetry.llm.registry import query, read

WINDOW = 13
WORD_BYTES = 16  # an index holds so many bytes of text a word at most
GRAM = 7  # shared spans of WINDOW words hold WINDOW - GRAM + 1 grams, whose least hash is the fingerprint
INDEX_WORDS = 4_000_000  # benchmark words that one index, sent to every task, may hold


class Index:
    """Fingerprints and windows of some benchmark items: sorted hashes, and the items of each."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW, gram: int = GRAM):
        self.window, self.gram = window, gram
        w = Words(pa.array([t for _, t in items], pa.string()), WORD_BYTE, lower=True)
        self.ids = [i for i, _ in items]
        by_length: dict[int, tuple[list, list]] = {}
        self.prints = np.zeros(0, np.uint64)
        h, ok = w.grams(window)
        if ok.any():
            by_length[window] = ([h[ok]], [w.row[: len(h)][ok]])
            least = sliding_min(gram_hash(w.hash, gram), window - gram + 1)
            self.prints = np.unique(least[ok])
        for n in sorted(set(w.count[(w.count > 0) & (w.count < window)].tolist())):
            rows = np.flatnonzero(w.count == n)
            by_length[n] = ([gram_hash(w.hash, n)[w.first[rows]]], [rows])
        self.tables = {}
        for n, (hashes, rows) in by_length.items():
            pair = np.unique(np.stack([np.concatenate(hashes), np.concatenate(rows).astype(np.uint64)], 1), axis=0)
            self.tables[n] = (pair[:, 0].copy(), pair[:, 1].astype(np.int64))

    def hits(self, w: Words) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """(word at which an occurrence begins, index of the item, length)."""
        out = []
        for n, (keys, rows) in self.tables.items():
            h, ok = w.grams(n)
            at = np.flatnonzero(ok)
            if n == self.window and len(at):
                least = sliding_min(gram_hash(w.hash, self.gram), n - self.gram + 1)[at]
                new = np.ones(len(at), bool)  # one lookup for a run of windows with the same fingerprint
                new[1:] = (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1)
                at = at[_in(least[new], self.prints)[np.cumsum(new) - 1]]
            low, high = np.searchsorted(keys, h[at], "left"), np.searchsorted(keys, h[at], "right")
            many = high - low
            within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            out.append((np.repeat(at, many), rows[np.repeat(low, many) + within], n))
        return out


def _in(x: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(x), bool)
    return keys[np.minimum(np.searchsorted(keys, x), len(keys) - 1)] == x


def _scan(docs: DataFrame, index: Index, text: str) -> DataFrame:
    """``docs`` with ``_words``, ``_hit`` (places of hit words) and ``_items``."""
    shared, columns = docs.sparkSession.sparkContext.broadcast(index), docs.columns
    at = columns.index(text)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            words, places, items = [], [], []
            for part in slices(batch.select([at]), text):
                w = Words(part.column(0), WORD_BYTE, lower=True)
                words += w.count.tolist()
                rise, pairs = np.zeros(len(w.hash) + 1, np.int64), [np.zeros((0, 2), np.int64)]
                for begin, item, n in index.hits(w):
                    np.add.at(rise, begin, 1)
                    np.add.at(rise, begin + n, -1)
                    pairs.append(np.unique(np.stack([w.row[begin], item], 1), axis=0))
                hit = np.flatnonzero(np.cumsum(rise)[:-1] > 0)
                for p in np.split(hit - w.first[w.row[hit]], np.cumsum(np.bincount(w.row[hit], minlength=w.n))[:-1]):
                    places.append(p.astype(np.int32))
                found = [set() for _ in range(w.n)]
                for r, i in np.concatenate(pairs).tolist():
                    if index.ids[i] is not None:
                        found[r].add(index.ids[i])
                items += [sorted(x) for x in found]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(words, pa.int64()), pa.array(places, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))],
                [*columns, "_words", "_hit", "_items"],
            )

    more = [("_words", T.LongType()), ("_hit", T.ArrayType(T.IntegerType())), ("_items", T.ArrayType(T.StringType()))]
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, t) for n, t in more]])
    return docs.mapInArrow(find, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
                  share: int = 20, index_words: int = INDEX_WORDS) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``hit_items`` (item ids as sorted strings) and ``contaminated``.

    Items and documents are lower-cased (A-Z) and cut into words of ASCII letters, digits and any other non-ASCII
    bytes. The fingerprint of 13 words is the least hash of their 7-grams, so a shared span of 13 words always shares
    one; where a document's fingerprint is in the index, every window it stands for is compared whole, which extends the
    hit. Items below 13 words are looked up whole. A document is contaminated if a twentieth (``share``) of its words
    are hit. The index goes to every task only while the benchmark's distinct items have ``index_words`` words at most, of 16 bytes
    on average; a larger one is taken in blocks of that size, one pass over the documents each, and the blocks' hits are put together. Null and
    empty texts have no words; repeated items and null ids count as hits, null ids are not listed; an empty
    benchmark contaminates nothing. Columns called like an added one are replaced.
    """
    names, users = aside(docs, ["n_words", "n_hit", "hit_items", "contaminated"])
    docs, text = docs.select(*users), aside_name(names, text)
    items = benchmark.select(col(item_id).cast("string").alias("id"), col(item_text).alias("text"))
    lengths = F.regexp_count(F.translate("text", ASCII_UPPER, ASCII_LOWER), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"))
    items = items.where(lengths > 0).distinct()
    words, size = items.agg(F.sum(lengths), F.sum(F.octet_length("text"))).first()
    blocks = max(-(-(words or 0) // index_words), -(-(size or 0) // (WORD_BYTES * index_words)), 1)
    if blocks == 1:
        out = _scan(docs, Index([tuple(r) for r in items.collect()]), text)  # index_words words of WORD_BYTES bytes at most
    else:
        out = _in_blocks(docs, items, text, blocks)
    hit = F.size("_hit").cast("long")
    return out.select(
        *back(names), F.col("_words").alias("n_words"), hit.alias("n_hit"), F.array_sort("_items").alias("hit_items"),
        ((hit > 0) & (F.lit(share) * hit >= F.col("_words"))).alias("contaminated"),
    )


def _in_blocks(docs: DataFrame, items: DataFrame, text: str, blocks: int) -> DataFrame:
    """The same for a benchmark beyond one index: rows with hits are put together by a digest of their text."""
    digest = F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")), 256)
    place = F.pmod(F.xxhash64("id", "text"), F.lit(blocks))
    some, found = docs.select(F.col(f"`{text}`").alias("text"), digest.alias("_key")), None
    for b in range(blocks):
        part = _scan(some, Index([tuple(r) for r in items.where(place == b).collect()]), "text")
        part = stored(part.where(F.size("_hit") > 0).select("_key", "_hit", "_items").dropDuplicates(["_key"]))
        found = part if found is None else found.union(part)
    found = found.groupBy("_key").agg(
        F.array_distinct(F.flatten(F.collect_list("_hit"))).alias("_hit"), F.array_distinct(F.flatten(F.collect_list("_items"))).alias("_items")
    )
    plain = _scan(docs, Index([]), text).drop("_hit", "_items").withColumn("_k", digest)
    empty = lambda c, t: F.coalesce(F.col(c), F.array().cast(f"array<{t}>")).alias(c)
    return plain.join(found, F.col("_k") == F.col("_key"), "left").select(*docs.columns, "_words", empty("_hit", "int"), empty("_items", "string"))


SQL = r"""
WITH item AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS key
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM item WHERE len(w) > 0)),
doc AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
spot AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, (SELECT DISTINCT n FROM win) WHERE len(w) >= n),
hit AS (SELECT doc_id, item_id, i, win.n FROM spot JOIN win ON win.n = spot.n AND win.key = array_to_string(spot.w[i : i + spot.n - 1], ' ')),
place AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hit),
a AS (SELECT doc_id, count(*) AS n_hit FROM place GROUP BY doc_id),
b AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT doc_id, cast(item_id AS varchar) AS s FROM hit) GROUP BY doc_id)
SELECT doc_id, cast(len(w) AS bigint) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id)
"""


@query("op7_decontamination", SQL)
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate(docs, read(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("hit_items", ","), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")
