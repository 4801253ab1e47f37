"""Substring dedup by relative Lempel-Ziv factors over a distributed phrase index (operator 1)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from onsetry.llm.common import Words, aside, aside_name, back, mix64, slices, span_hash, stored
from onsetry.llm.registry import query, read

WINDOW = 35
GRAM = 8  # words of an anchor


def phrases(w: Words, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Cut texts at anchors: (row, first window, windows, anchor hash, context hash, times) of every phrase.

    The anchor of a window is its ``gram`` words with the least hash (the last such place). Windows that follow one
    another with the same anchor are one phrase; its context is all the words of these windows. Equal windows
    have equal anchors, so a window can recur only in phrases of the same anchor; in phrases with the same context,
    every window recurs. In periodic text each window is a phrase and all are alike: equal phrases in a row are one,
    ``times`` repeated.
    """
    g, _ = w.grams(gram)
    n, width = len(w.hash) - window + 1, window - gram + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), none
    value, place, have = g, np.arange(len(g)), 1
    while have < width:
        step = min(have, width - have)
        right = value[step:] <= value[:-step]
        value, place = np.where(right, value[step:], value[:-step]), np.where(right, place[step:], place[:-step])
        have += step
    at = np.flatnonzero(w.row[:n] == w.row[window - 1 :])
    place = place[:n][at]
    new = np.ones(len(at), bool)
    new[1:] = (place[1:] != place[:-1]) | (w.row[at[1:]] != w.row[at[:-1]])
    first = np.flatnonzero(new)
    many = np.diff(np.append(first, len(at)))
    start, anchor = at[first], place[first]
    context = mix64(span_hash(w.hash, start, start + many + window - 1) + (anchor - start).astype(np.uint64))
    row, h = w.row[start], g[anchor]
    new = np.ones(len(start), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1]) | (context[1:] != context[:-1])
    first = np.flatnonzero(new)
    many = np.add.reduceat(many, first) if len(first) else many
    return row[first], start[first], many, h[first], context[first], np.diff(np.append(first, len(new)))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def phrase_index(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(h, c, id, k, lo, m, r): anchor, context, document, first window, number of windows and repetitions of every phrase."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                w = Words(part.column("text"))
                row, start, many, h, c, times = phrases(w, window, gram)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [_signed(h), _signed(c), part.column("id").take(take), part.column("k").take(take),
                     pa.array((start - w.first[row]).astype(np.int32)), pa.array(many.astype(np.int32)), pa.array(times.astype(np.int32))],
                    ["h", "c", "id", "k", "lo", "m", "r"],
                )

    return docs.mapInArrow(cut, "h long, c long, id long, k long, lo int, m int, r int")


def phrase_windows(docs: DataFrame, window: int) -> DataFrame:
    """(h, w, single, id, k, at): hash and place of each window of the phrases listed in ``asked``."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                w = Words(part.column("text"))
                grams, _ = w.grams(window)
                asked = part.column("asked")
                row = np.repeat(np.arange(len(part)), np.asarray(asked.value_lengths()))
                lo, m, h, single = (np.asarray(asked.flatten().field(f)) for f in ("lo", "m", "h", "single"))
                which = np.repeat(np.arange(len(row)), m)
                at = lo[which] + np.arange(len(which)) - np.repeat(np.cumsum(m) - m, m)
                take = pa.array(row[which])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[which]), _signed(grams[w.first[row[which]] + at]), pa.array(single[which]),
                     part.column("id").take(take), part.column("k").take(take), pa.array(at.astype(np.int32))],
                    ["h", "w", "single", "id", "k", "at"],
                )

    return docs.mapInArrow(expand, "h long, w long, single boolean, id long, k long, at int")


def remove_spans(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``kept``: words outside ``_spans`` (first, end), joined by one space."""
    columns = [c for c in docs.columns if c != "_spans"]
    place = docs.columns.index(text)

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, kept = [], [], []
            for part in slices(batch.select([place, docs_spans]), text):
                w = Words(part.column(0), hashed=False)
                spans = part.column(1)
                row = np.repeat(np.arange(len(part)), np.asarray(spans.value_lengths().fill_null(0)))
                lo, hi = (np.asarray(spans.flatten().field(f)).astype(np.int64) for f in ("lo", "hi"))
                rise = np.zeros(len(w.row) + 1, np.int64)
                np.add.at(rise, w.first[row] + lo, 1)
                np.add.at(rise, w.first[row] + hi, -1)
                gone = np.cumsum(rise)[:-1] > 0
                total.append(w.count)
                removed.append(np.bincount(w.row[gone], minlength=w.n))
                data = w.data.tobytes()
                for i in range(w.n):
                    a, b = w.first[i], w.first[i + 1]
                    left = np.flatnonzero(~gone[a:b]) + a
                    kept.append(b" ".join([data[s:e] for s, e in zip(w.start[left].tolist(), w.end[left].tolist())]).decode())
            none = [np.zeros(0, np.int64)]
            counts = [pa.array(np.concatenate(none + x).astype(np.int64)) for x in (total, removed)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in columns], *counts, pa.array(kept, pa.string())], [*columns, "n_words", "n_removed", "kept"]
            )

    docs_spans = docs.columns.index("_spans")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "_spans")
    return docs.mapInArrow(drop, f"{fields}, n_words long, n_removed long, kept string")


def drop_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``kept``: without the words of any repeated run of ``window`` words.

    Every document is parsed relative to all documents. The reference is indexed by phrases, cut at anchors that the
    words themselves choose, so that equal stretches are cut alike wherever they stand. Phrases found again with
    all their words chain up to long factors. At the ends of factors, where a phrase recurs in part only, the windows
    of one phrase for each context are compared one by one; what recurs extends the factor to its true end. The
    result is exact: a word goes if and only if it lies in ``window`` consecutive words that also start elsewhere,
    in the same document or another.

    Every index lookup is a join on 64-bit anchors, then on 128 bits (anchor and context, anchor and window); counts
    are combined before the shuffle, so a passage or copy that a third of all documents hold is counted by part. Words
    end at ASCII white space. Null and empty texts have no words; shorter texts lose nothing; repeated rows are repeats
    of each other; ids may have any type. A row is known by id and 64 bits of its text, without an integer id by 128 bits
    of its text, so equal or null ids do no harm. No rows give no rows. Columns called
    like an added one are replaced.
    """
    names, users = aside(docs, ["n_words", "n_removed", "kept"])
    docs, doc_id, text = docs.select(*users), aside_name(names, doc_id), aside_name(names, text)
    whole_number = isinstance(docs.schema[doc_id].dataType, T.IntegralType)
    id_ = F.coalesce(F.col(doc_id).cast("long") if whole_number else F.lit(None), F.xxhash64(text))
    k = F.xxhash64(F.lit("text"), text)
    lean = docs.select(id_.alias("id"), k.alias("k"), F.col(text).alias("text"))
    index = phrase_index(lean, window, gram)
    # stored first: a join of two plain shuffles is one that AQE can split where an anchor is common
    twice = stored(index.groupBy("h").agg(F.sum("r").alias("n")).where("n > 1").select("h"))
    shared = stored(index.join(twice, "h"))
    classes = stored(shared.groupBy("h", "c").agg(F.sum("r").alias("n"), F.min(F.struct("id", "k", "lo", "m")).alias("r")))
    whole = shared.join(classes.where("n > 1").select("h", "c"), ["h", "c"]).select("id", "k", "lo", (F.col("lo") + F.col("m") + window - 1).alias("hi"))

    several = classes.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1").select("h")
    ends = classes.join(several, "h").select("r.id", "r.k", F.struct("r.lo", "r.m", "h", (F.col("n") == 1).alias("single")).alias("p"))
    asked = ends.groupBy("id", "k").agg(F.collect_list("p").alias("asked"))
    windows = stored(phrase_windows(lean.join(asked, ["id", "k"]), window))
    place = F.struct("id", "k", "at")  # repeated rows give one place twice; their phrases recur whole anyway
    again = windows.groupBy("h", "w").agg(F.min(place).alias("one"), F.max(place).alias("two")).where("one <> two").select("h", "w")
    part = windows.where("single").join(again, ["h", "w"]).select("id", "k", F.col("at").alias("lo"), (F.col("at") + window).alias("hi"))

    spans = whole.union(part).groupBy("id", "k").agg(F.collect_list(F.struct("lo", "hi")).alias("_spans"))
    spans = spans.select(F.col("id").alias("_id"), F.col("k").alias("_k"), "_spans")
    out = remove_spans(docs.join(spans, (id_ == F.col("_id")) & (k == F.col("_k")), "left").drop("_id", "_k"), text)
    return out.select(*back(names), "n_words", "n_removed", "kept")


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM w WHERE len(w) >= 35),
g AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 34], ' ')) AS g FROM i),
r AS (SELECT doc_id, i FROM g WHERE g IN (SELECT g FROM g GROUP BY g HAVING count(*) > 1)),
d AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + 35)) AS p FROM r) GROUP BY doc_id),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM w),
x AS (SELECT doc_id, p FROM p EXCEPT SELECT doc_id, unnest(ps) FROM d),
k AS (SELECT doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY p) AS kept FROM p JOIN x USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, cast(len(w.w) AS bigint) AS n_words, cast(len(w.w) - coalesce(n_kept, 0) AS bigint) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""


@query("op1_substring_dedup", SQL)
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
