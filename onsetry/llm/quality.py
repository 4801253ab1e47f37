"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k (operator 3)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from onsetry.llm.common import Words, aside, aside_name, back, col, hash60, mix64, slices, stored
from onsetry.llm.mixing import thresholds
from onsetry.llm.registry import query, read

CHAR_GRAM = 4
CHAR_BUCKETS = 1 << 16
REACH = 8  # a word's repetition symbol: how many words ago it stood last, 0 if not within REACH
WORD_BUCKETS = (REACH + 1) ** 2
BUCKETS = CHAR_BUCKETS + WORD_BUCKETS
MAX_LABELLED = 20_000  # rows of labels, by hash of the id, that the target model and the threshold are fitted on
EVIDENCE = 40.0  # n-grams that a document's mean log ratio counts for against the Gumbel noise
KEY_RANGE = 1e6


def features(texts: pa.Array) -> tuple[int, list[tuple[np.ndarray, np.ndarray]]]:
    """For each n-gram family (text, bucket) of every n-gram: 4-grams of UTF-8 bytes, bigrams of repetition symbols."""
    w = Words(texts)
    data, out = w.data.astype(np.uint64), []
    n = len(data) - CHAR_GRAM + 1
    if n > 0:
        gram = sum((data[i : n + i] << np.uint64(8 * i) for i in range(1, CHAR_GRAM)), data[:n].copy())
        row = np.repeat(np.arange(w.n), np.diff(w.offsets))[:n]
        ok = np.arange(CHAR_GRAM, n + CHAR_GRAM) <= w.offsets[row + 1]
        out.append((row[ok], (mix64(gram[ok]) & np.uint64(CHAR_BUCKETS - 1)).astype(np.int64)))
    symbol = np.zeros(len(w.hash), np.int64)
    for ago in range(min(REACH, len(symbol) - 1), 0, -1):
        same = (w.hash[ago:] == w.hash[:-ago]) & (w.row[ago:] == w.row[:-ago])
        symbol[ago:][same] = ago
    ok = w.row[:-1] == w.row[1:]
    out.append((w.row[:-1][ok], CHAR_BUCKETS + (symbol[:-1] * (REACH + 1) + symbol[1:])[ok]))
    return w.n, out


def count_ngrams(docs: DataFrame, text: str, target: str) -> DataFrame:
    """(bucket, raw, target): n-gram counts over all rows, and over those where ``target`` is true."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in slices(batch):
                mark = np.asarray(part.column("target").fill_null(False))
                for row, bucket in features(part.column("text"))[1]:
                    raw += np.bincount(bucket, minlength=BUCKETS)
                    good += np.bincount(bucket[mark[row]], minlength=BUCKETS)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(good[at])], ["bucket", "raw", "target"])

    lean = docs.select(F.col(f"`{text}`").alias("text"), F.col(f"`{target}`").alias("target"))
    return lean.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(
        F.sum("raw").alias("raw"), F.sum("target").alias("target")
    )


def log_ratios(counts: DataFrame) -> np.ndarray:
    """log p(target) - log p(raw) by bucket, each family normalised by itself; the table has BUCKETS rows at most."""
    raw, good = np.full(BUCKETS, 0.5), np.full(BUCKETS, 0.5)
    for r in counts.collect():
        raw[r["bucket"]] += r["raw"]
        good[r["bucket"]] += r["target"]
    out = np.zeros(BUCKETS)
    for part in (slice(0, CHAR_BUCKETS), slice(CHAR_BUCKETS, BUCKETS)):
        out[part] = np.log(good[part] / good[part].sum()) - np.log(raw[part] / raw[part].sum())
    return out


def with_score(docs: DataFrame, model: np.ndarray, text: str = "text", name: str = "log_ratio") -> DataFrame:
    """``docs`` with the document's mean log ratio per n-gram, added up over the families; 0 without n-grams."""
    ratios = docs.sparkSession.sparkContext.broadcast(model)
    columns = [c for c in docs.columns if c != name]
    docs = docs.select(*[F.col(f"`{c}`") for c in columns])
    at = columns.index(text)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [np.zeros(0)]
            for part in slices(batch.select([at]), text):
                n, families = features(part.column(0))
                total = np.zeros(n)
                for row, bucket in families:
                    total += np.bincount(row, ratios.value[bucket], minlength=n) / np.maximum(np.bincount(row, minlength=n), 1)
                scores.append(total)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores))], [*columns, name])

    return docs.mapInArrow(score, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def gumbel(key: list[Column | str], seed: int) -> Column:
    """Standard Gumbel noise that a row's key and the seed decide."""
    u = (hash60(*key, seed=seed).cast("double") + 0.5) / float(1 << 60)
    return -F.log(-F.log(u))


def split_point(scores: np.ndarray, good: np.ndarray) -> float:
    """The threshold with the best balanced accuracy, in the middle of its gap; minus infinity without both classes."""
    if good.all() or not good.any():
        return float("-inf")
    order = np.argsort(scores, kind="stable")
    s, g = scores[order], good[order]
    rate = np.concatenate([[0], np.cumsum(~g)]) / (~g).sum() + 1 - np.concatenate([[0], np.cumsum(g)]) / g.sum()
    ok = np.concatenate([[True], s[1:] > s[:-1], [True]])  # between different scores only
    i = int(np.argmax(np.where(ok, rate, -1)))
    return float(s[0] - 1 if i == 0 else s[-1] + 1 if i == len(s) else (s[i - 1] + s[i]) / 2)


def resample(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
             max_labelled: int = MAX_LABELLED, seed: int = 0) -> DataFrame:
    """``docs`` with ``log_ratio``, ``gumbel_key`` and ``kept``: importance resampling towards the well-labelled rows.

    The raw model counts the n-grams of all documents, the target model those of documents labelled 1. The bounded
    sample of labels (``max_labelled`` rows by hash of the id, a documented limit of the fit) also gives the score
    that parts good from bad best; k is the number of documents, out of all, that reach it. Kept are the k largest of
    ``EVIDENCE`` x score + Gumbel noise, found by nested histograms, not by sorting. Null and empty texts score
    0 by definition; null labels and ids are no labels; an id with several labels is good if all are; without labels of
    both kinds everything is kept; rows with equal keys stay or go together. Columns called like an added one are
    replaced.
    """
    names, users = aside(docs, ["log_ratio", "gumbel_key", "kept"])
    known = labels.select(col(doc_id).alias("_id"), col(label).alias("_label")).where("_id is not null and _label is not null")
    docs, doc_id, text = docs.select(*users), aside_name(names, doc_id), aside_name(names, text)
    sample = known.groupBy("_id").agg((F.min("_label") >= 1).alias("_good"))
    sample = stored(sample.orderBy(hash60("_id", seed=seed), "_id").limit(max_labelled))
    few = F.broadcast(sample)  # max_labelled rows at most
    marked = docs.join(few, F.col(doc_id) == F.col("_id"), "left")
    model = log_ratios(count_ngrams(marked, text, "_good"))
    key = EVIDENCE * F.col("log_ratio") + gumbel([doc_id], seed)
    scored = with_score(docs, model, text).withColumn("gumbel_key", key)
    # ascending: the largest key comes first
    place = F.floor((KEY_RANGE - F.greatest(F.least(F.col("gumbel_key"), F.lit(KEY_RANGE - 1)), F.lit(-KEY_RANGE + 1))) * ((1 << 59) / KEY_RANGE))
    lean = stored(scored.select(F.col(doc_id).alias("_id"), "log_ratio", place.cast("long").alias("hash")))
    fitted = lean.join(few, "_id").select("log_ratio", "_good").collect()  # max_labelled documents
    tau = split_point(np.array([r[0] for r in fitted]), np.array([r[1] for r in fitted], bool))
    k = lean.where(F.col("log_ratio") >= tau).count()
    one = lean.select(F.lit("all").alias("source"), F.lit(1).cast("long").alias("size"), "hash")
    budget = docs.sparkSession.createDataFrame([("all", float(k))], "source string, rest double")
    cut = thresholds(one, budget).first()  # nothing if all are within the budget
    kept = F.lit(True) if cut is None else place < cut["threshold"]
    return scored.select(*back(names), "log_ratio", "gumbel_key", kept.alias("kept"))


@query("op3_quality")
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return resample(docs, read(spark, sf_dir, "labels")).select("doc_id", "log_ratio", "gumbel_key", "kept")
