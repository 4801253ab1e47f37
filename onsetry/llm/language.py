"""Language identification by averaged hashed subword embeddings (operator 12)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from onsetry.llm.common import BASE, col, fresh, in_arrow, mix64, slices
from onsetry.llm.registry import query, read

BUCKETS = 1 << 15  # hashed subwords share so many embeddings
GRAMS = (2, 3, 4)  # bytes of a subword, the borders of a word included
MAX_LABELLED = 8_000  # bound of the fit: labelled rows, dealt evenly over languages
MAX_SUBWORDS = 400  # bound of the fit: subwords drawn from the whole of a labelled text
DIMS, STEPS, BATCH, RATE, SEED = 16, 1500, 32, 2.0, 12
CALIBRATION_SHARE = 5  # one labelled row in so many is kept out of the fit, for temperature and threshold
TARGET_PRECISION = 0.99  # accepted calibration rows must be right at least so often
UNKNOWN = "und"

_LETTER = np.array([0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)])


def subwords(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each subword of all texts, how many each text has).

    Texts are lower-cased; every run of ASCII bytes that are no letters is one border. A subword is a run of two to
    four bytes with a border at most at either end.
    """
    data = np.frombuffer(b"\x00".join([b"", *((t or "").lower().encode("utf-8", "replace") for t in texts), b""]), np.uint8)
    cut = np.flatnonzero(data == 0)  # a zero byte inside a text cuts like any border, but must not end the text
    if len(cut) != len(texts) + 1:
        return subwords([(t or "").replace("\x00", " ") for t in texts])
    letter = _LETTER[data]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = True
    keep[cut] = True
    place = np.cumsum(keep) - 1
    text = np.where(letter, data, 0)[keep].astype(np.uint64) + np.uint64(1)
    letter = letter[keep]
    starts = place[cut]
    ids, owner = [], []
    for n in GRAMS:
        m = len(text) - n + 1
        if m < 1:
            continue
        h, inner = np.zeros(m, np.uint64), np.ones(m, bool)
        for i in range(n):
            h = h * np.uint64(257) + text[i : i + m]
            if 0 < i < n - 1:
                inner &= letter[i : i + m]
        inner &= letter[:m] | letter[1 : m + 1]
        at = np.flatnonzero(inner)
        ids.append((mix64(h[at] * np.uint64(BASE) + np.uint64(n)) % np.uint64(BUCKETS)).astype(np.int32))
        owner.append(np.searchsorted(starts, at, side="right") - 1)
    ids, owner = np.concatenate([*ids, np.zeros(0, np.int32)]), np.concatenate([*owner, np.zeros(0, np.int64)])
    order = np.argsort(owner, kind="stable")
    return ids[order], np.bincount(owner, minlength=len(texts) + 1)[: len(texts)]


@dataclass(frozen=True)
class Model:
    languages: list[str]
    embeddings: np.ndarray  # buckets x dims
    weights: np.ndarray  # dims x languages
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The mean of the subwords' embeddings through the linear layer; a text without subwords has the bias alone."""
        narrow = len(self.languages) < self.embeddings.shape[1]
        table = self.embeddings @ self.weights if narrow else self.embeddings
        total = np.zeros((len(counts), table.shape[1]))
        some = np.flatnonzero(counts)
        if len(some):
            first = np.concatenate([[0], np.cumsum(counts)])[some]
            for j in range(table.shape[1]):  # column by column: one gather and one sum at a time
                total[some, j] = np.add.reduceat(table[:, j][ids], first)
        mean = total / np.maximum(counts, 1)[:, None]
        return (mean if narrow else mean @ self.weights) + self.bias

    def probabilities(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return softmax(self.logits(ids, counts) / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(bags: list[np.ndarray], target: np.ndarray, languages: list[str]) -> Model:
    """``STEPS`` steps of stochastic gradient descent on the cross-entropy; languages weigh alike, the rate falls to zero."""
    random = np.random.default_rng(SEED)
    embeddings = random.uniform(-1, 1, (BUCKETS, DIMS)) / DIMS
    weights, bias = np.zeros((DIMS, len(languages))), np.zeros(len(languages))
    have = np.bincount(target, minlength=len(languages))
    weight = (len(target) / np.maximum(have * (have > 0).sum(), 1))[target]
    order = np.zeros(0, np.int64)
    for step in range(STEPS):
        while len(order) < BATCH:  # the next pass over the rows
            order = np.concatenate([order, random.permutation(len(bags))])
        rows, order = order[:BATCH], order[BATCH:]
        rate = RATE * (1 - step / STEPS)
        counts = np.array([len(bags[i]) for i in rows])
        ids = np.concatenate([bags[i] for i in rows])
        owner = np.repeat(np.arange(BATCH), counts)
        mean = np.zeros((BATCH, DIMS))
        np.add.at(mean, owner, embeddings[ids])
        mean /= np.maximum(counts, 1)[:, None]
        error = softmax(mean @ weights + bias)
        error[np.arange(BATCH), target[rows]] -= 1
        error *= np.minimum(weight[rows], 10)[:, None] / BATCH
        back = (error @ weights.T) / np.maximum(counts, 1)[:, None]
        weights -= rate * mean.T @ error
        bias -= rate * error.sum(0)
        np.subtract.at(embeddings, ids, rate * BATCH * back[owner])
    return Model(languages, embeddings, weights, bias)


def calibrated(model: Model, bags: list[np.ndarray], target: np.ndarray) -> Model:
    """The temperature of least cross-entropy, and the least score from which accepted rows are right often enough.

    Both are read off rows that the fit has not seen. Without such rows nothing is rejected.
    """
    if not len(bags):
        return model
    logits = model.logits(np.concatenate(bags), np.array([len(b) for b in bags]))
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 61))
    loss = [-np.log(softmax(logits / t)[np.arange(len(bags)), target] + 1e-300).mean() for t in grid]
    t = float(grid[int(np.argmin(loss))])
    p = softmax(logits / t)
    score, right = p.max(1), p.argmax(1) == target
    order = np.argsort(-score, kind="stable")
    precision = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(precision >= TARGET_PRECISION)
    threshold = float(score[order][good[-1]]) if len(good) else float(score.max())
    return Model(model.languages, model.embeddings, model.weights, model.bias, t, threshold)


def spread(ids: np.ndarray, most: int = MAX_SUBWORDS) -> np.ndarray:
    """At most so many of a text's subwords, evenly over the whole text."""
    return ids if len(ids) <= most else ids[(np.arange(most) * len(ids)) // most]


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang") -> Model | None:
    """Model of rows with a text that holds a letter and a label; None without any. The label need not be a string.

    The fit is bounded: ``MAX_LABELLED`` rows, the first of each language before the second of any, in the order of
    the text's digest; of each ``MAX_SUBWORDS`` subwords over its whole length.
    """
    rows = labelled.where(col(text).isNotNull() & col(lang).isNotNull()).select(col(text).alias("text"), col(lang).cast("string").alias("lang"))
    rows = rows.where(has_letter(F.col("text"))).withColumn("key", F.md5("text"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("key"))
    # digests first: texts are fetched for the chosen rows alone
    chosen = rows.select("lang", "key").distinct().withColumn("n", nth).where(F.col("n") <= MAX_LABELLED)
    chosen = F.broadcast(chosen.orderBy("n", "lang").limit(MAX_LABELLED).select("lang", "key"))

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                ids, counts = subwords(part.column("text").to_pylist())
                out = [spread(b) for b in np.split(ids, np.cumsum(counts)[:-1])] if len(counts) else []
                yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("key"), pa.array(out, pa.list_(pa.int32()))], ["lang", "key", "ids"])

    drawn = in_arrow(rows.join(chosen, ["lang", "key"], "left_semi").select("lang", "key", "text"), bags, "lang string, key string, ids array<int>")
    got = drawn.dropDuplicates(["lang", "key"]).toArrow().sort_by([("lang", "ascending"), ("key", "ascending")])
    if not got.num_rows:
        return None
    languages = sorted(set(got["lang"].to_pylist()))
    number = {x: i for i, x in enumerate(languages)}
    target = np.array([number[x] for x in got["lang"].to_pylist()])
    bag = got["ids"].combine_chunks()
    parts = np.split(bag.flatten().to_numpy(), np.cumsum(bag.value_lengths().to_numpy())[:-1])
    aside = np.array([int(k[:8], 16) % CALIBRATION_SHARE == 0 for k in got["key"].to_pylist()])
    if len(set(target[~aside])) < len(languages):
        aside[:] = False  # too few rows to set some apart
    pick = lambda which: [p for p, w in zip(parts, which) if w]
    return calibrated(train(pick(~aside), target[~aside], languages), pick(aside), target[aside])


def has_letter(text: Column) -> Column:
    return text.rlike(r"\p{L}")


def identify(df: DataFrame, model: Model | None, text: str = "text", reject: bool = True) -> DataFrame:
    """``df`` with ``lang_pred``, ``score`` (0 to 1) and ``rejected``.

    Whole texts are read. A null text, one without a letter, or no model gives ``und`` with score 0, rejected. A score
    below the calibrated threshold is rejected: ``und`` as well, or with ``reject`` off the best language all the
    same. Equal scores: first language in code point order. Columns of ``df`` called like an added one are replaced.
    """
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    base = df.drop(*[c for c in df.columns if c.lower() in [f.name for f in added]])
    (text_, letters) = fresh(base, "_text", "_letters")
    work = base.withColumn(text_, col(text).cast("string")).withColumn(letters, F.coalesce(has_letter(F.col(text_)), F.lit(False)))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_):
                known = part.column(letters).to_numpy(zero_copy_only=False) & (model is not None)
                best, score = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows)
                if model is not None:
                    p = model.probabilities(*subwords(part.column(text_).to_pylist()))
                    best, score = p.argmax(1), np.where(known, p.max(1), 0.0)
                rejected = ~known | (score < (model.threshold if model else 1.0))
                shown = known & ~rejected if reject else known
                names = [model.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), shown)]
                columns = [pa.array(names, pa.string()), pa.array(score), pa.array(rejected)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-2], *columns], names=[*part.schema.names[:-2], *[f.name for f in added]])

    return in_arrow(work, predict, T.StructType([*base.schema.fields, *added]))


def held_out(doc_id: Column) -> Column:
    """Rows kept out of every fit; a null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@query("op12_language_id")
def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), model, reject=False).drop("text")
