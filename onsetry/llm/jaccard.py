"""Exact Jaccard join of word shingle sets with set-relation skipping (operator 4)."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from onsetry.llm.common import NOT_SPACE, Words, bounded, components, gram_hash, mix64, slices, stored
from onsetry.llm.registry import query, read

#: An element in the heads of so many different sets is common and comes last in the order of elements.
COMMON = 16
SHINGLE, THRESHOLD = 5, Fraction(4, 5)
SENT_ROWS = 1_000_000  # ids or pairs that may be sent to every task


def shingles(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle hash) sorted by text and hash, each pair once, and the number of shingles of each text.

    Texts of fewer words give their whole sequence as one shingle; texts without words give none.
    """
    w = Words(texts, NOT_SPACE, lower=True)
    h, ok = w.grams(width)
    row, value = w.row[: len(h)][ok], h[ok]
    short = np.flatnonzero((w.count > 0) & (w.count < width))
    whole = np.zeros(len(short), np.uint64)
    for n in set(w.count[short].tolist()):
        same = w.count[short] == n
        whole[same] = gram_hash(w.hash, n)[w.first[short[same]]]
    row, value = np.concatenate([row, short]), np.concatenate([value, whole])
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    row, value = row[new], value[new]
    return row, value, np.bincount(row, minlength=w.n).astype(np.int64)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def allowance(n: np.ndarray, t: Fraction) -> np.ndarray:
    """How many of its own elements a set of ``n`` may miss in a partner: n - ceil(t n)."""
    return n - -(-n * t.numerator // t.denominator)


def spare(n: np.ndarray, t: Fraction) -> np.ndarray:
    """By how many elements a head is longer than the allowance."""
    return np.maximum(allowance(n, t) // 2, 1)


def index_lists(docs: DataFrame, width: int, t: Fraction) -> DataFrame:
    """(token, id, f, n, pos): the head of every set in hash order, half as long again as a prefix filter needs.

    Two linked sets miss ``allowance`` elements of each other at most; of heads longer by ``spare`` elements they share
    ``spare`` or more. So a set with fewer shared elements in its head than its least partner's ``spare`` has none.
    """

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                row, value, n = shingles(part.column("text"), width)
                f = np.zeros(len(n), np.uint64)
                np.add.at(f, row, mix64(value))
                pos = np.arange(len(row)) - (np.cumsum(n) - n)[row]
                keep = pos < (allowance(n, t) + spare(n, t))[row]
                row, value, pos = row[keep], value[keep], pos[keep]
                ids = np.asarray(part.column("id"))
                columns = [_signed(value), pa.array(ids[row]), _signed(f[row]), pa.array(n[row].astype(np.int32)), pa.array(pos.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["token", "id", "f", "n", "pos"])

    return docs.mapInArrow(heads, "token long, id long, f long, n int, pos int")


SKETCH_WORDS = 16  # 64-bit words of a parity sketch
FOLDED = 8  # words of one that is folded, which is a sketch with fewer classes
BEFORE = 8  # elements before it that an entry of an open list carries along


def parity_sketch(row: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """A bit for each of 1,024 classes of elements: whether the set holds an odd number of them.

    Sketches of two sets differ in no more bits than the sets differ in elements.
    """
    h = mix64(value + np.uint64(0x2545F4914F6CDD1D))
    out = np.zeros((n, SKETCH_WORDS), np.uint64)
    np.bitwise_xor.at(out, (row, (h & np.uint64(SKETCH_WORDS - 1)).astype(np.int64)), np.uint64(1) << (h >> np.uint64(58)))
    return out


def set_digests(docs: DataFrame, width: int) -> DataFrame:
    """(id, n, fa, fb, sketch): set size, 128 bits that equal sets share, and the parity sketch."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                row, value, n = shingles(part.column("text"), width)
                fa, fb = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
                np.add.at(fa, row, mix64(value))
                np.add.at(fb, row, mix64(value ^ np.uint64(0x5851F42D4C957F2D)))
                sketch = _signed(parity_sketch(row, value, len(n)).ravel())
                fixed = pa.array(np.arange(len(n) + 1, dtype=np.int32) * SKETCH_WORDS)
                columns = [part.column("id"), pa.array(n), _signed(fa), _signed(fb), pa.ListArray.from_arrays(fixed, sketch)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n", "fa", "fb", "sketch"])

    return docs.mapInArrow(digest, "id long, n long, fa long, fb long, sketch array<long>")


def sets_of(docs: DataFrame, width: int) -> DataFrame:
    """(id, n, tokens): the whole shingle set."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                row, value, n = shingles(part.column("text"), width)
                ends = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n), pa.ListArray.from_arrays(ends, _signed(value))], ["id", "n", "tokens"])

    return docs.mapInArrow(collect, "id long, n long, tokens array<long>")


def _alike(t: Fraction, a: str = "sa", b: str = "sb") -> str:
    """Sketches ``a`` and ``b`` of sets of ``na`` and ``nb`` elements do not rule the threshold out."""
    bits = f"aggregate(zip_with({a}, {b}, (x, y) -> bit_count(x ^ y)), 0, (x, y) -> x + y)"
    return f"coalesce({bits} * {t.denominator + t.numerator} <= (na + nb) * {t.denominator - t.numerator}, true)"


def _texts(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """The sets of the documents that ``ids`` names; several rows may carry one id."""
    chosen = docs.join(bounded(ids, SENT_ROWS), "id", "left_semi")
    return stored(sets_of(chosen, width).where("n > 0").dropDuplicates(["id", "n", "tokens"]))


def _linked(pairs: DataFrame, docs: DataFrame, about: DataFrame, width: int, t: Fraction) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the threshold; only sets that pairs with near sketches name are made."""
    brief = lambda x: about.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    pairs = stored(pairs.join(brief("a"), "a").join(brief("b"), "b").where(_alike(t)).select("a", "b").distinct())
    sets = _texts(docs, pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), width)
    one = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    two = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    both = one.join(bounded(pairs, SENT_ROWS), "a").join(two, "b").withColumn("o", F.size(F.array_intersect("ta", "tb")).cast("long"))
    return both.where(f"o * {t.denominator} >= (na + nb - o) * {t.numerator}").select("a", "b")


def prefixes(docs: DataFrame, width: int, t: Fraction) -> DataFrame:
    """(token, id, n, pos): elements that different sets share, by the prefixes of the sets that may have a partner.

    The order of elements is: common ones (``COMMON``) last, then by hash. One shuffle brings the heads together by
    element; elements of one set alone, and all but one of several copies, end there. The other prefixes follow from
    the same heads: they are half as long again as needed, so leaving out the common elements mostly leaves a whole
    prefix. The few sets for which it does not are cut into elements once more.
    """
    heads = index_lists(docs.where("id is not null"), width, t)
    by = Window.partitionBy("token")
    heads = heads.withColumns({"set": F.dense_rank().over(by.orderBy("f")), "copy": F.row_number().over(Window.partitionBy("token", "f").orderBy("id"))})
    shared = heads.where("copy = 1").withColumn("df", F.max("set").over(by)).where("df > 1")
    shared = stored(shared.select("token", "id", "f", "n", "pos", (F.col("df") >= COMMON).alias("common")))

    def misses(n: str) -> Column:  # ``allowance``
        return F.expr(f"{n} + cast(floor(-{n} * {t.numerator} / {t.denominator}) as int)")

    def half(x: Column) -> Column:  # ``spare``
        return F.greatest(F.floor(x / 2).cast("int"), F.lit(1))

    shared = shared.withColumns({"allowed": misses("n"), "least": (F.col("n") - misses("n")).cast("int")}).withColumn("need", half(misses("least")))
    counts = shared.groupBy("id", "f").agg(
        F.count("*").alias("c"), F.first("need").alias("need"), F.sum(F.col("common").cast("int")).alias("commons"), F.first("allowed").alias("allowed")
    ).where("c >= need")
    alive = stored(counts.select("id", "f", (F.col("commons") < half(F.col("allowed"))).alias("whole")))
    rows = shared.join(alive, ["id", "f"])
    before = F.sum(F.col("common").cast("int")).over(Window.partitionBy("id", "f").orderBy("pos"))
    short = rows.where("whole").withColumn("pos", F.col("pos") - before).where("not common and pos <= allowed").select("token", "id", "n", "pos")

    again = _texts(docs, alive.where("not whole").select("id").distinct(), width)
    common = shared.where("common").select("token").distinct()
    tokens = again.select("id", F.col("n").cast("int").alias("n"), F.posexplode("tokens").alias("place", "token"))
    tokens = tokens.join(common.withColumn("common", F.lit(True)), "token", "left").withColumn("common", F.coalesce("common", F.lit(False)))
    # the order within a set: not common ones first, each kind by hash, which is the order of the array
    number = F.row_number().over(Window.partitionBy("id", "n").orderBy("common", "place")) - 1
    long = tokens.withColumn("pos", number).where(F.col("pos") <= misses("n")).select("token", "id", "n", "pos")
    return stored(short.union(long).select("token", "id", F.col("n").cast("long").alias("n"), F.col("pos").cast("long").alias("pos")))


def with_elements_before(entries: DataFrame) -> DataFrame:
    """``entries`` (token, id, n, pos, ...) with ``before``: up to ``BEFORE`` elements that precede each in its set."""
    w = Window.partitionBy("id", "n").orderBy("pos", "token").rowsBetween(-BEFORE, -1)
    return entries.withColumn("before", F.collect_list("token").over(w))


def met_in_lists(entries: DataFrame, near: str) -> DataFrame:
    """(a, b): pairs of one list and different components for which ``near`` holds.

    Sets that share an element share most of those around it. A pair that already meets at an element which both
    entries carry in ``before`` is passed over: the sizes are the same there and the positions smaller, so ``near``
    holds there too, and the pair is never passed over at the first element it shares.
    """
    side = lambda x: entries.select("token", F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("pos").alias(f"p{x}"), F.col("comp").alias(f"c{x}"), F.col("before").alias(f"e{x}"), F.col("sketch").alias(f"s{x}"))
    return side("a").join(side("b"), "token").where(f"a > b and ca <> cb and not arrays_overlap(ea, eb) and {near}").select("a", "b")


def similar_sets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE, threshold: Fraction = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, component_id): exact Jaccard links of distinct ``width``-word shingles, as components.

    A-Z is lower-cased, words end at ASCII white space. Two texts link from ``threshold`` on; shorter texts are one
    shingle, texts without words (or null) are empty, link with nothing and keep their own id. Rows of equal sets are
    one class from the start, so thousands of copies cost no pair.

    1. Skipping sets: index lists over the head of each set in hash order; a set that shares too few head elements
       with other sets cannot have a partner and drops out.
    2. Skipping in the lists: the lists hold the prefixes of the sets left, common elements last (``prefixes``), and
       entries are passed over by size and by position.
    3. Answers from similar sets: in each list the most central set (least far down in its own order) is verified
       first. Sets tied by these links share an answer; only pairs from different components are verified then, so
       no link between components is lost and none inside is looked for. Parity sketches, which never differ in more
       bits than the sets do in elements, rule out most of the others.

    Ids must be integers; rows without one are left out of the links and come back with a null component. Rows of one
    id are one document with several texts. No rows give no rows.
    """
    lean = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    members = stored(set_digests(lean, width))
    usable = members.where("n > 0 and id is not null")
    classes = usable.groupBy("n", "fa", "fb").agg(F.min("id").alias("rep"))

    prefix = prefixes(lean, width, threshold)
    about = usable.groupBy("id").agg(F.count_distinct("n", "fa", "fb").alias("c"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    # an id with several texts has no sketch of its own
    about = about.select("id", *[F.when(F.col("c") == 1, F.col(x)).alias(x) for x in ("n", "sketch")])

    num, den = threshold.numerator, threshold.denominator
    near = f"na * {den} >= nb * {num} and nb * {den} >= na * {num} and (pa + pb) * {den + num} <= (na + nb) * {den - num}"
    least = prefix.groupBy("token").agg(F.min(F.struct("pos", "id", "n")).alias("l"), F.count("*").alias("c")).where("c > 1")
    star = prefix.join(least, "token").select(
        F.col("id").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("l.id").alias("b"), F.col("l.n").alias("nb"), F.col("l.pos").alias("pb")
    )
    tried = stored(star.where("a <> b").where(near).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    links = stored(_linked(tried, lean, about, width, threshold))
    groups = components(links)

    marked = prefix.join(groups.withColumnRenamed("id", "g"), F.col("id") == F.col("g"), "left").select(
        "token", "id", "n", "pos", F.coalesce("component", "id").alias("comp")
    )
    open_lists = marked.groupBy("token").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 < c1").select("token")
    folded = F.expr(f"transform(sequence(0, {FOLDED - 1}), i -> aggregate(sequence(i, {SKETCH_WORDS - 1}, {FOLDED}), 0L, (x, j) -> x ^ sketch[j]))")
    marked = with_elements_before(marked.join(open_lists, "token"))
    marked = stored(marked.join(about.select("id", F.when(F.col("sketch").isNotNull(), folded).alias("sketch")), "id"))
    # the lists carry half of each sketch; ``_linked`` compares the whole ones of the pairs left
    first = met_in_lists(marked, f"{near} and {_alike(threshold)}")
    rest = stored(first.distinct().join(tried, ["a", "b"], "left_anti"))
    more = stored(_linked(rest, lean, about, width, threshold))

    answers = components(links.union(more))
    own = usable.join(classes, ["n", "fa", "fb"]).select("id", "rep")
    own = own.join(answers.select(F.col("id").alias("rep"), "component"), "rep", "left")
    ids = own.groupBy("id").agg(F.min(F.coalesce("component", "rep")).alias("component"))
    out = members.join(ids, "id", "left")
    return out.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + least(len(w), 3) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 3) + 2)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * o >= 90 * (p.n + q.n - o)),
r AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT r.x AS doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r.y) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.x GROUP BY r.x
"""


@query("op4_jaccard_join", SQL)
def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_sets(read(spark, sf_dir, "documents"), width=3, threshold=Fraction(9, 10))
