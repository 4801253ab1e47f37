"""A corpus pipeline: quality, near duplicates, benchmark decontamination, mixing, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from onsetry.llm.common import col, stored
from onsetry.llm.contamination import decontaminate
from onsetry.llm.jaccard import similar_sets
from onsetry.llm.mixing import mix, n_words
from onsetry.llm.quality import resample
from onsetry.llm.registry import reachable
from onsetry.llm.sharding import assign


USED = ("doc_id", "text", "source", "lang")  # columns of documents that stages read


def apart(docs: DataFrame, stage: Callable[[DataFrame], DataFrame], added: tuple = ()) -> DataFrame:
    """``stage(docs)`` with the columns of ``docs``, whatever their names, and the ``added`` ones.

    All but the columns of documents go by private names while the stage runs, so that it neither takes a user's column
    for its own nor replaces one. A column called like an added one gives way to it.
    """
    names = {c: c if c in USED else f"_user_{i}" for i, c in enumerate(docs.columns)}
    out = stage(docs.select(*[col(c).alias(n) for c, n in names.items()]))
    taken = {a.lower() for a in added}
    return out.select(*[F.col(n).alias(c) for c, n in names.items() if c.lower() not in taken], *added)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling towards well-labelled text keeps.

    Rows of one id share its labels; a null text or id is weighed like any other. No rows give no rows.
    """
    labels = reachable(spark).read.parquet(f"{sf_dir}/labels.parquet")
    return apart(docs, lambda d: resample(d, labels).where("kept"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that links tie (five-word shingles, similarity 0.8 or more): that with the smallest id.

    A row is known by its id and text, so rows of one id with different texts are linked like any others, and so are
    rows without an id, which come last in a group. Of rows with the same id and text one stays. Rows without words
    (null, empty or white space alone) belong to no group and all stay. No rows give no rows.
    """
    reachable(spark)

    def stage(d: DataFrame) -> DataFrame:
        keyed = d.withColumn("_key", F.xxhash64(F.lit("text"), "text"))
        groups = similar_sets(keyed.select(F.col("_key").alias("doc_id"), "text")).where("n_shingles > 0")
        groups = stored(groups.select(F.col("doc_id").alias("_key"), F.col("component_id").alias("_group")).distinct())
        rows = keyed.select("doc_id", "_key").join(groups, "_key").groupBy("_group", "doc_id", "_key").agg(F.count("*").alias("_n"))
        best = F.min(F.struct(F.col("doc_id").isNull().alias("_none"), F.col("doc_id").alias("_id"), F.col("_key").alias("_k"), "_n"))
        best = stored(rows.groupBy("_group").agg(best.alias("b")).select("b._id", "b._k", "b._n"))
        kept = keyed.join(best, (F.col("_key") == F.col("_k")) & F.col("doc_id").eqNullSafe(F.col("_id")))
        order = Window.partitionBy("_id", "_k").orderBy(F.xxhash64(*[c for c in d.columns]))
        repeated = kept.where("_n > 1").withColumn("_nth", F.row_number().over(order)).where("_nth = 1")
        wordless = keyed.join(groups.select("_key"), "_key", "left_anti")
        return kept.where("_n = 1").select(*d.columns).union(repeated.select(*d.columns)).union(wordless.select(*d.columns))

    return apart(docs, stage)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items; a null text is not. No rows give no rows."""
    benchmark = reachable(spark).read.parquet(f"{sf_dir}/benchmark.parquet")
    return apart(docs, lambda d: decontaminate(d, benchmark).where("not contaminated"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it (up to three times); not at all beyond the budget.

    A null source is one of the sources; rows without words have no size to take. No rows give no rows.
    """

    def stage(d: DataFrame) -> DataFrame:
        out = mix(d, n_words(F.col("text")), ["doc_id"]).where("copies > 0")
        return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))

    return apart(docs, stage)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with ``shard`` and ``slot``: eight shards, row counts one apart at most. No rows give no rows."""
    text = F.coalesce(F.col("text"), F.lit(""))
    ties = ["doc_id", F.octet_length(text), F.crc32(text.cast("binary"))]
    return apart(docs, lambda d: assign(d, ["doc_id"], 8, ties=ties), ("shard", "slot"))


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each_group),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: Hashed n-gram models and the ring have no counterpart in SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
