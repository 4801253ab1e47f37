"""Mix sources to target weights by nested hash thresholds (operator 2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from onsetry.llm.common import aside, back, bounded, col, hash60, hash60_sql, stored
from onsetry.llm.registry import query, read

BITS, LEVELS = 10, 6  # six nested histograms of 1,024 buckets resolve a 60-bit hash
MOST_SOURCES = 100_000  # up to so many rows the table of sources is broadcast
MOST_REPEATS = 3


def n_words(text: Column) -> Column:
    """Words between ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, weights: DataFrame, most: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size) and (source, weight) to ``target``: min(most x size, level x weight), adding up to all sizes.

    That is where handing out by weight and sharing the excess again ends. Sources fill up in the order of
    size / weight, so the level follows from running totals over the table of sources.
    """
    cap = F.lit(most) * F.col("source_size")
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    all_rows = Window.partitionBy()
    s = sizes.join(weights, sizes["source"].eqNullSafe(weights["source"])).select(sizes["*"], "weight")
    s = s.withColumn("_cap", cap).withColumn("_full", F.sum("_cap").over(order)).withColumn("_w", F.sum("weight").over(order))
    s = s.withColumn("_all", F.sum("source_size").over(all_rows)).withColumn("_all_w", F.sum("weight").over(all_rows))
    # the source is full if the level, were it and all before it not full, reaches its cap
    rest, rest_w = F.col("_all") - F.col("_full") + F.col("_cap"), F.col("_all_w") - F.col("_w") + F.col("weight")
    s = s.withColumn("_is_full", rest * F.col("weight") >= F.col("_cap") * rest_w)
    full, full_w = (F.coalesce(F.sum(F.when(F.col("_is_full"), F.col(c))).over(all_rows), F.lit(0)) for c in ("_cap", "weight"))
    level = (F.col("_all") - full).cast("double") * F.col("weight") / (F.col("_all_w") - full_w)
    return s.withColumn("target", F.when(F.col("_is_full"), F.col("_cap").cast("double")).otherwise(level)).select(
        "source", "source_size", "target"
    )


def cyclic_weights(sources: DataFrame, cycle: int = 3) -> DataFrame:
    """Sources in code point order, null last, weigh 1, 2, ..., ``cycle``, repeating."""
    at = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    return sources.select("source", ((at - 1) % cycle + 1).cast("long").alias("weight"))


def thresholds(docs: DataFrame, budget: DataFrame) -> DataFrame:
    """For each source the hash up to which (exclusive) its documents are taken so that their sizes come nearest to ``rest``.

    ``docs`` (source, size, hash), ``budget`` (source, rest). Sizes are summed by source and bucket of the hash's
    leading bits; only the bucket in which the budget ends is cut again by the next bits. At the last level the one
    hash value left is taken if that comes nearer. Documents of one hash (repeated rows) stay together.
    """
    state = budget.select("source", F.col("rest"), F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"))
    inside = docs
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        hist = inside.groupBy("source", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("size"))
        hist = hist.select(F.col("source").alias("_s"), "bucket", F.col("size").alias("mass"))
        joined = state.select("source", "rest", "below").join(hist, F.col("source").eqNullSafe(F.col("_s")))
        run = Window.partitionBy("source").orderBy("bucket")
        joined = joined.withColumn("upto", F.col("below") + F.sum("mass").over(run))
        edge = joined.where("upto > rest").groupBy("source", "rest").agg(
            F.min(F.struct("bucket", (F.col("upto") - F.col("mass")).alias("below"), "mass")).alias("e")
        )
        state = stored(edge.select("source", "rest", F.col("e.bucket").alias("prefix"), F.col("e.below").alias("below"), F.col("e.mass").alias("mass")))
        if level < LEVELS:
            mark = bounded(state.select(F.col("source").alias("_s"), F.col("prefix").alias("_p")), MOST_SOURCES)
            same = inside["source"].eqNullSafe(mark["_s"]) & (F.shiftright(inside["hash"], shift) == mark["_p"])
            inside = inside.join(mark, same, "left_semi")
    nearer = (F.col("rest") - F.col("below")) * 2 >= F.col("mass")
    # a budget that no bucket exceeds takes the whole source
    return state.select("source", (F.col("prefix") + F.when(nearer, 1).otherwise(0)).alias("threshold"))


def mix(docs: DataFrame, size: Column, key: list[Column | str], source: str = "source", weights: DataFrame | None = None,
        seed: int = 0) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``copies`` (how often the mix takes the document).

    A source whose target is r times its size and a rest takes every document r times (three at most) and, once
    more, those whose hash of ``key`` lies below the source's threshold. Nothing is sorted; the same rows give the same
    mix. Null sources are one source, after all others; null or empty texts have size 0 and cost nothing; rows with
    equal keys go together; no rows give no rows. Columns of ``docs`` called like an added one are replaced.
    """
    names, users = aside(docs, ["size", "source_size", "target", "copies"])
    base = docs.select(*users, col(source).alias("source"), size.cast("long").alias("size"), hash60(*key, seed=seed).alias("hash"))
    lean = stored(base.select("source", "size", "hash"))
    sizes = lean.groupBy("source").agg(F.sum("size").alias("source_size"))
    weights = cyclic_weights(sizes.select("source")) if weights is None else weights
    plan = stored(targets(sizes, weights))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    cut = thresholds(lean, plan.where("rest > 0").select("source", "rest"))
    plan = plan.join(cut.withColumnRenamed("source", "_c"), F.col("source").eqNullSafe(F.col("_c")), "left").select(
        F.col("source").alias("_s"), "source_size", "target", "whole", F.coalesce("threshold", F.lit(0)).alias("threshold")
    )
    plan = bounded(stored(plan), MOST_SOURCES)
    out = base.join(plan, F.col("source").eqNullSafe(F.col("_s")))
    copies = F.col("whole") + F.when(F.col("hash") < F.col("threshold"), 1).otherwise(0)
    return out.select(*back(names), "size", "source_size", "target", copies.cast("long").alias("copies"))


SQL = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
             {hash60_sql('doc_id')} AS h FROM documents),
s AS (SELECT source, sum(size) AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM s),
o AS (SELECT *, sum(3 * source_size) OVER a AS full_cap, sum(weight) OVER a AS full_w, sum(source_size) OVER () AS total,
        sum(weight) OVER () AS total_w FROM w WINDOW a AS (ORDER BY source_size / weight, source NULLS LAST)),
f AS (SELECT *, (total - full_cap + 3 * source_size) * weight >= 3 * source_size * (total_w - full_w + weight) AS is_full FROM o),
t AS (SELECT source, source_size, CASE WHEN is_full THEN cast(3 * source_size AS double) ELSE
        cast(total - coalesce(sum(3 * source_size) FILTER (is_full) OVER (), 0) AS double) * weight
        / cast(total_w - coalesce(sum(weight) FILTER (is_full) OVER (), 0) AS double) END AS target FROM f),
g AS (SELECT source, h, sum(size) AS mass FROM d GROUP BY source, h),
c AS (SELECT source, h, mass, sum(mass) OVER (PARTITION BY source ORDER BY h) AS upto FROM g),
k AS (SELECT c.source, c.h, t.source_size, t.target,
        CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS whole, c.mass, c.upto
      FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source),
x AS (SELECT *, target - whole * source_size AS rest FROM k),
y AS (SELECT *, upto <= rest OR (upto - mass <= rest AND (rest - (upto - mass)) * 2 >= mass) AS extra FROM x)
SELECT d.doc_id, cast(d.size AS bigint) AS size, cast(y.source_size AS bigint) AS source_size, y.target,
  cast(d.size * (y.whole + CASE WHEN rest > 0 AND extra THEN 1 ELSE 0 END) AS bigint) AS taken
FROM d JOIN y ON d.source IS NOT DISTINCT FROM y.source AND d.h = y.h
"""


@query("op2_mixing", SQL)
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = mix(docs, n_words(F.col("text")), ["doc_id"])
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
