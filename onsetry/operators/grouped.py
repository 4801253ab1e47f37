"""Ordered and whole-group computations that survive a very large group.

``Window.partitionBy(keys)`` puts one group into one task.  The helpers here
plan the same computation so that a group above ``onsetry.splitRows`` rows is
cut along its own order: a hash sample of the group gives split points, rows
fall into order-preserving buckets, each bucket is one window partition, and
the prefix of the earlier buckets is added back.  The split changes the task
layout only, never a result.  Without such a group the plan is a plain window.

What reaches the driver is bounded by ``MOST``: so many of the largest groups,
and about so many split points and bucket totals for all of them together.  A
group past these holds less than 1/MOST of all rows, a bucket no more than the
split limit or 1/MOST of the rows, whatever the size of the data.

Rows that are grouped for windows are dealt to tasks by their number (``spread``),
since their bytes on the way say little about the memory that sorting them takes.
"""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

SPLIT_ROWS_CONF = "onsetry.splitRows"
SPLIT_ROWS = 2_000_000
TASK_ROWS_CONF = "onsetry.taskRows"
TASK_ROWS = 250_000
MOST = 100_000
SAMPLES_PER_SPLIT = 32


def down(col) -> list[Column]:
    """Order fields for "largest first, nulls last"."""
    c = F.col(col) if isinstance(col, str) else col
    return [c.isNull(), -c]


def _fields(order) -> list[Column]:
    out: list[Column] = []
    for o in order:
        if isinstance(o, list):
            out.extend(o)
        else:
            out.append(F.col(o) if isinstance(o, str) else o)
    return out


def split_rows(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(SPLIT_ROWS_CONF, str(SPLIT_ROWS)))


class Groups(list):
    """The groups too large for one task, and the number of ``rows`` of all groups."""

    rows = 0


def hot_groups(df: DataFrame, keys: list[str]) -> Groups:
    """Keys and row counts of the groups too large for one task (bounded)."""
    limit = split_rows(df)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    rows, large = sizes.agg(F.sum("_n"), F.count_if(F.col("_n") > limit)).first()
    found = Groups(sizes.where(F.col("_n") > limit).orderBy(F.desc("_n")).limit(MOST).collect() if large else [])
    found.rows = rows or 0
    return found


def tasks_for(df: DataFrame, rows: int) -> int:
    """Tasks that leave each about ``onsetry.taskRows`` rows; 0 if one will do."""
    session = df.sparkSession
    n = ceil(rows / int(session.conf.get(TASK_ROWS_CONF, str(TASK_ROWS))))
    return max(n, session.sparkContext.defaultParallelism) if n > 1 else 0


def spread(df: DataFrame, keys: list[str], hot: list) -> DataFrame:
    """Rows of a group together, in so many tasks that none holds many more than ``onsetry.taskRows`` (but for a large group).

    A plain shuffle by key is merged by AQE until a task has so many compressed bytes, which may be millions of narrow rows.
    """
    n = tasks_for(df, getattr(hot, "rows", 0))
    return df.repartition(n, *keys) if n and keys else df


def _same_keys(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_h_{k}")) for k in keys])


def _hot_frame(df: DataFrame, keys: list[str], hot: list) -> DataFrame:
    limit = max(split_rows(df), sum(r["_n"] for r in hot) // MOST)
    schema = T.StructType(
        [T.StructField(f"_h_{k}", df.schema[k].dataType) for k in keys]
        + [T.StructField("_h_n", T.LongType()), T.StructField("_h_parts", T.IntegerType())]
    )
    rows = [
        tuple(r[k] for k in keys) + (r["_n"], max(2, ceil(r["_n"] / limit)))
        for r in hot
    ]
    return df.sparkSession.createDataFrame(rows, schema)


def _pin(df: DataFrame) -> DataFrame:
    """Fix a bounded helper table as a local relation."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def _split_points(df: DataFrame, keys: list[str], hot: list) -> DataFrame:
    parts = _hot_frame(df, keys, hot)
    every = F.greatest(
        F.lit(1).cast("long"),
        F.floor(F.col("_h_n") / (F.col("_h_parts") * F.lit(SAMPLES_PER_SPLIT))).cast("long"),
    )
    sample = (
        df.join(F.broadcast(parts), _same_keys(keys), "inner")
        .where(F.pmod(F.xxhash64("_o"), every) == 0)
        .groupBy(*[f"_h_{k}" for k in keys])
        .agg(F.sort_array(F.collect_set("_o")).alias("_s"), F.first("_h_parts").alias("_p"))
    )
    point = F.expr(
        "transform(sequence(1, _p - 1), i -> _s[cast(floor(i * size(_s) / _p) as int)])"
    )
    return _pin(sample.select(*[f"_h_{k}" for k in keys], point.alias("_bounds")))


def ordered(
    df: DataFrame,
    keys: list[str],
    order: list,
    *,
    number: str | None = None,
    running: dict[str, Column] | None = None,
    lag: dict[str, Column] | None = None,
    lead: dict[str, Column] | None = None,
    totals: dict[str, Column] | None = None,
    hot: list | None = None,
) -> DataFrame:
    """Add row numbers, running sums, neighbours and group totals in one shuffle.

    ``order`` must make rows of a group distinct for ``number``/``lag``/``lead``
    to be deterministic.  ``running`` maps a name to the value summed from the
    first row up to the current one; ``lag``/``lead`` map a name to the value of
    the previous/next row; ``totals`` maps a name to any aggregate of the group.
    ``hot`` may give the large groups; a plain list leaves the number of tasks to Spark.
    """
    running, lag, lead, totals = running or {}, lag or {}, lead or {}, totals or {}
    fields = _fields(order)
    if hot is None:
        hot = hot_groups(df, keys)
    if not hot:
        part = Window.partitionBy(*keys)
        out: dict[str, Column] = {}
        if fields:
            seq = part.orderBy(*fields)
            upto = seq.rowsBetween(Window.unboundedPreceding, Window.currentRow)
            if number:
                out[number] = F.row_number().over(seq)
            out.update({n: F.sum(c).over(upto) for n, c in running.items()})
            out.update({n: F.lag(c).over(seq) for n, c in lag.items()})
            out.update({n: F.lead(c).over(seq) for n, c in lead.items()})
        out.update({n: a.over(part) for n, a in totals.items()})
        return spread(df, keys, hot).withColumns(out)
    return _ordered_split(df, keys, fields, number, running, lag, lead, totals, hot)


def _ordered_split(df, keys, fields, number, running, lag, lead, totals, hot) -> DataFrame:
    hkeys = [f"_h_{k}" for k in keys]
    cols = df.columns
    if fields:
        work = df.withColumn("_o", F.struct(*[f.alias(f"_o{i}") for i, f in enumerate(fields)]))
        bounds = _split_points(work, keys, hot)
        tagged = work.join(F.broadcast(bounds), _same_keys(keys), "left").withColumn(
            "_b",
            F.coalesce(F.size(F.filter("_bounds", lambda x: x < F.col("_o"))), F.lit(0)),
        )
        tagged = tagged.withColumn("_b", F.greatest(F.col("_b"), F.lit(0)))
        is_hot = F.col("_bounds").isNotNull()
    else:
        # totals only: any deterministic spread of the rows will do
        work = df.withColumn("_o", F.xxhash64(*cols))
        tagged = work.join(F.broadcast(_hot_frame(df, keys, hot)), _same_keys(keys), "left").withColumn(
            "_b", F.coalesce(F.pmod(F.col("_o"), F.col("_h_parts")), F.lit(0)).cast("int")
        )
        is_hot = F.col("_h_parts").isNotNull()

    hot_rows = tagged.where(is_hot)
    aggs = [F.count(F.lit(1)).alias("_n")]
    aggs += [F.sum(c).alias(f"_s_{n}") for n, c in running.items()]
    if lag:
        aggs.append(F.max(F.struct("_o", *[c.alias(n) for n, c in lag.items()])).alias("_last"))
    if lead:
        aggs.append(F.min(F.struct("_o", *[c.alias(n) for n, c in lead.items()])).alias("_next"))
    w = Window.partitionBy(*hkeys).orderBy("_hb")
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    pref = [F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_p_n")]
    pref += [F.sum(f"_s_{n}").over(before).alias(f"_p_{n}") for n in running]
    if lag:
        pref.append(F.max("_last").over(before).alias("_p_last"))
    if lead:
        pref.append(F.min("_next").over(after).alias("_p_next"))
    out = tagged
    if fields and (number or running or lag or lead):
        prefix = _pin(
            hot_rows.groupBy(*hkeys, F.col("_b").alias("_hb")).agg(*aggs).select(*hkeys, "_hb", *pref)
        )
        out = out.drop(*hkeys).join(
            F.broadcast(prefix), _same_keys(keys) & (F.col("_b") == F.col("_hb")), "left"
        )
    if totals:
        tot = _pin(
            hot_rows.groupBy(*hkeys).agg(
                *[a.alias(f"_t_{n}") for n, a in totals.items()], F.lit(True).alias("_t_hot")
            )
        )
        out = out.drop(*hkeys).join(F.broadcast(tot), _same_keys(keys), "left")
    # shuffle by key and bucket even where the rows already lie by key: that is what splits the group
    out = out.repartition(*[n for n in [tasks_for(df, getattr(hot, "rows", 0))] if n], *keys, "_b")
    part = Window.partitionBy(*keys, "_b")
    add: dict[str, Column] = {}
    if fields:
        seq = part.orderBy("_o")
        upto = seq.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rn = F.row_number().over(seq)
        if number:
            add[number] = rn + F.coalesce(F.col("_p_n"), F.lit(0))
        for n, c in running.items():
            add[n] = F.coalesce(
                F.sum(c).over(upto) + F.coalesce(F.col(f"_p_{n}"), F.lit(0)),
                F.sum(c).over(upto), F.col(f"_p_{n}"),
            )
        for n, c in lag.items():
            add[n] = F.when(rn == 1, F.col("_p_last")[n]).otherwise(F.lag(c).over(seq))
        if lead:
            last = rn == F.count(F.lit(1)).over(part)
            for n, c in lead.items():
                add[n] = F.when(last, F.col("_p_next")[n]).otherwise(F.lead(c).over(seq))
    for n, a in totals.items():
        add[n] = F.when(F.col("_t_hot"), F.col(f"_t_{n}")).otherwise(a.over(part))
    return out.withColumns(add).select(*cols, *add)


def numbered(df: DataFrame, keys: list[str], order: list, name: str = "rank", hot=None) -> DataFrame:
    """Row number inside each group, starting at 1."""
    return ordered(df, keys, order, number=name, hot=hot)


def with_totals(df: DataFrame, keys: list[str], totals: dict[str, Column], hot=None) -> DataFrame:
    """Attach group aggregates to the rows of the group."""
    return ordered(df, keys, [], totals=totals, hot=hot)


def quantiles(
    df: DataFrame, keys: list[str], specs: dict[str, tuple], aggs: dict[str, Column] | None = None,
    hot: list | None = None,
) -> DataFrame:
    """Exact linear-interpolation percentiles per group, plus other aggregates.

    ``specs`` maps a name to ``(value, p)``.  Ordinary groups use Spark's
    ``percentile``; large ones are reduced to distinct values with counts and
    selected by running count, so that no task holds a whole group.
    """
    specs = {n: (F.col(v) if isinstance(v, str) else v, p) for n, (v, p) in specs.items()}
    aggs = aggs or {}
    plain = [F.percentile(v, p).alias(n) for n, (v, p) in specs.items()]
    rest = [a.alias(n) for n, a in aggs.items()]
    if hot is None:
        hot = hot_groups(df, keys) if keys else whole_table(df)
    if not hot:
        return df.groupBy(*keys).agg(*plain, *rest)
    if not keys:
        return quantiles(
            df.withColumn("_all", F.lit(0)), ["_all"], specs, aggs, hot_groups(df.withColumn("_all", F.lit(0)), ["_all"])
        ).drop("_all")
    hkeys = [f"_h_{k}" for k in keys]
    flagged = df.join(
        F.broadcast(_hot_frame(df, keys, hot)), _same_keys(keys), "left"
    )
    cold = flagged.where(F.col("_h_n").isNull()).drop(*hkeys, "_h_n", "_h_parts")
    large = flagged.where(F.col("_h_n").isNotNull()).drop(*hkeys, "_h_n", "_h_parts")
    result = large.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"), *rest).drop("_c")
    for name, (value, p) in specs.items():
        counts = (
            large.select(*keys, value.alias("_v")).where("_v is not null").groupBy(*keys, "_v")
            .agg(F.count(F.lit(1)).alias("_c"))
        )
        run = ordered(
            counts, keys, ["_v"], running={"_cum": F.col("_c")}, totals={"_tot": F.sum("_c")},
        )
        pos = F.lit(float(p)) * (F.col("_tot") - 1)
        picked = run.groupBy(*keys).agg(
            F.min(F.when(F.col("_cum") > F.floor(pos), F.col("_v"))).alias("_lo"),
            F.min(F.when(F.col("_cum") > F.ceil(pos), F.col("_v"))).alias("_hi"),
            F.first(pos - F.floor(pos)).alias("_f"),
        )
        val = picked.select(
            *[F.col(k).alias(f"_h_{k}") for k in keys],
            (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_f")).cast("double").alias(name),
        )
        result = result.join(F.broadcast(val), _same_keys(keys), "left").drop(*hkeys)
    order = [*keys, *specs, *aggs]
    return cold.groupBy(*keys).agg(*plain, *rest).select(*order).unionByName(result.select(*order))


def framed(df: DataFrame, keys: list[str], pos: str, before: int, after: int, build, chunk: int = 65_536) -> DataFrame:
    """Window expressions with a bounded row frame over the rows of a series, in the order of ``pos``.

    Ordinary series are plain window partitions.  Where a series is too large for
    one task, its rows are numbered and cut into chunks of row numbers; each row is
    copied to every chunk whose frames reach it, so that many tasks work on the
    series.  Gaps in ``pos`` and frames longer than a chunk do no harm.  ``build``
    gets the ordered window and returns the new columns (a list of such steps if
    later ones build on earlier ones); together their frames may reach ``before``
    rows back and ``after`` rows ahead.
    """

    def add(rows: DataFrame, w) -> DataFrame:
        steps = build(w)
        for cols in steps if isinstance(steps, list) else [steps]:
            rows = rows.withColumns(cols)
        return rows

    hot = hot_groups(df, keys)
    if not hot:
        return add(df, Window.partitionBy(*keys).orderBy(pos))
    chunk = max(chunk, before + after)  # at most three copies of a row
    at = F.col("_at") - 1
    rows = ordered(df, keys, [pos], number="_at", hot=hot)
    needed = F.sequence(F.floor((at - after) / chunk), F.floor((at + before) / chunk))
    tiled = rows.withColumn("_chunk", F.explode(needed))
    out = add(tiled, Window.partitionBy(*keys, "_chunk").orderBy(pos))
    return out.where(F.floor(at / chunk) == F.col("_chunk")).drop("_at", "_chunk")


def correlation(x: str, y: str) -> Column:
    """Pearson correlation of two complete columns; null if one of them is constant."""
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def average_ranks(df: DataFrame, keys: list[str], value: str, name: str, ties: str | None = None) -> DataFrame:
    """Ascending rank in the group, equal values sharing the mean of their ranks; nulls get none.

    Values are reduced to distinct ones with counts, ranked by running count and
    joined back, so ties cost one row.  ``ties`` also keeps the number of equal values.
    """
    key = keys or ["_all"]
    rows = df if keys else df.withColumn("_all", F.lit(0))
    counts = rows.where(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count(F.lit(1)).alias("_c"))
    run = ordered(counts, key, [value], running={"_cum": F.col("_c")})
    rank = (F.col("_cum") - (F.col("_c") - 1) / 2).alias(name)
    extra = [F.col("_c").alias(ties)] if ties else []
    out = rows.join(run.select(*key, value, rank, *extra), [*key, value], "left")
    return out if keys else out.drop("_all")


def whole_table(df: DataFrame) -> list:
    """Non-empty if the table as one group is too large for one task."""
    n = df.count()
    return [n] if n > split_rows(df) else []


def pair_blocks(
    df: DataFrame, keys: list[str], ident: str, carry: list[str], blocks: int | str = 4,
    on: list[str] | None = None,
) -> DataFrame:
    """Unordered pairs ``a.ident < b.ident`` of one group, spread over block tasks.

    The pairs are the wanted rows (an edge table).  Each member is hashed to one
    of ``blocks`` blocks and sent to the block pairs that need it, so one group is
    worked on by ``blocks*(blocks+1)/2`` tasks; a column name gives each group its own number.  ``on`` adds equality columns
    (for example a shared time step) to the join.
    """
    on = on or []
    if blocks == 1:
        cols = list(dict.fromkeys([ident, *carry]))
        side = lambda s: df.select(*keys, *on, *[F.col(c).alias(f"{c}_{s}") for c in cols])
        return side("a").join(side("b"), [*keys, *on]).where(F.col(f"{ident}_a") < F.col(f"{ident}_b"))
    many = F.col(blocks) if isinstance(blocks, str) else F.lit(blocks)
    blk = F.pmod(F.xxhash64(ident), many).cast("int")
    base = df.select(*keys, *on, ident, *[c for c in carry if c != ident], many.alias("_many"), blk.alias("_blk"))
    tiles = F.explode(
        F.transform(
            F.sequence(F.lit(0), F.col("_many") - 1),
            lambda j: F.struct(
                F.least(F.col("_blk"), j).alias("lo"), F.greatest(F.col("_blk"), j).alias("hi")
            ),
        )
    )
    tiled = base.withColumn("_tile", tiles).withColumns({"_lo": F.col("_tile.lo"), "_hi": F.col("_tile.hi")})
    tiled = tiled.drop("_tile", "_many")
    join_on = [*keys, *on, "_lo", "_hi"]
    left = tiled.select(*join_on, *[F.col(c).alias(f"{c}_a") for c in [ident, *carry, "_blk"] if c in tiled.columns])
    right = tiled.select(*join_on, *[F.col(c).alias(f"{c}_b") for c in [ident, *carry, "_blk"] if c in tiled.columns])
    # a tile (lo, hi) with lo < hi pairs block lo with block hi only; lo == hi pairs the block with itself
    cross = (F.col("_blk_a") != F.col("_blk_b")) | (F.col("_lo") == F.col("_hi"))
    return (
        left.join(right, join_on)
        .where((F.col(f"{ident}_a") < F.col(f"{ident}_b")) & cross)
        .drop("_lo", "_hi", "_blk_a", "_blk_b")
    )
