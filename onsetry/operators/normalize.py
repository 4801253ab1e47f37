"""Group normalisation, cumulative bursts and cleaning of feature columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from onsetry.functions import scalars
from onsetry.operators.grouped import average_ranks, hot_groups, ordered, quantiles, with_totals

MAD_SCALE = 1.4826
SIGMA_FLOOR = 1e-9
CLIP = 20.0
META = {
    "dataset", "outcome", "phase", "patient", "seizure", "seizure_id", "seq_idx", "epoch", "is_avg",
    "electrode", "electrode_name", "node_index", "is_soz", "first_ictal_epoch", "file_path", "is_flat_zero",
}


def finite(col) -> Column:
    """NaN and infinities become null."""
    c = (F.col(col) if isinstance(col, str) else col).cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(None)).otherwise(c)


def numeric_features(df: DataFrame, wanted: list[str] | None = None, meta: set[str] = META) -> list[str]:
    """the wanted columns that exist and are numeric, else every numeric non-meta column."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    picked = [c for c in (wanted or []) if c in numeric]
    return picked or [c for c in numeric if c not in meta]


def drop_average_rows(df: DataFrame, epoch="epoch") -> DataFrame:
    """average rows carry epoch -1."""
    return df.where(F.col(epoch) != -1)


def groups_with_positive(df, keys, label="is_soz") -> DataFrame:
    """rows of the groups that hold at least one positive."""
    return with_totals(df, list(keys), {"_pos": F.sum(F.col(label).cast("int"))}).where("_pos > 0").drop("_pos")


def drop_flat_positives(df, label="is_soz", flat="is_flat_zero") -> DataFrame:
    """remove positives whose trace is all zero."""
    return df.where(~((F.coalesce(F.col(label), F.lit(0)) == 1) & F.coalesce(F.col(flat), F.lit(False))))


def zero_channels(df, keys, value="value", atol=0.0) -> DataFrame:
    """channels whose every value is zero within a tolerance."""
    flat = F.bool_and(F.abs(F.coalesce(F.col(value), F.lit(0.0))) <= atol)
    return df.groupBy(*keys).agg(flat.alias("_z")).where("_z").drop("_z")


def drop_channels(df, flagged, keys, label=None) -> DataFrame:
    """Drop flagged channels, or with ``label`` only the positive ones among them."""
    if label is None:
        return df.join(flagged, list(keys), "left_anti")
    marked = df.join(flagged.withColumn("_f", F.lit(True)), list(keys), "left")
    return marked.where(~(F.coalesce(F.col("_f"), F.lit(False)) & (F.col(label) == 1))).drop("_f")


def known_rows(df, label="is_soz", score="y_score", recording="seizure_id", drop_unknown=True) -> DataFrame:
    """drop rows without label or score, and recordings named ``?``."""
    out = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    return out.where(F.col(recording).cast("string") != "?") if drop_unknown else out


def column_medians(df: DataFrame, cols: list[str]) -> DataFrame:
    """F8: one row of medians over the finite values."""
    clean = df.select(*[finite(c).alias(c) for c in cols])
    return quantiles(clean, [], {c: (c, 0.5) for c in cols})


def impute(df: DataFrame, cols: list[str], medians: dict[str, float]) -> DataFrame:
    """Finite values, else the fitted median; a missing column is all medians."""
    present = set(df.columns)
    return df.withColumns({
        c: F.coalesce(finite(c) if c in present else F.lit(None).cast("double"), F.lit(medians.get(c)))
        for c in cols
    })


def clean_matrix(df: DataFrame, cols: list[str]) -> tuple[DataFrame, list[str], dict[str, float]]:
    """F8: impute with medians and name the non-constant columns (all, if none varies)."""
    medians = {k: v for k, v in column_medians(df, cols).first().asDict().items() if v is not None}
    filled = impute(df, cols, medians)
    spread = filled.agg(*[F.struct(F.min(c), F.max(c)).alias(c) for c in cols]).first()
    varying = [c for c in cols if spread[c][0] is not None and spread[c][0] != spread[c][1]]
    return filled, varying or list(cols), medians


# ------------------------------------------------------------------ baselines
def baseline_stats(long: DataFrame, channel: list[str], phase="phase", value="value",
                   fallback_to_ictal=True) -> DataFrame:
    """Median, absolute deviation and spread of the baseline rows of every channel and feature.

    The baseline is the preictal part; a recording without one may fall back to
    its ictal part.
    """
    hot = hot_groups(long, channel)
    pre = F.col(phase) == "preictal"
    if fallback_to_ictal:
        marked = with_totals(long, channel, {"_has_pre": F.bool_or(pre)}, hot)
        base = marked.where(pre | ~F.col("_has_pre")).drop("_has_pre")
    else:
        base = long.where(pre)
    med = quantiles(base, channel, {"med": (value, 0.5)}, {
        "base_mean": F.avg(value), "base_std": F.stddev_pop(value), "base_std_sample": F.stddev_samp(value),
    }, hot)
    dev = base.join(med.select(*channel, "med"), channel).withColumn("_d", F.abs(F.col(value) - F.col("med")))
    return med.join(quantiles(dev, channel, {"mad": ("_d", 0.5)}, hot=hot), channel, "left")


def robust_baseline_z(long, channel, phase="phase", value="value", clip: float | None = None) -> DataFrame:
    """B1, with ``clip`` B3: (x - median) / max(1.4826 MAD, 1e-9) of the preictal part."""
    stats = baseline_stats(long, channel, phase, value).select(*channel, "med", "mad")
    sigma = F.greatest(F.lit(MAD_SCALE) * F.col("mad"), F.lit(SIGMA_FLOOR))
    z = (F.col(value) - F.col("med")) / sigma
    if clip is not None:
        z = scalars.clip(z, -clip, clip)
    return long.join(stats, channel, "left").withColumn("z", z).drop("med", "mad")


def robust_baseline_z_std(long, channel, phase="phase", value="value") -> DataFrame:
    """B2: where the MAD vanishes use the population deviation; null without preictal rows."""
    stats = baseline_stats(long, channel, phase, value, fallback_to_ictal=False)
    mad = F.lit(MAD_SCALE) * F.col("mad")
    sigma = F.when(mad.isNull() | (mad < SIGMA_FLOOR), F.col("base_std") + SIGMA_FLOOR).otherwise(mad)
    out = long.join(stats.select(*channel, "med", sigma.alias("_sg")), channel, "left")
    return out.withColumn("z", (F.col(value) - F.col("med")) / (F.col("_sg") + SIGMA_FLOOR)).drop("med", "_sg")


def spatial_robust_z(long, window: list[str], value="value") -> DataFrame:
    """Robust z across the channels of one window; undefined values become 0."""
    hot = hot_groups(long, window)
    med = quantiles(long, window, {"_m": (value, 0.5)}, hot=hot)
    dev = long.join(med, window).withColumn("_d", F.abs(F.col(value) - F.col("_m")))
    mad = quantiles(dev, window, {"_mad": ("_d", 0.5)}, hot=hot)
    sigma = F.lit(MAD_SCALE) * F.nullif(F.col("_mad"), F.lit(0.0))
    z = F.coalesce((F.col(value) - F.col("_m")) / sigma, F.lit(0.0))
    return dev.join(mad, window).withColumn("z", z).drop("_m", "_mad", "_d")


# -------------------------------------------------------------------- bursts
def persistent_burst(long, channel, phase="phase", step="epoch", value="value", thr_k=3.0, decay=1.0) -> DataFrame:
    """S_t = decay * S_{t-1} + max(0, x_t - threshold), preictal rows before ictal rows.

    The threshold is mean + thr_k * sample deviation of the baseline.  A plain
    sum is a running sum; with decay < 1 see ``decayed_sum``.
    """
    stats = baseline_stats(long, channel, phase, value).select(*channel, "base_mean", "base_std_sample")
    # a one-row baseline has no sample deviation: threshold and excess are undefined, as in the definition
    sd = F.when(F.col("base_std_sample") < SIGMA_FLOOR, SIGMA_FLOOR).otherwise(F.col("base_std_sample"))
    thr = F.col("base_mean") + F.lit(float(thr_k)) * sd
    inst = F.when(thr.isNotNull() & F.col(value).isNotNull(), F.greatest(F.lit(0.0), F.col(value) - thr))
    rows = long.join(stats, channel, "left").withColumn("_inst", inst).drop("base_mean", "base_std_sample")
    order = [F.when(F.col(phase) == "preictal", 0).otherwise(1), step]
    if decay == 1.0:
        out = ordered(rows, channel, order, running={"_s": F.col("_inst"), "_bad": F.col("_inst").isNull().cast("int")})
        # an undefined step leaves every later sum undefined
        return out.withColumn("burst", F.when(F.col("_bad") == 0, F.col("_s"))).drop("_inst", "_s", "_bad")
    num = ordered(
        rows, channel, order, number="_pos", running={"_bad": F.col("_inst").isNull().cast("int")}
    ).withColumns({"_pos": F.col("_pos").cast("long") - 1, "_inst": F.coalesce(F.col("_inst"), F.lit(0.0))})
    out = decayed_sum(num, channel, "_pos", "_inst", decay, "burst")
    return out.withColumn("burst", F.when(F.col("_bad") == 0, F.col("burst"))).drop("_inst", "_pos", "_bad")


def decayed_sum(df, keys: list[str], pos: str, value: str, decay: float, name: str) -> DataFrame:
    """S_p = decay * S_{p-1} + x_p over positions 0, 1, 2, ... with 0 < decay < 1.

    Inside a chunk S is decay^i times a running sum of x * decay^-i; the chunk is
    short enough for the weights to stay finite.  The chunk ends obey the same
    recurrence with decay^chunk, so they are solved by the same function on a
    table shorter by the chunk length.
    """
    chunk = max(1, min(4096, int(200 / -math.log10(decay))))
    if chunk == 1:  # decay squared is zero in double precision
        out = ordered(df, keys, [pos], lag={"_before": F.col(value)})
        return out.withColumn(name, F.col(value) + decay * F.coalesce(F.col("_before"), F.lit(0.0))).drop("_before")
    d = F.lit(float(decay))
    rows = df.withColumns({"_chunk": F.floor(F.col(pos) / chunk).cast("long"), "_i": F.pmod(F.col(pos), F.lit(chunk)).cast("double")})
    w = Window.partitionBy(*keys, "_chunk").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_local", F.pow(d, F.col("_i")) * F.sum(F.col(value) * F.pow(d, -F.col("_i"))).over(w))
    ends = rows.groupBy(*keys, "_chunk").agg(F.max_by("_local", "_i").alias("_end"))
    carry = decayed_sum(ends, keys, "_chunk", "_end", float(decay) ** chunk, "_s").select(
        *keys, (F.col("_chunk") + 1).alias("_chunk"), F.col("_s").alias("_carry")
    )
    out = rows.join(carry, [*keys, "_chunk"], "left")
    total = F.col("_local") + F.coalesce(F.col("_carry") * F.pow(d, F.col("_i") + 1), F.lit(0.0))
    return out.withColumn(name, total).drop("_chunk", "_i", "_local", "_carry")


def phase_averages(df, keys, features: list[str], epoch="epoch") -> DataFrame:
    """Per-epoch rows plus one average row per phase (epoch -1, is_avg true)."""
    avg = df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in features])
    avg = avg.withColumn(epoch, F.lit(-1)).withColumn("is_avg", F.lit(True))
    return df.select(*keys, epoch, *features).withColumn("is_avg", F.lit(False)).unionByName(avg)


# ------------------------------------------------------------------- scalers
def minmax_columns(df: DataFrame, cols: list[str], fit: DataFrame | None = None) -> DataFrame:
    """Scale columns to 0..1 with the range of ``fit`` (default: all rows); constants become 0."""
    src = df if fit is None else fit
    box = src.agg(*[F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c) for c in cols]).first()
    out = {}
    for c in cols:
        lo, hi = (box[c]["lo"], box[c]["hi"]) if box[c] else (None, None)
        if lo is None:
            continue
        out[c] = (F.col(c) - F.lit(lo)) / F.lit(hi - lo) if hi > lo else F.col(c) * 0.0
    return df.withColumns(out)


def minmax_by_group(df, keys, cols, constant: float = 0.0) -> DataFrame:
    """B7 per graph and B11: range inside a group; a constant column gets ``constant``."""
    totals = {}
    for c in cols:
        totals |= {f"_lo_{c}": F.min(c), f"_hi_{c}": F.max(c)}
    out = with_totals(df, list(keys), totals)
    scaled = {
        c: F.when(F.col(f"_hi_{c}") == F.col(f"_lo_{c}"), F.when(F.col(c).isNotNull(), F.lit(float(constant)))).otherwise(
            (F.col(c) - F.col(f"_lo_{c}")) / F.nullif(F.col(f"_hi_{c}") - F.col(f"_lo_{c}"), F.lit(0.0))
        )
        for c in cols
    }
    return out.withColumns(scaled).drop(*totals)


def group_zscore(df, keys, cols) -> DataFrame:
    """Z inside the group with sample deviation; zero deviation counts as 1, one row gives null."""
    totals = {}
    for c in cols:
        totals |= {f"_m_{c}": F.avg(c), f"_s_{c}": F.stddev_samp(c)}
    out = with_totals(df, list(keys), totals)
    return out.withColumns({
        c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}"))
        for c in cols
    }).drop(*totals)


def standardize(train: DataFrame, apply_to: DataFrame, cols: list[str]) -> DataFrame:
    """Centre and scale by the training rows, population deviation, zero counts as 1."""
    fit = train.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in cols]).first()
    return apply_to.withColumns({
        c: (F.col(c) - F.lit(fit[c]["m"])) / F.lit(fit[c]["s"] or 1.0) for c in cols if fit[c]["m"] is not None
    })


def relative_long(long: DataFrame, group: list[str], ident: list[str], feature="feature", value="value") -> DataFrame:
    """B10 in long form: difference to the group mean, z and average percentile rank."""
    keys = [*group, feature]
    rows = with_totals(long, keys, {"_m": F.avg(value), "_sd": F.stddev_samp(value), "_n": F.count(value)})
    out = average_ranks(rows, keys, value, "_r")
    sd = F.nullif(F.col("_sd"), F.lit(0.0))
    return out.select(
        *group, *ident, feature, value,
        (F.col(value) - F.col("_m")).alias("rel"),
        ((F.col(value) - F.col("_m")) / (sd + 1e-6)).alias("z"),
        (F.col("_r") / F.col("_n")).alias("pct_rank"),
    )


def relative_features(df, group: list[str], ident: list[str], features: list[str]) -> DataFrame:
    """``f_rel``, ``f_z`` and ``f_rank`` for every feature, in one pass over a long table."""
    long = df.unpivot([*group, *ident], features, "feature", "value")
    rel = relative_long(long, group, ident)
    wide = []
    for f in features:
        for src, name in (("value", f), ("rel", f"{f}_rel"), ("z", f"{f}_z"), ("pct_rank", f"{f}_rank")):
            wide.append(F.max(F.when(F.col("feature") == f, F.col(src))).alias(name))
    return rel.groupBy(*group, *ident).agg(*wide)


def l1_normalize(long, vector: list[str], value="value", hot=None) -> DataFrame:
    """Divide by the sum of the vector; a zero sum gives null."""
    out = with_totals(long, vector, {"_sum": F.sum(value)}, hot)
    return out.withColumn(value, F.col(value) / F.nullif(F.col("_sum"), F.lit(0.0))).drop("_sum")


# --------------------------------------------------------------------- joins
def first_ictal_flag(df, recording: list[str], phase="phase", epoch="epoch") -> DataFrame:
    """True on the rows of the first ictal window of the recording."""
    first = F.min(F.when((F.col(phase) == "ictal") & (F.col(epoch) >= 0), F.col(epoch)))
    out = with_totals(df, recording, {"_first": first})
    flag = (F.col(phase) == "ictal") & (F.col(epoch) == F.col("_first"))
    return out.withColumn("first_ictal_epoch", F.coalesce(flag, F.lit(False))).drop("_first")


def three_valued_label(nodes, label_files, positives, keys: list[str], name="name") -> DataFrame:
    """Null without a label file, else whether the channel name is listed as positive."""
    marked = nodes.join(label_files.select(*keys).distinct().withColumn("_file", F.lit(True)), keys, "left")
    pos = positives.select(*keys, name).distinct().withColumn("_pos", F.lit(True))
    out = marked.join(pos, [*keys, name], "left")
    return out.withColumn("is_soz", F.when(F.col("_file"), F.col("_pos").isNotNull())).drop("_file", "_pos")


def lookup(df, dim, keys: list[str], columns: list[str], default="unknown") -> DataFrame:
    """Left join to a dimension; Spark broadcasts it when its measured size allows."""
    out = df.join(dim.select(*keys, *columns), keys, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(default)) for c in columns})
