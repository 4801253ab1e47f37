"""Segmentation of sampled signals and time-domain channel features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from onsetry.functions.scalars import seeded, seeded_number
from onsetry.operators.grouped import framed, numbered, quantiles, with_totals

EPS = 1e-12


def split_at_onset(samples, bounds, recording: list[str], time="t", onset="onset", offset="offset") -> DataFrame:
    """G1: preictal is [0, onset], ictal is [onset, offset]; the boundary sample is in both.

    ``bounds`` has one row per recording (a small table; joined by key).
    """
    b = bounds.where(
        F.col(onset).isNotNull() & F.col(offset).isNotNull() & (F.col(offset) > F.col(onset))
    )
    j = samples.join(b, recording)
    phases = F.array_compact(F.array(
        F.when(F.col(time) <= F.col(onset), F.lit("preictal")),
        F.when((F.col(time) >= F.col(onset)) & (F.col(time) <= F.col(offset)), F.lit("ictal")),
    ))
    return j.withColumn("phase", F.explode(phases)).drop(onset, offset)


def average_reference(samples, recording: list[str], n="n", x="x") -> DataFrame:
    """Subtract the mean over channels at each sample."""
    out = with_totals(samples, [*recording, n], {"_ref": F.avg(x)})
    return out.withColumn(x, F.col(x) - F.col("_ref")).drop("_ref")


def fixed_windows(samples, channel: list[str], size: int, n="n", x="x") -> DataFrame:
    """Non-overlapping windows of ``size`` samples as arrays; a partial tail is dropped.

    Grouping by (channel, window) bounds every array by ``size``.
    """
    w = F.floor(F.col(n) / size).cast("int").alias("epoch")
    arr = samples.groupBy(*channel, w).agg(
        F.sort_array(F.collect_list(F.struct(F.col(n).alias("n"), F.col(x).alias("x")))).alias("_a")
    )
    return arr.where(F.size("_a") == size).select(
        *channel, "epoch", F.transform("_a", lambda s: s["x"]).alias("samples")
    )


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v)


def array_mean(a: Column) -> Column:
    return array_sum(a) / F.size(a)


def centered_power(a: Column, p: int) -> Column:
    """Mean of (x - mean)^p over an array, the mean taken once."""
    return F.element_at(
        F.transform(
            F.array(array_mean(a)),
            lambda m: F.aggregate(a, F.lit(0.0), lambda acc, v: acc + F.pow(v - m, F.lit(float(p)))) / F.size(a),
        ),
        1,
    )


def zscore_windows(windows: DataFrame, samples="samples") -> DataFrame:
    """Z inside each window, population deviation, floor 1e-12."""
    a = F.col(samples)
    out = windows.withColumns({"_m": array_mean(a), "_s": F.greatest(F.sqrt(centered_power(a, 2)), F.lit(EPS))})
    return out.withColumn(samples, F.transform(a, lambda v: (v - F.col("_m")) / F.col("_s"))).drop("_m", "_s")


def boundary_epochs(df, recording: list[str], k_pre: int, k_ict: int, phase="phase", epoch="epoch") -> DataFrame:
    """The last ``k_pre`` preictal and first ``k_ict`` ictal windows.

    The rank filter is applied before the shuffle, so a long recording sends
    only its best rows.
    """
    pre = numbered(df.where(F.col(phase) == "preictal"), recording, [-F.col(epoch)], "_r", hot=[]).where(F.col("_r") <= k_pre)
    ict = numbered(df.where(F.col(phase) == "ictal"), recording, [F.col(epoch)], "_r", hot=[]).where(F.col("_r") <= k_ict)
    return pre.unionByName(ict).drop("_r")


def random_epochs(df, recording: list[str], seed: int, lo=20, hi=40, phase="phase", epoch="epoch") -> DataFrame:
    """A seeded draw of between ``lo`` and ``hi`` windows per recording and phase."""
    keys = [*recording, phase]
    out = numbered(df, keys, [seeded(*keys, epoch, seed=seed), epoch], "_r", hot=[])
    k = F.lit(lo) + seeded_number(*keys, seed=seed, below=hi - lo + 1)
    # the constant bound lets Spark cut each group before the shuffle
    return out.where((F.col("_r") <= hi) & (F.col("_r") <= k)).drop("_r")


# ----------------------------------------------------------- channel features
def _pairwise(a: Column, fn) -> Column:
    n = F.size(a)
    return F.zip_with(F.slice(a, 1, n - 1), F.slice(a, 2, n - 1), fn)


def _diff(a: Column) -> Column:
    return _pairwise(a, lambda p, q: q - p)


def _tkeo(a: Column) -> Column:
    n = F.size(a)
    outer = F.zip_with(F.slice(a, 1, n - 2), F.slice(a, 3, n - 2), lambda p, q: p * q)
    return F.zip_with(F.slice(a, 2, n - 2), outer, lambda v, o: v * v - o)


def time_features(windows: DataFrame, keys: list[str], samples="samples") -> DataFrame:
    """N6, N10, N13, N14 and the RMS of N4, from the sample array of each channel window."""
    a = F.col(samples)
    w = windows.select(*keys, samples).withColumns({"_dx": _diff(a), "_tk": _tkeo(a)})
    w = w.withColumn("_ddx", _diff(F.col("_dx")))
    n = F.size(a)
    mid = F.floor(n / 2).cast("int")
    w = w.withColumns({
        "_n": n.cast("double"),
        "dc_shift": array_mean(F.slice(a, mid + 1, n - mid)) - array_mean(F.slice(a, F.lit(1), mid)),
        "line_length": F.aggregate("_dx", F.lit(0.0), lambda acc, v: acc + F.abs(v)),
        "tkeo_energy": array_mean(F.col("_tk")),
        "rms": F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v * v) / n),
        "_v0": centered_power(a, 2), "_v1": centered_power(F.col("_dx"), 2), "_v2": centered_power(F.col("_ddx"), 2),
        "_m3": centered_power(a, 3), "_m4": centered_power(a, 4),
    })
    k = F.col("_n")
    g1 = F.col("_m3") / F.nullif(F.pow(F.col("_v0"), F.lit(1.5)), F.lit(0.0))
    g2 = F.col("_m4") / F.nullif(F.col("_v0") * F.col("_v0"), F.lit(0.0))
    w = w.withColumns({
        "hjorth_activity": F.col("_v0"),
        "hjorth_mobility": F.sqrt(F.col("_v1") / (F.col("_v0") + EPS)),
        "skewness": F.when(k > 2, F.sqrt(k * (k - 1)) / F.nullif(k - 2, F.lit(0.0)) * g1),
        "kurtosis": F.when(
            k > 3, ((k * k - 1) * g2 - 3 * (k - 1) * (k - 1)) / F.nullif((k - 2) * (k - 3), F.lit(0.0))
        ),
    })
    w = w.withColumn(
        "hjorth_complexity", F.sqrt(F.col("_v2") / (F.col("_v1") + EPS)) / (F.col("hjorth_mobility") + EPS)
    )
    return w.select(
        *keys, "dc_shift", "line_length", "tkeo_energy", "rms", "hjorth_activity", "hjorth_mobility",
        "hjorth_complexity", "skewness", "kurtosis",
    )


def across_channel_scores(features, window: list[str], rms="rms", low="p_low_band", high="p_high_band") -> DataFrame:
    """Saturating band power of channels under P30 / over P70 of the window's RMS values."""
    cut = quantiles(features, window, {"_p30": (rms, 0.3), "_p70": (rms, 0.7)})
    j = features.join(cut, window)

    def saturating(c):
        return F.col(c) / (F.col(c) + 1e-9)

    return j.withColumns({
        "lvfa_score": saturating(low) * (F.col(rms) < F.col("_p30")).cast("double"),
        "hafa_score": saturating(high) * (F.col(rms) > F.col("_p70")).cast("double"),
    }).drop("_p30", "_p70")


def across_channel_z(features, window: list[str], col: str, name: str) -> DataFrame:
    """N9 second step: z of a channel value over the channels of the window, population deviation."""
    out = with_totals(features, window, {"_m": F.avg(col), "_s": F.stddev_pop(col)})
    return out.withColumn(name, (F.col(col) - F.col("_m")) / (F.col("_s") + EPS)).drop("_m", "_s")


def moving_average(df, keys: list[str], order: str, value: str, width: int, name="smooth") -> DataFrame:
    """Centred moving sum divided by ``width``; outside the series counts as 0.

    An even width reaches one row further back, as in a same-size convolution.
    """
    back, ahead = width // 2, (width - 1) // 2
    return framed(
        df, keys, order, back, ahead,
        lambda w: {name: F.sum(value).over(w.rowsBetween(-back, ahead)) / width},
    )


def step_vector(t, onset) -> Column:
    """1 from the onset on, 0 before it or without one."""
    t, onset = F.col(t), F.col(onset)
    return F.when(onset.isNotNull() & (onset >= 0) & (t >= onset), 1).otherwise(0)
