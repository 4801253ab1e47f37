"""Onset detection on probability traces, trace summaries, pooling and gating.

A trace is a series over positions t = 0, 1, 2, ...; ``keys`` name the trace.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from onsetry.functions.scalars import clip
from onsetry.operators.grouped import down, framed, hot_groups, ordered, quantiles, split_rows, with_totals
from onsetry.operators.lineage import durable

BCE_EPS = 1e-7


def first_peak(value: str, t="t") -> Column:
    """Position of the largest value, the earliest one if several."""
    return F.max_by(t, F.struct(F.col(value), -F.col(t)))


def onset_simple(df, keys, t="t", p="p", thr=0.5, min_stable=3, fallback=False) -> DataFrame:
    """First t from which ``min_stable`` consecutive values reach ``thr``; -1 if none.

    With ``fallback`` the position of the maximum is used instead of -1.
    """
    m = min_stable
    rows = framed(df, keys, t, 0, m - 1, lambda w: {
        "_ok": (F.min(p).over(w.rowsBetween(0, m - 1)) >= thr) & (F.count(p).over(w.rowsBetween(0, m - 1)) == m)
    })
    missing = first_peak(p, t) if fallback else F.lit(-1)
    return rows.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col("_ok"), F.col(t))), missing).alias("t_onset"))


def onset_adaptive(df, keys, t="t", p="p", pre_window=20, k_sigma=2.0, thr_abs_min=0.55, thr_abs_max=0.85,
                   frac_of_range=0.60, min_stable=3, dmin=0.02) -> DataFrame:
    """Threshold from the baseline and caps, a slope gate, a run length and a tail check.

    The counter that resets on a bad step is the same as "the last
    ``min_stable`` steps are all good", so bounded frames replace the state
    machine.  Without a run, the step after the steepest rise is used.
    """
    head = df.where(F.col(t) < max(5, pre_window))
    base = quantiles(head, keys, {"_p95": (p, 0.95)}, {"_mu": F.avg(p), "_sd": F.stddev_pop(p)})
    span = df.groupBy(*keys).agg(F.min(p).alias("_lo"), F.max(p).alias("_hi"))
    stats = base.join(span, keys)
    h0 = F.greatest(F.col("_mu") + k_sigma * F.col("_sd"), F.col("_p95"), F.lit(thr_abs_min))
    cap = F.col("_lo") + frac_of_range * F.greatest(F.lit(1e-6), F.col("_hi") - F.col("_lo"))
    stats = stats.select(*keys, F.least(h0, F.lit(thr_abs_max), cap).alias("_h"))
    m = min_stable

    def steps(w):
        slope = (F.col(p) - F.lag(p, 2).over(w)) / 2
        run, tail = w.rowsBetween(1 - m, 0), w.rowsBetween(1 - m, 3 - m)
        good = (F.col(p) >= F.col("_h")) & ((F.col(t) < 2) | (slope >= dmin))
        return [
            {"_good": good.cast("int"), "_dp": F.col(p) - F.lag(p, 1).over(w)},
            {"_hit": (F.sum("_good").over(run) == m) & (F.min(p).over(tail) >= 0.8 * F.col("_h"))},
        ]

    rows = framed(df.join(stats, keys), keys, t, m + 1, max(0, 3 - m), steps)
    rise = F.max_by(t, F.when(F.col("_dp").isNotNull(), F.struct("_dp", -F.col(t))))
    return rows.groupBy(*keys).agg(
        F.coalesce(
            F.min(F.when(F.col("_hit"), F.col(t) - (m - 1))),
            F.when(F.count(F.lit(1)) >= 2, rise), F.lit(-1),
        ).alias("t_onset")
    )


def true_onset(df, keys, t="t", phase="phase") -> DataFrame:
    """First ictal step."""
    return df.groupBy(*keys).agg(F.min(F.when(F.col(phase) == "ictal", F.col(t))).alias("t_true"))


def onset_delay(pred: DataFrame, true: DataFrame, keys) -> DataFrame:
    """Predicted minus true onset, null if either is missing."""
    j = pred.join(true, keys)
    ok = (F.col("t_onset") >= 0) & F.col("t_true").isNotNull()
    return j.withColumn("delay", F.when(ok, F.col("t_onset") - F.col("t_true")))


def bce(y, p, eps=BCE_EPS) -> Column:
    q = clip(p, eps, 1 - eps)
    return -(y * F.log(q) + (1 - y) * F.log(1 - q))


def onset_bce(df, keys, t="t", p="p", t_true="t_true") -> DataFrame:
    """T4/T5: mean cross entropy of a trace against the step curve from the true onset."""
    y = (F.col(t) >= F.col(t_true)).cast("int")
    known = df.where(F.col(t_true).isNotNull() & (F.col(t_true) >= 0))
    return known.groupBy(*keys).agg(F.avg(bce(y, F.col(p))).alias("bce_onset"), F.first(t_true).alias("t_true"))


def sequence_quality(df, keys, label="y", p="p") -> DataFrame:
    """T4: cross entropy and ROC area of the steps of a sequence."""
    area = ordered(
        df.groupBy(*keys, p).agg(
            F.sum(F.col(label).cast("int")).alias("_p"), F.count(F.lit(1)).alias("_c"),
            F.sum(bce(F.col(label), F.col(p))).alias("_loss"),
        ).withColumn("_n", F.col("_c") - F.col("_p")),
        keys, [p], running={"_below": F.col("_n")},
    )
    u = F.sum(F.col("_p") * (F.col("_below") - F.col("_n") / 2))
    return area.groupBy(*keys).agg(
        (F.sum("_loss") / F.sum("_c")).alias("bce"),
        (u / F.nullif(F.sum("_p") * F.sum("_n"), F.lit(0))).alias("auc"),
        F.sum("_c").alias("n_steps"),
    )


# ------------------------------------------------------------ trace summaries
def trace_summary(df, keys, t="t", value="value", label="is_soz") -> DataFrame:
    """Moments, percentiles, slopes, area, peak time and the flat-zero flag.

    Traces with fewer than three steps are left out.
    """
    steps = framed(df, keys, t, 1, 0, lambda w: {"_pv": F.lag(value).over(w), "_pt": F.lag(t).over(w)})
    slope = F.col(value) - F.col("_pv")
    aggs = {
        "n_steps": F.count(F.lit(1)), "mean": F.avg(value), "std": F.stddev_pop(value),
        "min": F.min(value), "max": F.max(value), "slope_mean": F.avg(slope), "slope_std": F.stddev_pop(slope),
        "area": F.sum((F.col(value) + F.col("_pv")) / 2 * (F.col(t) - F.col("_pt"))),
        "time_to_peak": first_peak(value, t).cast("double"),
        "is_flat_zero": (F.max(F.abs(value)) == 0) & (F.max(label) == 1),
    }
    out = quantiles(steps, keys, {"median": (value, 0.5), "q25": (value, 0.25), "q75": (value, 0.75)}, aggs)
    return out.where("n_steps >= 3").withColumns({
        "range": F.col("max") - F.col("min"), "iqr": F.col("q75") - F.col("q25"),
    }).drop("q25", "q75")


def rise_and_decay(df, keys, t="t", value="value") -> DataFrame:
    """10 % to 90 % of the maximum, and 90 % to 50 % after the peak; null when not reached."""
    rows = with_totals(df, keys, {"_max": F.max(value), "_peak": first_peak(value, t)})
    v, top, after = F.col(value), F.col("_max"), F.col(t) >= F.col("_peak")
    first = lambda cond: F.min(F.when(cond, F.col(t)))
    return rows.groupBy(*keys).agg(
        (first(v >= 0.9 * top) - first(v >= 0.1 * top)).cast("double").alias("rise_time"),
        (first(after & (v <= 0.5 * top)) - first(after & (v <= 0.9 * top))).cast("double").alias("decay_time"),
    )


SPECTRUM = ["fft_peak_freq", "fft_energy", "spectral_entropy"]


@F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in SPECTRUM]))
def _spectrum(series: pd.Series) -> pd.DataFrame:
    """Amplitude spectra of whole traces; traces of one length are transformed together."""
    size = series.map(len).to_numpy()
    out = np.empty((len(series), 3))
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        x = np.stack(series.iloc[at].to_list())
        a = np.abs(np.fft.rfft(x - x.mean(axis=1, keepdims=True), axis=1))
        s = a.sum(axis=1, keepdims=True) + 1e-12
        q = a / s + 1e-12
        q /= q.sum(axis=1, keepdims=True)
        # amplitudes equal up to rounding noise count as tied: lowest bin wins
        peak = np.round(a, 9).argmax(axis=1) / n
        out[at] = np.stack([peak, (a * a).sum(axis=1), -(q * np.log(q)).sum(axis=1)], axis=1)
    return pd.DataFrame(out, columns=SPECTRUM)


def trace_spectrum(df, keys, t="t", value="value") -> DataFrame:
    """Peak frequency, energy and entropy of the amplitude spectrum of the mean-removed trace.

    The trace is the sequence of its known values.  A trace that fits one task is
    one array and one fast transform.  Longer ones (above the split limit) are
    transformed in four steps over rows and columns (``distributed_fft``): work is
    length times its logarithm, and a task holds about the root of the length.
    """
    known = df.where(F.col(value).isNotNull())
    hot = hot_groups(known, keys)
    if not hot:
        return _short_spectrum(known, keys, t, value)
    rows = ordered(known, keys, [t], number="_i", totals={"_n": F.count(F.lit(1)), "_m": F.avg(value)}, hot=hot)
    limit = split_rows(df)
    return _short_spectrum(rows.where(F.col("_n") <= limit), keys, t, value).unionByName(
        _long_spectrum(rows.where(F.col("_n") > limit), keys, value, limit)
    )


def _short_spectrum(df, keys, t, value) -> DataFrame:
    series = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(t, F.col(value).cast("double").alias("_v")))).alias("_s"))
    series = series.where(F.size("_s") >= 3).withColumn("_f", _spectrum(F.col("_s._v")))
    return series.select(*keys, "_f.*")


def _row_transform(parts: int):
    """The fast transform of one row of a two-dimensional layout, times the twiddle factors of that row.

    A row is a flat list of (place, re, im, ...) with ``parts`` complex numbers a place; places not listed are zero.
    """

    @F.pandas_udf("array<double>")
    def transform(flat: pd.Series, size: pd.Series, twist: pd.Series, total: pd.Series) -> pd.Series:
        out = []
        for x, n, r, whole in zip(flat, size, twist, total):
            x = np.asarray(x).reshape(-1, 1 + 2 * parts)
            z = np.zeros((parts, n), complex)
            z[:, x[:, 0].astype(np.int64)] = (x[:, 1::2] + 1j * x[:, 2::2]).T
            z = np.fft.fft(z, axis=1) * np.exp(-2j * np.pi * ((r * np.arange(n)) % whole) / whole)
            out.append(np.stack([z.real, z.imag], axis=1).ravel())
        return pd.Series(out)

    return transform


def distributed_fft(rows: DataFrame, keys: list[str], parts: list[tuple[str, str]], i="_i", n1="_n1", n2="_n2") -> DataFrame:
    """The discrete transform of series of n1 * n2 places, four steps over rows and columns of that layout.

    Place j1 + n1 * j2 belongs to row j1; its transform over j2 gives the columns k2, whose transforms over j1 give
    place k2 + n2 * k1. ``n1`` and ``n2`` are columns (one value a key); ``parts`` names re and im of series that are
    transformed together. Absent places are zero. A task holds one row or column, about the root of the length.
    """
    names = [c for p in parts for c in p]
    fixed = list(dict.fromkeys([*keys, n1, n2]))
    transform = _row_transform(len(parts))

    def step(df: DataFrame, row: Column, place: Column, size: str, twisted: bool, then: Column) -> DataFrame:
        cell = F.array(place.cast("double"), *[F.col(c).cast("double") for c in names])
        cells = df.select(*fixed, row.alias("_row"), cell.alias("_cell"))
        lines = cells.groupBy(*fixed, "_row").agg(F.flatten(F.collect_list("_cell")).alias("_cells"))
        twist = F.col("_row") if twisted else F.lit(0).cast("long")
        out = lines.withColumn("_f", transform("_cells", F.col(size), twist, F.col(n1) * F.col(n2)))
        value = lambda k, at: F.get("_f", (k + at * F.col(size)).cast("int"))
        spread = F.transform(F.sequence(F.lit(0).cast("long"), F.col(size) - 1), lambda k: F.struct(k.alias("_k"), *[value(k, at).alias(c) for at, c in enumerate(names)]))
        return out.select(*fixed, "_row", F.explode(spread).alias("_s")).select(*fixed, "_row", "_s.*").withColumn(i, then)

    at = F.col(i)
    columns = step(rows, at % F.col(n1), F.floor(at / F.col(n1)), n2, True, F.col("_k"))
    return step(columns, F.col(i), F.col("_row"), n1, False, F.col("_row") + F.col(n2) * F.col("_k")).select(*fixed, i, *names)


def _long_transform(rows: DataFrame, keys: list[str], value: Column, most: int) -> DataFrame:
    """(keys, _n, _i, _re, _im) of series numbered 0 ... _n - 1 by ``_i``.

    A length that parts into two factors of ``most`` at most is transformed directly; another one as a convolution
    with a chirp at a power of two (both series at once, product, and back).
    """
    divisors = F.filter(F.sequence(F.lit(1).cast("long"), F.floor(F.sqrt("_n")).cast("long")), lambda x: F.col("_n") % x == 0)
    sized = rows.groupBy(*keys).agg(F.first("_n").alias("_n")).withColumn("_n1", F.array_max(divisors)).withColumn("_n2", (F.col("_n") / F.col("_n1")).cast("long"))
    sized = durable(sized)
    same = [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in keys]
    placed = rows.alias("x").join(sized.drop("_n").alias("y"), same).select(*[F.col(f"x.{k}").alias(k) for k in keys], "_n", "_i", value.alias("_re"), "_n1", "_n2")
    fixed = [*keys, "_n"]
    direct = distributed_fft(placed.where(F.col("_n2") <= most).withColumn("_im", F.lit(0.0)), fixed, [("_re", "_im")])

    bits = F.ceil(F.log2(F.lit(2) * F.col("_n"))).cast("int")
    half = F.floor(bits / 2).cast("int")
    power = lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), b)
    chirp = placed.where(F.col("_n2") > most).withColumns({"_n1": power(half), "_n2": power(bits - half)})
    angle = F.pi() * F.pmod(F.col("_i") * F.col("_i"), 2 * F.col("_n")) / F.col("_n")
    c, s, m = F.cos(angle), F.sin(angle), F.col("_n1") * F.col("_n2")
    zero = F.lit(0.0)
    here = F.struct(F.col("_i").alias("_i"), (F.col("_re") * c).alias("a"), (-F.col("_re") * s).alias("b"), c.alias("c"), s.alias("d"))
    mirror = F.struct((m - F.col("_i")).alias("_i"), zero.alias("a"), zero.alias("b"), c.alias("c"), s.alias("d"))
    both = chirp.withColumn("_s", F.explode(F.when(F.col("_i") > 0, F.array(here, mirror)).otherwise(F.array(here)))).select(*fixed, "_n1", "_n2", "_s.*")
    both = distributed_fft(both, fixed, [("a", "b"), ("c", "d")])
    # the inverse transform is the conjugate of the transform of the conjugate
    product = both.select(*fixed, "_n1", "_n2", "_i", F.expr("a * c - b * d").alias("_re"), F.expr("-(a * d + b * c)").alias("_im"))
    back = distributed_fft(product, fixed, [("_re", "_im")]).where("_i < _n")
    back = back.withColumns({"_re": F.col("_re") / m, "_im": -F.col("_im") / m})
    back = back.withColumns({"_re": F.col("_re") * c + F.col("_im") * s, "_im": F.col("_im") * c - F.col("_re") * s})
    return direct.select(*fixed, "_i", "_re", "_im").union(back.select(*fixed, "_i", "_re", "_im"))


def _long_spectrum(rows, keys, value, most: int) -> DataFrame:
    parts = rows.where("_n >= 3").withColumn("_i", F.col("_i").cast("long") - 1)
    bins = _long_transform(parts, keys, F.col(value) - F.col("_m"), most).where("_i <= _n / 2")
    bins = bins.select(*keys, "_n", F.col("_i").alias("_k"), F.sqrt(F.col("_re") * F.col("_re") + F.col("_im") * F.col("_im")).alias("_a"))
    # q = (a / (S + 1e-12) + 1e-12) / (S / (S + 1e-12) + bins * 1e-12)
    tot = with_totals(bins, keys, {"_s": F.sum("_a"), "_bins": F.count(F.lit(1))})
    q = (F.col("_a") / (F.col("_s") + 1e-12) + 1e-12) / (F.col("_s") / (F.col("_s") + 1e-12) + F.col("_bins") * 1e-12)
    return tot.groupBy(*keys).agg(
        (F.max_by("_k", F.struct(F.round("_a", 9), -F.col("_k"))) / F.first("_n")).alias("fft_peak_freq"),
        F.sum(F.col("_a") * F.col("_a")).alias("fft_energy"),
        F.sum(-q * F.log(q)).alias("spectral_entropy"),
    )


def trace_features(df, keys, t="t", value="value", label="is_soz") -> DataFrame:
    """T6-T10 in one table."""
    return (
        trace_summary(df, keys, t, value, label)
        .join(rise_and_decay(df, keys, t, value), keys)
        .join(trace_spectrum(df, keys, t, value), keys, "left")
    )


# ------------------------------------------------------------ pooling, gating
def attention_weights(df, step: list[str], logit="logit") -> DataFrame:
    """Softmax over the channels of a step."""
    out = with_totals(df, step, {"_max": F.max(logit)}).withColumn("_e", F.exp(F.col(logit) - F.col("_max")))
    out = with_totals(out, step, {"_sum": F.sum("_e")})
    return out.withColumn("att", F.col("_e") / F.col("_sum")).drop("_max", "_e", "_sum")


def pool_nodes(df, step: list[str], p="p", node="node_index", att: str | None = None, k_ratio=0.2) -> DataFrame:
    """Mean, max, attention mean, active mean, top-k mean and noisy-or per step."""
    rows = df.where(F.col(p).isNotNull()).withColumn("_p", clip(F.col(p), 0.0, 1.0))
    w = F.greatest(F.lit(0.0), F.col(att)) if att else F.lit(1.0)
    rows = ordered(
        rows.withColumn("_w", w), step, [down("_p"), node],
        number="_r", totals={"_n": F.count(F.lit(1)), "_ws": F.sum("_w")},
    )
    k = F.greatest(F.lit(1), F.ceil(F.lit(k_ratio) * F.col("_n")))
    share = F.col("_w") / (F.col("_ws") + 1e-12) if att else 1 / F.col("_n")
    term = clip(1 - share * F.col("_p"), 1e-6, 1.0)
    active = F.avg(F.when(F.col("_p") > 0, F.col("_p")))
    weighted = F.sum(F.col("_w") * F.col("_p")) / F.nullif(F.sum("_w"), F.lit(0.0))
    return rows.groupBy(*step).agg(
        F.avg("_p").alias("mean"), F.max("_p").alias("max"),
        F.coalesce(weighted, F.avg("_p")).alias("att_mean"),
        F.coalesce(active, F.lit(0.0)).alias("active_mean"),
        F.avg(F.when(F.col("_r") <= k, F.col("_p"))).alias("topk_mean"),
        (1 - F.exp(F.sum(F.log(term)))).alias("noisy_or"),
    )


def persistent_gate(df, seq: list[str], t="t", node="node_index", p="p", k_max_ratio=0.2, k_new_ratio=0.1,
                    k_max: int | None = None, k_new: int | None = None, alpha_stay=0.8, abs_min=0.0) -> DataFrame:
    """Persistent top-k gate over time.

    At each step the former winners stay while p >= max(abs_min, alpha * p of the
    step before), at most K_new others enter, the set is filled to K_max, and the
    step's top K_max are always in.  Those that enter or fill are the first by rank
    besides the ones that stay, so their rank is K_max at most: a channel is on
    exactly if it is among the top K_max, or was on with p > 0 at the sequence's
    step before and may stay.  So each channel is on from a top step until its stay
    breaks, which sums along the channel tell; K_new never changes the outcome.
    """
    clean = df.where(F.col(p).isNotNull()).select(*seq, t, node, clip(F.col(p), 0.0, 1.0).cast("double").alias("p"))
    n = F.col("_n")
    k = F.greatest(F.lit(1).cast("long"), F.ceil(k_max_ratio * n)) if k_max is None else F.lit(k_max).cast("long")
    steps = clean.groupBy(*seq, t).agg(F.count(F.lit(1)).alias("_n"))
    steps = ordered(steps, seq, [t], lag={"_before": F.col(t), "_later": F.lit(True)}).withColumn("_top", F.least(k, n))
    steps = steps.select(*[F.col(c).alias(f"_s_{c}") for c in [*seq, t]], "_before", "_later", "_top")
    ranked = ordered(clean, [*seq, t], [-F.col("p"), node], number="_rank")
    same = [F.col(c).eqNullSafe(F.col(f"_s_{c}")) for c in [*seq, t]]
    rows = ranked.join(steps, same).drop(*[f"_s_{c}" for c in [*seq, t]])
    channel = [*seq, node]
    hot = hot_groups(clean, channel)
    rows = ordered(rows, channel, [t], lag={"_t1": F.col(t), "_p1": F.col("p"), "_seen": F.lit(True)}, hot=hot)
    stays = F.col("_seen") & F.col("_later") & F.col("_t1").eqNullSafe(F.col("_before")) & (F.col("_p1") > 0)
    stays &= F.col("p") >= F.greatest(alpha_stay * F.col("_p1"), F.lit(abs_min))
    rows = ordered(rows, channel, [t], running={"_part": F.when(stays, 0).otherwise(1)}, hot=hot)
    # within a part the channel stays from row to row, so one top step keeps it on from there
    rows = ordered(rows, [*channel, "_part"], [t], running={"_tops": (F.col("_rank") <= F.col("_top")).cast("int")}, hot=None if hot else [])
    gated = F.when(F.col("_tops") > 0, F.col("p")).otherwise(0.0)
    return rows.select(*seq, t, node, gated.alias("p_gated"), (gated > 0).alias("active"))
