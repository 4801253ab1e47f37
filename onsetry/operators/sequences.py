"""Onset-aligned sequences of windows.

Positions run over a recording: preictal windows first, so the onset is at
``n_pre``.  Which sequences exist follows from ``n_pre`` and ``n`` by
arithmetic; a sequence is a span ``(seq_id, lo, len)``.  Rows then pick the spans
that cover them, so no recording is gathered.  Arrays of paths are built only
for spans of bounded length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from onsetry.functions.scalars import seeded
from onsetry.operators.grouped import numbered, ordered, with_totals

SPAN = "array<struct<seq_id:int,lo:int,len:int>>"


def relative_time(df, rec: list[str], phase="phase", epoch="epoch") -> DataFrame:
    """Q1: position in the recording and time relative to the first ictal window."""
    pre = F.col(phase) == "preictal"
    out = ordered(
        df.where(F.col(phase).isin("preictal", "ictal")), rec, [F.when(pre, 0).otherwise(1), epoch],
        number="_n1", totals={"n": F.count(F.lit(1)), "n_pre": F.count(F.when(pre, 1))},
    ).withColumns({"n": F.col("n").cast("int"), "n_pre": F.col("n_pre").cast("int")})
    pos = (F.col("_n1") - 1).cast("int")
    return out.withColumn("pos", pos).withColumn("t_rel", F.col("pos") - F.col("n_pre")).drop("_n1")


def _span(seq_id, lo, length) -> Column:
    return F.struct(
        F.lit(seq_id).cast("int").alias("seq_id") if not isinstance(seq_id, Column) else seq_id.cast("int").alias("seq_id"),
        lo.cast("int").alias("lo"), length.cast("int").alias("len"),
    )


def _only_if(cond: Column, span: Column) -> Column:
    return F.when(cond, F.array(span)).otherwise(F.array().cast(SPAN))


def crosses_onset() -> Column:
    return (F.col("n_pre") > 0) & (F.col("n") > F.col("n_pre"))


def sliding_spans(L: int, S: int, keep_short=False, min_short=1, ictal: tuple[int, int] | None = None) -> Column:
    """Q2, and Q3 with ``ictal``: starts i = 0, S, 2S, ... whose window crosses the onset.

    Only starts in (n_pre - L, n_pre) can hold both phases, so the list is
    bounded by L / S.  ``ictal`` limits the number of ictal windows.
    """
    stride = max(1, min(S, L // 2))
    n, pre = F.col("n"), F.col("n_pre")
    lo_need, hi_need = (1, L - 1) if ictal is None else (max(1, ictal[0]), min(L - 1, ictal[1]))
    # ictal windows in the sequence: i + L - n_pre
    first = F.greatest(F.lit(0), pre - L + lo_need)
    first = (F.ceil(first / stride) * stride).cast("int")
    last = F.least(n - L, pre - L + hi_need, pre - 1)
    starts = F.when(first <= last, F.sequence(first, F.greatest(first, last), F.lit(stride))).otherwise(F.array().cast("array<int>"))
    spans = F.transform(starts, lambda i: _span((i / stride), i, F.lit(L)))
    short_ok = crosses_onset() if ictal is None else crosses_onset() & (n - pre).between(*ictal)
    short = _only_if(short_ok & (n >= min_short) & F.lit(keep_short), _span(0, F.lit(0), n))
    return F.when(n < L, short).when(crosses_onset(), spans).otherwise(F.array().cast(SPAN))


def adaptive_spans(pre_target=10, post_target=10, min_total=8, exact: int | None = None,
                   ictal: tuple[int, int] | None = None, seq_id=0) -> Column:
    """Q4: one span around the onset; what one side lacks the other side adds if it can."""
    n, onset = F.col("n"), F.col("n_pre")
    right = n - 1 - onset
    pre, post = F.least(F.lit(pre_target), onset), F.least(F.lit(post_target), right)
    post2 = F.when(pre < pre_target, post + F.greatest(F.lit(0), F.least(pre_target - pre, right - post))).otherwise(post)
    pre2 = F.when(post < post_target, pre + F.greatest(F.lit(0), F.least(post_target - post, onset - pre))).otherwise(pre)
    lo = F.greatest(F.lit(0), onset - pre2)
    hi = F.least(n, onset + post2 + 1)
    ok = crosses_onset() & (hi - lo >= min_total)
    if exact is not None:
        ok &= hi - lo == exact
    if ictal is not None:
        ok &= (hi - onset).between(*ictal)
    return _only_if(ok, _span(seq_id, lo, hi - lo))


def centered_spans(controlled: tuple[int, int] | None = None, seq_id=0) -> Column:
    """Q5: ``(n_pre, n_ictal)`` windows if available, else the longest symmetric span."""
    n, onset = F.col("n"), F.col("n_pre")
    if controlled is not None:
        a, b = controlled
        ok = crosses_onset() & F.lit(a > 0 and b > 0) & (onset - a >= 0) & (onset + b - 1 < n)
        return _only_if(ok, _span(seq_id, onset - a, F.lit(a + b)))
    k = F.least(onset, n - onset - 1)
    return _only_if(crosses_onset() & (k > 0), _span(seq_id, onset - k, 2 * k + 1))


def offset_spans(controlled: tuple[int, int] | int | None = None) -> Column:
    """Q6: three spans of one length with the onset at 25, 50 and 75 %.

    With a free length the longest feasible one solves
    floor(3(L-1)/4) <= n_pre and L - floor((L-1)/4) <= n_ictal.
    """
    n, pre = F.col("n"), F.col("n_pre")
    ict = n - pre
    if isinstance(controlled, tuple):
        length, p50 = F.lit(sum(controlled)), F.lit(controlled[0])
    elif controlled is not None:
        length, p50 = F.lit(int(controlled)), F.lit((int(controlled) - 1) // 2)
    else:
        by_pre = F.ceil((pre + 1) * 4 / 3)
        by_ict = F.floor(4 * (ict - 1) / 3) + 1
        length = F.least(by_pre, by_ict, 2 * F.least(pre, ict - 1) + 1).cast("int")
        p50 = F.floor((length - 1) / 2).cast("int")
    p25 = F.floor((length - 1) / 4).cast("int")
    p75 = F.floor(3 * (length - 1) / 4).cast("int")
    ok = (pre > 0) & (ict > 1) & (length >= 3)
    for p in (p25, p50, p75):
        ok &= (p >= 1) & (p <= length - 2) & (p <= pre) & (length - p <= ict)
    spans = F.array(*[_span(i, pre - p, length) for i, p in enumerate((p25, p50, p75))])
    return F.when(ok, spans).otherwise(F.array().cast(SPAN))


def items(timeline: DataFrame, spans: Column) -> DataFrame:
    """Rows of every sequence: ``seq_id``, ``lo``, ``len`` and the step inside it."""
    covered = timeline.withColumn("_spans", spans).withColumn(
        "_s",
        F.explode(F.filter("_spans", lambda s: (F.col("pos") >= s["lo"]) & (F.col("pos") < s["lo"] + s["len"]))),
    )
    return covered.select(
        *timeline.columns, F.col("_s.seq_id").alias("seq_id"), F.col("_s.lo").alias("lo"), F.col("_s.len").alias("len"),
        (F.col("pos") - F.col("_s.lo")).alias("step"),
    )


def path_arrays(rows: DataFrame, keys: list[str], path="path", phase="phase") -> DataFrame:
    """Bounded sequences as arrays of paths and phases, in step order."""
    arr = rows.groupBy(*keys, "seq_id").agg(
        F.sort_array(F.collect_list(F.struct("step", path, phase))).alias("_a")
    )
    return arr.select(
        *keys, "seq_id", F.transform("_a", lambda x: x[path]).alias("paths"),
        F.transform("_a", lambda x: x[phase]).alias("phases"),
    )


def has_both(phases="phases") -> Column:
    """Q7 on a sequence: a preictal and an ictal window are present."""
    return F.array_contains(phases, "preictal") & F.array_contains(phases, "ictal")


def path_has_phase(path: Column, phase: str) -> Column:
    """Q7: the phase is an exact path segment."""
    return F.array_contains(F.split(F.lower(path), r"[\\/]+"), phase)


def split_has_both(rows, keys: list[str], phase="phase") -> DataFrame:
    """Q7 on a split: some sequence item of each phase exists."""
    return rows.groupBy(*keys).agg(
        (F.bool_or(F.col(phase) == "preictal") & F.bool_or(F.col(phase) == "ictal")).alias("both_phases")
    )


def deduplicate(seqs, keys: list[str], paths="paths", order="seq_id") -> DataFrame:
    """Q8: equal path lists of a split keep the first sequence."""
    rest = [c for c in seqs.columns if c not in (*keys, paths, order)]
    best = seqs.groupBy(*keys, paths).agg(F.min(F.struct(order, *rest)).alias("_b"))
    return best.select(*keys, paths, *[F.col(f"_b.{c}").alias(c) for c in (order, *rest)])


def patient_summary(seqs, recordings, min_recordings: int, patient="patient", split="split", recording="seizure",
                    splits=("train", "test")) -> DataFrame:
    """Q9: patients with enough recordings and both phases in every split, with counts."""
    n_rec = recordings.groupBy(patient).agg(F.count_distinct(recording).alias("n_seizures"))
    per = seqs.groupBy(patient).agg(*[
        agg for s in splits for agg in (
            F.count(F.when(F.col(split) == s, 1)).alias(f"n_{s}_seqs"),
            (F.coalesce(F.bool_or(F.when(F.col(split) == s, F.array_contains("phases", "preictal"))), F.lit(False))
             & F.coalesce(F.bool_or(F.when(F.col(split) == s, F.array_contains("phases", "ictal"))), F.lit(False))
             ).alias(f"_ok_{s}"),
        )
    ])
    ok = F.lit(True)
    for s in splits:
        ok &= F.col(f"_ok_{s}")
    return (
        n_rec.where(F.col("n_seizures") >= min_recordings).join(per.where(ok), patient)
        .drop(*[f"_ok_{s}" for s in splits])
    )


def all_in_train(seqs, keys: list[str], paths="paths", split="split") -> DataFrame:
    """Q10: every split becomes train; equal sequences are kept once."""
    return seqs.withColumn(split, F.lit("train")).select(*keys, split, paths).dropDuplicates([*keys, paths])


def middle_sequences(seqs, rec: list[str], order="seq_id", chunks_of_three=True) -> DataFrame:
    """Q11: the middle of every chunk of three if n divides by 3, else index n // 2."""
    rows = ordered(seqs, rec, [order], number="_r", totals={"_n": F.count(F.lit(1))})
    r, n = F.col("_r") - 1, F.col("_n")
    mid = r == F.floor(n / 2)
    keep = F.when(n % 3 == 0, r % 3 == 1).otherwise(mid) if chunks_of_three else mid
    return rows.where(keep).drop("_r", "_n")


def first_sequences(seqs, rec: list[str], order="seq_id") -> DataFrame:
    """Q12: the first sequence of a recording; the rank filter runs before the shuffle."""
    return numbered(seqs, rec, [order], "_r", hot=[]).where("_r = 1").drop("_r")


def random_sequence(seqs, rec: list[str], seed: int, order="seq_id") -> DataFrame:
    """Q13: one seeded choice per recording."""
    return numbered(seqs, rec, [seeded(*rec, order, seed=seed), order], "_r", hot=[]).where("_r = 1").drop("_r")


def covering_windows(seq_info: DataFrame, rec: list[str], steps_pre: int, steps_post: int) -> DataFrame:
    """Q14 selection: the sequence covering most of [onset - pre, onset + post]; ties take the first.

    ``seq_info`` has one row per sequence with ``seq_id``, ``t_true`` and ``len``.
    """
    t0 = F.greatest(F.lit(0), F.col("t_true") - steps_pre)
    t1 = F.least(F.col("len") - 1, F.col("t_true") + steps_post)
    cand = seq_info.where(F.col("t_true").isNotNull()).withColumns({"t0": t0, "t1": t1}).where("t1 > t0")
    best = cand.groupBy(*rec).agg(
        F.min(F.struct((F.col("t0") - F.col("t1")).alias("_c"), "seq_id", "t0", "t1", "t_true")).alias("_b")
    )
    return best.select(*rec, *[F.col(f"_b.{c}").alias(c) for c in ("seq_id", "t0", "t1", "t_true")])


def centered_window_rows(node_traces, seq_info, onsets, rec: list[str], steps_pre: int, steps_post: int) -> DataFrame:
    """Q14: channel rows inside the chosen window with relative time and true/predicted state.

    ``onsets`` has the predicted onset per recording and sequence, relative to the
    window start; -1 means none.
    """
    best = covering_windows(seq_info, rec, steps_pre, steps_post)
    rows = node_traces.join(best, [*rec, "seq_id"]).where((F.col("t") >= F.col("t0")) & (F.col("t") <= F.col("t1")))
    rows = rows.join(onsets.select(*rec, "seq_id", "t_onset"), [*rec, "seq_id"], "left")
    hit = (F.col("t_onset") >= 0) & (F.col("t") - F.col("t0") >= F.col("t_onset"))
    return rows.withColumns({
        "t_rel": F.col("t") - F.col("t_true"),
        "true_ictal": (F.col("t") >= F.col("t_true")).cast("int"),
        "pred_ictal": F.coalesce(hit, F.lit(False)).cast("int"),
    })


def align_steps(rows, batch: list[str], seq="seq_id", phase="phase") -> DataFrame:
    """Q15: step t of a batch holds the sequences longer than t, with their 0/1 label.

    Long form: one row per (batch, step, sequence) and the number present.
    """
    out = with_totals(rows, [*batch, "step"], {"n_present": F.count(F.lit(1))})
    return out.withColumn("y", (F.col(phase) == "ictal").cast("int")).select(*batch, "step", seq, "y", "n_present")


def report(rows, keys: list[str], phase="phase") -> DataFrame:
    """Q16: length, onset step and onset position in percent of length - 1."""
    out = rows.groupBy(*keys, "seq_id").agg(
        F.count(F.lit(1)).alias("length"), F.min(F.when(F.col(phase) == "ictal", F.col("step"))).alias("onset_idx")
    )
    return out.withColumn("onset_pct", 100.0 * F.col("onset_idx") / F.greatest(F.lit(1), F.col("length") - 1))
