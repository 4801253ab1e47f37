"""Traces too long for a task: transforms by rows and columns, the gate by runs along a channel."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from onsetry.operators import traces as T


def spectrum(x):
    a = np.abs(np.fft.rfft(x - x.mean()))
    q = a / (a.sum() + 1e-12) + 1e-12
    q /= q.sum()
    return np.round(a, 9).argmax() / len(x), (a * a).sum(), -(q * np.log(q)).sum()


@pytest.mark.parametrize("most", [3, 30])
def test_long_spectra(spark, most):
    """With 3 every length goes by the chirp, with 30 those of balanced factors directly."""
    r = np.random.default_rng(7)
    series = {n: r.normal(size=n) for n in (2, 3, 36, 97, 100, 128, 202)} | {None: r.normal(size=60)}
    rows = [(None if k is None else f"n{k}", 5 * i, float(v)) for k, x in series.items() for i, v in enumerate(x)] + [("n97", 3, None)]
    df = spark.createDataFrame(rows, "k string, t int, value double").repartition(5)
    spark.conf.set("onsetry.splitRows", str(most))
    try:
        got = {x.k: x for x in T.trace_spectrum(df, ["k"]).collect()}
    finally:
        spark.conf.unset("onsetry.splitRows")
    assert set(got) == {None, *[f"n{n}" for n in series if n and n > 2]}
    for k, x in series.items():
        if k != 2:
            g = got[None if k is None else f"n{k}"]
            assert (g.fft_peak_freq, g.fft_energy, g.spectral_entropy) == pytest.approx(spectrum(x), rel=1e-9)


def test_four_steps_are_the_transform(spark):
    r = np.random.default_rng(1)
    z = r.normal(size=(2, 60)) + 1j * r.normal(size=(2, 60))
    z[:, 7] = 0  # a place without a row
    rows = [(i, *(float(v) for s in z for v in (s[i].real, s[i].imag)), 6, 10) for i in range(60) if i != 7]
    df = spark.createDataFrame(rows, "_i long, a double, b double, c double, d double, _n1 long, _n2 long")
    out = sorted(T.distributed_fft(df, [], [("a", "b"), ("c", "d")]).collect(), key=lambda x: x["_i"])
    want = np.fft.fft(z, axis=1)
    assert [x["_i"] for x in out] == list(range(60))
    assert np.allclose([[x.a + 1j * x.b, x.c + 1j * x.d] for x in out], want.T)


def walk(rows, k_ratio, alpha, floor):
    """The recursion as stated: winners stay, some enter, the set is filled, the top is in."""
    out, by = {}, {}
    for s, t, node, p in rows:
        if p is not None:
            by.setdefault(s, {}).setdefault(t, []).append((-min(max(p, 0.0), 1.0), node))
    for s, steps in by.items():
        before = {}
        for t in sorted(steps, key=lambda t: (t is not None, t or 0)):
            line = sorted(steps[t])
            k = max(1, int(np.ceil(k_ratio * len(line))))
            new = int(np.ceil(k_ratio / 2 * len(line)))
            on = {n for p, n in line if n in before and -p >= max(alpha * before[n], floor)}
            rest = [(p, n) for p, n in line if n not in on]
            enter = rest[: min(new, max(0, k - len(on)))]
            on |= {n for p, n in enter if -p >= floor}
            on |= {n for p, n in [x for x in line if x[1] not in on][: max(0, k - len(on))]}
            on |= {n for p, n in line[:k]}
            before = {n: -p for p, n in line if n in on and -p > 0}
            out.update({(s, t, n): (-p if n in on else 0.0) for p, n in line})
    return out


@pytest.mark.parametrize("split", [None, "4"])
def test_gate_with_gaps(spark, split):
    r = np.random.default_rng(11)
    rows = []
    for s in ("a", "b", None):
        for t in [None, *range(12)]:
            for n in range(8):
                if r.random() < 0.8 and not (s == "b" and t == 5):
                    rows.append((s, t, n, None if r.random() < 0.05 else float(np.round(r.random() * 1.4 - 0.2, 1))))
    df = spark.createDataFrame(rows, "s string, t int, node_index int, p double").repartition(4)
    if split:
        spark.conf.set("onsetry.splitRows", split)
    try:
        for floor in (0.0, 0.3):
            got = {(x.s, x.t, x.node_index): x.p_gated for x in T.persistent_gate(df, ["s"], alpha_stay=0.7, abs_min=floor).collect()}
            assert got == pytest.approx(walk(rows, 0.2, 0.7, floor))
    finally:
        spark.conf.unset("onsetry.splitRows")
