"""Scalar functions on probabilities and parsed text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

LOGIT_EPS = 1e-12


def clip(x: Column, lo: float, hi: float) -> Column:
    """``x`` held to [lo, hi]; null stays null (greatest and least alone would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), x)))


def sigmoid(x: Column) -> Column:
    """1 / (1 + e^-x), written so that neither branch overflows."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def logit(p: Column, eps: float = LOGIT_EPS) -> Column:
    """Log odds with p clipped to [eps, 1 - eps]."""
    q = clip(p, eps, 1 - eps)
    return F.log(q / (1 - q))


def seeded(*cols: Column | str, seed: int) -> Column:
    """A text that orders rows in a seeded random way; any engine with MD5 gives the same order."""
    return F.md5(F.concat_ws("|", *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols], F.lit(str(seed))))


def seeded_number(*cols: Column | str, seed: int, below: int) -> Column:
    """A seeded whole number from 0 to ``below`` - 1."""
    return F.conv(F.substring(seeded(*cols, seed=seed), 1, 7), 16, 10).cast("long") % below


def to_int(text: Column) -> Column:
    """X11: integer or null; decimal text is truncated."""
    return F.coalesce(text.try_cast("bigint"), text.try_cast("double").try_cast("bigint"))


def to_float(text: Column) -> Column:
    """X11: finite double or null."""
    v = text.try_cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(None)).otherwise(v)


def parse_ids(text: Column) -> Column:
    """JSON list of ids to ``array<int>``; null if it is not a list."""
    return F.from_json(text, "array<int>")


def write_ids(ids: Column) -> Column:
    """Array of ids to JSON text."""
    return F.to_json(ids)
