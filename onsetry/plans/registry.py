"""Named queries, each with the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DIGITS = 6
NOISE = 9  # a first rounding removes summation noise, so that exact halves round alike


def rounded(df: DataFrame) -> DataFrame:
    """Round floating columns for output, and write -0.0 as 0.0."""
    return df.select(
        *[
            (F.round(F.round(F.col(f"`{f.name}`").cast("double"), NOISE), DIGITS) + F.lit(0.0)).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def r(expr: str, name: str | None = None) -> str:
    """The same rounding in SQL."""
    sql = f"cast(round(cast({expr} as decimal(38, {NOISE})), {DIGITS}) as double) + 0.0"
    return f"{sql} AS {name or expr}"


def query(name: str, sql: str | None = None):
    """Register a query under ``name``; ``sql`` is its independent statement."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: rounded(fn(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return fn

    return wrap
