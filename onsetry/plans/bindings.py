"""How the operators' input tables are read from the driver's tables.

Every binding exists twice: as DataFrame code and as a SQL common table
expression of the same name, used by the oracle statements.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from onsetry.operators.grouped import ordered

GROUP = ["patient", "seizure_id", "seq_idx"]
REC = ["patient", "seizure"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- predictions
PRED = """pred AS (
 SELECT l_suppkey AS patient, l_returnflag AS seizure_id, l_linenumber % 3 AS seq_idx,
  l_partkey AS node_index, l_extendedprice / (SELECT max(l_extendedprice) FROM lineitem) AS y_score,
  CASE WHEN l_quantity >= 45 THEN 1 ELSE 0 END AS is_soz,
  l_linestatus AS run, l_linenumber % 2 AS experiment, l_orderkey AS row_id
 FROM lineitem)"""
NODES = """nodes AS (
 SELECT patient, seizure_id, seq_idx, node_index, max(y_score) AS y_score, max(is_soz) AS is_soz
 FROM pred GROUP BY ALL)"""
RANKED = """ranked AS (
 SELECT *, row_number() OVER (PARTITION BY patient, seizure_id, seq_idx ORDER BY y_score DESC, node_index) AS rank,
  count(*) OVER (PARTITION BY patient, seizure_id, seq_idx) AS n FROM nodes)"""


def predictions(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem")
    top = li.agg(F.max("l_extendedprice")).scalar()
    return li.select(
        F.col("l_suppkey").alias("patient"),
        F.col("l_returnflag").alias("seizure_id"),
        (F.col("l_linenumber") % 3).alias("seq_idx"),
        F.col("l_partkey").alias("node_index"),
        (F.col("l_extendedprice") / top).alias("y_score"),
        (F.col("l_quantity") >= 45).cast("int").alias("is_soz"),
        F.col("l_linestatus").alias("run"),
        (F.col("l_linenumber") % 2).alias("experiment"),
        F.col("l_orderkey").alias("row_id"),
    )


# ---------------------------------------------------------------------- panel
PANEL = """panel AS (
 SELECT user_id % 10 AS patient, event_type AS seizure, user_id AS electrode,
  CAST(extract(day FROM ts) AS INTEGER) AS epoch,
  CASE WHEN extract(day FROM ts) < 21 THEN 'preictal' ELSE 'ictal' END AS phase,
  CASE WHEN user_id % 7 = 0 THEN 1 ELSE 0 END AS is_soz,
  sum(value) AS f_sum, avg(value) AS f_avg, max(value) AS f_max, CAST(count(value) AS DOUBLE) AS f_cnt
 FROM events GROUP BY ALL)"""
FEATS = ["f_sum", "f_avg", "f_max", "f_cnt"]
PANEL_LONG = """plong AS (
 SELECT patient, seizure, electrode, epoch, phase, is_soz, u.feature, u.value FROM panel,
  LATERAL (VALUES ('f_sum', f_sum), ('f_avg', f_avg), ('f_max', f_max), ('f_cnt', f_cnt)) u(feature, value))"""


def panel(spark, d) -> DataFrame:
    day = F.dayofmonth("ts")
    return (
        table(spark, d, "events")
        .groupBy(
            (F.col("user_id") % 10).alias("patient"),
            F.col("event_type").alias("seizure"),
            F.col("user_id").alias("electrode"),
            day.alias("epoch"),
            F.when(day < 21, "preictal").otherwise("ictal").alias("phase"),
            F.when(F.col("user_id") % 7 == 0, 1).otherwise(0).alias("is_soz"),
        )
        .agg(
            F.sum("value").alias("f_sum"),
            F.avg("value").alias("f_avg"),
            F.max("value").alias("f_max"),
            F.count("value").cast("double").alias("f_cnt"),
        )
    )


def panel_long(spark, d) -> DataFrame:
    return panel(spark, d).unpivot(
        ["patient", "seizure", "electrode", "epoch", "phase", "is_soz"], FEATS, "feature", "value"
    )


# --------------------------------------------------------------------- signal
SIGNAL = """sig AS (
 SELECT user_id AS channel, user_id % 10 AS recording, value AS x,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events)"""


def signal(spark, d) -> DataFrame:
    ev = table(spark, d, "events").select("user_id", "ts", "event_id", "value")
    return ordered(ev, ["user_id"], ["ts", "event_id"], number="_n").select(
        F.col("user_id").alias("channel"),
        (F.col("user_id") % 10).alias("recording"),
        F.col("value").alias("x"),
        (F.col("_n") - 1).alias("n"),
    )


def windows_sql(win: int, name: str = "win") -> str:
    return f"""w0 AS (
 SELECT recording, channel, CAST(floor(n / {win}) AS INTEGER) AS epoch, CAST(n % {win} AS INTEGER) AS i, x FROM sig),
{name} AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY channel, epoch) AS c FROM w0) WHERE c = {win})"""


# --------------------------------------------------------------------- traces
TRACE = """trace AS (
 SELECT user_id % 10 AS patient, event_type AS seizure_id, user_id AS node_index,
  CASE WHEN user_id % 7 = 0 THEN 1 ELSE 0 END AS is_soz, value / (1 + value) AS value,
  CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS INTEGER) AS t
 FROM events)"""
NODE = ["patient", "seizure_id", "node_index", "is_soz"]
TGRP = ["patient", "seizure_id"]


def traces(spark, d) -> DataFrame:
    ev = table(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return (
        ordered(ev, ["user_id", "event_type"], ["ts", "event_id"], number="_n")
        .select(
            (F.col("user_id") % 10).alias("patient"),
            F.col("event_type").alias("seizure_id"),
            F.col("user_id").alias("node_index"),
            F.when(F.col("user_id") % 7 == 0, 1).otherwise(0).alias("is_soz"),
            (F.col("value") / (1 + F.col("value"))).alias("value"),
            (F.col("_n") - 1).alias("t"),
        )
    )
