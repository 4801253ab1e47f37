"""Cutting the lineage of a table that several jobs read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is named in ``spark.checkpoint.dir`` (or set on the context, as tests do).  Only in local mode, where there is
    one machine, a temporary folder serves; a cluster without the setting is an error.
    """
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="onsetry-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(at)
    return at


def durable(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Written as Parquet in the shared folder and read back: cut from its lineage and compressed, for tables of many rows."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
