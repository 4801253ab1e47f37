"""Writers.  All of them keep the partitioning of the data; none gathers it."""

from __future__ import annotations

from pyspark.sql import DataFrame

from onsetry.operators.grouped import tasks_for


def write_table(df: DataFrame, path: str, fmt="parquet", partition_by: str | None = None, separator=",", mode="overwrite") -> str:
    """Parquet, ORC, CSV (any separator) or JSON; ``partition_by`` gives one folder per patient.

    The rows are then spread by range over the patient and two more columns, so
    that a patient with most of the rows is written by several tasks.
    """
    writer = df.write
    if partition_by:
        spread = [partition_by, *[c for c in df.columns if c != partition_by][:2]]
        writer = df.repartitionByRange(*spread).write.partitionBy(partition_by)
    writer = writer.mode(mode)
    if fmt == "csv":
        writer.option("header", True).option("sep", separator).csv(path)
    elif fmt in ("parquet", "json", "orc"):
        getattr(writer, fmt)(path)
    else:
        raise ValueError(f"unknown format {fmt}")
    return path


def write_tree(df: DataFrame, root: str, folders: list[str], separator=",", mode="append", rows: int = 0) -> str:
    """A tree of CSV tables with a header each: the last of the ``folders`` columns names the table, the others its folders.

    Calls on one root add to it; columns may differ from call to call. Rows are spread by range over folders and the
    other columns, so that a table with most of the rows is written by several tasks. ``rows``, if known, gives the
    number of tasks; else Spark chooses it by bytes.
    """
    rest = [c for c in df.columns if c not in folders]
    spread = df.repartitionByRange(*[n for n in [tasks_for(df, rows)] if n], *folders, *rest[:2])
    spread.write.partitionBy(*folders).mode(mode).option("header", True).option("sep", separator).csv(root)
    return root
