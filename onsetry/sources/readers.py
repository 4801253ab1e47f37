"""Readers for the file layouts of recordings, features, edges, series and predictions.

Each reader is one scan over a directory tree; metadata comes from the file path
as columns.  Every CSV file is read by its own header, so files of one tree may
differ in columns and in their order; files are split by bytes, whatever their size.  NaN and infinities become null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from onsetry.functions import strings as X
from onsetry.functions.scalars import to_int
from onsetry.operators.lineage import durable
from onsetry.operators.normalize import finite

# fixed values: metric name in a file name -> accepted value columns, standard column
EDGE_VALUES = {
    "corr": (["pearson_r", "corr", "r"], "pearson_r"),
    "psi": (["psi"], "psi"),
    "granger": (["granger_f", "granger", "gc", "granger_stat"], "granger_f"),
    "coh1245": (["coh_12_45", "coh"], "coh_12_45"),
    "psi1245": (["psi_12_45", "psi"], "psi_12_45"),
}
# fixed values: accepted column names of a node map
NODE_MAP_NAMES = {
    "node_index": ("node_index", "electrode_id"),
    "electrode_name": ("electrode_name", "name"),
    "is_soz": ("is_SOZ", "soz"),
}


def nan_to_null(df: DataFrame) -> DataFrame:
    return df.withColumns({
        f.name: finite(f"`{f.name}`") for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    })


def load_table(spark: SparkSession, path: str, **options) -> DataFrame:
    """Parquet, JSON or CSV by extension."""
    if path.endswith((".parquet", ".pq")):
        return nan_to_null(spark.read.parquet(path))
    if path.endswith((".json", ".jsonl")):
        return nan_to_null(spark.read.json(path))
    opts = {"header": True, "inferSchema": True, "nanValue": "nan", **options}
    return nan_to_null(spark.read.options(**opts).csv(path))


def clean_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Trim the string key columns."""
    strings = [f.name for f in df.schema.fields if f.name in keys and isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.trim(c) for c in strings})


MOST_HEADS = 50_000  # so many headers go to every task; more are joined by shuffle
UNQUOTED = r'(?=(?:[^"]*"[^"]*")*[^"]*$)'  # a separator followed by whole quotes only


def name_pattern(glob: str) -> str:
    """A file name glob (``*``, ``?``, ``[...]``, ``{a,b}``) as a regular expression."""
    out = ""
    for part in re.findall(r"\[[^]]*\]|\{[^}]*\}|.", glob):
        if part[0] == "{":
            out += "(" + "|".join(re.escape(x) for x in part[1:-1].split(",")) + ")"
        else:
            out += part if part[0] == "[" else {"*": "[^/]*", "?": "[^/]"}.get(part, re.escape(part))
    return f"^{out}$"


def table_path(path: Column) -> Column:
    """The path of the table a file belongs to: a folder of part files stands for one file of that name.

    Spark writes a table as such a folder; the ``key=`` before the name of a partition folder is left out.
    """
    whole = F.regexp_replace(F.regexp_replace(path, r"^file:/+", "/"), r"/part-[^/]*$", "")
    return F.regexp_replace(whole, r"/[A-Za-z_][A-Za-z0-9_]*=([^/]+)", "/$1")


def run_starts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows that follow each other in a task with the same ``keys``, the first: few rows, found without sorting."""

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if batch.num_rows:
                cols = [batch.column(k) for k in keys]
                new = reduce(pc.or_, [pc.not_equal(c[1:], c[:-1]) for c in cols])
                yield batch.filter(pa.concat_arrays([pa.array([[c[0].as_py() for c in cols] != last]), new]))
                last = [c[-1].as_py() for c in cols]

    return rows.mapInArrow(starts, rows.schema)


def csv_rows(spark, root: str, glob: str, comment: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Lines and headers of the CSV files whose name fits ``glob``: (_file, value) and (_file, file_path, path, header, separator, first).

    Files are read by byte ranges, so neither a file nor a tree needs to fit anywhere. The header is the first line of
    a file that is neither blank nor a ``comment``; headers are one row per file, stored once. Lines equal to their
    file's header repeat it and are no rows; a quoted cell ends on its line. ``path`` is the table's (``table_path``).
    """
    raw = spark.read.option("recursiveFileLookup", True).text(root)
    skip = F.trim("value") == ""
    if comment:
        skip |= F.startswith(F.col("value"), F.lit(comment))
    cols = [F.col("_metadata.file_path").alias("_file"), F.rtrim("value").alias("value")]
    lines = raw.where(~skip).select(*cols)
    placed = raw.where(~skip).select(*cols, F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    # a task reads the lines of a block in order, so only the first of them can be the first of its file
    first = run_starts(placed, ["_file", "_block"]).groupBy("_file").agg(F.min_by("value", F.struct("_block", "_id")).alias("first"))
    # names are looked at once a file, not once a line
    first = first.withColumn("file_path", X.decoded_path(F.col("_file"))).withColumn("path", table_path(F.col("file_path")))
    first = first.where(X.file_name(F.col("path")).rlike(name_pattern(glob)))
    count = lambda c: F.length(F.regexp_replace("first", f"[^{c}]", ""))
    sep = F.when((count(";") > count(",")) & (count(";") >= count("\t")), ";").when(count("\t") > count(","), "\t").otherwise(",")
    heads = durable(first.withColumn("separator", sep).withColumn("header", cells_of(F.col("first"), F.col("separator"))))
    return lines, heads


def cells_of(line: Column, separator: Column) -> Column:
    """The trimmed cells of a line, without the quotes around them."""
    plain = F.split(line, separator, -1)
    parts = F.when(F.contains(line, F.lit('"')), F.split(line, F.concat(separator, F.lit(UNQUOTED)), -1)).otherwise(plain)
    bare = ~F.contains(line, F.lit('"')) & ~F.contains(line, F.lit(" "))
    return F.when(bare, plain).otherwise(F.transform(parts, lambda c: F.regexp_replace(F.trim(c), '^"(.*)"$', "$1")))


def with_headers(lines: DataFrame, heads: DataFrame) -> DataFrame:
    """The rows of the files in ``heads``, with their columns and ``_cells``; a file's lines need not meet in one task."""
    few = F.broadcast(heads) if heads.count() <= MOST_HEADS else heads
    rows = lines.join(few, "_file").where(F.col("value") != F.col("first"))
    return rows.withColumn("_cells", cells_of(F.col("value"), F.col("separator"))).drop("value", "_file")


def cell(cells: Column, header: Column, name: str) -> Column:
    """The cell under ``name``; null if the file has no such column or the line is short."""
    at = F.array_position(header, name)
    return F.when(at > 0, F.get(cells, (at - 1).cast("int")))


def csv_lines(lines: DataFrame, heads: DataFrame, kinds: dict[str, str] | None = None, other: str = "string", keep: tuple = ()) -> DataFrame:
    """All lines, columns matched by name over all headers; ``kinds`` gives types by name, ``other`` that of the rest.

    ``keep`` names columns of ``heads`` to carry along.
    """
    names = sorted(r[0] for r in heads.select(F.explode("header")).distinct().collect())  # as many as there are names
    cast = {n: (kinds or {}).get(n, other) for n in names}
    typed = [cell(F.col("_cells"), F.col("header"), n) for n in names]
    return with_headers(lines, heads).select(
        "file_path", *keep, *[(c if cast[n] == "string" else c.try_cast(cast[n])).alias(n) for n, c in zip(names, typed)]
    )


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def tag_node_files(df: DataFrame, root: str, path="file_path") -> DataFrame:
    """S3 + S4: directory metadata first, file name second; rows of unmatched names are dropped."""
    return _tagged(df, root, path).where("_parts is not null").drop("_parts")


def _tagged(df: DataFrame, root: str, path: str) -> DataFrame:
    p = F.regexp_replace(F.col(path), r"^file:/+", "/")
    # split the path once; the columns below read the arrays
    df = df.withColumn("_path", p).withColumns({
        "_dirs": X.directory_parts(F.col("_path"), root), "_parts": X.node_name_parts(X.file_name(F.col("_path"))),
    })
    d = X.directory_metadata(F.col("_dirs"))
    n = X.file_metadata(F.col("_parts"))
    return df.withColumns({
        "dataset": d["dataset"], "outcome": d["outcome"], "phase": F.coalesce(d["phase"], n["phase"]),
        "patient": F.coalesce(d["patient"], n["patient"]), "seizure": n["seizure"], "epoch": n["epoch"], "is_avg": n["is_avg"],
    }).drop("_path", "_dirs")


def collect_node_features(spark, root: str, glob="*{znorm,normpre}.csv", kinds: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Normalised node files, united by column name; and the files whose names do not fit.

    The first, unnamed column is the channel; others are numbers unless ``kinds`` says otherwise.
    """
    lines, heads = csv_rows(spark, root, glob)
    heads = _tagged(heads, root, "path")
    named = F.concat(F.array(F.lit("electrode")), F.slice("header", F.lit(2), F.greatest(F.size("header") - 1, F.lit(0))))
    good = heads.where("_parts is not null").withColumn("header", named)
    tags = ("dataset", "outcome", "phase", "patient", "seizure", "epoch", "is_avg")
    return nan_to_null(csv_lines(lines, good, {"electrode": "string", **(kinds or {})}, "double", tags)), heads.where("_parts is null").select("file_path")


def value_column(df: DataFrame, aliases: list[str], keys=("source", "target")) -> str:
    """First alias present, else the first numeric column."""
    for a in aliases:
        if a in df.columns:
            return a
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in keys]
    if not numeric:
        raise ValueError(f"no value column among {df.columns}")
    return numeric[0]


def value_positions(lines: DataFrame, heads: DataFrame, keys=("source", "target")) -> DataFrame:
    """S5 per file: ``heads`` with ``_at``, the position (from 0) of the first of its ``_aliases`` in the header, else of
    the first column, keys apart, that holds numbers or nothing in every row; null without one."""
    at = F.get(F.filter(F.transform("_aliases", lambda a: F.array_position("header", a)), lambda i: i > 0), F.lit(0)) - 1
    heads = heads.withColumn("_alias", at.cast("int"))
    rows = with_headers(lines, heads.where("_alias is null and _aliases is not null"))
    number = lambda c: c.isNull() | (c == "") | c.try_cast("double").isNotNull()
    each = rows.select("file_path", "_cells", F.posexplode("header").alias("i", "_name")).where(~F.col("_name").isin(*keys))
    free = each.groupBy("file_path", "i").agg(F.bool_and(number(F.get("_cells", "i"))).alias("ok"))
    free = free.where("ok").groupBy("file_path").agg(F.min("i").alias("_free"))
    return heads.join(free, "file_path", "left").withColumn("_at", F.coalesce("_alias", "_free")).drop("_alias", "_free")


def collect_edge_features(spark, root: str, metrics=tuple(EDGE_VALUES)) -> tuple[DataFrame, DataFrame]:
    """Edge files as one long table; and the files without end points, values or a fitting name.

    Matrix, adjacency and Laplacian files are no edge files and are passed over.
    """
    lines, heads = csv_rows(spark, root, "*_EDGE_*.csv")
    heads = heads.where(~X.ignored_edge_file(X.file_name(F.col("path")))).withColumn("_parts", X.edge_name_parts(X.file_name(F.col("path"))))
    d = X.directory_metadata(X.directory_parts(F.col("path"), root), X.EDGE_FOLDER)
    n = X.file_metadata(F.col("_parts"), edge=True)
    heads = heads.withColumn("_metric", n["feature"]).where(F.col("_metric").isin(*metrics) | F.col("_parts").isNull())
    aliases, std = F.lit(None).cast("array<string>"), F.lit(None).cast("string")
    for m in metrics:
        aliases = F.when(F.col("_metric") == m, F.array(*map(F.lit, EDGE_VALUES[m][0]))).otherwise(aliases)
        std = F.when(F.col("_metric") == m, EDGE_VALUES[m][1]).otherwise(std)
    heads = heads.select(
        "_file", "file_path", "first", "separator", "header", "_metric", "_parts", d["dataset"].alias("dataset"), d["outcome"].alias("outcome"),
        F.coalesce(d["phase"], n["phase"]).alias("phase"), F.coalesce(d["patient"], n["patient"]).alias("patient"),
        n["seizure"].alias("seizure"), n["epoch"].alias("epoch"), n["is_avg"].alias("is_avg"))
    ends = F.array_contains("header", "source") & F.array_contains("header", "target") & F.col("_parts").isNotNull()
    heads = durable(value_positions(lines, heads.withColumns({"_aliases": aliases, "_std": std, "_ok": F.coalesce(ends, F.lit(False))})))
    rows = with_headers(lines, heads.where("_ok and _at is not null"))
    end = lambda k: cell(F.col("_cells"), F.col("header"), k).alias(k)
    edges = rows.select(
        "dataset", "outcome", "phase", "patient", "seizure", "epoch", "is_avg", end("source"), end("target"), F.col("_std").alias("feature"),
        F.get("_cells", F.col("_at")).try_cast("double").alias("value"), "file_path",
    )
    return nan_to_null(edges), heads.where("not _ok or _at is null").select("file_path")


def list_paths(spark, root: str, glob="*") -> DataFrame:
    """Paths of a tree; file contents are not read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return df.select(F.regexp_replace("path", r"^file:/+", "/").alias("path"))


def recording_triplets(paths: DataFrame, path="path") -> tuple[DataFrame, DataFrame]:
    """Signal, events and channels file of the same subject and run; and the incomplete runs."""
    name = X.file_name(F.col(path))
    kind = F.when(F.lower(name).endswith(".edf"), "signal").when(F.lower(name).endswith("_events.tsv"), "events").when(
        F.lower(name).endswith("_channels.tsv"), "channels")
    runs = paths.select(
        F.nullif(F.regexp_extract(path, r"(sub-[A-Za-z0-9]+)", 1), F.lit("")).alias("subject"),
        F.nullif(F.regexp_extract(name, r"(?i)_run-(\d{2})", 1), F.lit("")).alias("run"), kind.alias("kind"), F.col(path).alias("p"),
    ).where("run is not null and kind is not null")
    wide = runs.groupBy("subject", "run").agg(*[
        F.min(F.when(F.col("kind") == k, F.col("p"))).alias(f"{k}_path") for k in ("signal", "events", "channels")])
    whole = "signal_path is not null and events_path is not null and channels_path is not null"
    return wide.where(whole), wide.where(f"not ({whole})")


def participants(df: DataFrame, ident="participant_id", code="outcome", exclude: list[str] | None = None) -> DataFrame:
    """Trimmed ids; S is a good and F a bad outcome, anything else is unknown."""
    c = F.upper(F.trim(F.col(code)))
    out = df.select(F.trim(ident).alias(ident), F.when(c == "S", "good outcome").when(c == "F", "bad outcome").alias("outcome"))
    return out.where(~F.col(ident).isin(*exclude)) if exclude else out


def recording_bounds(events: DataFrame, recording="recording", kind="trial_type", time="onset", order: str | None = None) -> DataFrame:
    """First ``sz onset`` and ``sz offset`` of a recording; null unless finite and ordered."""
    k = F.lower(F.trim(F.col(kind)))
    t = finite(time)
    pick = lambda name: F.min_by(t, F.when(k == name, F.col(order or time)))
    b = events.groupBy(recording).agg(pick("sz onset").alias("on"), pick("sz offset").alias("off"))
    ok = F.col("on").isNotNull() & F.col("off").isNotNull() & (F.col("off") > F.col("on"))
    return b.select(recording, F.when(ok, F.col("on")).alias("onset"), F.when(ok, F.col("off")).alias("offset"))


def good_channels(channels: DataFrame, recorded: DataFrame, keys: list[str], status="status") -> DataFrame:
    """Channels marked good that were recorded."""
    good = channels.where(F.lower(F.trim(F.col(status))) == "good").select(*keys).distinct()
    return recorded.join(good, keys, "left_semi")


def without_bad_channels(recorded: DataFrame, bad: DataFrame, keys: list[str]) -> DataFrame:
    """Recorded channels minus the listed bad ones."""
    return recorded.join(bad, keys, "left_anti")


def recordings_of_phase(paths: DataFrame, phase: str, path="path") -> DataFrame:
    """Distinct recording numbers named in the file names of a phase."""
    num = F.nullif(F.regexp_extract(X.file_name(F.col(path)), rf"(?i)_{phase}_(\d+)", 1), F.lit(""))
    return paths.select(num.try_cast("int").alias("seizure")).where("seizure is not null").distinct()


def series_files(paths: DataFrame, path="path") -> DataFrame:
    """Series files with the node map of the same stem, if there is one."""
    name = X.file_name(F.col(path))
    is_map = F.lower(name).rlike(r"_nodes\.csv$")
    rec, seq = X.series_file(name)
    folder = F.regexp_replace(F.col(path), r"/[^/]*$", "")
    rows = paths.select(folder.alias("folder"), rec.alias("seizure_id"), seq.alias("seq_idx"), is_map.alias("m"), F.col(path).alias("p")).where(
        "seizure_id is not null")
    return rows.groupBy("folder", "seizure_id", "seq_idx").agg(
        F.min(F.when(~F.col("m"), F.col("p"))).alias("data_path"), F.min(F.when(F.col("m"), F.col("p"))).alias("nodes_path"),
    ).where("data_path is not null")


def wide_to_long(wide: DataFrame, ids: list[str], node_map: DataFrame | None = None, map_keys: list[str] | None = None) -> DataFrame:
    """``node_044:NAME`` columns to rows; the node map, if given, overrides the name and adds the label."""
    cols = [c for c in wide.columns if c.startswith("node_")]
    typed = wide.select(*ids, *[F.expr(f"try_cast(`{c}` as double)").alias(c) for c in cols])
    long = typed.unpivot(ids, cols, "_c", "value")
    idx, name = X.node_column(F.col("_c"))
    long = long.select(*ids, idx.alias("node_index"), name.alias("electrode_name"), finite("value").alias("value"))
    if node_map is None:
        return long
    keys = [*(map_keys or []), "node_index"]
    m = node_map.select(*keys, F.col("electrode_name").alias("_n"), "is_soz")
    out = long.join(m, keys, "left")
    return out.withColumn("electrode_name", F.coalesce("_n", "electrode_name")).drop("_n")


def read_series(spark, root: str, glob="seiz_*_seq_*[0-9].csv") -> DataFrame:
    """Every series file by its own header, comment lines skipped, in long form."""
    lines, heads = csv_rows(spark, root, glob, comment="#")
    rec, seq = X.series_file(X.file_name(F.col("path")))
    rows = with_headers(lines, heads.withColumns({"_rec": rec, "_seq": seq}))
    step = cell(F.col("_cells"), F.col("header"), "t").try_cast("int")
    pairs = F.explode(F.filter(F.arrays_zip(F.col("header").alias("k"), F.col("_cells").alias("v")), lambda x: F.startswith(F.lower(x["k"]), F.lit("node_"))))
    long = rows.select("file_path", F.col("_rec").alias("seizure_id"), F.col("_seq").alias("seq_idx"), step.alias("t"), pairs.alias("_c"))
    idx, name = X.node_column(F.col("_c.k"))
    return nan_to_null(long.select(
        "file_path", "seizure_id", "seq_idx", "t", idx.alias("node_index"), name.alias("electrode_name"), F.col("_c.v").try_cast("double").alias("value")))


def node_map(df: DataFrame, keys: list[str] | None = None, names: dict[str, tuple] | None = None) -> DataFrame:
    """Node map by accepted column names (``names`` adds others); rows without an index are dropped.

    Raises without an index or a name column; a missing label column gives null labels.
    """
    out: list[Column] = []
    for std, accepted in NODE_MAP_NAMES.items():
        known = [*accepted, *(names or {}).get(std, ())]
        found = next((n for n in known if n in df.columns and n not in (keys or [])), None)
        if found is None and std != "is_soz":
            raise ValueError(f"no column for {std} among {df.columns}; one of {known} is needed")
        c = F.col(found).cast("string") if found else F.lit(None).cast("string")
        out.append((c if std == "electrode_name" else to_int(c).try_cast("int")).alias(std))
    return df.select(*(keys or []), *out).where("node_index is not null")


def header_metadata(lines: DataFrame, keys: list[str], names: list[str], line="value") -> DataFrame:
    """``#key,value`` lines to one row per file."""
    t = F.regexp_extract(line, r"^#\s*([^,]+),(.*)$", 1)
    v = F.regexp_extract(line, r"^#\s*([^,]+),(.*)$", 2)
    rows = lines.where(F.startswith(F.col(line), F.lit("#"))).select(*keys, F.trim(t).alias("k"), F.trim(v).alias("v"))
    return rows.groupBy(*keys).pivot("k", names).agg(F.max("v"))


def with_outcomes(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """Tables tagged by outcome; a key found under two outcomes becomes unknown."""
    from onsetry.operators.grouped import with_totals

    both = union_all([df.withColumn("outcome", F.lit(o)) for o, df in parts.items()])
    out = with_totals(both, [key], {"_a": F.min("outcome"), "_b": F.max("outcome")})
    return out.withColumn("outcome", F.when(F.col("_a") == F.col("_b"), F.col("outcome")).otherwise("unknown")).drop("_a", "_b")


def read_predictions(spark, root: str, kinds: dict[str, str] | None = None, file="cv_val_predictions_ranked.csv") -> DataFrame:
    """The prediction files of all runs and experiments in one scan, each by its own header."""
    kinds = {"y_score": "double", "is_SOZ": "int", "seq_idx": "int", "node_index": "int", "rank": "int", "fold": "int"} | (kinds or {})
    lines, heads = csv_rows(spark, root, file)
    run, exp = X.experiment_path(F.col("path"))
    return nan_to_null(csv_lines(lines, heads.withColumns({"_run": run, "_exp": exp}), kinds, keep=("_run", "_exp"))).withColumns(
        {"run": F.col("_run"), "experiment": F.col("_exp")}).drop("_run", "_exp")


def selected_epochs(manifest: DataFrame, epochs: DataFrame, keys: list[str], ids="selected_epoch_ids", status="status", epoch="epoch") -> DataFrame:
    """Epochs listed by the manifest where it is ok; recordings it does not cover keep all."""
    ok = manifest.where(F.lower(F.trim(F.col(status))) == "ok").select(*keys, F.from_json(ids, "array<int>").alias("_ids"))
    ok = ok.where(F.size("_ids") > 0)
    j = epochs.join(ok, keys, "left")
    return j.where(F.col("_ids").isNull() | F.array_contains("_ids", F.col(epoch))).drop("_ids")


def selected_feature_lines(lines: DataFrame, keys: list[str], line="value") -> DataFrame:
    """Non-empty trimmed lines as (patient, feature) rows."""
    return lines.select(*keys, F.trim(line).alias("feature")).where("feature <> ''")
