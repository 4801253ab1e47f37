"""Names, ids and paths as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed values: modality words that may stand before or after a channel name
MODALITY = "(EEG|ECOG|SEEG|EKG|EMG|DBS|LFP)"
# fixed values: dataset prefixes of a patient id, in the order they are removed
PATIENT_PREFIXES = ("ds004100_", "CHUM_")
# fixed values: file name layouts; groups are patient, phase, recording, epoch
EPOCH_PART = r"(?:epoch_(\d+)(?:_[A-Za-z0-9-]+)?|avg_over_epochs(?:_[A-Za-z0-9-]+)?)\.csv$"
NODE_PATTERNS = (
    r"(?i)^(.+?)_(ictal|preictal)_(\d+)_NODE(?:_|-)?features_" + EPOCH_PART,
    r"(?i)^(.+?)_(ictal|preictal).*?seizure[_-]?(\d+).*?_NODE(?:_|-)?features_" + EPOCH_PART,
    r"(?i)^(.+?)_(ictal|preictal).*?run-(\d+).*?_NODE(?:_|-)?features_" + EPOCH_PART,
)
EDGE_PATTERN = (
    r"(?i)^(.+?)_(ictal|preictal)_(\d+)_EDGE_(corr|psi|granger|coh1245|psi1245)_(?:epoch_(\d+)|avg_over_epochs)\.csv$"
)
IGNORED_EDGE_FILES = ("_matrix_", "_ADJ_", "_LAPL_")
NODE_FOLDER = r"^NODE_features"
EDGE_FOLDER = r"^EDGE_features"


def _blank_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


# ------------------------------------------------------------- channel names
def channel_basic(c: Column) -> Column:
    """No white space, upper case."""
    return F.upper(F.regexp_replace(c, r"\s+", ""))


def channel_without_prefix(c: Column) -> Column:
    """A leading modality word removed, then basic."""
    s = F.trim(F.regexp_replace(c, r"\s+", " "))
    return channel_basic(F.regexp_replace(s, rf"(?i)^{MODALITY}\s+", ""))


def channel_bare(c: Column) -> Column:
    """Parentheses, modality words on either side, white space and underscores removed."""
    s = F.regexp_replace(F.upper(c), r"[()]+", "")
    s = F.trim(F.regexp_replace(s, r"\s+", " "))
    s = F.regexp_replace(s, rf"\s+{MODALITY}$", "")
    s = F.regexp_replace(s, rf"^{MODALITY}\s+", "")
    return F.regexp_replace(s, r"[\s_]+", "")


def channel_display(c: Column) -> Column:
    """The word SEEG removed anywhere, single spaces."""
    return F.trim(F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("SEEG"), F.lit("")), r"\s+", " "))


# --------------------------------------------------------------- patient ids
def patient_number(c: Column) -> Column:
    """First number in the id."""
    return _blank_null(F.regexp_extract(c, r"(\d+)", 1)).try_cast("int")


def padded_patient(c: Column) -> Column:
    """``Patient_07`` for any spelling that holds a number."""
    n = patient_number(c)
    text = n.cast("string")
    return F.when(n.isNull(), c).otherwise(F.concat(F.lit("Patient_"), F.when(F.length(text) < 2, F.lpad(text, 2, "0")).otherwise(text)))


def canonical_patient(c: Column) -> Column:
    """``::`` and ``__`` become ``_``."""
    return F.replace(F.replace(c, F.lit("::"), F.lit("_")), F.lit("__"), F.lit("_"))


def bare_patient(c: Column) -> Column:
    """Dataset part, dataset prefixes and ``sub-`` removed."""
    s = F.trim(F.coalesce(c, F.lit("")))
    s = F.when(F.contains(s, F.lit("::")), F.regexp_replace(s, r"^.*?::", "")).otherwise(s)
    s = F.replace(s, F.lit("__"), F.lit("_"))
    for prefix in PATIENT_PREFIXES:
        s = F.regexp_replace(s, f"^{prefix}", "")
    return F.regexp_replace(s, "^sub-", "")


def dataset_of(c: Column) -> Column:
    """Dataset before ``::``, else by the form of the id."""
    s = F.trim(c)
    return F.when(F.contains(s, F.lit("::")), F.trim(F.regexp_extract(s, r"^(.*?)::", 1))).when(
        F.startswith(s, F.lit("sub-")), "ds004100").otherwise("CHUM")


def patient_of(c: Column) -> Column:
    s = F.trim(c)
    return F.when(F.contains(s, F.lit("::")), F.trim(F.regexp_replace(s, r"^.*?::", ""))).otherwise(s)


def recording_number(c: Column) -> Column:
    """Integer recording id from text, the first number in it; null if none."""
    return _blank_null(F.regexp_extract(c.cast("string"), r"(\d+)", 1)).try_cast("int")


def numeric_first(c: Column) -> list[Column]:
    """Order fields that put numbers first, by value, then text."""
    v = c.try_cast("double")
    return [v.isNull(), v, c]


def node_column(c: Column) -> tuple[Column, Column]:
    """``node_044:NAME`` to index and name."""
    idx = _blank_null(F.regexp_extract(c, r"^node_(\d+)", 1)).try_cast("int")
    return idx, _blank_null(F.regexp_extract(c, r"^node_\d+:(.*)$", 1))


# --------------------------------------------------------------------- paths
def file_path() -> Column:
    """Path of the scanned file with percent codes resolved."""
    return decoded_path(F.col("_metadata.file_path"))


def decoded_path(path: Column) -> Column:
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _after(parts: Column, pos: Column) -> Column:
    """Element after a 1-based position; null at the end or without a position."""
    return F.when((pos > 0) & (pos < F.size(parts)), F.get(parts, pos))


def directory_parts(path: Column, root: str) -> Column:
    """Folders of a file path below ``root``, as an array; null outside of it."""
    base = root.rstrip("/") + "/"
    folder = F.regexp_replace(path, r"/[^/]*$", "")
    return F.when(F.startswith(folder, F.lit(base)), F.split(F.substr(folder, F.lit(len(base) + 1)), "/"))


def directory_metadata(parts: Column, folder: str = NODE_FOLDER, skip=("ictal", "preictal")) -> dict[str, Column]:
    """S3: dataset, outcome, phase and patient by position among the folders.

    The dataset is the first part under ``root``; the part after ``sc_fc`` is the
    outcome unless it is a phase; the patient follows the features folder.
    """
    cand = _after(parts, F.array_position(parts, "sc_fc"))
    known = F.array_contains(parts, "sc_fc")
    feature_dir = F.get(F.filter(parts, lambda p: p.rlike(folder)), 0)
    patient = _after(parts, F.array_position(parts, feature_dir))
    return {
        "dataset": F.get(parts, 0),
        "outcome": F.when(known & ~cand.isin(*skip) & ~cand.rlike(folder), cand),
        "phase": F.when(known, F.when(F.array_contains(parts, "preictal"), "preictal").when(F.array_contains(parts, "ictal"), "ictal")),
        "patient": F.when(known, patient),
    }


def _groups(name: Column, pattern: str, n: int) -> Column:
    """All groups of one match as an array, null without a match; one pass of the pattern."""
    sep = "\u0001"
    found = F.split(F.regexp_replace(name, pattern, sep.join(f"${i}" for i in range(1, n + 1))), sep)
    return F.when(F.size(found) == n, found)


def node_name_parts(name: Column) -> Column:
    """Patient, phase, recording and epoch text of a node file name, by the first layout that fits."""
    plain, seizure, run = NODE_PATTERNS
    low = F.lower(name)
    # the second and third layout are costly to reject, so a fixed word is looked for first
    return F.coalesce(
        _groups(name, plain, 4),
        F.when(F.contains(low, F.lit("seizure")), _groups(name, seizure, 4)),
        F.when(F.contains(low, F.lit("run-")), _groups(name, run, 4)),
    )


def edge_name_parts(name: Column) -> Column:
    """S4 for edge files: patient, phase, recording, metric and epoch text."""
    return _groups(name, EDGE_PATTERN, 5)


def file_metadata(parts: Column, edge: bool = False) -> dict[str, Column]:
    """Typed columns from the name parts; a name without epoch is an average (-1, true)."""
    epoch = F.nullif(F.get(parts, 4 if edge else 3), F.lit(""))
    out = {"patient": F.get(parts, 0), "phase": F.lower(F.get(parts, 1)), "seizure": F.get(parts, 2).try_cast("int")}
    if edge:
        out["feature"] = F.lower(F.get(parts, 3))
    out["epoch"] = F.when(parts.isNotNull(), F.coalesce(epoch.try_cast("int"), F.lit(-1)))
    out["is_avg"] = F.when(parts.isNotNull(), epoch.isNull())
    return out


def ignored_edge_file(name: Column) -> Column:
    cond = F.lit(False)
    for token in IGNORED_EDGE_FILES:
        cond |= F.contains(name, F.lit(token))
    return cond


def series_file(name: Column) -> tuple[Column, Column]:
    """Recording id text and sequence number of ``seiz_<id>_seq_<n>``."""
    pattern = r"^seiz_(.+?)_seq_(\d+)(?:_nodes)?\.[A-Za-z]+$"
    return _blank_null(F.regexp_extract(name, pattern, 1)), _blank_null(F.regexp_extract(name, pattern, 2)).try_cast("int")


def experiment_path(path: Column) -> tuple[Column, Column]:
    """``results_*`` run directory and the experiment directory under it."""
    run = _blank_null(F.regexp_extract(path, r"/(results_[^/]+)/", 1))
    exp = _blank_null(F.regexp_extract(path, r"/results_[^/]+/(?:.*/)?([^/]+)/[^/]+$", 1))
    return run, exp
