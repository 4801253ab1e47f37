"""Drop lines that many documents share (operator 5)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from onsetry.llm.common import SPACES, aside, aside_name, back, slices
from onsetry.llm.registry import query, read

WHITE = SPACES.encode()


def line_key(line: bytes) -> bytes:
    """ASCII white space stripped at both ends, A-Z lower-cased; other bytes stay, so UTF-8 does too."""
    return line.strip(WHITE).lower()


def key_hash(key: bytes) -> bytes:
    """128 bits of the key: a chance match among 10 ** 12 lines stays out of reach."""
    return hashlib.blake2b(key, digest_size=16).digest()


def long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (min_chars <= 1 or len(key.decode()) >= min_chars)


def line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """(a, b, x, y): row and key of every distinct line key of a row, each as two integers."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found, many = [], []
                for text in part.column("text").cast(pa.binary()).to_pylist():
                    keys = {line_key(line) for line in (text or b"").split(b"\n")}
                    keys = [key_hash(k) for k in keys if long_enough(k, min_chars)]
                    found += keys
                    many.append(len(keys))
                row = pa.array(np.repeat(np.arange(len(many)), many))
                h = np.frombuffer(b"".join(found), dtype="<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [part.column("a").take(row), part.column("b").take(row), *[pa.array(np.ascontiguousarray(h[:, i])) for i in (0, 1)]],
                    ["a", "b", "x", "y"],
                )

    return docs.mapInArrow(cut, "a long, b long, x long, y long")


def without_common(min_chars: int):
    """(text, keys to drop) to (lines dropped, the others joined); the work is linear in lines and keys."""

    def drop(texts: pa.Array, common: pa.Array) -> pa.Array:
        gone, kept = [], []
        for text, keys in zip(texts.cast(pa.binary()), common):
            if not keys.is_valid:
                gone.append(0)
                kept.append(None)
                continue
            keys = keys.values
            x, y = (np.asarray(keys.field(f)) for f in ("x", "y"))
            known = {k.tobytes() for k in np.stack([x, y], 1).astype("<i8")}
            lines = (text.as_py() or b"").split(b"\n")
            left = [line for line in lines if not long_enough(k := line_key(line), min_chars) or key_hash(k) not in known]
            gone.append(len(lines) - len(left))
            kept.append(b"\n".join(left).decode())
        return pa.StructArray.from_arrays([pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["gone", "kept"])

    return F.arrow_udf(drop, "gone long, kept string")


def drop_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and ``kept`` (the other lines, in place, joined by a line feed).

    Keys of ``min_chars`` code points or more found in ``min_docs`` documents or more lose all their lines. Each
    document brings each of its keys once; counts are combined before the shuffle, and the few common keys go back
    to the documents that hold them, as short lists, so neither a line that everyone has nor a long document gathers
    in one task, and the work is linear in lines. Each row counts as a document of its own, whatever its id. Rows are
    known by 128 bits of id and text; equal rows share a list. A null or empty text is one empty line; no rows give no
    rows. Columns of ``docs`` called like an added one are replaced.
    """
    names, users = aside(docs, ["n_lines", "n_dropped", "kept"])
    docs, doc_id, text = docs.select(*users), aside_name(names, doc_id), aside_name(names, text)
    docs = docs.withColumns({"a": F.xxhash64(doc_id, text), "b": F.xxhash64(F.lit("row"), doc_id, text)})
    keys = line_keys(docs.select("a", "b", F.col(text).alias("text")), min_chars)
    common = keys.groupBy("x", "y").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("x", "y")
    held = keys.join(common, ["x", "y"]).groupBy("a", "b").agg(F.collect_set(F.struct("x", "y")).alias("common"))
    whole = F.coalesce(F.col(text), F.lit(""))
    left = without_common(min_chars)(F.when(F.col("common").isNotNull(), F.col(text)), F.col("common"))
    out = docs.join(held, ["a", "b"], "left").withColumn("left", left)
    return out.select(
        *back(names), (F.length(whole) - F.length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.col("left.gone").alias("n_dropped"), F.coalesce(F.col("left.kept"), whole).alias("kept"),
    )


SQL = """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
             unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (key IN (FROM c)) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (key NOT IN (FROM c)), '')) AS kept_sha256
FROM k GROUP BY doc_id
"""


@query("op5_line_dedup", SQL)
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_common_lines(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
