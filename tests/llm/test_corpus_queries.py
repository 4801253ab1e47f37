"""Corpus queries against their SQL, or against plain Python where SQL cannot state them."""

import hashlib
import html
import os
import re
import sys

import numpy as np
import pyarrow.parquet as pq
import pytest
from compare import diff
from conftest import SF

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from onsetry.llm import queries  # noqa: E402
from onsetry.llm.secret_scan import KINDS  # noqa: E402
from onsetry.llm.sharding import SPACE, shard_of_keys  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, duck, name):
    assert diff(spark, SF, duck, queries.QUERIES[name], queries.ORACLES[name]) is None


def table(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


def test_quality_keeps_good_and_rejects_bad(spark):
    got = {r["doc_id"]: r["kept"] for r in queries.QUERIES["op3_quality"](spark, SF).collect()}
    assert len(got) == len(table("documents"))
    labels = [r for r in table("labels") if r["doc_id"] in got]
    assert all(got[r["doc_id"]] == bool(r["quality"]) for r in labels)


def test_sharding_is_the_walk_key_by_key(spark):
    got = queries.QUERIES["op6_sharding"](spark, SF).toPandas()
    at = lambda i: int(hashlib.md5(f"v{i}|0".encode()).hexdigest()[:15], 16)
    ids = sorted(got.doc_id, key=at)
    assert all(0 <= at(i) < SPACE for i in ids)
    assert dict(zip(got.doc_id, got.shard)) == dict(zip(ids, shard_of_keys([at(i) for i in ids], 8)))
    sizes = got.groupby("shard").size()
    assert sizes.max() - sizes.min() <= 1
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))


def test_secret_scan_base_spans(spark):
    kinds = [
        (re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 1, 6),
        (re.compile(r"AKIA[A-Z0-9]+"), 0, 20), (re.compile(r"[0-9a-f]+"), 0, 24),
    ]
    got = {r["doc_id"]: r for r in queries.QUERIES["op8_secret_scan"](spark, SF).collect()}
    for d in table("documents"):
        want = sorted((m.start(), i, m.end()) for i, (p, g, n) in enumerate(kinds) for m in p.finditer(d["text"] or "") if len(m[g]) >= n)
        text = ",".join(f"{KINDS[i]}:{a}:{b}" for a, i, b in want)
        r = got[d["doc_id"]]
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(i == k for _, i, _ in want) for k in range(3))
        assert not text or set(text.split(",")) <= set(r["spans"].split(","))


def test_html_text_is_the_article(spark):
    got = {r["page_id"]: r for r in queries.QUERIES["op9_html_text"](spark, SF).collect()}
    for p in table("pages"):
        inner = re.search("<article>(.*?)</article>", p["html"], re.S)[1]
        want = " ".join(html.unescape(re.sub("<[^>]+>", " ", inner)).split())
        assert got[p["page_id"]]["text"] == want and got[p["page_id"]]["n_chars"] == len(want)


def test_embedding_dedup_matches_all_pairs(spark):
    rows = table("embeddings")
    v = np.array([r["embedding"] for r in rows])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    links = (v @ v.T >= 0.95).sum(1) - 1
    got = {r["vec_id"]: r["n_links"] for r in queries.QUERIES["op10_embedding_dedup"](spark, SF).collect()}
    assert [got[r["vec_id"]] for r in rows] == links.tolist()
