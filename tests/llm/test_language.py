"""Language identification: subwords restated plainly, the gradient step, held-out accuracy, awkward tables."""

import random
import re

import numpy as np
import pyarrow.parquet as pq

from conftest import SF
from onsetry.llm import language as L
from onsetry.llm import queries


def plain_subwords(text):
    """All byte runs of two to four with a border at most at the ends, as sorted buckets."""
    marked = b"\x00" + re.sub(rb"[^A-Za-z\x80-\xff]+", b"\x00", (text or "").lower().encode()) + b"\x00"
    marked = re.sub(rb"\x00+", b"\x00", marked)
    out = []
    for n in L.GRAMS:
        for i in range(len(marked) - n + 1):
            gram = marked[i : i + n]
            if b"\x00" in gram[1:-1] or gram.strip(b"\x00") == b"":
                continue
            h = 0
            for b in gram:
                h = h * 257 + b + 1
            out.append(int(L.mix64(np.array([(h * L.BASE + n) % (1 << 64)], np.uint64))[0]) % L.BUCKETS)
    return sorted(out)


def test_subwords():
    texts = ["a", None, "", "Été, l'an 2000!", "x\x00y  z", "  ", "ab\n\ncd", "12", "ß" * 300]
    for group in (texts, texts[::-1], ["The end"], []):
        ids, counts = L.subwords(group)
        parts = np.split(ids, np.cumsum(counts)[:-1]) if len(counts) else []
        assert [sorted(p.tolist()) for p in parts] == [plain_subwords(t) for t in group]


def test_descent_learns_and_both_layouts_agree(monkeypatch):
    monkeypatch.setattr(L, "STEPS", 200)
    bags = [L.subwords([t])[0] for t in ("the cat sat", "the dog ran", "der hund lief", "die katze sass")]
    model = L.train(bags, np.array([0, 0, 1, 1]), ["en", "de"])
    p = model.probabilities(np.concatenate(bags), np.array([len(b) for b in bags]))
    assert (p.argmax(1) == [0, 0, 1, 1]).all() and p.max(1).min() > 0.8
    wide = L.Model([str(i) for i in range(40)], model.embeddings, np.random.default_rng(1).normal(size=(L.DIMS, 40)), np.zeros(40))
    slow = np.array([wide.embeddings[b].mean(0) @ wide.weights for b in bags])
    assert np.allclose(wide.logits(np.concatenate(bags), np.array([len(b) for b in bags])), slow)
    narrow = np.array([model.embeddings[b].mean(0) @ model.weights + model.bias for b in bags])
    assert np.allclose(model.logits(np.concatenate(bags), np.array([len(b) for b in bags])), narrow)


def test_calibration_rejects_what_is_often_wrong():
    r = np.random.default_rng(4)
    model = L.Model(["x", "y"], np.zeros((L.BUCKETS, L.DIMS)), np.zeros((L.DIMS, 2)), np.zeros(2))
    model.embeddings[:, 0] = r.normal(size=L.BUCKETS) * 3
    model.weights[0] = [1, -1]
    bags = [np.array([i]) for i in range(2000)]
    sure = np.abs(model.embeddings[:2000, 0]) > 1.5
    truth = np.where(sure, model.embeddings[:2000, 0] < 0, r.integers(0, 2, 2000)).astype(int)
    out = L.calibrated(model, bags, truth)
    p = out.probabilities(np.arange(2000), np.ones(2000, int))
    taken = p.max(1) >= out.threshold
    assert 0.5 < taken.mean() < 0.95 and (p.argmax(1) == truth)[taken].mean() >= L.TARGET_PRECISION
    assert L.calibrated(model, [], np.zeros(0, int)).threshold == 0


def test_held_out_accuracy(spark):
    rows = queries.QUERIES["op12_language_id"](spark, SF).collect()
    truth = {d["doc_id"]: d["lang"] for d in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    assert len(rows) == len(truth) and all(0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.98 * len(held) > 0


def test_awkward_rows(spark):
    r = random.Random(0)
    make = lambda alphabet: " ".join("".join(r.choice(alphabet) for _ in range(5)) for _ in range(30))
    rows = [(i, make("abcde"), "aa", "u", "mine") for i in range(40)] + [(i, make("vwxyz"), "zz", "u", "mine") for i in range(40, 80)]
    rows += [(80, None, "aa", "u", "m"), (81, "", "aa", "u", "m"), (82, "123 456 ...", None, "u", "m"), (None, "abc abd", None, None, None),
             (84, "wxyz" * 100_000, "zz", "u", "m"), (84, "vwx\x00vwx", None, "u", "m"), (85, "é", None, "u", "m")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, `a.b` string, Score string").repartition(3)
    model = L.fit(df)
    assert model.languages == ["aa", "zz"]
    out = L.identify(df, model, reject=False)
    assert out.columns == ["doc_id", "text", "lang", "a.b", "lang_pred", "score", "rejected"]
    got = out.collect()
    assert len(got) == len(rows)
    for x in got:
        letters = any(c.isalpha() for c in x["text"] or "")
        assert (x["lang_pred"] == L.UNKNOWN) == (not letters) and (letters or x["score"] == 0 and x["rejected"])
        if x["lang"] and letters:
            assert x["lang_pred"] == x["lang"]
    again = {(x["doc_id"], x["text"]): x["score"] for x in L.identify(df.coalesce(1), L.fit(df.coalesce(1)), reject=False).collect()}
    assert again == {(x["doc_id"], x["text"]): x["score"] for x in got}
    assert L.fit(df.where("lang is null")) is None
    nothing = L.identify(df, None).collect()
    assert {x["lang_pred"] for x in nothing} == {L.UNKNOWN} and all(x["rejected"] for x in nothing)
    assert L.identify(df.limit(0), model).count() == 0
