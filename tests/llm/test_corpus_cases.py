"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns for every operator."""

import itertools
import math
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SF
from onsetry.llm.common import Words, components, gram_hash, sliding_min
from onsetry.llm.contamination import decontaminate
from onsetry.llm.html_text import extract, main_text
from onsetry.llm.jaccard import met_in_lists, prefixes, similar_sets, with_elements_before
from onsetry.llm.lines import drop_common_lines
from onsetry.llm.mixing import mix, n_words
from onsetry.llm.neighbours import near_vectors
from onsetry.llm.quality import resample, split_point
from onsetry.llm.secret_scan import labelled_samples, ratio, scan, train
from onsetry.llm.sharding import assign
from onsetry.llm.substrings import drop_repeats

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, source=None, ids=None):
    rows = [(i if ids is None else ids[i], t, None, source[i] if source else None, None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


def words(n, seed, vocabulary=5000):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


# --- helpers -------------------------------------------------------------------------------------------------------


def test_words_and_grams():
    texts = ["a b\tc", None, "", " x  a b c ", "é\x0bü", "a\x1cb"]
    w = Words(pa.array(texts))
    assert w.count.tolist() == [3, 0, 0, 4, 2, 1]
    h, ok = w.grams(3)
    assert [i for i in np.flatnonzero(ok) if h[i] == h[0]] == [0, 4]
    assert (sliding_min(np.array([3, 1, 2, 5, 4]), 3) == [1, 1, 2]).all()
    assert len(gram_hash(w.hash, 40)) == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 160)} == {100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 1 substring dedup ---------------------------------------------------------------------------------------------


def brute_repeats(texts, window):
    lists = [(t or "").encode().split() if t else [] for t in texts]
    seen = Counter(tuple(x[i : i + window]) for x in lists for i in range(len(x) - window + 1))
    out = []
    for x in lists:
        gone = {p for i in range(len(x) - window + 1) if seen[tuple(x[i : i + window])] > 1 for p in range(i, i + window)}
        out.append(" ".join(b.decode() for i, b in enumerate(x) if i not in gone))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_substrings_match_brute_force(spark, seed):
    r, pool = random.Random(seed), [words(r, 10 + s) for s, r in enumerate([50, 90, 36, 35, 34])]
    texts = []
    for d in range(40):
        parts = [words(r.randrange(0, 120), 100 * seed + d, 30 if d % 3 else 5000), r.choice(pool)[r.randrange(0, 6) :], words(r.randrange(0, 40), d)]
        r.shuffle(parts)
        texts.append(" ".join(itertools.chain(*parts)))
    texts += [None, "", " ", texts[0], texts[0], " ".join(["same"] * 80), " ".join(words(3000, 5)) + " " + " ".join(words(3000, 5))]
    ids = [*range(len(texts) - 2), None, 3]  # an id missing, one used twice
    got = drop_repeats(docs(spark, texts, ids=ids).withColumn("kept", F.lit(1)), window=35).select("text", "kept").collect()
    want = Counter(zip(texts, brute_repeats(texts, 35)))
    assert Counter((x["text"], x["kept"]) for x in got) == want
    assert drop_repeats(docs(spark, [])).count() == 0


# --- 2 mixing ------------------------------------------------------------------------------------------------------


def test_mixing_meets_targets(spark):
    r = random.Random(0)
    source = [r.choice(["a", "b", "b", "b", "b", "b", "b", "c", None, "hot"]) if i % 3 else "hot" for i in range(3000)]
    texts = [None if i % 50 == 0 else " ".join(["w"] * r.randrange(0, 60)) for i in range(3000)]
    frame = docs(spark, texts, source).withColumn("size", F.lit("x"))
    got = mix(frame, n_words(F.col("text")), ["doc_id"]).toPandas()
    total = got["size"].sum()
    for _, part in got.groupby("source", dropna=False):
        assert abs((part["size"] * part["copies"]).sum() - part["target"].iloc[0]) <= part["size"].max()
        assert part["target"].iloc[0] <= 3 * part["source_size"].iloc[0] and part["copies"].between(0, 3).all()
    assert math.isclose(got.groupby("source", dropna=False)["target"].first().sum(), total, rel_tol=1e-9)
    again = mix(frame, n_words(F.col("text")), ["doc_id"]).toPandas()
    assert Counter(zip(got.doc_id, got.copies)) == Counter(zip(again.doc_id, again.copies))
    assert mix(docs(spark, []), n_words(F.col("text")), ["doc_id"]).count() == 0


# --- 3 quality -----------------------------------------------------------------------------------------------------


def test_quality_parts_clean_from_junk(spark):
    r = random.Random(4)
    clean = [" ".join(r.choice(["the", "river", "runs", "past", "an", "old", "mill", "today"]) for _ in range(40)) for _ in range(300)]
    junk = [" ".join(r.choice(["$$$", "***", "@@@", "###"]) + w.upper() for w in c.split()) for c in clean[:60]]
    frame = docs(spark, [*clean, *junk]).withColumn("kept", F.lit(1))
    labels = spark.createDataFrame([(i, int(i < 300)) for i in range(0, 360, 2)] + [(None, 1), (5, None), (2, 1)], "doc_id long, quality int")
    got = {x["doc_id"]: x["kept"] for x in resample(frame, labels).collect()}
    assert all(got[i] == (i < 300) for i in range(360))
    odd = docs(spark, [None, "", "the river", "the river"])
    assert resample(odd, labels.limit(0)).where("kept").count() == 4  # nothing to learn from
    assert resample(docs(spark, []), labels).count() == 0
    assert split_point(np.array([0.0, 1.0, 2.0, 3.0]), np.array([False, False, True, True])) == 1.5


# --- 4 n-gram Jaccard join -----------------------------------------------------------------------------------------


def brute_components(texts, ids, width, t):
    sets = []
    for x in texts:
        w = (x or "").lower().encode().split()
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    comp = list(ids)
    root = lambda i: i if comp[i] == i else root(comp[i])
    for i, j in itertools.combinations(range(len(sets)), 2):
        o = len(sets[i] & sets[j])
        if o and o >= t * (len(sets[i]) + len(sets[j]) - o):
            a, b = sorted((root(i), root(j)))
            comp[b] = a
    return [len(s) for s in sets], [root(i) for i in range(len(sets))]


@pytest.mark.parametrize(("width", "t"), [(3, Fraction(9, 10)), (5, Fraction(4, 5))])
def test_jaccard_join_matches_all_pairs(spark, width, t):
    r, base, texts = random.Random(width), [words(n, n) for n in (20, 60, 61, 150, 400)], []
    for _ in range(140):
        w = list(r.choice(base))
        for _ in range(r.randrange(0, 5)):
            w[r.randrange(len(w))] = f"x{r.randrange(9999)}"
        texts.append(" ".join(w[: len(w) - r.randrange(0, 4)]))
    texts += [None, "", " ", "a b", "A  B", "b a", "a", *texts[:3], " ".join(["z"] * 50)]
    frame = docs(spark, texts).withColumn("component_id", F.lit(0))
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in similar_sets(frame, width=width, threshold=t).collect()}
    sizes, comp = brute_components(texts, range(len(texts)), width, t)
    assert [got[i] for i in range(len(texts))] == list(zip(sizes, comp))
    assert len(set(comp)) < len(texts) - 20
    assert similar_sets(docs(spark, [])).count() == 0
    none = similar_sets(docs(spark, ["a b c", "a b c"], ids=[None, 4])).collect()
    assert Counter((x["doc_id"], x["component_id"]) for x in none) == Counter([(None, None), (4, 4)])


def test_a_pair_meets_in_its_lists_about_once(spark):
    """Texts of one template that are no links share most of their elements; pairs used to be made once for each."""
    r, base, texts = random.Random(8), words(200, 31), []
    for _ in range(40):
        w = list(base)
        for at in r.sample(range(len(w)), 3):
            w[at] = f"y{r.randrange(10**6)}"
        texts.append(" ".join(w))
    ids, t = list(range(len(texts))), Fraction(4, 5)
    entries = prefixes(docs(spark, texts).select(F.col("doc_id").cast("long").alias("id"), "text"), 5, t).withColumns({"comp": F.col("id"), "sketch": F.lit(0)})
    near = "na * 5 >= nb * 4 and nb * 5 >= na * 4 and (pa + pb) * 9 <= na + nb"
    each = [(x.a, x.b) for x in met_in_lists(entries.withColumn("before", F.array().cast("array<bigint>")), near).collect()]
    got = [(x.a, x.b) for x in met_in_lists(with_elements_before(entries), near).collect()]
    assert len(each) > 3 * len(set(each)) and set(got) == set(each) and len(got) < 1.5 * len(set(got))
    sizes, comp = brute_components(texts, ids, 5, t)
    assert sorted((x["doc_id"], x["n_shingles"], x["component_id"]) for x in similar_sets(docs(spark, texts)).collect()) == list(zip(ids, sizes, comp))


# --- 5 line dedup --------------------------------------------------------------------------------------------------


def test_line_dedup_cases(spark):
    texts = [None, "", "\n\n", "Common\nown", "  common \r\nother", "COMMON", "common", "é\ncommon"]
    got = {x["doc_id"]: x for x in drop_common_lines(docs(spark, texts).withColumn("n_lines", F.lit("x")), min_docs=3).collect()}
    assert [(got[i]["n_lines"], got[i]["n_dropped"], got[i]["kept"]) for i in range(8)] == [
        (1, 0, ""), (1, 0, ""), (3, 0, "\n\n"), (2, 1, "own"), (2, 1, "other"), (1, 1, ""), (1, 1, ""), (2, 1, "é"),
    ]
    twice = drop_common_lines(docs(spark, ["x", "x", "y"], ids=[1, 1, None]), min_docs=2).collect()
    assert Counter((x["doc_id"], x["n_dropped"]) for x in twice) == Counter([(1, 1), (1, 1), (None, 0)])
    assert drop_common_lines(docs(spark, [])).count() == 0


# --- 6 sharding ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 5, 1001])
def test_sharding_balance(spark, n):
    ids = [None if i % 100 == 3 else i // 2 for i in range(n)]
    got = assign(docs(spark, ["t"] * n, ids=ids).withColumn("slot", F.lit("x")), ["doc_id"], 8).toPandas()
    assert len(got) == n
    sizes = [int((got["shard"] == s).sum()) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1
    for s in range(8):
        assert sorted(got[got["shard"] == s]["slot"]) == list(range(sizes[s]))


def test_sharding_moves_little(spark):
    one = assign(docs(spark, ["t"] * 4000), ["doc_id"], 8).toPandas().set_index("doc_id")["shard"]
    two = assign(docs(spark, ["t"] * 4000), ["doc_id"], 9).toPandas().set_index("doc_id")["shard"]
    assert (one != two.reindex(one.index)).mean() < 0.5  # hashing modulo the number of shards moves eight in nine


# --- 7 decontamination ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize("index_words", [10**6, 40])
def test_decontamination_matches_brute_force(spark, index_words):
    r, items = random.Random(7), [words(n, 900 + n) for n in (30, 13, 12, 4, 60, 14)] + [["solo"], []]
    bench = [(i, " ".join(w).upper()) for i, w in enumerate(items)] + [(100, None), (1, " ".join(items[1])), (None, "lone term here")]
    texts = []
    for d in range(60):
        w = words(r.randrange(0, 80), d)
        cut = r.choice(items)
        a = r.randrange(0, max(1, len(cut) - 11))
        at = r.randrange(0, len(w) + 1)
        texts.append("-".join(w[:at] + cut[a:] + w[at:]))
    texts += [None, "", "...", "solo", "lone term here", texts[0], "é" * 5]
    pattern = __import__("re").compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s or "")
    lists = [(i, pattern.findall(lower(t))) for i, t in bench]
    frame = docs(spark, texts).withColumn("n_hit", F.lit("x"))
    got = {x["doc_id"]: x for x in decontaminate(frame, spark.createDataFrame(bench, "item_id long, text string"), index_words=index_words).collect()}
    for d, t in enumerate(texts):
        w, hit, found = pattern.findall(lower(t)), set(), set()
        for i, item in lists:
            n = min(13, len(item))
            wins = {tuple(item[k : k + n]) for k in range(len(item) - n + 1)} if n else set()
            for k in range(len(w) - n + 1 if n else 0):
                if tuple(w[k : k + n]) in wins:
                    hit |= set(range(k, k + n))
                    found |= {str(i)} if i is not None else set()
        x = got[d]
        assert (x["n_words"], x["n_hit"], x["hit_items"]) == (len(w), len(hit), sorted(found))
        assert x["contaminated"] == (len(hit) > 0 and 20 * len(hit) >= len(w))
    assert decontaminate(docs(spark, texts), spark.createDataFrame([], "item_id long, text string")).where("contaminated").count() == 0
    assert decontaminate(docs(spark, []), spark.createDataFrame(bench, "item_id long, text string")).count() == 0


# --- 8 secret scan -------------------------------------------------------------------------------------------------


def test_secret_scan_adds_random_strings_only(spark):
    corpus = spark.read.parquet(f"{SF}/documents.parquet")
    model = train(labelled_samples(corpus))
    key = "Zk3xQ9vT7bLm2WcR8yHn4DsF6gJ1"
    texts = [f"é key {key} end", "getUserAccountSettingsForRiver2", "token = 'abcdef' 😀 Secret:short api_key=" + "x" * 7, None, "", "0123456789" * 4 + "-1",
             "AKIA" + "Q" * 16 + " AKIAshort", "deadbeef" * 3 + "g" + "ab" * 11, "token=token=abcdef", "secret:token:abcdefgh"]
    got = {x["doc_id"]: x for x in scan(docs(spark, texts).withColumn("all_spans", F.lit(1)), model).collect()}
    spans = lambda i: [(s["start"], s["kind"], s["end"]) for s in got[i]["all_spans"]]
    assert spans(0) == [(6, 3, 6 + len(key))] and spans(1) == []
    assert spans(2) == [(0, 0, 15), (32, 0, 47)] and spans(3) == spans(4) == [] and spans(5) == [(0, 2, 40)]
    assert spans(6) == [(0, 1, 20)] and spans(7) == [(0, 2, 24)] and spans(8) == [(0, 0, 18)] and spans(9) == []
    scores = spark.createDataFrame([(key,), ("ordinary_name_of_thing",)], "t string").select(ratio(F.col("t"), model).alias("r")).collect()
    assert scores[0]["r"] > 0.5 > 0 > scores[1]["r"]
    assert scan(docs(spark, []), model).count() == 0


# --- 9 html --------------------------------------------------------------------------------------------------------


def test_html_extraction_cases(spark):
    body = "".join(f"<p>Sentence {i}, with commas, and <a href=x>one link</a> in a paragraph of some length.</p>" for i in range(4))
    text = " ".join(f"Sentence {i}, with commas, and one link in a paragraph of some length." for i in range(4))
    page = f"""<html><head><title>T</title><style>p{{}}</style></head><body class="with-sidebar"><header><h1>Site</h1></header>
      <div id=menu><a href=a>A</a><a href=b>B</a></div><div class="cookie-notice">We use cookies, and more cookies, and more.</div>
      <div class="content has-comments"><h2>Title&nbsp;&amp; more</h2>{body}<script>var a="</p>"</script><ul><li><a>x</a><li><a>y</a><li><a>z</a></ul>
      <form><input>Subscribe</form><div class="comments"><p>Nice, great, long comment, indeed, with many, many commas.</p></div></div>
      <aside>Side, note, here</aside><footer>&copy; 2020, all, rights</footer></body></html>"""
    assert main_text(page) == "Title & more " + text
    assert main_text("<p>one<br>two<p>three") == "one two three"
    assert main_text("plain, no markup") == "plain, no markup"
    assert main_text("<div>" * 3000 + "deep") == "deep"
    assert main_text("<nav><a>only</a></nav>") == "" and main_text("<!-- <p>x</p>") == "" and main_text("a &lt;b&gt; c") == "a <b> c"
    frame = spark.createDataFrame([(1, "u", page, "old"), (2, None, None, None), (3, "u", "", "x"), (1, "u", page, "old")],
                                  "page_id long, url string, html string, text string")
    got = sorted((x["page_id"], x["text"], x["n_chars"]) for x in extract(frame).collect())
    want = "Title & more " + text
    assert got == [(1, want, len(want)), (1, want, len(want)), (2, "", 0), (3, "", 0)]
    assert extract(frame.limit(0)).count() == 0


# --- 10 embeddings -------------------------------------------------------------------------------------------------


def test_near_vectors_match_all_pairs(spark):
    r = np.random.default_rng(3)
    centre = r.standard_normal((12, 16))
    v = [*(centre[i % 12] + 0.12 * r.standard_normal(16) for i in range(240)), *r.standard_normal((400, 16))]
    rows = [(i, [float(np.float32(y)) for y in x], 1) for i, x in enumerate(v)]
    rows += [(1000 + i, rows[0][1], 2) for i in range(30)]  # one very common vector
    bad = [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] * 16, 1), (2003, [1.0, None], 1), (2004, [], 1), (2005, [1.0, 2.0], 1), (None, rows[0][1], 1)]
    frame = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, kept int")
    got = {x["vec_id"]: x for x in near_vectors(frame, shard_rows=200, block_rows=300).collect()}
    m = np.array([x[1] for x in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    near = m @ m.T >= 0.95
    links = near.sum(1) - 1
    found = np.array([got[x[0]]["n_links"] for x in rows])
    assert (found <= links).all() and found.sum() >= 0.9 * links.sum()
    comp = {x[0]: got[x[0]]["component_id"] for x in rows}
    assert all(comp[rows[j][0]] == comp[rows[i][0]] for i in range(0, len(rows), 7) for j in np.flatnonzero(near[i])) or found.sum() < links.sum()
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in range(2000, 2006))
    assert (got[None]["n_links"], got[None]["component_id"], got[None]["kept"]) == (0, None, False)
    assert near_vectors(frame.limit(0)).count() == 0


# --- the pipeline --------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    frame, seen = spark.read.parquet(f"{SF}/documents.parquet").cache(), []
    columns = frame.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = frame.count()
        frame = stage(spark, frame, SF).cache()
        seen.append((name, before, frame.count()))
        assert frame.columns == (columns if i < 4 else [*columns, "shard", "slot"])
    assert all(after < before for _, before, after in seen[:3]) and seen[4][1] == seen[4][2]
    assert corpus_pipeline.run(spark, SF).count() == seen[-1][2]
