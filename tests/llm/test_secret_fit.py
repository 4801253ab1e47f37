"""The models of operator 8 are fitted on the word pairs of every document."""

import random
import re
import string

import pytest
from pyspark.sql import functions as F

from onsetry.llm.secret_scan import MIN_RATIO, corpus_counts, labelled_samples, model_of, pair_counts, ratio

SF = "/root/testdata/sf0.01"
KINDS = {
    "upper": string.ascii_uppercase + string.digits, "hex": "0123456789abcdef", "upper hex": "0123456789ABCDEF",
    "base62": string.ascii_letters + string.digits,
}


def texts(n):
    """Six hundred documents and more, and above 5,000 different word pairs."""
    letters = [a + b for a in "abcdefghijklmnop" for b in "qrstuvwxyz"]
    rng = random.Random(3)
    return [" ".join("".join(rng.sample(letters, 2)) for _ in range(10)) for _ in range(n)] + [None, "", "x 1", "One one ONE two"]


def test_every_document_and_pair_is_counted(spark):
    rows = [(i if i % 50 else None, t) for i, t in enumerate(texts(700))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ordinary = {}
    for _, t in rows:
        words = list(dict.fromkeys(re.findall(r"\b[A-Za-z]{2,}\b", t or "")))
        for a, b in zip(words, [*words[1:], "id"]):
            for s in (f"{a.lower()}_{b.lower()}", a.lower() + b.capitalize()):
                ordinary[s] = ordinary.get(s, 0) + 1
    got = labelled_samples(docs).groupBy("secret", "text").count().collect()
    assert {r["text"]: r["count"] for r in got if not r["secret"]} == ordinary
    assert sum(r["count"] for r in got if r["secret"]) == sum(ordinary.values()) > 10_000
    assert {len(r["text"]) for r in got if r["secret"]} == {40, 43}


def test_counts_are_those_of_the_strings(spark):
    docs = spark.createDataFrame(list(enumerate(texts(40))), "doc_id long, text string")
    both = [{(r["s"], r["at"]): r["n"] for r in x.collect()} for x in (corpus_counts(docs), pair_counts(labelled_samples(docs)))]
    assert both[0] == both[1] and len(both[0]) > 1000
    assert corpus_counts(docs.limit(0)).count() == 0 and set(model_of(corpus_counts(docs.limit(0)))) == {0.0}


@pytest.fixture(scope="module")
def fitted(spark):
    return model_of(corpus_counts(spark.read.parquet(f"{SF}/documents.parquet")))


@pytest.mark.parametrize("kind", KINDS)
def test_recall_of_random_strings(spark, fitted, kind):
    rng, found = random.Random(5), []
    while len(found) < 400:
        t = "".join(rng.choice(KINDS[kind]) for _ in range(rng.randint(20, 40)))
        found += [(t,)] if re.search("[0-9]", t) and re.search("[A-Za-z]", t) else []
    hits = spark.createDataFrame(found, "t string").where(ratio(F.col("t"), fitted) >= MIN_RATIO).count()
    assert hits >= 396, f"{hits} of 400"


def test_the_model_depends_on_shares_not_on_size(spark):
    docs = spark.createDataFrame(list(enumerate(texts(300))), "doc_id long, text string")
    once = corpus_counts(docs)
    ten = once.withColumn("n", F.col("n") * 10)
    thousand = once.withColumn("n", F.col("n") * 1000)
    assert model_of(once) == pytest.approx(model_of(ten), abs=1e-12) and model_of(once) == pytest.approx(model_of(thousand), abs=1e-12)


def test_identifiers_with_a_number_are_not_secrets(spark, fitted):
    """Camel-case names of five words of the corpus with a number at the end: at most one in fifty is flagged."""
    words = spark.read.parquet(f"{SF}/documents.parquet").select(F.explode(F.split("text", r"[^A-Za-z]+")).alias("w")).where("length(w) between 3 and 9")
    pool = sorted(r.w.lower() for r in words.distinct().collect())
    rng = random.Random(9)
    names = [(rng.choice(pool) + "".join(rng.choice(pool).capitalize() for _ in range(4)) + str(rng.randrange(100)),) for _ in range(500)]
    hits = spark.createDataFrame(names, "t string").where(ratio(F.col("t"), fitted) >= MIN_RATIO).count()
    assert hits <= 10, f"{hits} of 500"
