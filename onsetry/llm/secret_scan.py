"""Secrets by patterns and by character Markov models (operator 8), with DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from onsetry.llm.registry import query, read

#: The base kinds in their order, with the least length of the checked part (group) of a match.
BASE = [
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),  # maximal runs, so that shorter ones need not be listed first
]
MARKOV = "markov"
KINDS = [k for k, *_ in BASE] + [MARKOV]

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
UNSEEN = 0.02  # share of each row of a model that is spread over all symbols
MIN_RATIO = 0.5  # nats per character pair by which the model of random strings must explain a candidate better


def spans(text: Column, pattern: str, group: int, least: int, kind: int) -> Column:
    """Array of (start, kind, end, match) of the leftmost non-overlapping matches whose ``group`` has ``least`` characters.

    What lies between matches is what ``split`` leaves, so starts are running sums of lengths in code points.
    """
    found, checked = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), found.alias("match"), F.transform(checked, F.length).alias("size")
    )
    parts = F.slice(parts, F.lit(1), F.size(found))
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,match:string>>")

    def add(acc, x):
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["match"])
        one = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["match"].alias("match"))
        return F.struct(end.alias("at"), F.when(x["size"] >= least, F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

    listed = F.aggregate(parts, F.struct(F.lit(0).alias("at"), empty.alias("out")), add)["out"]
    return F.when(text.rlike(pattern), listed).otherwise(empty)


def pair_counts(samples: DataFrame, text: str = "text", secret: str = "secret", n: Column | None = None) -> DataFrame:
    """(s, at, n): how often each character pair occurs in the secret and the ordinary strings; ``n`` weights a string."""
    size = len(ALPHABET) + 1
    clean = samples.where(F.col(text).isNotNull() & F.col(secret).isNotNull() & (F.length(text) >= 2))
    pairs = F.explode(F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substring(F.col(text), i, F.lit(2))))
    counts = clean.select(F.col(secret).cast("boolean").alias("s"), (F.lit(1) if n is None else n).cast("long").alias("n"), pairs.alias("p"))
    code = F.instr(F.lit(ALPHABET), F.substring("p", 1, 1)) * size, F.instr(F.lit(ALPHABET), F.substring("p", 2, 1))
    return counts.groupBy("s", (code[0] + code[1]).alias("at")).agg(F.sum("n").alias("n"))


def model_of(counts: DataFrame) -> list[float]:
    """Log-likelihood ratios of character pairs, secret against ordinary, from their counts (s, at, n).

    Two first-order Markov models over ``ALPHABET``; other characters count as one symbol more. ``UNSEEN`` of each
    row's probability is spread evenly, so a model depends on shares only: ten times the corpus gives the same one,
    and a pair that ordinary strings never hold (one with a digit, say) weighs a fixed amount. A symbol that was never
    counted has an even row. The table has (66 + 2) squared entries of either kind, whatever was counted.
    """
    size = len(ALPHABET) + 1
    table = {True: [0] * size * size, False: [0] * size * size}
    for r in counts.collect():
        table[r["s"]][r["at"]] += r["n"]
    total = {k: [sum(v[i * size : (i + 1) * size]) for i in range(size)] for k, v in table.items()}

    def logp(k: bool, i: int) -> float:
        n = total[k][i // size]
        return math.log((1 - UNSEEN) * table[k][i] / n + UNSEEN / size if n else 1 / size)

    return [logp(True, i) - logp(False, i) for i in range(size * size)]


def train(samples: DataFrame, text: str = "text", secret: str = "secret") -> list[float]:
    """The model of labelled strings; null texts and labels are left out."""
    return model_of(pair_counts(samples, text, secret))


def ratio(token: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of a string, per character pair."""
    size = len(ALPHABET) + 1
    table = F.split(F.lit(",".join(f"{x:.9g}" for x in model)), ",").cast("array<double>")
    code = lambda i: F.instr(F.lit(ALPHABET), F.substring(token, i, F.lit(1)))
    pair = lambda acc, i: acc + F.element_at(table, (code(i) * size + code(i + 1) + 1).cast("int"))
    return F.aggregate(F.sequence(F.lit(1), F.length(token) - 1), F.lit(0.0), pair) / (F.length(token) - 1)


def word_pairs(docs: DataFrame, doc_id: str, text: str, seed: int) -> DataFrame:
    """(a, b, x0 .. x3): each plain word of a document with its next new one, in lower case, and a 256-bit digest of both and the id."""
    words = F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"\b[A-Za-z]{2,}\b"), F.lit(0)))
    zipped = F.arrays_zip(words.alias("a"), F.slice(F.concat(words, F.array(F.lit("id"))), 2, 1 << 30).alias("b"))
    pairs = docs.select(F.col(doc_id).alias("_id"), F.explode(zipped).alias("w")).select("_id", F.lower("w.a").alias("a"), F.lower("w.b").alias("b"))
    pairs = pairs.select("a", "b", F.xxhash64("a", "b", "_id", F.lit(seed)).alias("h"))
    return pairs.select("a", "b", *[F.xxhash64("h", F.lit(i)).alias(f"x{i}") for i in range(4)])


def labelled_samples(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = 0) -> DataFrame:
    """(text, secret): identifiers put together from the words of every document, and as many keys.

    Ordinary ones are pairs of plain words in snake and camel case; secret ones are digests of them written in Base64 and
    in hexadecimal, which is how random keys look.
    """
    key = F.concat(*[F.lpad(F.hex(f"x{i}"), 16, "0") for i in range(4)])
    forms = [
        (F.concat_ws("_", "a", "b"), False), (F.concat("a", F.initcap("b")), False),
        (F.translate(F.base64(F.unhex(key)), "=", ""), True), (F.lower(F.substring(key, 1, 40)), True),
    ]
    pairs = word_pairs(docs, doc_id, text, seed)
    return pairs.select(F.explode(F.array(*[F.struct(c.alias("text"), F.lit(s).alias("secret")) for c, s in forms])).alias("x")).select("x.*")


def corpus_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = 0) -> DataFrame:
    """``pair_counts`` of ``labelled_samples`` without making its strings, which are ten times the corpus.

    Ordinary strings are counted as pieces first (the words and the joints between two words), so that characters are
    taken apart once per distinct piece. The symbols of a digest are read from its bits: runs of 60 of them, one every 48,
    hold 8 pairs of Base64 symbols or 12 of hexadecimal ones before the next begins; the last 16 bits hold two pairs more.
    """
    size, pairs = len(ALPHABET) + 1, word_pairs(docs, doc_id, text, seed)
    last, first = F.substring("a", -1, 1), F.substring("b", 1, 1)
    pieces = F.array("a", "a", "b", F.initcap("b"), F.concat(last, F.lit("_"), first), F.concat(last, F.upper(first)))
    pieces = pairs.select(F.explode(pieces).alias("text")).groupBy("text").count()
    ordinary = pair_counts(pieces.withColumn("secret", F.lit(False)), n=F.col("count"))
    shift, low = F.shiftrightunsigned, lambda c, n: F.col(c).bitwiseAND(F.lit((1 << n) - 1))
    runs = F.array(
        shift("x0", 4), F.shiftleft(low("x0", 16), 44).bitwiseOR(shift("x1", 20)), F.shiftleft(low("x1", 32), 28).bitwiseOR(shift("x2", 36)),
        F.shiftleft(low("x2", 48), 12).bitwiseOR(shift("x3", 52)), shift("x3", 4), F.shiftleft(low("x3", 16), 44),
    )
    part = pairs.select(F.posexplode(runs).alias("c", "r")).select("c", "r", F.explode(F.array(*map(F.lit, range(20)))).alias("j"))
    part = part.where("if(j < 8, j < 2 or c < 5, c < 3 or (c = 3 and j < 11))")  # 42 pairs of Base64, 39 hexadecimal ones
    part = part.select(F.expr("cast(if(j < 8, shiftright(r, 48 - 6 * j) & 4095, 4096 + (shiftright(r, 84 - 4 * j) & 255)) as int)").alias("v"))
    seen = part.groupBy("v").count()
    digit = lambda x: F.when(x < 10, x + 53).otherwise(x + 17)  # noqa: E731  as instr counts in ALPHABET
    v, h = F.col("v"), F.col("v") - 4096
    at = F.when(v < 4096, (F.shiftright(v, 6) + 1) * size + v.bitwiseAND(F.lit(63)) + 1).otherwise(
        digit(F.shiftright(h, 4)) * size + digit(h.bitwiseAND(F.lit(15))))
    secret = seen.groupBy(F.lit(True).alias("s"), at.alias("at")).agg(F.sum("count").alias("n"))
    return ordinary.union(secret)


def scan(docs: DataFrame, model: list[float], text: str = "text", min_ratio: float = MIN_RATIO) -> DataFrame:
    """``docs`` with ``base_spans`` and ``all_spans``: arrays of (start, kind, end, match), by start and kind.

    Starts and ends count code points, the end is exclusive; kinds are numbered as in ``KINDS``. To the base kinds the
    Markov models add runs of 20 or more key characters that hold letters and digits, overlap no base span, and are
    better explained as random strings than as identifiers. A null or empty text has no spans; every row is scanned by
    itself, so ties and repeated rows are no special case. Columns called like an added one are replaced.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    base = F.concat(*[spans(body, p, g, n, i) for i, (_, p, g, n) in enumerate(BASE)])
    out = docs.drop("base_spans", "all_spans").withColumn("base_spans", F.array_sort(base))
    looks = lambda x: x["match"].rlike("[0-9]") & x["match"].rlike("[A-Za-z]")
    apart = lambda x: ~F.exists("base_spans", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    random = lambda x: looks(x) & apart(x) & (ratio(x["match"], model) >= min_ratio)
    more = F.filter(spans(body, CANDIDATE, 0, 20, len(BASE)), random)
    return out.withColumn("all_spans", F.array_sort(F.concat("base_spans", more)))


def written(spans_column: str) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans_column, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


@query("op8_secret_scan")
def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = scan(docs, model_of(corpus_counts(docs)))
    number = lambda i: F.size(F.filter("base_spans", lambda x: x["kind"] == i)).cast("long")
    return out.select(
        "doc_id", *[number(i).alias(f"n_{k}") for i, (k, *_) in enumerate(BASE)], F.sha2(written("base_spans"), 256).alias("base_sha256"),
        written("all_spans").alias("spans"),
    )
