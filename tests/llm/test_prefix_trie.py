"""The trie of conversation prefixes against a plain trie, on awkward tables and with tiny shards."""

import hashlib
import random
import zlib

import pytest

from onsetry.llm.prefix_trie import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows, share):
    by = {}
    for c, t, r, x, *_ in rows:
        if c is not None:
            r, x = r or "", x or ""
            key = hashlib.md5(f"{len(r)}:{r}{x}".encode()).digest()
            by.setdefault(c, []).append((t is not None, t or 0, key, (r, x)))
    plain = {c: [v[3] for v in sorted(rs)] for c, rs in by.items()}
    made = dict(plain)
    if share:
        every, most = share
        for c, own in plain.items():
            h = zlib.crc32(str(c).encode()) % most
            base = c - (abs(c) % every) * (1 if c >= 0 else -1)
            made[c] = plain.get(base, [])[:h] + own[h:]
    nodes = {}
    for c, s in made.items():
        for d in range(len(s) + 1):
            nodes.setdefault(tuple(s[:d]), []).append((c, d == len(s)))
    out = []
    for k, held in nodes.items():
        below = [x for x in nodes if x[: len(k)] == k]
        kids = {x for x in nodes if len(x) == len(k) + 1 and x[: len(k)] == k}
        leaves = [x for x in below if not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in below)]
        saved = sum((len(nodes[x]) - 1) * len(x[-1][1]) for x in below if x)
        ends = ",".join(str(c) for c in sorted(c for c, last in held if last))
        parent = min(c for c, _ in nodes[k[:-1]]) if k else None
        out.append((min(held)[0], len(k), parent, len(held), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows, schema=SCHEMA, share=(100, 6), **sizes):
    out = prefix_trie(spark.createDataFrame(rows, schema).repartition(4), share=share, **sizes)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute(rows, share)


def conversations(seed, n, turns, texts):
    r = random.Random(seed)
    return [(r.randrange(-150, 400), r.choice([None, *range(turns)]), r.choice(["user", "bot", None]), r.choice(texts)) for _ in range(n)]


@pytest.mark.parametrize("sizes", [{}, {"ids": 7, "segment": 2}])
@pytest.mark.parametrize("share", [(100, 6), None])
def test_random_tables(spark, share, sizes):
    check(spark, conversations(1, 300, 5, ["a", "", None, "bé"]), share=share, **sizes)


def test_segment_borders(spark):
    # same beginnings of lengths around the multiples of a segment, and one copy of each
    rows = [(10 * n + k, t, "u", f"t{t}") for n in range(0, 10) for k in (1, 2) for t in range(n)]
    rows += [(200, t, "u", f"t{t}" if t != 4 else "other") for t in range(9)]
    check(spark, rows, share=None, ids=15, segment=3)


def test_long_chain_of_growing_conversations(spark, tiny_splits):
    # each conversation goes one turn further than the one before: chains hang on chains
    check(spark, [(c, t, "u", f"t{t}") for c in range(1, 14) for t in range(c)], share=None)
    check(tiny_splits, [(20 - c, t, "u", f"t{t}") for c in range(1, 14) for t in range(c)] + [(3, t, "x", "y") for t in range(40)])


def test_awkward_rows(spark):
    rows = [(1, 1, "u", "a", "x"), (1, 1, "u", "a", "y"), (1, None, None, None, "z"), (None, 1, "u", "lost", ""), (2, 5, "u", "n" * 100_000, "")]
    rows += [(100, 1, "u", "head", ""), (101, 9, "u", "tail", ""), (300 + 17, 1, "u", "q", ""), (-5, 2, "12:", "b", ""), (-5, 2, "1", "2:b", "")]
    check(spark, rows, SCHEMA + ", pos string")
    check(spark, [], SCHEMA)
    check(spark, [(None, 1, "u", "a")], SCHEMA)


def test_turnless_conversations_belong_to_the_root(spark):
    lonely = next(c for c in range(1000, 2000) if zlib.crc32(str(c).encode()) % 6 > 1 and c % 100)
    out = prefix_trie(spark.createDataFrame([(lonely, 1, "u", "a")], SCHEMA)).collect()
    want = hashlib.sha256(str(lonely).encode()).hexdigest()
    assert [tuple(r) for r in out] == [(lonely, 0, None, 1, 0, 1, 0, want)]
