"""Trie of conversation prefixes by vertical bitmaps (operator 13)."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from onsetry.llm.common import bounded, col, stored
from onsetry.llm.registry import query, read
from onsetry.operators.grouped import MOST, ordered, split_rows

IDS = 1_000  # a shard holds the conversations of so many consecutive ids ...
SEGMENT = 1_000  # ... and so many turns of each
BROADCAST_ROWS = 1_000_000
NODE = ["a", "b", "depth"]
LOCAL = "a long, b long, depth long, pa long, pb long, conv long, n long, len long, ends string, block long"
EMPTY_HASH = hashlib.sha256(b"").hexdigest()


# --- conversations as numbered turns ------------------------------------------------------------------------------


def numbered_turns(df: DataFrame, conv_id="conv_id", turn="turn", role="role", text="text") -> DataFrame:
    """(c, pos, key, len): turns counted from 1 in the order of ``turn`` (null first, ties by digest); texts become digests.

    Null role or text is empty; rows without a conversation id belong to none and are left out.
    """
    who, what = (F.coalesce(col(x).cast("string"), F.lit("")) for x in (role, text))
    key = F.unhex(F.md5(F.concat(F.length(who).cast("string"), F.lit(":"), who, what)))
    rows = df.where(col(conv_id).isNotNull()).select(
        col(conv_id).cast("long").alias("c"), col(turn).alias("turn"), key.alias("key"), F.length(what).cast("long").alias("len")
    )
    order = [F.col("turn").isNotNull(), F.col("turn"), F.col("key")]
    return ordered(rows, ["c"], order, number="pos").select("c", F.col("pos").cast("long").alias("pos"), "key", "len")


def with_shared_heads(turns: DataFrame, every: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """(rebuilt turns, ids of conversations without a turn) of ``numbered_turns``.

    Conversation c takes the first h = crc32(c) % ``most`` turns of conversation c - c % ``every`` (all if fewer, none
    if that one is absent) and then its own turns after its first h.
    """
    turns = stored(turns)
    h = F.crc32(F.col("c").cast("string").cast("binary")) % most
    base = F.col("c") - F.col("c") % every
    heads = turns.where((F.col("c") % every == 0) & (F.col("pos") < most)).select(F.col("c").alias("base"), "pos", "key", "len")
    size = bounded(stored(heads.groupBy("base").agg(F.count("*").alias("have"))), BROADCAST_ROWS)
    taken = F.least(F.col("h"), F.coalesce("have", F.lit(0)))
    people = turns.groupBy("c").agg(F.count("*").alias("own")).withColumns({"h": h, "base": base})
    people = stored(people.join(size, "base", "left").withColumn("taken", taken))
    first = people.join(heads, "base").where("pos <= taken").select("c", "pos", "key", "len")
    rest = turns.withColumns({"h": h, "base": base}).where("pos > h").join(size, "base", "left")
    rest = rest.select("c", (F.col("pos") - F.col("h") + taken).alias("pos"), "key", "len")
    return first.union(rest), people.where("taken = 0 and own <= h").select("c")


# --- one shard ----------------------------------------------------------------------------------------------------


class Shard:
    """Some conversations' turns at positions start + 1 and on, as bitsets over the conversations in ascending order."""

    def __init__(self, c: np.ndarray, pos: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray, start: int):
        begins = size < 0  # rows that carry what precedes the segment: a conversation may have nothing else here
        self.ids, at = np.unique(c, return_inverse=True)
        self.start, n = start, len(self.ids)
        order = np.lexsort((pos, at, begins))
        order = order[: len(order) - int(begins.sum())]
        self.size, row = size[order], at[order]
        self.count = np.bincount(row, minlength=n)
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        self.before = np.zeros((2, n), np.uint64)
        self.key = np.zeros((2, len(order)), np.uint64)
        for i, x in enumerate((a, b)):
            x = x.view(np.uint64)
            self.before[i, at[begins]] = x[begins]
            total = np.cumsum(x[order], dtype=np.uint64)
            offset = np.concatenate([np.zeros(1, np.uint64), total])[self.first[:-1]]
            self.key[i] = total - offset[row] + self.before[i][row]
        # the vertical index: (position, turn) -> conversations, and position -> conversations that go so far
        depth = np.arange(len(order)) - self.first[row]
        self.turn = list(zip(depth.tolist(), a[order].tolist(), b[order].tolist()))
        self.posting, self.reach = defaultdict(int), defaultdict(int)
        for i, t in zip(row.tolist(), self.turn):
            self.posting[t] |= 1 << i
            self.reach[t[0]] |= 1 << i

    def ends(self, members: int) -> str | None:
        out = []
        while members:
            low = members & -members
            out.append(str(self.ids[low.bit_length() - 1]))
            members ^= low
        return ",".join(out) if out else None

    def nodes(self, segment: int) -> Iterator[tuple]:
        """(first member, steps from the start, popcount, ends or None) of every node, depth first."""
        roots: dict[tuple, int] = defaultdict(int)
        for i, key in enumerate(zip(*self.before.tolist())):
            roots[key] |= 1 << i
        stack = [(members, 0) for members in roots.values()]
        while stack:
            members, d = stack.pop()
            i = (members & -members).bit_length() - 1
            if d == segment:  # whether a conversation ends here is known to the shard that starts here
                yield i, d, members.bit_count(), None
                continue
            if members & (members - 1) == 0:  # one conversation: the rest is a chain
                last = int(self.count[i])
                for k in range(d, last + 1):
                    yield i, k, 1, str(self.ids[i]) if k == last < segment else None
                continue
            going = members & self.reach[d]
            yield i, d, members.bit_count(), self.ends(members ^ going)
            while going:
                j = (going & -going).bit_length() - 1
                child = going & self.posting[self.turn[self.first[j] + d]]
                stack.append((child, d + 1))
                going ^= child


def shard_nodes(table: pa.Table, segment: int) -> pa.Table:
    """The nodes of one shard: key, depth, parent's key, smallest member, members, code points, ends."""
    block, part = table["block"][0].as_py(), table["part"][0].as_py()
    c, pos, a, b, size = (table[x].to_numpy() for x in ("c", "pos", "a", "b", "len"))
    shard = Shard(c, pos, a, b, size, part * segment)
    found = list(shard.nodes(segment))
    who, step, n = (np.array([f[k] for f in found], np.int64) for k in range(3))
    own = step > 0
    if part:  # the start itself belongs to the shard before; only ends are news there
        news = own | np.array([f[3] is not None for f in found])
    else:
        news = np.ones(len(found), bool)
    row = shard.first[who] + step - 1
    key, parent = np.zeros((2, 2, len(found)), np.uint64)
    for i in range(2):
        key[i] = shard.before[i][who]
        key[i][own] = shard.key[i][row[own]]
        parent[i] = shard.before[i][who]
        deep = step > 1
        parent[i][deep] = shard.key[i][row[deep] - 1]
    length = np.zeros(len(found), np.int64)
    length[own] = shard.size[row[own]]
    n[~own & bool(part)] = 0
    columns = [pa.array(x) for x in (key[0].view(np.int64), key[1].view(np.int64), step + shard.start)]
    columns += [pa.array(x.view(np.int64), mask=~own) for x in parent]  # what comes before a start is not known here
    out = [*columns, *[pa.array(x) for x in (shard.ids[who], n, length)]] + [pa.array([f[3] for f in found], pa.string()), pa.array(np.full(len(found), block))]
    return pa.Table.from_arrays(out, names=["a", "b", "depth", "pa", "pb", "conv", "n", "len", "ends", "block"]).filter(pa.array(news))


def local_nodes(turns: DataFrame, turnless: DataFrame, ids: int = IDS, segment: int = SEGMENT) -> DataFrame:
    """Depth-first intersection in every shard (``ids`` consecutive ids by ``segment`` turns).

    A prefix is known by the sums, modulo 2 ** 64, of two hashes of its (position, turn) pairs. Where a conversation
    is longer than a segment, its prefix at the start of each further one comes from sums by segment.
    """
    rows = stored(
        turns.select(
            "c", "pos", F.xxhash64("pos", "key").alias("a"), F.xxhash64(F.lit("turn"), "key", "pos").alias("b"), "len",
            F.floor((F.col("pos") - 1) / segment).alias("part"),
        )
    )
    long_ones = rows.where(F.col("pos") == segment).select("c")
    wide = "decimal(38,0)"
    sums = rows.join(long_ones, "c", "left_semi").groupBy("c", "part").agg(
        F.count("*").alias("n"), F.sum(F.col("a").cast(wide)).alias("sa"), F.sum(F.col("b").cast(wide)).alias("sb")
    )
    running = ordered(sums, ["c"], [F.col("part")], running={"ra": F.col("sa"), "rb": F.col("sb")}).where(F.col("n") == segment)

    def wrapped(x: str):
        whole, half = (F.lit(str(1 << e)).cast(wide) for e in (64, 63))
        low = F.pmod(F.col(x), whole)
        return F.when(low >= half, low - whole).otherwise(low).cast("long")

    begins = running.select(
        "c", (F.col("part") + 1).cast("long").alias("part"), wrapped("ra").alias("a"), wrapped("rb").alias("b"), F.lit(-1).cast("long").alias("len")
    )
    none = turnless.select("c", *[F.lit(x).cast("long").alias(n) for x, n in ((0, "part"), (0, "a"), (0, "b"), (-1, "len"))])
    both = begins.unionByName(none).withColumn("pos", F.lit(0).cast("long"))
    shards = rows.unionByName(both).withColumn("block", F.floor(F.col("c") / ids).cast("long"))
    return shards.groupBy("block", "part").applyInArrow(lambda t: shard_nodes(t, segment), LOCAL)


# --- shards put together ------------------------------------------------------------------------------------------


def end_hashes(ends: DataFrame) -> DataFrame:
    """SHA-256 of each node's end list. Lists come in the order of their blocks; a task holds one block's at a time."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for batch in batches:
            keys, out, found = list(zip(*[batch[x].to_pylist() for x in NODE])), [], []
            for key, text in zip(keys, batch["ends"]):
                if key != node:
                    if node is not None:
                        out.append(node)
                        found.append(digest.hexdigest())
                    node, digest = key, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(text.as_py().encode())
            yield rows(out, found)
        if node is not None:
            yield rows([node], [digest.hexdigest()])

    def rows(keys: list[tuple], found: list[str]) -> pa.RecordBatch:
        columns = [pa.array([k[i] for k in keys], pa.int64()) for i in range(3)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.string())], names=[*NODE, "ends_sha256"])

    dealt = ends.repartition(*NODE).sortWithinPartitions(*NODE, "block")
    return dealt.select(*NODE, "ends").mapInArrow(work, "a long, b long, depth long, ends_sha256 string")


def trie(turns: DataFrame, turnless: DataFrame, ids: int = IDS, segment: int = SEGMENT) -> DataFrame:
    """One row per node of the trie of conversations given as (c, pos, key, len) and ids without turns.

    A node is known by (its smallest member, its depth): below a node whose smallest member is c, the nodes on c's own
    path have c as smallest member too. So the nodes of one c form a chain, chains hang on nodes of other chains, and
    a subtree's sum is the sum down the chain and over the chains that hang there. Sums over chains of chains double
    their reach each round, so rounds grow with the logarithm of their depth. No input rows, no nodes.
    """
    local = stored(local_nodes(turns, turnless, ids, segment))
    ends = end_hashes(local.where("ends is not null").select(*NODE, "block", "ends"))
    nodes = local.groupBy(*NODE).agg(
        F.min("conv").alias("conv"), F.sum("n").alias("n"), F.max("len").alias("len"), F.min("pa").alias("pa"), F.min("pb").alias("pb")
    )
    nodes = stored(nodes.join(ends, NODE, "left").withColumn("saved", (F.col("n") - 1) * F.col("len")))

    top = F.min(F.struct("depth", "pa", "pb"))
    chains = nodes.groupBy("conv").agg(top.alias("top"), F.max("depth").alias("last"), F.sum("saved").alias("s"))
    chains = stored(chains.select("conv", "last", "s", "top.*"))
    root = nodes.where("depth = 0").select("conv").first()
    root = root and root["conv"]
    # a chain that starts at depth 1 hangs on the root, which needs no join; further down parents are looked up
    deep = chains.where("depth > 1").join(
        nodes.select(F.col("a").alias("pa"), F.col("b").alias("pb"), (F.col("depth") + 1).alias("depth"), F.col("conv").alias("up")), ["pa", "pb", "depth"]
    ).select("conv", "last", "s", "depth", "up")
    up = F.when(F.col("depth") == 1, F.lit(root).cast("long"))
    chains = stored(chains.where("depth < 2").select("conv", "last", "s", "depth", up.alias("up")).union(deep))
    hung = chains.where("up is not null").groupBy(F.col("up").alias("conv"), (F.col("depth") - 1).alias("last")).agg(F.count("*").alias("kids"))
    sums = stored(
        chains.join(hung, ["conv", "last"], "left").select(
            "conv", "last", "depth", "up", F.col("up").alias("over"), "s", F.col("kids").isNull().alias("leaf"), F.when(F.col("kids").isNull(), 1).otherwise(0).cast("long").alias("l")
        )
    )
    while sums.where("over is not null").limit(1).count():
        below = sums.where("over is not null").groupBy(F.col("over").alias("conv")).agg(F.sum("s").alias("ds"), F.sum("l").alias("dl"))
        # the root's chain hangs on nothing, so those below it are done and its many children need no look-up
        higher = sums.where(F.col("over") != F.lit(root)).select("conv", "over").join(
            sums.where("over is not null").select(F.col("conv").alias("over"), F.col("over").alias("next")), "over"
        ).select("conv", "next")
        grown = sums.join(below, "conv", "left").join(higher, "conv", "left")
        sums = stored(
            grown.select(
                "conv", "last", "depth", "up", F.col("next").alias("over"), (F.col("s") + F.coalesce("ds", F.lit(0))).alias("s"), "leaf",
                (F.col("l") + F.coalesce("dl", F.lit(0))).alias("l"),
            )
        )

    zero = F.lit(0).cast("long")
    marks = (
        sums.where("up is not null").select(F.col("up").alias("conv"), (F.col("depth") - 1).alias("depth"), F.lit(1).cast("long").alias("kids"), F.col("s").alias("ds"), F.col("l").alias("dl"), F.lit(None).cast("long").alias("up"))
        .union(sums.where("leaf").select("conv", "last", zero, zero, F.lit(1).cast("long"), F.lit(None).cast("long")))
        .union(sums.select("conv", "depth", zero, zero, zero, "up"))
    )
    marks = marks.groupBy("conv", "depth").agg(F.sum("kids").alias("kids"), F.sum("ds").alias("ds"), F.sum("dl").alias("dl"), F.max("up").alias("up"), F.lit(True).alias("marked"))
    most = split_rows(nodes)
    lengths = sums.select("conv", (F.col("last") - F.col("depth") + 1).alias("_n"))
    hot = lengths.where(F.col("_n") > most).orderBy(F.desc("_n")).limit(MOST).collect()
    rows = nodes.join(marks, ["conv", "depth"], "left").select(
        "conv", "depth", "n", "ends_sha256", "up", *[F.coalesce(x, zero).alias(x) for x in ("kids", "dl")],
        (F.col("saved") + F.coalesce("ds", zero)).alias("ds"),
    )
    rows = ordered(
        rows, ["conv"], [-F.col("depth")], number="from_end", hot=hot, running={"n_leaves": F.col("dl"), "saved_tokens": F.col("ds")}
    )
    more = F.when(F.col("from_end") > 1, 1).otherwise(0)
    first_of_chain = F.col("up").isNotNull() | (F.col("depth") == 0)
    return rows.select(
        F.col("conv").alias("conv_id"), "depth", F.when(first_of_chain, F.col("up")).otherwise(F.col("conv")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), (F.col("kids") + more).alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(EMPTY_HASH)).alias("ends_sha256"),
    )


def prefix_trie(df: DataFrame, conv_id="conv_id", turn="turn", role="role", text="text", share: tuple[int, int] | None = (100, 6),
                ids: int = IDS, segment: int = SEGMENT) -> DataFrame:
    """The trie of all prefixes of the conversations in ``df`` (see ``numbered_turns``, ``with_shared_heads``, ``trie``).

    ``share`` = (every, most) rebuilds conversations with shared heads first; None takes them as they are. Repeated
    rows are further turns. An empty table gives no nodes. Other columns are not looked at.
    """
    turns = numbered_turns(df, conv_id, turn, role, text)
    if share:
        rebuilt, turnless = with_shared_heads(turns, *share)
    else:
        rebuilt, turnless = turns, turns.where(F.lit(False)).select("c")
    return trie(rebuilt, turnless, ids, segment)


SQL = """
WITH RECURSIVE o AS (SELECT conv_id AS c, struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) AS x, row_number() OVER (PARTITION BY conv_id
    ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS p FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT c, list(x ORDER BY p) AS s, cast(c AS varchar) AS name FROM o GROUP BY c),
crc AS (SELECT c, name, 0 AS i, 4294967295::bigint AS v FROM l UNION ALL
  SELECT c, name, i + 1, list_reduce([xor(v, ascii(name[i + 1])), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: xor(a >> 1, 3988292384 * (a & 1))) FROM crc WHERE i < len(name)),
h AS (SELECT c, xor(v, 4294967295) % 6 AS h FROM crc WHERE i = len(name)),
q AS (SELECT l.c, coalesce(b.s[1:h], []) || l.s[h + 1:] AS s FROM l JOIN h USING (c) LEFT JOIN l b ON b.c = l.c - l.c % 100),
e AS (SELECT s[1:d] AS k, d, c, d = len(s) AS last FROM (SELECT *, unnest(range(len(s) + 1)) AS d FROM q)),
n AS (SELECT k, d, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(cast(c AS varchar), ',' ORDER BY c) FILTER (last), '')) AS ends_sha256 FROM e GROUP BY k, d),
u AS (SELECT k[1:d - 1] AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
w AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN d > 0 THEN (n_convs - 1) * length(k[d].t) ELSE 0 END AS saved FROM n LEFT JOIN u USING (k)),
t AS (SELECT k[1:y] AS k, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM (SELECT *, unnest(range(d + 1)) AS y FROM w) GROUP BY 1)
SELECT w.conv_id, w.d AS depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves, cast(saved_tokens AS bigint) AS saved_tokens, w.ends_sha256
FROM w JOIN t USING (k) LEFT JOIN w p ON w.d > 0 AND p.k = w.k[1:w.d - 1]
"""


@query("op13_prefix_trie", SQL)
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(read(spark, sf_dir, "conversations"))
