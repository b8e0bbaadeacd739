"""Prefix trie of conversations in double arrays.

A node is a distinct sequence of first turns. Its key is the exclusive or of 128-bit hashes of its turns with their places, a
running aggregate over range partitions, so that neither a conversation nor a first turn that many share meets in one task.
Subtrees of at most SHARD_ROWS turns are shards: a task packs the BASE and CHECK arrays of its shards over dense turn
ids and walks every path through them. The nodes above, which shards share, are aggregated by Spark; what a shard has in
total goes up along the path of its smallest member.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldsmith.llm._text import record
from foldsmith.operators.scan import running
from foldsmith.session import materialize

#: Turns of the paths below a prefix from which on it is an upper node, and turns that a task packs at a time (about).
SHARD_ROWS = 4096
WORDS = r"[^\x20\x09-\x0D]+"
NODE = pa.schema(
    [("p1", pa.int64()), ("p2", pa.int64()), ("q1", pa.int64()), ("q2", pa.int64()), ("top", pa.bool_()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64())]
    + [(n, pa.int64()) for n in ("n_convs", "n_children", "n_leaves", "saved_tokens", "slot")]
)
NODE_DDL = "p1 long, p2 long, q1 long, q2 long, top boolean, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, slot long"


class DoubleArray:
    """A trie over dense symbols: the child of state s by symbol c is t = base[s] + c, if check[t] == s. State 0 is the root."""

    def __init__(self) -> None:
        self.base, self.check, self.end = np.zeros(64, np.int64), np.full(64, -1, np.int64), 1
        self.holes = np.empty(0, np.int64)

    def _reserve(self, end: int) -> None:
        while end > len(self.base):
            self.base = np.concatenate([self.base, np.zeros_like(self.base)])
            self.check = np.concatenate([self.check, np.full_like(self.check, -1)])
        self.end = max(self.end, end)

    def add_level(self, states: np.ndarray, symbols: np.ndarray) -> None:
        """Give states their children: distinct pairs, sorted by state and then symbol; no state may have children yet."""
        own, first, many = np.unique(states, return_index=True, return_counts=True)
        for s, a, n in zip(own[many > 1], first[many > 1], many[many > 1]):
            codes = symbols[a : a + n]
            self._place(int(s), codes - codes[0], int(codes[0]))
        one = many == 1
        n = int(one.sum())
        if n:
            free = np.concatenate([self.holes[:n], self.end + np.arange(max(0, n - len(self.holes)))])
            self.holes = self.holes[n:]
            self._reserve(int(free.max()) + 1)
            self.base[own[one]] = free - symbols[first[one]]
            self.check[free] = own[one]

    def _place(self, state: int, away: np.ndarray, least: int) -> None:
        """The first place where all children find free slots: among the holes, else at the end."""
        at = self.end
        if 0 < len(self.holes) * len(away) <= 1 << 16:
            slots = self.holes[:, None] + away
            fits = np.flatnonzero(((slots >= self.end) | (self.check[np.minimum(slots, len(self.check) - 1)] < 0)).all(axis=1))
            at = int(self.holes[fits[0]]) if len(fits) else at
        before = self.end
        self._reserve(at + int(away[-1]) + 1)
        self.base[state] = at - least
        self.check[at + away] = state
        new = np.arange(before, self.end)
        self.holes = np.concatenate([self.holes, new])
        self.holes = self.holes[self.check[self.holes] < 0]

    def step(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The children of the states by the symbols; -1 where there is none."""
        t = self.base[states] + symbols
        ok = (t > 0) & (t < self.end)
        return np.where(ok & (self.check[np.where(ok, t, 0)] == states), t, -1)


def pack(path: np.ndarray, level: np.ndarray, symbol: np.ndarray) -> tuple[DoubleArray, np.ndarray]:
    """(the double array of all paths, the slot of every row): rows of a path number, a level from 0 and any symbol.

    Symbols become dense ids in the order in which the levels meet them, so that siblings lie side by side. The slots come from
    walking the finished arrays.
    """
    raw = np.unique(symbol, return_inverse=True)[1].ravel()
    dense, known = np.full(raw.max(initial=-1) + 1, -1, np.int64), 0
    order = np.lexsort((level, path))
    path, level, raw = path[order], level[order], raw[order]
    cuts = np.searchsorted(np.sort(level), np.arange(level.max(initial=-1) + 2))
    by_level = np.argsort(level, kind="stable")
    trie, state = DoubleArray(), np.zeros(path.max(initial=-1) + 1, np.int64)
    for a, b in zip(cuts, cuts[1:]):
        rows = by_level[a:b]
        pairs = np.unique(np.stack([state[path[rows]], raw[rows]], axis=1), axis=0)
        met, first = np.unique(pairs[:, 1], return_index=True)
        new = met[np.argsort(first)]
        new = new[dense[new] < 0]
        dense[new] = known + np.arange(len(new))
        known += len(new)
        pairs[:, 1] = dense[pairs[:, 1]]
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        trie.add_level(pairs[:, 0], pairs[:, 1])
        state[path[rows]] = trie.step(state[path[rows]], dense[raw[rows]])
    slots, state = np.empty(len(path), np.int64), np.zeros_like(state)
    for a, b in zip(cuts, cuts[1:]):
        rows = by_level[a:b]
        state[path[rows]] = trie.step(state[path[rows]], dense[raw[rows]])
        slots[rows] = state[path[rows]]
    out = np.empty(len(path), np.int64)
    out[order] = slots
    return trie, out


def _pack_shards(rows: pa.Table) -> pa.Table:
    """The nodes of a bucket of shards: rows c, pos, cut, n, words, p1, p2, q1, q2, k1, k2, t1, t2 (the shard's prefix)."""
    c, pos, cut, n, words, p1, p2, q1, q2, k1, k2, t1, t2 = (rows[x].to_numpy() for x in ("c", "pos", "cut", "n", "words", "p1", "p2", "q1", "q2", "k1", "k2", "t1", "t2"))
    level = pos - cut
    # The first symbol of a path is its shard's prefix, the others are its turns.
    top = level == 0
    symbol = np.empty(len(c), [("top", bool), ("a", np.int64), ("b", np.int64)])
    symbol["top"], symbol["a"], symbol["b"] = top, np.where(top, t1, k1), np.where(top, t2, k2)
    path = np.unique(c, return_inverse=True)[1].ravel()
    trie, slot = pack(path, level, np.unique(symbol, return_inverse=True)[1].ravel())
    size = trie.end
    convs, least, depth, tokens = np.zeros(size, np.int64), np.full(size, np.iinfo(np.int64).max), np.full(size, -1, np.int64), np.zeros(size, np.int64)
    key = np.zeros((4, size), np.int64)
    np.add.at(convs, slot, n)
    np.minimum.at(least, slot, c)
    depth[slot], tokens[slot] = pos, words
    key[:, slot] = p1, p2, q1, q2
    used = np.flatnonzero(trie.check[:size] >= 0)
    parent = trie.check[used]
    children = np.bincount(parent, minlength=size)
    leaves, saved = (children == 0).astype(np.int64), (convs - 1) * tokens
    at_level = np.zeros(size, np.int64)
    at_level[slot] = level
    for k in range(int(level.max(initial=0)), 0, -1):
        here = used[at_level[used] == k]
        np.add.at(leaves, trie.check[here], leaves[here])
        np.add.at(saved, trie.check[here], saved[here])
    is_top = parent == 0
    up = pa.array(np.where(is_top, 0, least[parent]), mask=is_top)
    columns = [*key[:, used], is_top, least[used], depth[used], up, convs[used], children[used], leaves[used], saved[used], used]
    return pa.Table.from_batches([record(NODE, *columns)])


def rebuilt_turns(turns: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """(c, pos, k1, k2, words): the rebuilt conversations' turns by place, and at place 0 a row for the conversation itself.

    turns: conv_id, turn, role, text. Conversation c begins with the first h = crc32(c) mod `most` turns of conversation
    c - c % every and goes on with its own behind its first h. A turn is known by 128 bits of hashes of role and text,
    of which null counts as empty. Turns are ordered by turn, null first; equal ones by those hashes. Rows without conv_id are left out,
    repeated rows are turns of their own.
    """
    role, text = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in ("role", "text"))
    slim = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("c"), "turn", F.xxhash64(role, text).alias("k1"), F.xxhash64(F.lit(1), role, text).alias("k2"), F.regexp_count(text, F.lit(WORDS)).cast("long").alias("words"))
    own = running(slim, ["c"], [F.asc_nulls_first("turn"), F.col("k1"), F.col("k2")], {"k": ("sum", F.lit(1).cast("long"))})
    own = materialize(own, "trie-turns")
    size = own.groupBy("c").agg(F.max("k").alias("size"))
    h = F.pmod(F.crc32(F.col("c").cast("string").cast("binary")), F.lit(most))
    convs = size.select("c", (F.col("c") - F.col("c") % every).alias("base"), h.alias("h"))
    convs = convs.join(size.select(F.col("c").alias("base"), F.col("size").alias("have")), "base", "left").withColumn("have", F.least("h", F.coalesce("have", F.lit(0).cast("long"))))
    convs = materialize(convs, "trie-convs")
    heads = own.where(F.col("k") < most).select(F.col("c").alias("base"), F.col("k").alias("pos"), "k1", "k2", "words")
    a = convs.join(heads, "base").where("pos <= h").select("c", "pos", "k1", "k2", "words")
    b = own.join(convs.select("c", "h", "have"), "c").where("k > h").select("c", (F.col("k") - F.col("h") + F.col("have")).alias("pos"), "k1", "k2", "words")
    zero = F.lit(0).cast("long")
    return a.union(b).union(convs.select("c", zero, zero, zero, zero))


def _sha_of_runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(p1, p2, ends_sha256) of rows p1, p2, part, ids that come sorted: a node's parts are hashed one after the other."""
    schema = pa.schema([("p1", pa.int64()), ("p2", pa.int64()), ("ends_sha256", pa.string())])
    now, sha = None, None
    for batch in batches:
        out = []
        for p1, p2, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
            if now != (p1, p2):
                if now is not None:
                    out.append((*now, sha.hexdigest()))
                now, sha = (p1, p2), hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(ids.encode())
        if out:
            yield record(schema, *map(list, zip(*out)))
    if now is not None:
        yield record(schema, [now[0]], [now[1]], [sha.hexdigest()])


def _end_hashes(ends: DataFrame) -> DataFrame:
    """(p1, p2, ends_sha256) of (c, p1, p2): SHA-256 of each node's ids in ascending order, comma between.

    The ids are sorted over ranges; each range joins its own ids of a node, and one task hashes a node's stretches in a stream.
    """
    ranged = ends.repartitionByRange("p1", "p2", "c").withColumn("part", F.spark_partition_id())
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("c")), lambda x: x.cast("string")), ",")
    runs = materialize(ranged.groupBy("p1", "p2", "part").agg(ids.alias("ids")), "trie-ends")
    return runs.repartition("p1", "p2").sortWithinPartitions("p1", "p2", "part").mapInArrow(_sha_of_runs, "p1 long, p2 long, ends_sha256 string")


def prefix_nodes(turns: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """A row for each node of the trie of all rebuilt conversations (see rebuilt_turns): conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256, and the node's slot in its shard's arrays (null for upper nodes).

    An empty table has no node, as the root has no member; conversations without turns end in the root. Extra columns are not
    looked at. Equal rebuilt conversations go through the trie as one path with a count.
    """
    flat = rebuilt_turns(turns)
    mark = lambda *seed: F.when(F.col("pos") > 0, F.xxhash64(*seed, "k1", "k2", "pos")).otherwise(F.lit(0).cast("long"))
    keyed = running(flat.withColumns({"h1": mark(), "h2": mark(F.lit(1))}), ["c"], [F.col("pos")], {"p1": ("bit_xor", F.col("h1")), "p2": ("bit_xor", F.col("h2"))})
    keyed = materialize(keyed.withColumns({"q1": F.col("p1").bitwiseXOR(F.col("h1")), "q2": F.col("p2").bitwiseXOR(F.col("h2"))}).drop("h1", "h2"), "trie-keys")
    ends = materialize(keyed.groupBy("c").agg(F.max("pos").alias("len"), F.max_by(F.struct("p1", "p2"), "pos").alias("p")).select("c", "len", "p.*"), "trie-whole")
    paths = ends.groupBy("p1", "p2").agg(F.min("c").alias("c"), F.count("*").alias("n"), F.max("len").alias("len")).select("c", "n", "len")
    rows = materialize(keyed.join(paths, "c"), "trie-paths")
    # Turns below a prefix; it falls along every path, so the upper nodes are the first ones of a path.
    upper = rows.groupBy("p1", "p2").agg(F.sum(F.col("len") - F.col("pos") + 1).alias("below"), F.min("pos").alias("at")).where((F.col("below") > shard_rows) | (F.col("at") == 0))
    upper = materialize(upper, "trie-high")  # a join behind the aggregate itself could not be split at a prefix that many share
    rows = materialize(rows.join(upper.select("p1", "p2", F.lit(True).alias("upper")), ["p1", "p2"], "left").withColumn("upper", F.coalesce("upper", F.lit(False))), "trie-cut")
    high, low = rows.where("upper"), rows.where("NOT upper")
    tops = low.groupBy("c").agg(F.min("pos").alias("cut"), F.min_by(F.struct(F.col("p1").alias("t1"), F.col("p2").alias("t2")), "pos").alias("t")).select("c", "cut", "t.*")
    low = low.join(tops, "c")
    buckets = max(1, -(-low.count() // shard_rows))
    shards = low.groupBy(F.pmod(F.xxhash64("t1", "t2"), F.lit(buckets)).alias("bucket")).applyInArrow(_pack_shards, NODE_DDL)
    shards = materialize(shards, "trie-shards")
    # Upper nodes: members and children by their key, sums over their subtrees along the paths of smallest members.
    nodes = high.groupBy("p1", "p2").agg(F.max("q1").alias("q1"), F.max("q2").alias("q2"), F.min("c").alias("conv_id"), F.max("pos").alias("depth"), F.sum("n").alias("n_convs"), F.max("words").alias("words"))
    nodes = materialize(nodes, "trie-upper")
    born = nodes.where("depth > 0").select("q1", "q2").union(shards.where("top").select("q1", "q2")).groupBy("q1", "q2").agg(F.count("*").alias("n_children"))
    zero = F.lit(0).cast("long")
    nodes = nodes.join(born.select(F.col("q1").alias("p1"), F.col("q2").alias("p2"), "n_children"), ["p1", "p2"], "left").withColumn("n_children", F.coalesce("n_children", zero))
    nodes = materialize(nodes, "trie-born")
    own = nodes.select(F.col("conv_id").alias("c"), F.col("depth").alias("pos"), (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    lower = shards.where("top").select(F.col("conv_id").alias("c"), (F.col("depth") - 1).alias("pos"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
    gained = own.union(lower).groupBy("c", "pos").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    along = running(high.join(gained, ["c", "pos"], "left").select("c", "pos", "p1", "p2", "leaves", "saved"), ["c"], [F.desc("pos")], {"n_leaves": ("sum", F.col("leaves")), "saved_tokens": ("sum", F.col("saved"))})
    sums = along.groupBy("p1", "p2").agg(*(F.coalesce(F.sum(x), zero).alias(x) for x in ("n_leaves", "saved_tokens")))
    up = nodes.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("up"))
    cols = ["p1", "p2", "q1", "q2", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "slot"]
    no = F.lit(None).cast("long")
    all_nodes = nodes.join(sums, ["p1", "p2"]).withColumns({"parent_conv_id": no, "slot": no}).select(*cols).union(shards.select(*cols))
    all_nodes = all_nodes.join(up, ["q1", "q2"], "left")
    parent = F.when(F.col("depth") > 0, F.coalesce("parent_conv_id", "up"))
    hashes = _end_hashes(ends.select("c", "p1", "p2"))
    sha = F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest()))
    return all_nodes.join(hashes, ["p1", "p2"], "left").select("conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", sha.alias("ends_sha256"), "slot")
