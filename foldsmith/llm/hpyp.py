"""Language-model scoring with a hierarchical Pitman-Yor model of words.

Every word seen in training has a restaurant of its own for the word after it, and so has the beginning of a text; all
of these share their parent, the restaurant of the empty context, whose base is uniform over the training words and one
unknown. A context's customers are the words after it, a table is a customer of the parent.

Gibbs moves. With the sizes of tables summed out, the seating of a dish is its number of tables t of c customers,
with weight S(c, t) (d x g)**t: S is the generalised Stirling number of discount d, g the parent's probability
of the word, and x ~ Gamma(theta / d + tables of the restaurant), which makes the dishes of a restaurant independent.
A sweep draws x for each restaurant and then reseats all customers of every dish at once from that exact
conditional (beyond EXACT customers, from its limit, 1 + Poisson or normal). A pass is some sweeps under given g; the tables then go to
the parent, which is reseated likewise and draws g anew. What a seat at a new table of the parent gives to a
word is taken at its mean. The scores use the mean of the conditional expectations of the last pass.

Placement. Texts are tokenized once, into blocks with a vocabulary each; words are known by 64-bit hashes (two of 5
million words share one with a chance of 1e-6). Words are numbered in buckets by hash. A block then sends each bucket the
pairs of its contexts, counted; the bucket keeps what each block asked beside their sum and answers it in the end. So
a pair costs some bytes for each block that has it and nothing for each place. A context of more than `hot`
training tokens is dealt to several buckets by the word after it. Blocks and contexts are written in
buckets of Spark, so the joins with the small tables of a pass leave them where they are.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldsmith.llm._text import binary_text, record, text_slices
from foldsmith.session import drop_scratch, materialize, scratch_path

#: Bytes of text of a block; tokens for each bucket; training tokens of a context for each of its buckets.
BLOCK, BUCKET, HOT = 8 << 20, 3 << 20, 2 << 20
#: Passes, sweeps of a pass, those of them that are averaged; concentration; customers of a dish up to which S is tabled.
PASSES, SWEEPS, KEPT, THETA, EXACT = 3, 6, 4, 1.0, 512
END = xxhash.xxh64_intdigest(b" end")  # no word has a space
#: The word of a pair that only names its context.
NO_WORD = 0xFFFFFFFF


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed cell, each byte of their numbers on its own."""
    zip_ = zstandard.ZstdCompressor(level=1).compress
    parts = [zip_(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()) for a in arrays]
    return np.array([len(p) for p in parts], np.int64).tobytes() + b"".join(parts)


def unpack(cell: bytes, *kinds) -> list[np.ndarray]:
    """The arrays of a packed cell, of the given types."""
    ends = np.append(0, np.cumsum(np.frombuffer(cell[: 8 * len(kinds)], np.int64))) + 8 * len(kinds)
    raw = zstandard.ZstdDecompressor().decompress
    out = []
    for a, b, k in zip(ends, ends[1:], kinds):
        planes = np.frombuffer(raw(cell[a:b]), np.uint8).reshape(np.dtype(k).itemsize, -1)
        out.append(np.ascontiguousarray(planes.T).view(k).ravel())
    return out


def _steps(x: np.ndarray, group: np.ndarray | None = None) -> np.ndarray:
    """Differences of ascending numbers, beginning anew with each group."""
    out = np.diff(x, prepend=x.dtype.type(0))
    if group is not None and len(x):
        first = np.append(True, group[1:] != group[:-1])
        out[first] = x[first]
    return out


def _sums(steps: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers that _steps made differences of, for groups of the given sizes."""
    total = np.cumsum(steps.astype(np.int64))
    sizes = sizes[sizes > 0]
    first = np.cumsum(sizes) - sizes
    return total - np.repeat(total[first] - steps[first], sizes)


def _cells(batches):
    """Rows of record batches, one at a time."""
    for batch in batches:
        for i in range(len(batch)):
            yield [c[i].as_py() for c in batch.columns]


BLOCKS = "block long, n_words long, body binary, vocab binary"


def token_blocks(docs: DataFrame) -> DataFrame:
    """Blocks of (doc_id, train, text) rows. body: ids, lengths, train and word codes; vocab: hash of each code. Code 0 is the end."""
    schema = pa.schema([("block", pa.int64()), ("n_words", pa.int64()), ("body", pa.binary()), ("vocab", pa.binary())])

    def run(batches):
        part, n = TaskContext.get().partitionId(), 0

        def fresh():
            vocab: dict = defaultdict(count(1).__next__)
            return vocab, [], 0

        vocab, held, size = fresh()

        def flush():
            digest = np.array([END, *map(xxhash.xxh64_intdigest, vocab)], np.uint64)
            docs, lens, train, codes = (np.concatenate([h[i] for h in held]) for i in range(4))
            return record(schema, [part << 24 | n], [len(codes)], [pack(docs, lens, train, codes)], [pack(digest)])

        for piece, texts in text_slices(batches, 2, 1 << 20):
            get = vocab.__getitem__
            codes = [[*map(get, t.lower().split()), 0] for t in texts]
            lens = np.array([len(c) for c in codes], np.int64)
            flat = np.fromiter((x for c in codes for x in c), np.uint32, int(lens.sum()))
            who = np.where(np.asarray(piece.column(0).is_null()), np.iinfo(np.int64).min, np.asarray(piece.column(0).fill_null(0)))
            held.append((who, lens, np.asarray(piece.column(1).cast(pa.int8())), flat))
            size += sum(map(len, texts))
            if size >= BLOCK:
                yield flush()
                n += 1
                vocab, held, size = fresh()
        if held:
            yield flush()

    return docs.mapInArrow(run, BLOCKS)


class Block:
    """The arrays of a block row; doc: the text of each token."""

    def __init__(self, body: bytes):
        self.docs, self.lens, train, codes = unpack(body, np.int64, np.int64, np.int8, np.uint32)
        self.train, self.codes = train.astype(bool), codes.astype(np.int64)
        self.doc = np.repeat(np.arange(len(self.lens)), self.lens)

    def counts(self, size: int) -> np.ndarray:
        """Training tokens of each code."""
        return np.bincount(self.codes[self.train[self.doc]], minlength=size)


MESSAGE = "bucket int, block long, cell binary"
_MESSAGE = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("cell", pa.binary())])


def _gather(messages: DataFrame, buckets: int, run, ddl: str) -> DataFrame:
    """run(bucket, blocks, cells) once for each bucket; it yields record batches."""

    def go(batches):
        now, blocks, cells = None, [], []
        for bucket, block, cell in _cells(batches):
            if bucket != now:
                if cells:
                    yield from run(now, blocks, cells)
                now, blocks, cells = bucket, [], []
            blocks.append(block)
            cells.append(cell)
        if cells:
            yield from run(now, blocks, cells)

    return messages.select("bucket", "block", "cell").repartition(buckets, "bucket").sortWithinPartitions("bucket", "block").mapInArrow(go, ddl)


def number_words(blocks: DataFrame, buckets: int) -> DataFrame:
    """(block, body, known): blocks with the number and the training tokens of each code's word.

    A word's number modulo `buckets` is its bucket, and frequent words have small numbers.
    """

    def ask(batches):
        for block, body, vocab in _cells(batches):
            words = unpack(vocab, np.uint64)[0]
            order = np.argsort(words)
            n = Block(body).counts(len(words))[order]
            words = words[order]
            cuts = np.searchsorted((words >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))
            for i, (a, z) in enumerate(zip(cuts, cuts[1:])):
                if z > a:
                    yield record(_MESSAGE, [i], [block], [pack(_steps(words[a:z]), n[a:z])])

    def number(bucket, asked, cells):
        parts = [unpack(c, np.uint64, np.int64) for c in cells]
        words, at = np.unique(np.concatenate([np.cumsum(w, dtype=np.uint64) for w, _ in parts]), return_inverse=True)
        total = np.bincount(at, np.concatenate([n for _, n in parts]), len(words)).astype(np.int64)
        rank = np.empty(len(words), np.int64)
        rank[np.lexsort((words, -total))] = np.arange(len(words))
        if int(rank.max()) * buckets + bucket >= NO_WORD:
            raise ValueError("more words than 32-bit numbers")
        ends = np.cumsum([len(w) for w, _ in parts])
        for block, a, z in zip(asked, np.append(0, ends), ends):
            yield record(_MESSAGE, [bucket], [block], [pack((rank[at[a:z]] * buckets + bucket).astype(np.uint32), total[at[a:z]])])

    replies = _gather(blocks.select("block", "body", "vocab").mapInArrow(ask, MESSAGE), buckets, number, MESSAGE)
    schema = pa.schema([("block", pa.int64()), ("body", pa.binary()), ("known", pa.binary())])

    def attach(batches):
        for block, body, vocab, got in _cells(batches):
            order = np.argsort(unpack(vocab, np.uint64)[0])
            ids, n = (np.concatenate(x) for x in zip(*(unpack(r["cell"], np.uint32, np.int64) for r in got)))
            own = np.empty_like(ids), np.empty_like(n)
            for to, x in zip(own, (ids, n)):
                to[order] = x
            yield record(schema, [block], [body], [pack(*own)])

    return blocks.drop("n_words").join(_answers(replies), "block").mapInArrow(attach, "block long, body binary, known binary")


def _answers(replies: DataFrame) -> DataFrame:
    """(block, got): all replies to a block, by bucket."""
    return replies.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "cell"))).alias("got"))


class Pairs:
    """The different pairs of (context, word after it) of a block in the order of its messages.

    u, w: codes, w -1 for a pair that only names a context of several buckets; n: training tokens; to: bucket; at: the
    pair of each token.
    """

    def __init__(self, b: Block, ids: np.ndarray, total: np.ndarray, buckets: int, hot: int = HOT):
        before = np.append(0, b.codes[:-1])  # every text ends with code 0, which stands for the beginning of the next
        key, at = np.unique(before << 32 | b.codes, return_inverse=True)
        n = np.bincount(at, b.train[b.doc], len(key)).astype(np.int64)
        u, w = key >> 32, key & NO_WORD
        self.parts = np.minimum(1 + total // hot, buckets)
        some = np.flatnonzero(self.parts > 1)
        more = np.repeat(some, self.parts[some])
        nth = np.arange(len(more)) - np.repeat(np.cumsum(self.parts[some]) - self.parts[some], self.parts[some])
        wide = ids.astype(np.int64)
        part = np.append((wide[w] * 0x9E3779B1 >> 7) % self.parts[u], nth)
        u, w, n = np.append(u, more), np.append(w, np.full(len(more), -1)), np.append(n, np.zeros(len(more), np.int64))
        number = np.where(w < 0, NO_WORD, wide[w])
        order = np.argsort(wide[u] << 32 | number if len(u) and wide.max() < 1 << 31 else _wide_key(wide[u], number))
        to = ((wide[u] + part) % buckets)[order]
        order, to = order[np.argsort(to, kind="stable")], np.sort(to, kind="stable")
        self.u, self.w, self.n, self.to, self.number = u[order], w[order], n[order], to, number[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.at = place[at]

    def messages(self, buckets: int):
        """(bucket, slice) of each message."""
        cuts = np.searchsorted(self.to, np.arange(buckets + 1))
        return [(i, slice(a, z)) for i, (a, z) in enumerate(zip(cuts, cuts[1:])) if z > a]


def _wide_key(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return u.astype(np.uint64) << np.uint64(32) | w.astype(np.uint64)


def _groups(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place, length) of each run of equal neighbours."""
    first = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.empty(0, np.int64)
    return first, np.diff(np.append(first, len(x)))


#: Arrays of a message: number, pairs, buckets and training tokens of each context, then steps of the words' numbers and tokens.
ASK = (np.uint32, np.uint32, np.uint32, np.uint32, np.uint32, np.uint32)
CONTEXTS = "bucket int, cell binary, blocks array<long>, asks array<binary>, pairs long, once long, twice long, words long, tokens long"


def merge_pairs(known: DataFrame, buckets: int, hot: int = HOT) -> DataFrame:
    """One row for each bucket. cell: its contexts and the training tokens of their pairs; asks: the messages of the blocks."""
    schema = pa.schema([("bucket", pa.int32()), ("cell", pa.binary()), ("blocks", pa.list_(pa.int64())), ("asks", pa.list_(pa.binary())), *((c, pa.int64()) for c in ("pairs", "once", "twice", "words", "tokens"))])

    def send(batches):
        for block, body, cell in _cells(batches):
            ids, total = unpack(cell, np.uint32, np.int64)
            b = Block(body)
            own, p = b.counts(len(ids)), Pairs(b, ids, total, buckets, hot)
            for bucket, part in p.messages(buckets):
                first, k = _groups(p.u[part])
                u = p.u[part][first]
                mine = np.where(ids[u] % buckets == bucket, own[u], 0)
                number = _steps(p.number[part].astype(np.uint32), p.u[part])
                yield record(_MESSAGE, [bucket], [block], [pack(_steps(ids[u]), *(x.astype(np.uint32) for x in (k, p.parts[u], mine, number, p.n[part])))])

    def merge(bucket, asked, cells):
        key, n, names, parts, mine = [], [], [], [], []
        for cell in cells:
            u, w, m, k, split, own = read_ask(cell)
            key.append(_wide_key(np.repeat(u, k), w))
            n.append(m)
            names.append(u)
            parts.append(split)
            mine.append(own)
        u, at = np.unique(np.concatenate(names), return_inverse=True)
        split = np.ones(len(u), np.int64)
        split[at] = np.concatenate(parts)
        own = np.bincount(at, np.concatenate(mine), len(u)).astype(np.int64)
        key, at = np.unique(np.concatenate(key), return_inverse=True)
        c = np.bincount(at, np.concatenate(n), len(key)).astype(np.int64)
        key, c = key[c > 0], c[c > 0]
        k = np.diff(np.searchsorted(key, np.append(u.astype(np.uint64) << np.uint64(32), np.uint64(2**64 - 1))))
        w = (key & np.uint64(NO_WORD)).astype(np.uint32)
        cell = pack(_steps(u.astype(np.uint32)), k.astype(np.uint32), split.astype(np.uint32), _steps(w, key >> np.uint64(32)), c)
        numbers = [len(c), (c == 1).sum(), (c == 2).sum(), (own > 0).sum(), own.sum()]
        yield record(schema, [bucket], [cell], [asked], [cells], *([int(x)] for x in numbers))

    return _gather(known.mapInArrow(send, MESSAGE), buckets, merge, CONTEXTS)


def read_ask(cell: bytes):
    """(contexts, words and tokens of their pairs, pairs of each context, its buckets, its training tokens)."""
    u, k, split, own, w, n = unpack(cell, *ASK)
    k = k.astype(np.int64)
    return np.cumsum(u.astype(np.int64)), _sums(w, k), n.astype(np.int64), k, split.astype(np.int64), own.astype(np.int64)


@lru_cache(maxsize=4)
def log_stirling(d: float, size: int = EXACT) -> np.ndarray:
    """Logarithms of S(c, t), c and t up to size: S(c + 1, t) = S(c, t - 1) + (c - d t) S(c, t), S(1, 1) = 1."""
    out = np.full((size + 1, size + 1), -np.inf)
    out[1, 1] = 0.0
    t = np.arange(size + 1)
    with np.errstate(divide="ignore"):
        for c in range(1, size):
            out[c + 1, 1:] = np.logaddexp(out[c, :-1], out[c, 1:] + np.log(np.maximum(c - d * t[1:], 0)))
    return out


def draw_tables(c: np.ndarray, y: np.ndarray, d: float, rnd: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(expected, drawn) tables of dishes with c customers and weights S(c, t) y**t."""
    mean, drawn = np.ones(len(c)), np.ones(len(c), np.int64)
    order = np.argsort(c, kind="stable")
    size = c[order]
    table, at, end = log_stirling(d), int(np.searchsorted(size, 2)), int(np.searchsorted(size, EXACT, "right"))
    while at < end:
        width = min(EXACT, int(size[at]) * 5 // 4)
        stop = min(int(np.searchsorted(size[:end], width, "right")), at + max(1, (1 << 20) // width))
        rows, t = order[at:stop], np.arange(1, width + 1)
        weight = table[c[rows], 1 : width + 1] + np.log(y[rows])[:, None] * t
        weight = np.exp(weight - weight.max(axis=1, keepdims=True))
        upto = np.cumsum(weight, axis=1)
        mean[rows] = weight @ t / upto[:, -1]
        drawn[rows] = 1 + np.minimum((upto < (rnd.random(len(rows)) * upto[:, -1])[:, None]).sum(axis=1), c[rows] - 1)
        at = stop
    rows = order[end:]
    if len(rows):
        # The saddle point of the generating function (1 - (1 - z)**d)**t lies at r = 1 - z with (1 - r) r**(d - 1) = c / y.
        low, high = np.full(len(rows), -600.0), np.zeros(len(rows))
        for _ in range(50):
            mid = (low + high) / 2
            over = np.log1p(-np.exp(mid)) + (d - 1) * mid > np.log(c[rows] / y[rows])
            low, high = np.where(over, mid, low), np.where(over, high, mid)
        r = np.exp(low)
        rate = y[rows] / d * (1 - r**d)
        mean[rows] = np.minimum(1 + rate, c[rows])
        spread = rate - y[rows] * r ** (d - 1) / (1 / (1 - r) + (1 - d) / r)  # derivative of the rate by log y
        normal = np.rint(rate + np.sqrt(np.maximum(spread, 0)) * rnd.standard_normal(len(rows)))
        drawn[rows] = np.clip(1 + np.where(rate > 50, normal, rnd.poisson(rate)), 1, c[rows])
    return mean, drawn


class Contexts:
    """The restaurants of a bucket: customers c of each pair (by context and word) and the draws of their tables."""

    def __init__(self, cell: bytes, buckets: int):
        u, k, split, w, c = unpack(cell, np.uint32, np.uint32, np.uint32, np.uint32, np.int64)
        self.u, k, self.split = np.cumsum(u.astype(np.int64)), k.astype(np.int64), split.astype(np.int64)
        self.w, self.c = _sums(w, k), c
        self.at = np.repeat(np.arange(len(self.u)), k)
        self.many = np.flatnonzero(c > 1)  # a lone customer has one table
        self.alone = np.bincount(self.at[c == 1], minlength=len(self.u))
        words, at = np.unique(self.w[self.many], return_inverse=True)
        order = np.argsort(words % buckets, kind="stable")
        self.words, place = words[order], np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.word = place[at]  # of each pair of two customers or more
        self.cuts = np.searchsorted(self.words % buckets, np.arange(buckets + 1))

    def sweeps(self, g: np.ndarray, d: float, rnd: np.random.Generator, sweeps: int = SWEEPS, kept: int = KEPT):
        """Draw x and all tables `sweeps` times; (mean of the last `kept` expectations, last tables) of the pairs of `many`.

        g: the parent's probability of each of `words`. A context in several buckets takes its tables elsewhere to be as many as here.
        """
        c, at, mean = self.c[self.many], self.at[self.many], np.zeros(len(self.many))
        t = np.ones(len(self.many), np.int64)
        for i in range(sweeps):
            tables = (self.alone + np.bincount(at, t, len(self.u))) * self.split
            x = rnd.standard_gamma(THETA / d + tables)
            expected, t = draw_tables(c, np.maximum(d * x[at] * g[self.word], 1e-300), d, rnd)
            if i >= sweeps - kept:
                mean += expected / kept
        return mean, t


UP = "bucket int, block long, cell binary, tables long"
_UP = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("cell", pa.binary()), ("tables", pa.int64())])


def first_tables(contexts: DataFrame, buckets: int) -> DataFrame:
    """One table for each pair, sent to the words' buckets; block: the contexts' bucket."""

    def run(batches):
        for bucket, cell in _cells(batches):
            k = Contexts(cell, buckets)
            t = np.bincount(k.word, minlength=len(k.words))
            lone, n = np.unique(k.w[k.c == 1], return_counts=True)
            order = np.argsort(lone % buckets, kind="stable")
            lone, n = lone[order], n[order]
            cuts = np.searchsorted(lone % buckets, np.arange(buckets + 1))
            for to in range(buckets):
                a, b = slice(k.cuts[to], k.cuts[to + 1]), slice(cuts[to], cuts[to + 1])
                if a.stop > a.start or b.stop > b.start:
                    yield record(_UP, [to], [bucket], [pack(_steps(k.words[a].astype(np.uint32)), t[a], _steps(lone[b].astype(np.uint32)), n[b])], [int(t[a].sum() + n[b].sum())])

    return contexts.select("bucket", "cell").mapInArrow(run, UP)


ROOTS = "bucket int, cell binary, once long, twice long"
DOWN = "bucket int, block long, cell binary, root binary, tables double"


def sum_roots(ups: DataFrame, buckets: int) -> DataFrame:
    """(bucket, cell, once, twice): the words of a bucket that have customers at the root, and their tables of lone customers."""
    schema = pa.schema([("bucket", pa.int32()), ("cell", pa.binary()), ("once", pa.int64()), ("twice", pa.int64())])

    def run(bucket, sources, cells):
        parts = [unpack(c, np.uint32, np.int64, np.uint32, np.int64) for c in cells]
        many, n, lone, m = (np.concatenate([np.cumsum(p[i], dtype=np.int64) if i in (0, 2) else p[i] for p in parts]) for i in range(4))
        words, at = np.unique(np.concatenate([lone, many]), return_inverse=True)
        fixed = np.bincount(at[: len(lone)], m, len(words)).astype(np.int64)
        c = fixed + np.bincount(at[len(lone) :], n, len(words)).astype(np.int64)
        yield record(schema, [bucket], [pack(_steps(words.astype(np.uint32)), fixed)], [int((c == 1).sum())], [int((c == 2).sum())])

    return _gather(ups, buckets, run, ROOTS)


class Root:
    """What all buckets know of the root: customers, tables, discount, words."""

    def __init__(self, customers: float, tables: float, d: float, words: int):
        self.c, self.t, self.d, self.base = customers, tables, d, 1 / (words + 1)

    @property
    def fresh(self) -> float:
        """What every word has from new tables."""
        return (THETA + self.d * self.t) * self.base


def reseat_root(roots: DataFrame, ups: DataFrame, root: Root, buckets: int, seed: int, final: bool) -> DataFrame:
    """Reseat the tables that came up as customers of the root.

    Rows with a block (the contexts' bucket) answer it: its words' probabilities, drawn anew. One row of each bucket without a
    block has its tables and, at the end, its words' numerators c - d t.
    """
    schema = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("cell", pa.binary()), ("root", pa.binary()), ("tables", pa.float64())])
    x = float(np.random.default_rng(seed).standard_gamma(THETA / root.d + root.t))

    def run(bucket, sources, cells):
        rnd = np.random.default_rng([seed, bucket])
        own = sources.index(-1)
        words, fixed = unpack(cells[own], np.uint32, np.int64)
        words = np.cumsum(words, dtype=np.int64)
        parts = [(s, *unpack(c, np.uint32, np.int64)) for s, c in zip(sources, cells) if s >= 0]
        place = [np.searchsorted(words, np.cumsum(w, dtype=np.int64)) for _, w, _ in parts]
        c = fixed.copy()
        for at, (_, _, t) in zip(place, parts):
            c[at] += t
        mean, t = draw_tables(c, np.full(len(c), root.d * x * root.base), root.d, rnd)
        value = c - root.d * mean
        yield record(schema, [bucket], [None], [None], [pack(_steps(words.astype(np.uint32)), value) if final else None], [float(mean.sum() if final else t.sum())])
        g = ((rnd.standard_gamma(c - root.d * t) + root.fresh) / (THETA + root.c)).astype(np.float32)
        for at, (source, *_) in zip(place, parts):
            if not final and len(at):
                yield record(schema, [bucket], [source], [pack(g[at])], [None], [0.0])

    known = roots.select("bucket", F.lit(-1).cast("long").alias("block"), "cell")
    return _gather(known.union(ups.select("bucket", "block", "cell")), buckets, run, DOWN)


def first_probabilities(ups: DataFrame, total: int, buckets: int) -> DataFrame:
    """Answers like those of reseat_root before any tables were drawn: shares of the root's customers."""
    schema = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("cell", pa.binary()), ("root", pa.binary()), ("tables", pa.float64())])

    def run(bucket, sources, cells):
        parts = [unpack(c, np.uint32, np.int64, np.uint32, np.int64) for c in cells]
        many, n, lone, m = ([np.cumsum(p[i], dtype=np.int64) if i in (0, 2) else p[i] for p in parts] for i in range(4))
        words, at = np.unique(np.concatenate([*lone, *many]), return_inverse=True)
        c = np.bincount(at, np.concatenate([*m, *n]), len(words))
        for source, w in zip(sources, many):
            if len(w):
                yield record(schema, [bucket], [source], [pack((c[np.searchsorted(words, w)] / total).astype(np.float32))], [None], [0.0])

    return _gather(ups, buckets, run, DOWN)


def _given(contexts: DataFrame, down: DataFrame, *columns: str) -> DataFrame:
    """Rows of contexts with all answers to their bucket, by the answering bucket; contexts stay where they are."""
    got = down.where("block IS NOT NULL").select(F.col("block").cast("int").alias("bucket"), F.struct("bucket", "cell").alias("x"))
    got = got.groupBy("bucket").agg(F.sort_array(F.collect_list("x")).alias("got"))
    return contexts.select("bucket", "cell", *columns).join(got, "bucket", "left").select("bucket", "cell", "got", *columns)


def _probabilities(got) -> np.ndarray:
    return np.concatenate([np.empty(0, np.float32), *(unpack(r["cell"], np.float32)[0] for r in got or [])])


def draw_contexts(contexts: DataFrame, down: DataFrame, d: float, buckets: int, seed: int) -> DataFrame:
    """A pass over the contexts; the tables of pairs of two customers or more go up."""

    def run(batches):
        for bucket, cell, got in _cells(batches):
            k = Contexts(cell, buckets)
            _, t = k.sweeps(_probabilities(got), d, np.random.default_rng([seed, bucket]))
            total = np.bincount(k.word, t, len(k.words)).astype(np.int64)
            lone = int((k.c == 1).sum())
            yield record(_UP, [0], [None], [None], [lone])
            for to in range(buckets):
                a = slice(k.cuts[to], k.cuts[to + 1])
                if a.stop > a.start:
                    yield record(_UP, [to], [bucket], [pack(_steps(k.words[a].astype(np.uint32)), total[a])], [int(total[a].sum())])

    return _given(contexts, down).mapInArrow(run, UP)


def answer(contexts: DataFrame, down: DataFrame, final: DataFrame, d: float, buckets: int, seed: int) -> DataFrame:
    """The last pass again, for what the blocks asked: tables and root numerator of their contexts, numerators c - d t of their pairs."""
    root = final.where("block IS NULL").select("bucket", "root")

    def run(batches):
        for bucket, cell, got, blocks, asks, roots in _cells(batches):
            k = Contexts(cell, buckets)
            mean, _ = k.sweeps(_probabilities(got), d, np.random.default_rng([seed, bucket]))
            t = np.ones(len(k.c))
            t[k.many] = mean
            value = np.append(_short(k.c - d * t), np.float32(0))
            tables = np.bincount(k.at, t, len(k.u))
            key = _wide_key(k.u[k.at], k.w)
            words, numerator = unpack(roots, np.uint32, np.float64) if roots else (np.empty(0, np.uint32), np.empty(0))
            words = np.append(np.cumsum(words, dtype=np.int64), NO_WORD)
            numerator = np.append(numerator, 0)
            for block, ask in zip(blocks, asks):
                u, w, _, n, _, _ = read_ask(ask)
                want = _wide_key(np.repeat(u, n), w)
                at = np.searchsorted(key, want)
                found = np.append(key, np.uint64(0))[at] == want
                own = np.minimum(np.searchsorted(words, u), len(words) - 1)
                at_u = np.searchsorted(k.u, u)
                yield record(_MESSAGE, [bucket], [block], [pack(tables[at_u].astype(np.float32), np.where(words[own] == u, numerator[own], 0), value[np.where(found, at, len(key))])])

    given = _given(contexts, down, "blocks", "asks").join(root, "bucket", "left").select("bucket", "cell", "got", "blocks", "asks", "root")
    return given.mapInArrow(run, MESSAGE)


def _short(x: np.ndarray) -> np.ndarray:
    """float32 of 16 bits of fraction, so a byte of each number is zero."""
    return ((x.astype(np.float32).view(np.uint32) + np.uint32(128)) & np.uint32(0xFFFFFF00)).view(np.float32)


def bucketed(df: DataFrame, by: str, buckets: int, name: str) -> DataFrame:
    """df written to the shared folder in buckets of a column, so that joins on it move only their other side."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, by).option("path", scratch_path(spark, name)).saveAsTable(table)
    return spark.table(table)


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", train: str = "train", bucket_tokens: int = BUCKET, hot: int = HOT, passes: int = PASSES) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity) of every row.

    The boolean column `train` marks the rows to learn from, null counts as false. Tokens are the A-Z lower-cased words
    and one end; a null text has the end alone. base_score is the add-one unigram log10 probability, score the model's,
    perplexity 10 ** (-score / n_tokens). Repeated rows and null ids keep a row each, other columns are left out. Without
    training rows the model is its base, probability 1. An empty table gives an empty result.
    """
    own = docs.select(F.col(doc_id).cast("long").alias(doc_id), F.coalesce(F.col(train), F.lit(False)).alias("_train"), F.col(text).alias("_text"))
    blocks = materialize(token_blocks(binary_text(own, doc_id, "_train", "_text")), "hpyp-blocks")
    size = blocks.agg(F.count("*"), F.sum("n_words")).first()
    buckets = max(2, -(-(size[1] or 0) // bucket_tokens))
    wide = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = bucketed(number_words(blocks, buckets), "block", max(wide, size[0]), "hpyp_known")
    drop_scratch(blocks)
    contexts = bucketed(merge_pairs(known, buckets, hot), "bucket", max(wide, buckets), "hpyp_contexts")
    s = contexts.agg(*(F.sum(c).alias(c) for c in ("pairs", "once", "twice", "words", "tokens"))).first()
    words, tokens = s.words or 0, s.tokens or 0
    d = _discount(s.once, s.twice)
    ups = materialize(first_tables(contexts, buckets), "hpyp-tables")
    roots = materialize(sum_roots(ups, buckets), "hpyp-roots")
    r = roots.agg(F.sum("once"), F.sum("twice")).first()
    root = Root(s.pairs or 0, words, _discount(*r), words)
    down = materialize(first_probabilities(ups, max(s.pairs or 0, 1), buckets), "hpyp-down")
    for i in range(passes):
        drop_scratch(ups)
        ups = materialize(draw_contexts(contexts, down, d, buckets, i), "hpyp-tables")
        root.c = ups.agg(F.sum("tables")).first()[0] or 0
        last = i == passes - 1
        new = materialize(reseat_root(roots, ups.where("cell IS NOT NULL"), root, buckets, 1000 + i, last), "hpyp-down")
        root.t = new.agg(F.sum("tables")).first()[0] or 0
        if not last:
            drop_scratch(down)
            down = new
    replies = answer(contexts, down, new, d, buckets, passes - 1)
    return _score_blocks(known, replies, d, root, buckets, hot, words, tokens, doc_id)


def _discount(once, twice) -> float:
    """n1 / (n1 + 2 n2) of the dishes with one and two customers."""
    return float(np.clip((once or 0) / max((once or 0) + 2 * (twice or 0), 1), 0.1, 0.95))


def _score_blocks(known: DataFrame, replies: DataFrame, d: float, root: Root, buckets: int, hot: int, n_words: int, n_train: int, doc_id: str) -> DataFrame:
    ddl = f"`{doc_id}` long, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    schema = pa.schema([(doc_id, pa.int64()), *((c, pa.int64()) for c in ("n_tokens", "n_known", "train_tokens")), *((c, pa.float64()) for c in ("base_score", "score", "perplexity"))])

    def finish(batches):
        for body, cell, got in _cells(batches):
            b = Block(body)
            ids, c = unpack(cell, np.uint32, np.int64)
            p = Pairs(b, ids, c, buckets, hot)
            tables, numerator, value = np.zeros(len(ids)), np.zeros(len(ids)), []
            for r, (_, part) in zip(got, p.messages(buckets)):
                t, n, x = unpack(r["cell"], np.float32, np.float64, np.float32)
                u = p.u[part][_groups(p.u[part])[0]]
                tables[u] += t
                numerator[u] += n
                value.append(x)
            p0 = (numerator + root.fresh) / (THETA + root.c)
            prob = (np.concatenate(value).astype(float) + (THETA + d * tables[p.u]) * p0[p.w]) / (THETA + c[p.u])
            docs = len(b.lens)
            total = np.bincount(b.doc, np.log10(prob)[p.at], docs)
            base = np.bincount(b.doc, np.log10((c + 1) / (n_train + n_words + 1))[b.codes], docs)
            who = pa.array(b.docs, mask=b.docs == np.iinfo(np.int64).min)
            seen = np.bincount(b.doc, c[b.codes] > 0, docs).astype(np.int64)
            yield record(schema, who, b.lens, seen, np.full(docs, n_train), base, total, 10 ** (-total / b.lens))

    return known.join(_answers(replies), "block").select("body", "known", "got").mapInArrow(finish, ddl)


def held_out(doc_id: str = "doc_id"):
    """crc32(doc_id as text) mod 7 is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 7 == 2, F.lit(False))
