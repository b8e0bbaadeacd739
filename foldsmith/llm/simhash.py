"""SimHash near-duplicate detection.

Fingerprints of 64 bits are cut into 32 segments of two bits. The vector of a fingerprint's
per-segment bit counts is its embedding, and the Manhattan distance of two embeddings never exceeds
the Hamming distance of the fingerprints. A grid range-join finds the pairs whose embeddings are
near: the 32 coordinates are dealt to `groups` groups; two vectors at distance d or less agree in
all but d groups, so the grid has one family of cells for each choice of groups - d groups, and any
pair in range shares a cell of some family. Inside a cell the Manhattan distance is tested first and
the exact Hamming distance of what is left last.

Two-bit segments keep the bound tight: a count vector has about 45 bits of information, so cells
stay small. Counts are held in unary (0 -> 00, 1 -> 01, 2 -> 11), where the Manhattan distance of two
vectors is the number of bits in which they differ.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldsmith.llm._text import binary_text, record, text_slices, unused
from foldsmith.operators.graph import connected_components, star_forest
from foldsmith.session import materialize

SEED = 42
LOW = 0x5555555555555555
#: Members of a cell that one task compares; larger cells are cut into tiles.
CELL = 4096


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """SimHash of the A-Z lower-cased words of a text, as an unsigned 64-bit integer; no word: 0."""
    words = text.lower().split()
    if not words:
        return 0
    parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) > shingle else [b" ".join(words)]
    digest = xxhash.xxh64_digest
    raw = np.frombuffer(b"".join([digest(p, SEED) for p in parts]), np.uint8)
    n = len(raw) // 8
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 255 * 256):  # counts of 255 rows fit in a byte
        bits = np.unpackbits(raw[at * 8 : (at + 255 * 256) * 8]).reshape(-1, 64)
        full = len(bits) // 255 * 255
        ones += bits[:full].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        ones += bits[full:].sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4, keep: tuple = ()) -> DataFrame:
    """(doc_id, *keep, fp) with fp as a signed long; keep: long columns. One pass over the texts, no shuffle."""
    schema = pa.schema([*((c, pa.int64()) for c in (doc_id, *keep)), ("fp", pa.int64())])

    def run(batches):
        for piece, texts in text_slices(batches, 1 + len(keep)):
            found = np.array([fingerprint(t, shingle) for t in texts], np.uint64)
            yield record(schema, *piece.columns[:-1], found.view(np.int64))

    ddl = ", ".join(f"`{f.name}` long" for f in schema)
    return binary_text(docs.withColumn(doc_id, F.col(doc_id).cast("long")), doc_id, *keep, text).mapInArrow(run, ddl)


def grid_masks(n: int, distance: int) -> list[int]:
    """The coordinates of every family of cells, as masks over the unary vectors.

    More groups mean more families but smaller cells. The choice weighs the cost of a row (its
    shuffle and sort) against that of the candidate pairs expected among n fingerprints; it changes
    the cost alone, as any number of groups over `distance` finds every pair.
    """
    bits, row_cost, pair_cost = 1.415, 3e-6, 15e-9

    def cost(g: int) -> float:
        return comb(g, distance) * (row_cost + pair_cost * n / 2 ** (32 * (g - distance) / g * bits))

    g = min(range(distance + 2, distance + 7), key=cost)  # with one group agreeing, cells would be few and large
    cuts = [32 * i // g for i in range(g + 1)]
    whole = [sum(3 << 2 * s for s in range(a, b)) for a, b in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(whole, g - distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def embed(fp):
    """Unary vector of the per-segment bit counts of a fingerprint column."""
    low, high = fp.bitwiseAND(F.lit(LOW)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(LOW))
    return low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def _cell_links(fp: np.ndarray, group: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Star forest of the links between members of the same group; group is sorted."""
    low = np.uint64(LOW)
    u = fp.view(np.uint64)
    lo, hi = u & low, (u >> np.uint64(1)) & low
    vec = lo | hi | ((lo & hi) << np.uint64(1))
    size = np.diff(np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(group)))
    left = np.repeat(size, size) - 1 - (np.arange(len(group)) - np.repeat(np.cumsum(size) - size, size))  # members that follow
    a, b, held = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
    rows, step = np.flatnonzero(left >= 1), 1
    while len(rows):
        near = rows[np.bitwise_count(vec[rows] ^ vec[rows + step]) <= distance]  # Manhattan distance of the embeddings
        near = near[np.bitwise_count(u[near] ^ u[near + step]) <= distance]
        a.append(fp[near])
        b.append(fp[near + step])
        held += len(near)
        if held > 1 << 20:
            x, y = star_forest(np.concatenate(a), np.concatenate(b))
            a, b, held = [x], [y], 0
        step += 1
        rows = rows[left[rows] >= step]
    return star_forest(np.concatenate(a), np.concatenate(b))


def links(fps: DataFrame, distance: int = 4, cell: int = CELL) -> DataFrame:
    """(a, b): links between distinct fingerprints that connect just what all links would connect.

    fps has one column fp of distinct signed longs. A task compares the members of a cell in NumPy and
    emits a star forest of their links, so a group of copies gives rows in proportion to its members.
    A cell of more than `cell` members is cut into blocks, and every pair of blocks becomes a task
    group of its own.
    """
    masks = grid_masks(fps.count(), distance)
    vec = fps.select("fp", embed(F.col("fp")).alias("vec"))
    cells = F.array(*(F.struct(F.lit(i).cast("short").alias("family"), F.col("vec").bitwiseAND(F.lit(_signed(m))).alias("cell")) for i, m in enumerate(masks)))
    keyed = vec.select("fp", F.explode(cells).alias("c")).select("fp", "c.family", "c.cell")
    hot = materialize(keyed.groupBy("family", "cell").agg(F.count("*").alias("n")).where(F.col("n") > cell), "simhash-hot")
    if hot.isEmpty():
        tiled = keyed.withColumn("tile", F.lit(0).cast("long"))
    else:
        blocks = F.ceil(F.col("n") / cell).cast("long")
        own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
        pair = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda x: F.least(x, F.col("own")) * F.col("blocks") + F.greatest(x, F.col("own")))
        tiled = (
            keyed.join(hot.withColumn("blocks", blocks), ["family", "cell"], "left")
            .withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
            .withColumn("own", own)
            .select("fp", "family", "cell", F.explode(pair).alias("tile"))
        )
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        held = []
        for batch in batches:
            held.append([np.asarray(batch.column(i)) for i in range(4)])
            yield from done(held, False)
        yield from done(held, True)

    def done(held, last):
        if not held or not last and sum(len(h[0]) for h in held) < 1 << 16:
            return
        fp, *key = (np.concatenate(c) for c in zip(*held))
        new = np.append(True, np.any([k[1:] != k[:-1] for k in key], axis=0)) if len(fp) else np.empty(0, bool)
        group = np.cumsum(new)
        end = len(fp) if last or not len(fp) else np.flatnonzero(new)[-1]  # the last group may go on
        held[:] = [] if last else [[fp[end:], *(k[end:] for k in key)]]
        if end:
            yield record(schema, *_cell_links(fp[:end], group[:end], distance))

    dealt = tiled.repartition("family", "cell", "tile").sortWithinPartitions("family", "cell", "tile")
    return dealt.select("fp", "family", "cell", "tile").mapInArrow(run, "a long, b long").distinct()


def roots(first: DataFrame, distance: int = 4) -> DataFrame:
    """first (a row for each distinct fp) with the column root, the least fingerprint that links reach."""
    comp = connected_components(materialize(links(first.select("fp"), distance), "simhash-links"))
    return materialize(first.join(comp, first.fp == comp.node, "left").select(*first.columns, F.coalesce("component", "fp").alias("root")), "simhash-root")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = 4, shingle: int = 4) -> DataFrame:
    """One row of every component of near_duplicates, with all its columns, whatever their names: that of the least doc_id.

    A null doc_id comes after all others. Of different texts that share the least doc_id the one with the least hash
    stays, of rows equal in both any one. Null, empty and blank texts have fingerprint zero and are one component with what links
    to it. An empty table stays empty. One shuffle of the texts, by a hash of doc_id and text.
    """
    row, nth = unused(docs, "_row"), unused(docs, "_nth")
    own = docs.withColumn(row, F.xxhash64(doc_id, text))
    plain = own.select(F.col(doc_id).alias("id"), F.col(row).alias("row"), F.col(text).alias("text"))
    fp = materialize(fingerprints(plain, "id", "text", shingle, ("row",)), "simhash-fp")
    order = F.struct(F.col("id").isNull().alias("null"), "id", "row")
    first = materialize(fp.groupBy("fp").agg(F.min(order).alias("best")), "simhash-first")
    stays = roots(first, distance).groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.row").alias(row))
    one = F.row_number().over(Window.partitionBy(row).orderBy(F.lit(1)))
    return own.join(stays, row, "left_semi").withColumn(nth, one).where(F.col(nth) == 1).select(*(F.col(f"`{c}`") for c in docs.columns))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = 4, shingle: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every document.

    component_id is the least doc_id of all documents that links reach. Null and empty texts and
    texts without a word have fingerprint zero and link like any other; a repeated doc_id keeps all its
    rows; a null doc_id keeps its row and never names a component unless nothing else is in it. An
    empty table gives an empty result, and other columns are ignored.
    """
    fp = materialize(fingerprints(docs, doc_id, text, shingle), "simhash-fp")
    first = materialize(fp.groupBy("fp").agg(F.min(doc_id).alias("first")), "simhash-first")
    root = roots(first, distance)
    name = root.groupBy("root").agg(F.min("first").alias("component_id"))
    named = root.join(name, "root").select("fp", "component_id")
    return fp.join(named, "fp").select(doc_id, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
