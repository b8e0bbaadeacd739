"""Exact joins of vectors by cells around pivots, instead of all pairs [J4, J5, J10, J13, J15, G10, T2, T3].

Every vector belongs to the cell of the pivot that it makes the least angle with. Angles obey the triangle inequality, so a vector
at angle a to the pivot of a cell whose members reach out to r can be within t of a member only if a <= r + t; and as members are
nearer to their own pivot than to any other, only if a is at most 2 t more than the least of its own angles. What fails that is
never sent to the cell. The pivots come from a bounded sample; which ones they are changes the work, not the result. Where the cells
rule so little out that a row would go to more than MOST_BLOCKS of them, all rows meet in tiles instead, which send it to no more.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldsmith.operators import tiles
from foldsmith.operators.tiles import matrix, numbers, slices
from foldsmith.session import materialize

#: Rows of a cell (about), and pivots at most: these are what tasks get along with the code.
CELL_ROWS, MOST_PIVOTS = 1024, 2048
#: Rows that a cell's blocks have at most.
BLOCK = 4096
#: Best targets that a kernel picks one by one; more are sorted.
PICKS = 16
#: Products of a block that are looked through for ties at once, and dot products that are added term after term at once.
NEAR, DOTS = 1 << 18, 1 << 14
#: Room for rounding in angles.
SLACK = 1e-6


@dataclass(frozen=True)
class Cells:
    """Pivots (unit rows), and of each one's cell: members, greatest and least angle; norms of all vectors."""

    pivots: np.ndarray
    count: np.ndarray
    reach: np.ndarray
    least: np.ndarray
    norms: tuple[float, float]

    @property
    def blocks(self) -> np.ndarray:
        """Blocks of at most about BLOCK rows that a cell is dealt to."""
        return np.maximum(1, -(-self.count // BLOCK))


def angles(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Angle of every vector to every pivot; that of a zero vector is 0, and to a pivot without elements (see choose_pivots)."""
    if not pivots.shape[1]:
        return np.zeros((len(vectors), len(pivots)))
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    cos = np.divide(vectors @ pivots.T, norm, out=np.ones((len(vectors), len(pivots))), where=norm > 0)
    return np.arccos(np.clip(cos, -1, 1))


def choose_pivots(df: DataFrame, n: int, cell_rows: int) -> np.ndarray:
    """Vectors far from each other, out of the first four times as many in hash order (columns k and v); without rows one of no elements."""
    want = int(min(MOST_PIVOTS, max(1, n // cell_rows)))
    rows = df.select("v").orderBy(F.xxhash64("k"), "k").limit(4 * want).collect()  # at most 4 * MOST_PIVOTS vectors
    if not rows:
        return np.zeros((1, 0))
    sample = np.array([r.v for r in rows], float)
    norm = np.linalg.norm(sample, axis=1, keepdims=True)
    sample = sample[norm[:, 0] > 0] / norm[norm[:, 0] > 0]
    if not len(sample):
        return np.eye(1, max(1, sample.shape[1]))
    picked, near = [0], sample @ sample[0]
    while len(picked) < min(want, len(sample)) and near.min() < 1 - 1e-12:
        picked.append(int(near.argmin()))
        near = np.maximum(near, sample @ sample[picked[-1]])
    return sample[picked]


def measure(df: DataFrame, pivots: np.ndarray) -> Cells:
    """The cells of df (column v) around the pivots; a row for each cell comes to the driver."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = matrix(pa.chunked_array([batch.column(0)]))
                a = angles(v, pivots)
                cell, own, norm = a.argmin(axis=1), a.min(axis=1), np.linalg.norm(v, axis=1)
                yield pa.RecordBatch.from_pydict({"cell": cell, "angle": own, "norm": norm})

    rows = df.select("v").mapInArrow(run, "cell long, angle double, norm double")
    g = rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("hi"), F.min("angle").alias("lo"), F.max("norm").alias("most"), F.min("norm").alias("few")).collect()
    count, reach, least = np.zeros(len(pivots), np.int64), np.full(len(pivots), -np.inf), np.full(len(pivots), np.inf)
    for r in g:
        count[r.cell], reach[r.cell], least[r.cell] = r.n, r.hi, r.lo
    return Cells(pivots, count, reach, least, (min((r.few for r in g), default=0.0), max((r.most for r in g), default=0.0)))


def angle_of(dot: float, a: Cells, b: Cells) -> float:
    """The greatest angle at which vectors of two sides can have this dot product, whatever their norms."""
    low, high = a.norms[0] * b.norms[0], a.norms[1] * b.norms[1]
    scale = high if dot > 0 else low
    cos = dot / scale if scale > 0 else (2.0 if dot > 0 else -1.0)
    return math.pi if cos <= -1 else math.acos(min(1.0, cos)) + SLACK


def wanted(a: np.ndarray, other: Cells, reach: float) -> np.ndarray:
    """Which cells of the other side each vector must meet, from its angles to all pivots."""
    return (other.count > 0) & (a <= other.reach + reach) & (a >= other.least - reach) & (a <= a.min(axis=1, keepdims=True) + 2 * reach + SLACK)


def copies(df: DataFrame, own: Cells, other: Cells, reach: float) -> int:
    """How many rows _sent() makes of df."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                a = angles(matrix(pa.chunked_array([batch.column(0).slice(at, 1024)])), own.pivots)
                yield pa.RecordBatch.from_pydict({"n": [int((wanted(a, other, reach) @ other.blocks).sum())]})

    return int(df.select("v").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0)


def _sent(df: DataFrame, own: Cells, other: Cells, reach: float, side: int | None) -> DataFrame:
    """df (k, v and more) once for each pair of blocks in which a row has something to meet: u, w, here; side None joins df with itself."""
    fields = [f for f in df.schema]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                a = angles(matrix(pa.chunked_array([part.column("v")])), own.pivots)
                cell = a.argmin(axis=1)
                key = np.asarray(part.column("k")).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
                here = cell * (1 << 32) + key.astype(np.int64) % own.blocks[cell]
                row, to = np.nonzero(wanted(a, other, reach))
                many = other.blocks[to]
                row, to = np.repeat(row, many), np.repeat(to, many)
                nth = np.arange(len(to)) - np.repeat(np.cumsum(many) - many, many)
                there = to * (1 << 32) + nth
                mine = here[row]
                u, w = (np.minimum(mine, there), np.maximum(mine, there)) if side is None else ((mine, there) if side == 0 else (there, mine))
                for lo in range(0, len(row), 8192):
                    s = slice(lo, lo + 8192)
                    yield pa.RecordBatch.from_arrays([*part.take(pa.array(row[s])).columns, pa.array(u[s]), pa.array(w[s]), pa.array(mine[s])], names=[*part.schema.names, "u", "w", "here"])

    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    return df.mapInArrow(run, f"{ddl}, u long, w long, here long")


def self_join(df: DataFrame, least: float, kernel: Callable[[pa.Table, pa.Table], pa.Table], ddl: str, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Union of kernel(block, block) over the pairs of blocks that can hold a pair of rows with a dot product of `least` or more.

    df: k (long), v (array of double), and what the kernel needs. Each unordered pair of blocks is met once, a block with itself too.
    """
    cells = measure(df, choose_pivots(df, df.count(), cell_rows))
    reach = angle_of(least, cells, cells)
    if copies(df, cells, cells, reach) > (tiles.MOST_BLOCKS + 1) * cells.count.sum():
        return tiles.tile_self_join(df, "k", kernel, ddl)

    def run(rows: pa.Table) -> pa.Table:
        u, w, here = rows["u"][0].as_py(), rows["w"][0].as_py(), numbers(rows["here"])
        if u == w:
            return kernel(rows, rows)
        return kernel(rows.filter(pa.array(here == u)), rows.filter(pa.array(here == w)))

    return _sent(df, cells, cells, reach, None).groupBy("u", "w").applyInArrow(run, ddl)


def join(left: DataFrame, right: DataFrame, least: float, kernel: Callable[[pa.Table, pa.Table], pa.Table], ddl: str, cell_rows: int = CELL_ROWS) -> DataFrame:
    """As self_join, of the rows of two sides."""
    pivots = choose_pivots(right, right.count(), cell_rows)
    a, b = measure(left, pivots), measure(right, pivots)
    reach = angle_of(least, a, b)
    if copies(left, a, b, reach) + copies(right, b, a, reach) > tiles.MOST_BLOCKS * (a.count.sum() + b.count.sum()):
        return tiles.tile_join(left, right, "k", kernel, ddl)
    x, y = _sent(left, a, b, reach, 0), _sent(right, b, a, reach, 1)
    y = y.select(*(F.col(c).alias(c) for c in y.columns))
    return x.groupBy("u", "w").cogroup(y.groupBy("u", "w")).applyInArrow(lambda s, t: kernel(s, t), ddl)


def block_pairs(df: DataFrame, least: float, cell_rows: int = CELL_ROWS) -> tuple[int, int]:
    """(pairs of rows that self_join compares, pairs of all rows): what the cells save."""
    cells = measure(df, choose_pivots(df, df.count(), cell_rows))
    sent = _sent(df, cells, cells, angle_of(least, cells, cells), None)
    n = sent.groupBy("u", "w").agg(F.count_if(F.col("here") == F.col("u")).alias("a"), F.count_if(F.col("here") == F.col("w")).alias("b"))
    met = n.agg(F.sum(F.when(F.col("u") == F.col("w"), F.col("a") * (F.col("a") - 1) / 2).otherwise(F.col("a") * F.col("b")))).first()[0]
    total = int(cells.count.sum())
    return int(met or 0), total * (total - 1) // 2


def nearest(queries: DataFrame, targets: DataFrame, k: int, apart: list[str], cell_rows: int = CELL_ROWS) -> DataFrame:
    """(q, p, t, cosine): the k targets of greatest dot product for each query (k, v) in each pool p of the targets (k, v, p).

    Targets with the query's value in any of the columns `apart`, which both sides have, and the query itself are left out. Ties go to the
    least target id. A query visits cells in the order of the best that they can hold: one, then four more, sixteen more and so on;
    it stops when its kth best beats what the next cell can hold, so nothing that counts is left unseen. Once the queries that go on
    could have more than MOST_BLOCKS visits each before them, they meet all targets in tiles instead, which send them to no more. The
    pools of each cell are measured on the driver, a row for each.
    """
    spark = queries.sparkSession
    n = targets.count()
    pivots = choose_pivots(targets, n, cell_rows)
    targets = materialize(_celled(targets, pivots), "cell-targets")
    stats = targets.groupBy("p", "cell").agg(F.count("*").alias("n"), F.max("angle").alias("hi"), F.min("angle").alias("lo")).collect()
    longest, shortest = (targets.agg(F.max("norm"), F.min("norm")).first() or (0.0, 0.0)) if n else (0.0, 0.0)
    pools: dict[int, list] = {}
    for r in sorted(stats, key=lambda r: (r.p, r.cell)):
        pools.setdefault(r.p, []).append((r.cell, r.n, r.hi, r.lo))
    pool_cells = {p: tuple(np.array(x) for x in zip(*rows)) for p, rows in pools.items()}
    blocks = {(r.p, r.cell): max(1, -(-r.n // BLOCK)) for r in stats}
    if stats:
        sizes = spark.createDataFrame([(p, int(c), int(b)) for (p, c), b in blocks.items()], "p long, cell long, blocks long")
        targets = targets.join(F.broadcast(sizes), ["p", "cell"]).withColumn("sub", F.pmod(F.xxhash64("k"), F.col("blocks")))
    else:
        targets = targets.withColumn("sub", F.lit(0).cast("long"))
    targets = targets.select("k", "v", "p", "cell", "sub", *apart)
    asked, every = queries.select("k", "v", *apart), targets.drop("cell", "sub")
    names = {f.name: f.dataType.simpleString() for f in asked.schema}

    def ranked(part: pa.RecordBatch, first: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(pool, cells of each query from the one of place `first` on, whether they can hold something that counts)."""
        v = matrix(pa.chunked_array([part.column("v")]))
        a, norm = angles(v, pivots), np.linalg.norm(v, axis=1)
        kth = [dict(zip(x["p"], x["kth"])) if x else {} for x in part.column("kth").to_pylist()] if first else None
        for p, (cell, count, hi, lo) in pool_cells.items():
            if first >= len(cell):
                continue
            cell = cell.astype(np.int64)
            bound = np.cos(np.maximum(0, np.maximum(a[:, cell] - hi, lo - a[:, cell]) - SLACK))
            bound = norm[:, None] * np.where(bound > 0, longest, shortest) * bound + 1e-9
            order = np.argsort(-bound, axis=1, kind="stable")[:, first:]
            ok = np.ones(order.shape, bool)
            if kth is not None:
                ok = np.take_along_axis(bound, order, axis=1) >= np.array([x.get(p, -np.inf) for x in kth])[:, None]
            yield p, cell[order], ok

    def ahead(step: int) -> Callable:
        first = (4**step - 1) // 3

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    many = np.zeros(part.num_rows, np.int64)
                    for _, _, ok in ranked(part, first):
                        many += ok.sum(axis=1)
                    yield pa.RecordBatch.from_arrays([part.column("k"), pa.array(many)], names=["k", "ahead"])

        return run

    def visits(step: int) -> Callable:
        first, many = (4**step - 1) // 3, 4**step

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    rows, p_out, c_out, s_out = [], [], [], []
                    for p, cell, ok in ranked(part, first):
                        i, j = np.nonzero(ok[:, :many])
                        to = cell[i, j]
                        b = np.array([blocks[p, c] for c in to.tolist()], np.int64)
                        i, to = np.repeat(i, b), np.repeat(to, b)
                        s_out.append(np.arange(len(i)) - np.repeat(np.cumsum(b) - b, b))
                        rows.append(i)
                        c_out.append(to)
                        p_out.append(np.full(len(i), p, np.int64))
                    if rows and sum(map(len, rows)):
                        i = np.concatenate(rows)
                        own = part.select([*names]).take(pa.array(i))
                        yield pa.RecordBatch.from_arrays([*own.columns, pa.array(np.concatenate(p_out)), pa.array(np.concatenate(c_out)), pa.array(np.concatenate(s_out).astype(np.int64))], names=[*names, "p", "cell", "sub"])

        return run

    def kernel(x: pa.Table, y: pa.Table) -> pa.Table:
        return best_of(x, y, k, apart)

    found_ddl = "q long, p long, t long, cosine double"
    ddl = ", ".join(f"{n} {t}" for n, t in names.items()) + ", p long, cell long, sub long"
    unit = ["p", "cell", "sub", "qb"]
    if len(pools) > tiles.MOST_BLOCKS:
        return tiles.tile_join(asked, every, "k", kernel, found_ddl)
    best, step, state = None, 0, asked
    while not step or (4**step - 1) // 3 < len(pivots):
        if step:
            left = materialize(state.mapInArrow(ahead(step), "k long, ahead long").where("ahead > 0"), "cell-ahead")
            many, total = left.agg(F.count("*"), F.sum("ahead")).first()
            if not many:
                break
            if total > tiles.MOST_BLOCKS * many:
                rest = tiles.tile_join(asked.join(left.select("k"), "k", "left_semi"), every, "k", kernel, found_ddl)
                return best.join(left.select(F.col("k").alias("q")), "q", "left_anti").select(*best.columns).unionByName(rest)
        seen = materialize(state.mapInArrow(visits(step), ddl), "cell-visits")
        # A unit's visitors come in blocks too, so that its targets are repeated no more than the visitors are many.
        parts = seen.groupBy("p", "cell", "sub").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("parts"))
        there = targets.join(F.broadcast(parts), ["p", "cell", "sub"]).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        there = there.select(*(F.col(c).alias(c) for c in [*unit, "k", "v", *apart]))
        here = seen.join(F.broadcast(parts), ["p", "cell", "sub"]).withColumn("qb", F.pmod(F.xxhash64("k"), F.col("parts")))
        new = here.select(*unit, *names).groupBy(*unit).cogroup(there.groupBy(*unit)).applyInArrow(kernel, found_ddl)
        both = new if best is None else best.unionByName(new)
        rank = F.row_number().over(Window.partitionBy("q", "p").orderBy(F.desc("cosine"), "t"))
        best = materialize(both.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank"), "cell-best")
        full = best.groupBy("q", "p").agg(F.count("*").alias("n"), F.min("cosine").alias("kth")).where(F.col("n") == k)
        full = full.groupBy("q").agg(F.collect_list(F.struct("p", "kth")).alias("kth")).select(F.col("q").alias("k"), F.struct(F.col("kth.p").alias("p"), F.col("kth.kth").alias("kth")).alias("kth"))
        state, step = asked.join(full, "k", "left"), step + 1
    return best


def best_of(x: pa.Table, y: pa.Table, k: int, apart: list[str]) -> pa.Table:
    """(q, p, t, cosine): the k best targets (k, v, p) of y for each query (k, v) of x in each pool, ties to the least target id."""
    found = [tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, float))]
    if x.num_rows and y.num_rows:
        y = y.take(pa.array(np.lexsort((numbers(y["k"]), numbers(y["p"])))))
        a, b, pools = numbers(x["k"]), numbers(y["k"]), numbers(y["p"])
        ends = [*np.flatnonzero(np.append(True, pools[1:] != pools[:-1])).tolist(), len(pools)]
        left, right = matrix(x["v"]), matrix(y["v"])
        others = [(numbers(x[c]), numbers(y[c])) for c in apart]
        # Sums of the same products in two orders differ by less than half of this.
        room = 4 * np.finfo(float).eps * right.shape[1] * np.linalg.norm(left, axis=1) * np.linalg.norm(right, axis=1).max()
        for s in slices(len(a), len(b)):
            sim = left[s] @ right.T
            same = a[s, None] == b[None, :]
            for own, other in others:
                same |= own[s, None] == other[None, :]
            np.copyto(sim, -np.inf, where=same)
            for lo, hi in zip(ends, ends[1:]):
                i, c, score = _first_best(sim[:, lo:hi], k, left[s], right[lo:hi], room[s])
                found.append((a[s][i], np.full(len(i), pools[lo]), b[lo:hi][c], score))
    q, p, t, cosine = (np.concatenate(c) for c in zip(*found))
    return pa.table({"q": q, "p": p, "t": t, "cosine": cosine})


def _first_best(sim: np.ndarray, k: int, left: np.ndarray, right: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, columns, dot products) of the k greatest of each row, the first ones on ties; sim is spoilt.

    A matrix product adds the terms in an order that depends on the place in the block, so that equal vectors may get different sums. Its best, and what is
    within `room` of them, are added again term after term, as SQL does, and ranked by that.
    """
    if k > PICKS:
        best = np.argsort(-sim, axis=1, kind="stable")[:, :k]
        score = np.take_along_axis(sim, best, axis=1)
        np.put_along_axis(sim, best, -np.inf, axis=1)
    else:
        rows = np.arange(len(sim))
        best, score = np.empty((len(sim), min(k, sim.shape[1])), np.int64), np.empty((len(sim), min(k, sim.shape[1])))
        for i in range(best.shape[1]):
            best[:, i] = sim.argmax(axis=1)
            score[:, i] = sim[rows, best[:, i]]
            sim[rows, best[:, i]] = -np.inf
    # Where fewer than k are left, all have been picked.
    floor = np.where(score[:, -1] > -np.inf, score[:, -1] - room, np.inf)
    out = []
    step = max(1, NEAR // sim.shape[1])
    for at in range(0, len(sim), step):
        s = slice(at, at + step)
        i, nth = np.nonzero(score[s] > -np.inf)
        more, col = np.nonzero(sim[s] >= floor[s, None])
        i, c = np.concatenate((i, more)) + at, np.concatenate((best[s][i, nth], col))
        exact = in_order(left, right, i, c)
        order = np.lexsort((c, -exact, i))
        i = i[order]
        kept = np.arange(len(i)) - np.searchsorted(i, i) < k
        out.append((i[kept], c[order][kept], exact[order][kept]))
    return tuple(map(np.concatenate, zip(*out)))


def in_order(left: np.ndarray, right: np.ndarray, i: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Dot products of rows i of left and c of right, their terms added one after the other."""
    out = np.empty(len(i))
    for at in range(0, len(i), DOTS):
        s = slice(at, at + DOTS)
        out[s] = np.add.accumulate(left[i[s]] * right[c[s]], axis=1)[:, -1]
    return out


def _celled(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    """df with cell, angle (to its pivot) and norm."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = matrix(pa.chunked_array([batch.column("v")]))
                a = angles(v, pivots)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(a.argmin(axis=1)), pa.array(a.min(axis=1)), pa.array(np.linalg.norm(v, axis=1))], names=[*batch.schema.names, "cell", "angle", "norm"])

    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{ddl}, cell long, angle double, norm double")
