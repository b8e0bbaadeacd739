"""Similarity joins on vectors, bit strings and word shingles [J4-J7, J10, J11, J13, J19, T2, T3, P12, A7-A9]."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldsmith.operators import cells
from foldsmith.operators.graph import connected_components, star_forest
from foldsmith.operators.hamming import near_hashes, nearest_hashes
from foldsmith.operators.shingles import near_classes
from foldsmith.operators.tiles import matrix, numbers, once, slices, tile_join, tile_self_join
from foldsmith.session import materialize


def cosine_pairs(df: DataFrame, threshold: float, key: str = "vec_id", vec: str = "embedding", cross: str | None = None, cross_threshold: float | None = None, tiled: bool = False, cell_rows: int = cells.CELL_ROWS) -> DataFrame:
    """(a, b, cosine), a < b: pairs of unit vectors at or above the threshold [J4].

    With `cross` also pairs whose `cross` differs at or above cross_threshold, which counts only below the
    threshold [J5]. Cells that are too far apart never meet; `tiled` compares all pairs of blocks instead, as a reference.
    """
    use_cross = cross is not None and cross_threshold is not None and cross_threshold < threshold
    cols = [F.col(key).cast("long").alias("k"), _vector(df, vec)] + ([F.xxhash64(cross).alias("d")] if use_cross else [])

    def kernel(x: pa.Table, y: pa.Table) -> pa.Table:
        a, b = numbers(x["k"]), numbers(y["k"])
        found = [tuple(np.empty(0, t) for t in (np.int64, np.int64, float))]
        for i, j, cosine in _cosine_hits(x, y, threshold, cross_threshold if use_cross else None):
            one = once(a, b, i, j)
            i, j = i[one], j[one]
            found.append((np.minimum(a[i], b[j]), np.maximum(a[i], b[j]), cosine[one]))
        return pa.table(dict(zip(("a", "b", "cosine"), map(np.concatenate, zip(*found)))))

    rows, ddl = df.select(*cols).where("k IS NOT NULL AND v IS NOT NULL"), "a long, b long, cosine double"
    if tiled:
        return tile_self_join(rows, "k", kernel, ddl)
    return cells.self_join(rows, min(threshold, cross_threshold) if use_cross else threshold, kernel, ddl, cell_rows)


def _vector(df: DataFrame, vec: str) -> Column:
    """The vectors as column v; floats stay floats until a kernel takes them as doubles."""
    known = df.schema[vec].dataType.simpleString() == "array<float>"
    return (F.col(vec) if known else F.col(vec).cast("array<double>")).alias("v")


def _cosine_hits(x: pa.Table, y: pa.Table, threshold: float, cross_threshold: float | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places in x, places in y, cosines) of the links of two blocks, slice by slice; with cross_threshold also those of it whose d differs."""
    if not x.num_rows or not y.num_rows:
        return
    left, right = matrix(x["v"]), matrix(y["v"]).T
    for s in slices(len(left), right.shape[1]):
        sim = left[s] @ right
        hit = sim >= threshold
        if cross_threshold is not None:
            hit |= (sim >= cross_threshold) & (numbers(x["d"])[s, None] != numbers(y["d"])[None, :])
        i, j = np.nonzero(hit)
        yield i + s.start, j, sim[i, j]


def cosine_links(df: DataFrame, threshold: float, key: str = "vec_id", vec: str = "embedding", cell_rows: int = cells.CELL_ROWS) -> DataFrame:
    """(a, b): links that connect just what those of cosine_pairs connect [G3]; two blocks give a forest of theirs, no more rows than they have."""
    rows = df.select(F.col(key).cast("long").alias("k"), _vector(df, vec)).where("k IS NOT NULL AND v IS NOT NULL")
    return cells.self_join(rows, threshold, lambda x, y: _forest(x, y, ((i, j) for i, j, _ in _cosine_hits(x, y, threshold))), "a long, b long", cell_rows)


def cosine_pair_count(df: DataFrame, threshold: float, key: str = "vec_id", vec: str = "embedding", cell_rows: int = cells.CELL_ROWS) -> DataFrame:
    """(n): how many pairs cosine_pairs has; blocks count their own."""
    rows = df.select(F.col(key).cast("long").alias("k"), _vector(df, vec)).where("k IS NOT NULL AND v IS NOT NULL")

    def kernel(x: pa.Table, y: pa.Table) -> pa.Table:
        a, b = numbers(x["k"]), numbers(y["k"])
        return pa.table({"n": [int(sum(once(a, b, i, j).sum() for i, j, _ in _cosine_hits(x, y, threshold)))]})

    return cells.self_join(rows, threshold, kernel, "n long", cell_rows).agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("n"))


def _forest(x: pa.Table, y: pa.Table, hits: Iterable[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
    """(a, b): star forest of the links between the ids of two blocks, from their places; no more than FOREST links are held beyond it."""
    a, b = numbers(x["k"]), numbers(y["k"])
    u, w, held = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
    for i, j in hits:
        apart = a[i] != b[j]
        u.append(a[i[apart]])
        w.append(b[j[apart]])
        held += len(u[-1])
        if held > FOREST:
            c, d = star_forest(np.concatenate(u), np.concatenate(w))
            u, w, held = [c], [d], 0
    c, d = star_forest(np.concatenate(u), np.concatenate(w))
    return pa.table({"a": c, "b": d})


#: Links of a pair of blocks that a task holds before it reduces them.
FOREST = 1 << 20
#: Distance up to which hash segments are looked up. Of a million random hashes a probe meets 4 in 100 at 15 bits, 7 at 16 and 13 at 18, each a
#: row of a join; beyond 15 bits blocks of hashes are compared instead, which costs less for a pair.
MOST_BY_SEGMENTS = 15
#: Comparisons of hashes that take a core less than a second: not worth an index. Those of a million hashes take some core minutes in
#: blocks, which send a row to few tasks; the pairs that meet by segments grow with the square as well, and each is a shuffled row.
FEW, MANY = 1 << 28, 1 << 40


#: Hashes of a block that are compared with the other block at once, which bounds what a task holds.
HAMMING_ROWS = 128


def hamming_pairs(df: DataFrame, most: int, key: str = "vec_id", hashes: str = "h8", tiled: bool | None = None) -> DataFrame:
    """(a, b, distance, a_to_b, b_to_a), a < b: first hash of one against all orientations of the other [J6].

    A pair is a link if either direction is at `most` or below; distance is the less of the two. Null
    and empty hash arrays link to nothing. Up to MOST_BY_SEGMENTS bits the hashes are looked up by segments, beyond that all blocks of
    hashes are compared; `tiled` chooses one of the two, which give the same rows.
    """
    rows = df.select(F.col(key).cast("long").alias("k"), F.col(hashes).alias("h")).where(F.col("k").isNotNull() & (F.size("h") > 0))
    if not (most > MOST_BY_SEGMENTS if tiled is None else tiled):
        return _hamming_by_segments(rows, most)

    def kernel(x: pa.Table, y: pa.Table) -> pa.Table:
        a, b = numbers(x["k"]), numbers(y["k"])
        found = [tuple(np.empty(0, np.int64) for _ in range(4)), *_hamming_hits(x, y, most)]
        i, j, p, q = (np.concatenate(c) for c in zip(*found))
        one = once(a, b, i, j)
        i, j, p, q = i[one], j[one], p[one], q[one]
        swap = a[i] > b[j]
        return pa.table({"a": np.minimum(a[i], b[j]), "b": np.maximum(a[i], b[j]), "distance": np.minimum(p, q), "a_to_b": np.where(swap, q, p), "b_to_a": np.where(swap, p, q)})

    return tile_self_join(rows, "k", kernel, "a long, b long, distance long, a_to_b long, b_to_a long")


def _hamming_hits(x: pa.Table, y: pa.Table, most: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(places in x, places in y, distance of the first hash of x to any of y, and the other way round) of the links of two blocks, slice by slice."""
    if not x.num_rows or not y.num_rows:
        return
    h, g = matrix(x["h"], np.int64).view(np.uint64), matrix(y["h"], np.int64).view(np.uint64)
    for at in range(0, len(h), HAMMING_ROWS):
        s = slice(at, at + HAMMING_ROWS)
        to = np.full((len(h[s]), len(g)), 65, np.uint8)
        back = to.copy()
        for k in range(g.shape[1]):
            np.minimum(to, np.bitwise_count(h[s, :1] ^ g[None, :, k]), out=to)
        for k in range(h.shape[1]):
            np.minimum(back, np.bitwise_count(h[s, k : k + 1] ^ g[None, :, 0]), out=back)
        i, j = np.nonzero(np.minimum(to, back) <= most)
        yield i + at, j, to[i, j].astype(np.int64), back[i, j].astype(np.int64)


def hamming_links(df: DataFrame, most: int, key: str = "vec_id", hashes: str = "h8", tiled: bool | None = None) -> DataFrame:
    """(a, b): links that connect just what those of hamming_pairs connect [G3]; two blocks give a forest of theirs, no more rows than they have."""
    if not (most > MOST_BY_SEGMENTS if tiled is None else tiled):
        return hamming_pairs(df, most, key, hashes, tiled=False).select("a", "b")
    rows = df.select(F.col(key).cast("long").alias("k"), F.col(hashes).alias("h")).where(F.col("k").isNotNull() & (F.size("h") > 0))
    return tile_self_join(rows, "k", lambda x, y: _forest(x, y, ((i, j) for i, j, *_ in _hamming_hits(x, y, most))), "a long, b long")


def _hamming_by_segments(rows: DataFrame, most: int) -> DataFrame:
    """hamming_pairs of k and h: different hashes meet by their segments, images by the hashes that have met."""
    rows = materialize(rows, "hashes")
    first = rows.select("k", F.col("h")[0].alias("q"))
    turned = rows.select("k", F.explode(F.array_distinct("h")).alias("h")).where("h IS NOT NULL")
    met = materialize(near_hashes(first, turned, most).select("q", "h"), "hashes-met")
    link = first.select(F.col("k").alias("x"), "q").join(met, "q").join(turned.select(F.col("k").alias("y"), "h"), "h").where("x <> y")
    pairs = link.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    both = pairs.join(rows.select(F.col("k").alias("a"), F.col("h").alias("ha")), "a").join(rows.select(F.col("k").alias("b"), F.col("h").alias("hb")), "b")
    to = lambda one, other: F.array_min(F.transform(other, lambda x: F.bit_count(F.col(one)[0].bitwiseXOR(x)))).cast("long")
    both = both.select("a", "b", to("ha", "hb").alias("a_to_b"), to("hb", "ha").alias("b_to_a"))
    return both.select("a", "b", F.least("a_to_b", "b_to_a").alias("distance"), "a_to_b", "b_to_a")


def guarded_hamming_pairs(df: DataFrame, most: int, least_cosine: float, key: str = "vec_id", hashes: str = "h8", vec: str = "embedding") -> DataFrame:
    """hamming_pairs with the pair's cosine and kept = cosine at or above the guard [J7]; the rejected directed pairs are where not kept.

    The vectors are joined to the pairs that pass the hashes, not to all.
    """
    from foldsmith.functions.vectors import dot

    p = hamming_pairs(df, most, key, hashes)
    v = df.select(F.col(key).cast("long").alias("k"), F.col(vec).alias("v"))
    p = p.join(v.select(F.col("k").alias("a"), F.col("v").alias("va")), "a").join(v.select(F.col("k").alias("b"), F.col("v").alias("vb")), "b")
    return p.withColumn("cosine", dot(F.col("va"), F.col("vb"))).withColumn("kept", F.col("cosine") >= least_cosine).drop("va", "vb")


def top_similar(queries: DataFrame, targets: DataFrame, k: int, key: str = "vec_id", vec: str = "embedding", pool: str | None = None, other: str | list[str] | None = None, tiled: bool = False, cell_rows: int = cells.CELL_ROWS) -> DataFrame:
    """(q, t[, pool], cosine, rank): each query's k most similar targets, of every pool if one is named [T2, T3, J10].

    With `other`, one column or several, targets that share the query's value of any of them are left out before the ranking; as in SQL,
    a null differs from nothing, so that its row neither asks nor is found. Ties go to the least target id. Cells of targets are visited best first until the kth best beats what the rest can hold; `tiled` compares all
    blocks instead, as a reference.
    """
    others = [other] if isinstance(other, str) else list(other or [])
    cols = [F.col(key).cast("long").alias("k"), *(F.xxhash64(c).alias(f"o{i}") for i, c in enumerate(others))]
    apart = [f"o{i}" for i in range(len(others))]
    ok = "k IS NOT NULL AND v IS NOT NULL"
    for c in others:
        queries, targets = (df.where(F.col(c).isNotNull()) for df in (queries, targets))
    left = queries.select(*cols, _vector(queries, vec)).where(ok)
    right = targets.select(*cols, _vector(targets, vec), F.xxhash64(pool).alias("p") if pool else F.lit(0).cast("long").alias("p")).where(ok)
    found = _top_of_tiles(left, right, k, apart) if tiled else cells.nearest(left, right, k, apart, cell_rows)
    rank = F.row_number().over(Window.partitionBy("q", "p").orderBy(F.desc("cosine"), "t"))
    found = found.withColumn("rank", rank).where(F.col("rank") <= k)
    if pool:
        names = targets.select(F.xxhash64(pool).alias("p"), F.col(pool).alias("pool")).distinct()
        return found.join(names, "p").select("q", "t", "pool", "cosine", "rank")
    return found.select("q", "t", "cosine", "rank")


def _top_of_tiles(left: DataFrame, right: DataFrame, k: int, apart: list[str]) -> DataFrame:
    """(q, p, t, cosine): the k best of every tile and pool; each passes no more on, so what is shuffled does not grow with the square."""

    def kernel(x: pa.Table, y: pa.Table) -> pa.Table:
        return cells.best_of(x, y, k, apart)

    return tile_join(left, right, "k", kernel, "q long, p long, t long, cosine double")


def band(found: DataFrame, low: float, high: float) -> DataFrame:
    """Low <= cosine < high, after the ranking: what lies above still takes up a rank."""
    return found.where((F.col("cosine") >= low) & (F.col("cosine") < high))


def nearest_hamming(queries: DataFrame, targets: DataFrame, key: str = "vec_id", bits: str = "bits", tiled: bool | None = None) -> DataFrame:
    """(q, distance): least Hamming distance of each query to any target; 64 for a null query or without a target [J11].

    bits: a hash or an array of them. Of a query the first counts, of a target all, so an array of the 8 orientations of the targets
    finds turned copies. Rings of growing radius over the hashes' segments settle the queries that have something near; only those with
    nothing within 15 bits are compared with all different hashes of the targets. `tiled` compares all at once; if it is not
    given, that is done where it takes no more than FEW comparisons, which costs less than a ring. Both give the same rows.
    """
    array = lambda df: F.col(bits) if df.schema[bits].dataType.typeName() == "array" else F.array(bits)
    asks = queries.select(F.col(key).cast("long").alias("q"), F.get(array(queries), 0).alias("h"))
    hashes = targets.where(F.col(key).isNotNull()).select(F.explode(array(targets)).alias("h")).where("h IS NOT NULL").distinct()
    hashes = materialize(hashes, "target-hashes")
    probes = asks.where("q IS NOT NULL AND h IS NOT NULL").select(F.col("h").alias("q")).distinct()
    tiled = probes.count() * hashes.count() <= FEW if tiled is None else tiled
    done, far = (None, probes) if tiled else nearest_hashes(probes, hashes)

    def kernel(x: pa.Table, y: pa.Table) -> pa.Table:
        a, b = (numbers(t["k"]).astype(np.int64) for t in (x, y))
        if not len(a) or not len(b):
            return pa.table({"q": np.empty(0, np.int64), "d": np.empty(0, np.int64)})
        least = np.empty(len(a), np.int64)
        for s in slices(len(a), len(b)):
            least[s] = np.bitwise_count(a.view(np.uint64)[s, None] ^ b.view(np.uint64)[None, :]).min(axis=1)
        return pa.table({"q": a, "d": least})

    if tiled or not far.isEmpty():
        rest = tile_join(far.select(F.col("q").alias("k")), hashes.select(F.col("h").alias("k")), "k", kernel, "q long, d long").groupBy("q").agg(F.min("d").alias("distance"))
        done = rest if done is None else done.unionByName(rest)
    out = asks.join(done.select(F.col("q").alias("h"), "distance"), "h", "left")
    return out.select("q", F.coalesce("distance", F.lit(64).cast("long")).alias("distance"))


def distance_counts(left: DataFrame, right: DataFrame, uppers: list[int], key: str = "vec_id", bits: str = "bits") -> DataFrame:
    """(bucket, n): pairs of the two sides by Hamming distance above 0; bucket i ends at uppers[i], the last one has what lies beyond.

    Tiles count their own pairs and send a row for each bucket.
    """
    rows = lambda df: df.select(F.col(key).cast("long").alias("k"), F.col(bits).alias("h")).where("k IS NOT NULL AND h IS NOT NULL")
    edges = np.array([0, *uppers])

    def kernel(x: pa.Table, y: pa.Table) -> pa.Table:
        n = np.zeros(len(edges) + 1, np.int64)
        if x.num_rows and y.num_rows:
            h, g = (numbers(t["h"]).astype(np.int64).view(np.uint64) for t in (x, y))
            for s in slices(len(h), len(g)):
                by_distance = np.bincount(np.bitwise_count(h[s, None] ^ g[None, :]).ravel(), minlength=65)
                np.add.at(n, np.searchsorted(edges, np.arange(65)), by_distance)
        return pa.table({"bucket": np.arange(len(n) - 1), "n": n[1:]})

    return tile_join(rows(left), rows(right), "k", kernel, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).where("n > 0")


def most_similar(queries: DataFrame, targets: DataFrame, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(q, t, cosine): the nearest target of every query that has one [J10]."""
    return top_similar(queries, targets, 1, key, vec).drop("rank")


def far_from(df: DataFrame, held: DataFrame, threshold: float, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """The rows of df whose greatest cosine to any row of `held` is below the threshold [J13]."""
    return df.join(near_any(df, held, threshold, key, vec).select(F.col("q").alias(key)), key, "left_anti")


def near_any(df: DataFrame, held: DataFrame, threshold: float, key: str = "vec_id", vec: str = "embedding", cell_rows: int = cells.CELL_ROWS) -> DataFrame:
    """(q): the rows of df that any other row of `held` is near to, at the threshold or above [J14, J15, G10]; no pair leaves its task."""
    rows = lambda x: x.select(F.col(key).cast("long").alias("k"), _vector(x, vec)).where("k IS NOT NULL AND v IS NOT NULL")

    def kernel(x: pa.Table, y: pa.Table) -> pa.Table:
        a, b = numbers(x["k"]), numbers(y["k"])
        hit = np.zeros(len(a), bool)
        if len(a) and len(b):
            left, right = matrix(x["v"]), matrix(y["v"]).T
            for s in slices(len(a), len(b)):
                hit[s] = ((left[s] @ right >= threshold) & (a[s, None] != b[None, :])).any(axis=1)
        return pa.table({"q": a[hit]})

    return cells.join(rows(df), rows(held), threshold, kernel, "q long", cell_rows).distinct()


def jaccard_classes(docs: DataFrame, threshold: float, key: str = "doc_id", text: str = "text", words: int = 3, links: bool = False) -> tuple[DataFrame, DataFrame]:
    """((a, b, jaccard) of classes of equal shingle sets, a < b, (k, id): the members of every class k, its least id among them).

    `links` gives fewer pairs that join the same classes, and no values. Texts of fewer than `words` words have no shingle and are in no class.
    """
    return near_classes(docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("binary").alias("text")), threshold, words, links)


def jaccard_pairs(docs: DataFrame, threshold: float, key: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """(a, b, jaccard), a < b, of the sets of word shingles: jaccard_classes with every copy named, so n copies give n (n - 1) / 2 rows."""
    found, member = jaccard_classes(docs, threshold, key, text, words)
    x = found.join(member.select(F.col("k").alias("a"), F.col("id").alias("x")), "a").join(member.select(F.col("k").alias("b"), F.col("id").alias("y")), "b")
    same = member.select("k", F.col("id").alias("x")).join(member.select("k", F.col("id").alias("y")), "k").where("x < y").withColumn("jaccard", F.lit(1.0))
    pairs = x.select("x", "y", "jaccard").union(same.select("x", "y", "jaccard"))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "jaccard")


def jaccard_components(docs: DataFrame, threshold: float, key: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """(node, component) of the documents that jaccard_pairs links: links of classes, and one edge for each further copy."""
    found, member = jaccard_classes(docs, threshold, key, text, words, links=True)
    return connected_components(materialize(found.select("a", "b").union(member.where("k <> id").select("k", "id")), "shingle-links"))


def closest_pairs(df: DataFrame, n: int, apart: str, key: str = "vec_id", bits: str = "bits", tiled: bool | None = None) -> DataFrame:
    """T4: (a, b, distance), a < b: the n pairs of the least Hamming distance above 0 whose `apart` differs; ties by a, then b.

    All blocks are compared, and every pair of blocks passes no more than n on. Beyond MANY comparisons, or if `tiled` is false, hashes
    are looked up by segments within 7 and then 15 bits; n pairs found within a radius hold the n closest. Of the rows of one hash and
    `apart` only the n least ids can be among them. If there are fewer, all blocks are compared after all. Rows without key, hash or `apart` are left out.
    """
    rows = df.select(F.col(key).cast("long").alias("k"), F.col(bits).alias("h"), F.xxhash64(apart).alias("o"), F.col(apart).alias("_o")).where("k IS NOT NULL AND h IS NOT NULL AND _o IS NOT NULL").drop("_o")
    if not (rows.count() ** 2 <= MANY if tiled is None else tiled):
        first = F.row_number().over(Window.partitionBy("h", "o").orderBy("k"))
        few = materialize(rows.withColumn("_nth", first).where(F.col("_nth") <= n).drop("_nth"), "closest-rows")
        x, y = few.select(F.col("k").alias("x"), F.col("h").alias("q"), F.col("o").alias("ox")), few.select(F.col("k").alias("y"), "h", F.col("o").alias("oy"))
        for most in (7, MOST_BY_SEGMENTS):
            met = near_hashes(x.select("q"), y.select("h"), most).where("q < h")
            pairs = met.join(x, "q").join(y, "h").where("ox <> oy").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "distance")
            found = materialize(pairs.orderBy("distance", "a", "b").limit(n), "closest")
            if found.count() == n:
                return found.orderBy("distance", "a", "b")

    def kernel(x: pa.Table, y: pa.Table) -> pa.Table:
        a, b = numbers(x["k"]), numbers(y["k"])
        h, g = (numbers(t["h"]).astype(np.int64).view(np.uint64) for t in (x, y))
        own, other = numbers(x["o"]), numbers(y["o"])
        lo, hi, near = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        for s in slices(len(a), len(b)):
            d = np.bitwise_count(h[s, None] ^ g[None, :])
            # What is farther than the n that a slice or those before it hold cannot be among the n closest.
            most = near[-1] if len(near) == n else 64
            hit = (d > 0) & (d <= most) & (own[s, None] != other[None, :])
            within = np.cumsum(np.bincount(d[hit], minlength=65))
            hit &= d <= np.searchsorted(within, 2 * n)
            i, j = np.nonzero(hit)
            i, d = i + s.start, d[i, j].astype(np.int64)
            one = once(a, b, i, j)
            i, j, d = i[one], j[one], d[one]
            lo, hi, near = (np.append(*c) for c in ((lo, np.minimum(a[i], b[j])), (hi, np.maximum(a[i], b[j])), (near, d)))
            best = np.lexsort((hi, lo, near))[:n]
            lo, hi, near = lo[best], hi[best], near[best]
        return pa.table({"a": lo, "b": hi, "distance": near})

    return tile_self_join(rows, "k", kernel, "a long, b long, distance long").orderBy("distance", "a", "b").limit(n)


def threshold_counts(df: DataFrame, score: str, thresholds: dict[str, float]) -> list[Column]:
    """Conditional counters of a score at or above each threshold [A7, A8]."""
    return [F.count_if(F.col(score) >= t).alias(name) for name, t in thresholds.items()]
