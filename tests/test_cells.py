"""Cells and hash segments against all pairs, and what they save."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldsmith.operators import cells, hamming
from foldsmith.operators import similarity as S

SCHEMA = "vec_id long, embedding array<float>, label int, part string"


def clustered(spark, n, clusters, spread=0.05, dims=16, copies=0, seed=1, odd=True):
    """Vectors around far centres, some equal, some null or zero."""
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(clusters, dims))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    v = centres[rnd.integers(clusters, size=n)] + rnd.normal(size=(n, dims)) * spread
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[n - copies :] = v[0]
    rows = [(i, [float(y) for y in x], int(rnd.integers(3)), random.Random(i).choice(["a", "b", None])) for i, x in enumerate(v)]
    if odd:
        rows += [(n, None, 1, "a"), (None, rows[0][1], 1, "a"), (n + 1, [0.0] * dims, 1, "a"), (n + 2, [0.0] * dims, 2, "b")]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def pairs(df):
    return sorted((r.a, r.b, round(r.cosine, 6)) for r in df.collect())


@pytest.mark.parametrize("threshold", [0.97, 0.6, 0.0, -0.5])
def test_cosine_pairs(spark, threshold):
    df = clustered(spark, 260, 7, spread=0.12, copies=9)
    got = S.cosine_pairs(df, threshold, cell_rows=12)
    assert pairs(got) == pairs(S.cosine_pairs(df, threshold, tiled=True))


def test_cross_and_norms(spark):
    df = clustered(spark, 200, 5, spread=0.2).withColumn("embedding", F.transform("embedding", lambda x: (x * (1 + F.col("vec_id") % 3)).cast("float")))
    for args in ((2.0,), (3.5, "vec_id", "embedding", "label", 0.9)):
        assert pairs(S.cosine_pairs(df, *args, cell_rows=10)) == pairs(S.cosine_pairs(df, *args, tiled=True))


def test_one_large_cell(spark, monkeypatch):
    monkeypatch.setattr(cells, "BLOCK", 16)
    df = clustered(spark, 150, 2, spread=0.01, copies=60, odd=False)
    assert pairs(S.cosine_pairs(df, 0.99, cell_rows=30)) == pairs(S.cosine_pairs(df, 0.99, tiled=True))
    assert sorted(map(tuple, S.top_similar(df, df, 3, cell_rows=30).select("q", "t", "rank").collect())) == sorted(map(tuple, S.top_similar(df, df, 3, tiled=True).select("q", "t", "rank").collect()))


def test_empty(spark):
    df = clustered(spark, 10, 2)
    none = df.limit(0)
    assert S.cosine_pairs(none, 0.9).count() == 0 and S.near_any(df, none, 0.9).count() == 0 and S.near_any(none, df, 0.9).count() == 0
    assert S.top_similar(df, none, 2).count() == 0 and S.top_similar(none, df, 2, pool="part").count() == 0


def test_near_any(spark):
    df = clustered(spark, 240, 6, spread=0.1, copies=5)
    left, right = df.where("label = 0"), df.where("label <> 0")
    want = {r.q for r in S.top_similar(left, right, 1, tiled=True).where("cosine >= 0.9").collect()}
    assert {r.q for r in S.near_any(left, right, 0.9, cell_rows=10).collect()} == want and want


@pytest.mark.parametrize("pool,other", [(None, None), ("part", None), ("label", ["part"]), (None, ["label", "part"])])
def test_top_similar(spark, pool, other):
    df = clustered(spark, 300, 8, spread=0.15, copies=7)
    key = lambda rows: sorted((r.q, str(r["pool"]) if pool else "", r["rank"], r.t, round(r.cosine, 6)) for r in rows)
    got = S.top_similar(df, df, 4, pool=pool, other=other, cell_rows=8).collect()
    assert key(got) == key(S.top_similar(df, df, 4, pool=pool, other=other, tiled=True).collect())


def test_work_grows_slower_than_the_square(spark):
    met = {}
    for n in (1000, 4000):
        met[n], every = cells.block_pairs(clustered(spark, n, n // 50, odd=False).select(F.col("vec_id").alias("k"), F.col("embedding").cast("array<double>").alias("v")), 0.95, cell_rows=25)
        assert met[n] < every / 4
    assert math.log(met[4000] / met[1000], 4) < 1.5


def hashes(spark, n=260, seed=3, copies=80):
    rnd = random.Random(seed)
    base = [rnd.getrandbits(64) for _ in range(20)]
    flip = lambda h: h ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(16)))
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    rows = [(i, [signed(flip(rnd.choice(base))) for _ in range(8)]) for i in range(n)]
    rows += [(n + i, [0] * 8) for i in range(copies)] + [(5000, []), (5001, None), (None, [0] * 8)]
    return spark.createDataFrame(rows, "vec_id long, h8 array<long>")


@pytest.mark.parametrize("most", [0, 5, 10, 15])
def test_hamming_pairs_by_segments(spark, most, monkeypatch):
    monkeypatch.setattr(hamming, "PART", 20)
    df = hashes(spark)
    rows = lambda x: sorted(map(tuple, x.select("a", "b", "distance", "a_to_b", "b_to_a").collect()))
    got = rows(S.hamming_pairs(df, most, tiled=False))
    assert got == rows(S.hamming_pairs(df, most, tiled=True)) and len(got) >= 80 * 79 / 2


@pytest.mark.parametrize("m", [2, 3, 5, 7])
def test_every_number_of_segments(spark, m):
    df = hashes(spark, 150, copies=0).where("size(h8) = 8")
    h = df.select(F.explode("h8").alias("h")).distinct()
    got = {(r.q, r.h) for r in hamming.near_hashes(h.withColumnRenamed("h", "q"), h, 6, m).collect()}
    values = [r.h for r in h.collect()]
    assert got == {(a, b) for a in values for b in values if ((a ^ b) & (1 << 64) - 1).bit_count() <= 6}


def test_nearest_hamming_over_orientations(spark):
    df = hashes(spark, 200)
    far = spark.createDataFrame([(9000, [0x0F0F0F0F0F0F0F0F]), (9001, [-1])], "vec_id long, h8 array<long>")
    asks, targets = df.where("vec_id % 3 = 0 OR vec_id > 5000").unionByName(far), df.where("vec_id % 3 = 1")
    rows = lambda x: sorted(map(tuple, x.collect()), key=str)
    got = rows(S.nearest_hamming(asks, targets, bits="h8", tiled=False))
    assert got == rows(S.nearest_hamming(asks, targets, bits="h8", tiled=True))
    assert dict(got)[5001] == 64 and min(d for _, d in got) == 0
    assert rows(S.nearest_hamming(asks, targets.limit(0), bits="h8", tiled=False))[0][1] == 64
    # A turned copy is found by the targets' other orientations.
    turned = targets.select((F.col("vec_id") + 10_000).alias("vec_id"), F.slice("h8", 6, 1).alias("h8"))
    assert {r.distance for r in S.nearest_hamming(turned.where("size(h8) = 1"), targets, bits="h8", tiled=False).collect()} == {0}


def test_closest_pairs(spark):
    df = hashes(spark, 150, copies=30).where("size(h8) > 0").select("vec_id", F.col("h8")[0].alias("bits"), (F.col("vec_id") % 3).alias("label"))
    rows = lambda x: [tuple(r) for r in x.collect()]
    for n in (1, 25, 4000):
        assert rows(S.closest_pairs(df, n, "label", tiled=False)) == rows(S.closest_pairs(df, n, "label", tiled=True))
