"""Joins of all pairs send a row to a bounded number of tasks, and links go on as forests."""

import numpy as np
from pyspark.sql import functions as F

from foldsmith.operators import registry, tiles
from foldsmith.operators import similarity as S
from foldsmith.operators.graph import connected_components


def scattered(spark, n, copies=0, dims=8, seed=5):
    """Vectors without clusters, the last ones equal."""
    v = np.random.default_rng(seed).normal(size=(n, dims))
    v[n - copies :] = v[0]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return spark.createDataFrame([(i, x.tolist(), i % 3) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int").repartition(4)


def test_blocks_do_not_grow_with_the_rows():
    assert tiles.blocks_for(10**5) == tiles.blocks_for(5 * 10**5) == tiles.MOST_BLOCKS and tiles.blocks_for(0) == 1
    assert all(-(-n // tiles.blocks_for(n)) <= tiles.LARGEST for n in (10**4, 10**6, 10**7))


def test_vectors_that_cells_do_not_part_meet_in_tiles(spark, monkeypatch):
    used = []
    for name in ("tile_self_join", "tile_join"):
        was = getattr(tiles, name)
        monkeypatch.setattr(tiles, name, lambda *a, was=was, name=name, **k: used.append(name) or was(*a, **k))
    monkeypatch.setattr(tiles, "MOST_BLOCKS", 3)
    monkeypatch.setattr(tiles, "PRODUCTS", 500)
    df = scattered(spark, 300, copies=20)
    rows = lambda x, *c: sorted(tuple(r) for r in x.withColumn("cosine", F.round("cosine", 6)).select(*c, "cosine").collect())
    assert rows(S.cosine_pairs(df, 0.3, cell_rows=8), "a", "b") == rows(S.cosine_pairs(df, 0.3, tiled=True), "a", "b")
    for args in ({"other": ["label"]}, {"pool": "label"}):
        key = ("q", "t", "rank", *(["pool"] if "pool" in args else []))
        assert rows(S.top_similar(df, df, 4, cell_rows=8, **args), *key) == rows(S.top_similar(df, df, 4, tiled=True, **args), *key)
    left, right = df.where("label = 0"), df.where("label = 1")
    near = {r.q for r in S.top_similar(left, right, 1, tiled=True).where("cosine >= 0.7").collect()}
    assert {r.q for r in S.near_any(left, right, 0.7, cell_rows=8).collect()} == near
    assert used == ["tile_self_join", "tile_join", "tile_join", "tile_join"]


def test_more_pools_than_blocks(spark, monkeypatch):
    monkeypatch.setattr(tiles, "MOST_BLOCKS", 2)
    df = scattered(spark, 120)
    key = lambda x: sorted((r.q, r.pool, r["rank"], r.t) for r in x.collect())
    assert key(S.top_similar(df, df, 20, pool="label", cell_rows=8)) == key(S.top_similar(df, df, 20, pool="label", tiled=True))


def test_links_are_forests(spark, monkeypatch):
    monkeypatch.setattr(S, "FOREST", 50)
    df = scattered(spark, 260, copies=120)
    pairs = S.cosine_pairs(df, 0.9)
    links = S.cosine_links(df, 0.9)
    group = lambda e: sorted(map(tuple, connected_components(e.select("a", "b")).collect()))
    assert group(links) == group(pairs) and links.count() < 260 < pairs.count()
    assert S.cosine_pair_count(df, 0.9).first().n == pairs.count() and S.cosine_pair_count(df.limit(0), 0.9).first().n == 0
    h = df.select("vec_id", F.array(F.expr("vec_id % 40"), F.lit(-1)).cast("array<long>").alias("h8"))
    assert group(S.hamming_links(h, 16)) == group(S.hamming_pairs(h, 16)) and S.hamming_links(h, 16).count() < 260
    nodes = df.select(F.col("vec_id").alias("idx"))
    got = registry.rule_merges(nodes, [("hamming", h.selectExpr("vec_id AS a", "vec_id % 200 AS b")), ("cosine", links)])
    want = registry.rule_merges(nodes, [("both", h.selectExpr("vec_id AS a", "vec_id % 200 AS b").union(pairs.select("a", "b")))])
    assert got[0] == ("hamming", 60) and got[0][1] + got[1][1] == want[0][1]


def test_closest_pairs_by_blocks(spark, monkeypatch):
    df = scattered(spark, 200).select("vec_id", "label", F.xxhash64(F.col("vec_id") % 150).alias("bits"))
    want = S.closest_pairs(df, 25, "label", tiled=False).collect()

    def refuse(*_):
        raise AssertionError("looked up by segments")

    monkeypatch.setattr(S, "near_hashes", refuse)
    monkeypatch.setattr(S, "FEW", 0)
    monkeypatch.setattr(tiles, "PRODUCTS", 300)
    for block in (1024, 32):
        monkeypatch.setattr(tiles.tile_self_join, "__defaults__", (block,))
        assert S.closest_pairs(df, 25, "label").collect() == want


def test_a_detection_is_one_row_for_all_thresholds(spark, monkeypatch):
    from foldsmith.operators import metrics

    seen = []
    was = metrics.running
    monkeypatch.setattr(metrics, "running", lambda df, *a: seen.append(df.count()) or was(df, *a))
    rows = [(i, 0, j, 1.0 - j / 10 - i / 1000, 10.0 * j + i % 4, 0.0, 10.0, 10.0) for i in range(20) for j in range(3)]
    det = spark.createDataFrame(rows, "image_id long, class_id int, det long, score double, x double, y double, w double, h double")
    truth = spark.createDataFrame([(i, 0, i % 5 == 0, 0.0, 0.0, 10.0, 10.0) for i in range(20)], "image_id long, class_id int, crowd boolean, x double, y double, w double, h double")
    out = metrics.average_precision(det, truth, spark.createDataFrame([(0,)], "class_id int")).first()
    # Of images 0, 5, 10, 15 the true box is a crowd box; offsets of 0 to 3 overlap by 1, 9/11, 8/12 and 7/13. Crowd boxes hide what covers them.
    assert seen == [60] and out.support == 16 and 0 < out.ap_75 < out.ap_50 <= 1 and out.ap_75 < out.ap < out.ap_50
