"""Small fixtures with hand-checked answers, and naive versions of the greedy operators."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foldsmith.functions import boxes as B
from foldsmith.functions import names, vectors
from foldsmith.operators import balance, ids, merge, metrics, pairs, registry, splits
from foldsmith.operators.graph import connected_components
from foldsmith.operators.similarity import band, cosine_pairs, hamming_pairs, jaccard_pairs, top_similar
from foldsmith.plans import curves


def annotations(spark, rows):
    df = spark.createDataFrame([(i, o, c, float(x), float(y), float(w), float(h)) for i, o, c, x, y, w, h in rows], "image_id long, ord int, class_id int, x double, y double, w double, h double")
    return df.select("image_id", "ord", "class_id", F.struct("x", "y", "w", "h").alias("box"))


def test_greedy_merge(spark):
    a = annotations(spark, [(1, 0, 1, 0, 0, 100, 100), (1, 1, 1, 5, 0, 100, 100), (1, 2, 1, 9, 0, 100, 100), (1, 3, 2, 0, 0, 100, 100), (2, 0, 1, 0, 0, 10, 10), (2, 1, 1, 0, 0, 10, 9)])
    got = [(r.ann_id, r.image_id, r.ord) for r in merge.merge_annotations(a).orderBy("ann_id").collect()]
    assert got == [(0, 1, 0), (1, 1, 2), (2, 1, 3), (3, 2, 0), (4, 2, 1)]


def test_pick():
    v = [(1, 0), (1, 0), (0.96, 0.28), (0.6, 0.8), (0, 1), (-1, 0)]
    df = pd.DataFrame({"id": range(10, 16), "sha": list("ppqrtu"), "cap_key": ["s1"] * 5 + ["s2"], "embedding": v})
    assert [10 + i for i in splits.pick(df, 2, 0.95)] == [10, 13, 15]


def test_top_k_before_band(spark):
    c = [0.95, 0.85, 0.70, 0.62]
    t = spark.createDataFrame([(i + 1, [x, (1 - x * x) ** 0.5]) for i, x in enumerate(c)], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(100, [1.0, 0.0])], t.schema)
    assert [round(r.cosine, 2) for r in band(top_similar(q, t, 3), 0.60, 0.90).orderBy("rank").collect()] == [0.85, 0.70]


def test_hamming_links_in_either_direction(spark):
    df = spark.createDataFrame([(1, [0] * 8), (2, [-1, 15, *[-1] * 6]), (3, None)], "vec_id long, h8 array<long>")
    assert [(r.a, r.b, r.distance, r.a_to_b, r.b_to_a) for r in hamming_pairs(df, 8).collect()] == [(1, 2, 4, 4, 64)]


def test_tiles_equal_brute_force(spark):
    rnd = np.random.default_rng(1)
    v = rnd.normal(size=(60, 4))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, x.tolist(), i % 3) for i, x in enumerate(v)], "vec_id long, embedding array<double>, d int")
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if v[i] @ v[j] >= 0.8}
    from foldsmith.operators import tiles

    tiles_block, tiles.BLOCK = tiles.BLOCK, 16
    try:
        tiles.tile_self_join.__defaults__ = (16,)
        got = [(r.a, r.b) for r in cosine_pairs(df, 0.8).collect()]
    finally:
        tiles.BLOCK = tiles_block
        tiles.tile_self_join.__defaults__ = (tiles_block,)
    assert sorted(got) == sorted(want)


def test_repeat_factors(spark):
    rows = [("A1", "A", [0]), ("A2", "A", [0]), ("A3", "A", [0, 1]), ("B1", "B", [1])]
    got = {r.id: round(r.factor, 6) for r in balance.repeat_factors(spark.createDataFrame(rows, "id string, dataset string, classes array<int>")).collect()}
    assert got == {"A1": 1, "A2": 1, "A3": 1, "B1": 1.414214}


def test_weighted_sample_is_in_proportion(spark):
    df = spark.createDataFrame([(i, float(i % 3)) for i in range(30)], "k long, w double")
    got = {r.k: r.draws for r in balance.weighted_sample(df, "w", "k", 30_000, 1).collect()}
    assert sum(got.values()) == 30_000 and all(i % 3 for i in got)
    assert all(abs(n - 30_000 * (k % 3) / 30) < 200 for k, n in got.items())


def test_early_stopping(spark):
    s = [0.10, 0.12, 0.12, 0.11, 0.13, 0.12, 0.12, 0.12]
    rows = metrics.early_stopping(spark.createDataFrame([(1, i, x) for i, x in enumerate(s)], "u int, e int, s double"), ["u"], "e", "s", 3).orderBy("e").collect()
    assert [r.e for r in rows if r.is_best] == [0, 1, 4] and [r.e for r in rows if r.stop] == [7]


def test_curves_and_summaries(spark):
    x = spark.createDataFrame([(s,) for s in (5, 10, 65, 120)], "s int").select(F.round(vectors.lr_factor(F.col("s"), 10, 12, 1, 5e-5, 1e-6), 6).alias("f"))
    assert [r.f for r in x.collect()] == [0.5, 1.0, 0.5, 0.02]
    one = spark.range(1).select(vectors.ema(F.array(F.lit(2.0), F.lit(3.0)), 0.9, 1.0).alias("e"), F.bround(F.lit(0.025) / 0.05).alias("g"))
    assert round(one.first().e, 9) == 1.29 and one.first().g == 0
    r = metrics.fold_summary(spark.createDataFrame([(0.1, 5), (0.2, 5), (0.6, 5)], "v double, support long").withColumn("k", F.lit(1)), "v", ["k"]).first()
    assert (round(r["mean"], 6), round(r["std"], 6), r.half_range, r.low_support) == (0.3, 0.216025, 0.25, True)
    p = metrics.percentiles(spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 4.0)], "k int, v double"), "v", ["k"], 2).first()
    assert (round(p.p10, 6), p.p50, round(p.p90, 6)) == (1.2, 2.0, 3.6)


def test_names(spark):
    rows = ["IMG_12_jpg.rf.AbC123", "a", "105_14_png.rf.x1", "x.rf.1.rf.2", "photo.rf.a-b"]
    got = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, n string").orderBy("i").select(names.source_name(F.col("n")).alias("s")).collect()
    assert [r.s for r in got] == ["img_12", None, "105_14", "x.rf.1", None]
    got = spark.createDataFrame([("105_14",), ("img_12",)], "n string").select(names.photo_id(F.col("n"), r"^(\d+)_\d+$").alias("p")).collect()
    assert [r.p for r in got] == ["105", "img_12"]


def test_box_clip(spark):
    b = spark.range(1).select(B.from_normal_centre(*map(F.lit, (0.95, 0.5, 0.2, 0.5)), F.lit(100), F.lit(200)).alias("b")).first().b
    assert [round(x, 6) for x in b] == [85, 50, 15, 100]


def test_registry(spark):
    occ = spark.createDataFrame(
        [("X", 0, 0, "x0", "a"), ("X", 0, 1, "x1", "b"), ("Y", 1, 0, "y0", "a"), ("Y", 1, 1, "y1", "c"), ("Y", 1, 2, "y2", "d"), ("Z", 2, 0, "z0", "e"), ("Z", 2, 1, "z0", "e")],
        "dataset string, dataset_ord int, image_ord int, path string, sha string",
    )
    idx = {r.sha: r.idx for r in registry.nodes_of(occ).collect()}
    assert idx == {"a": 0, "b": 1, "c": 2, "d": 3, "e": 4}
    edge = lambda *p: spark.createDataFrame([(idx[x], idx[y]) for x, y in p], "a long, b long")
    strong, weak = edge("bd"), edge("cd")
    reg = registry.build_registry(occ, strong, weak)
    got = [(r.path, r.id, r.group_id, r.subscene_id) for r in reg.orderBy(F.col("id").asc_nulls_last()).collect()]
    assert got == [("x0", 0, 0, 0), ("y0", 1, 0, 0), ("x1", 2, 1, 1), ("y1", 3, 1, 2), ("y2", 4, 1, 1), ("z0", 5, 2, 3), ("z0", None, None, None)]
    assert registry.rule_merges(registry.nodes_of(occ), [("strong", strong), ("weak", weak)]) == [("strong", 1), ("weak", 1)]
    assert registry.group_rollup(reg).where("cross_dataset").count() == 2


def test_components_equal_union_find(spark):
    rnd = random.Random(2)
    for n, m in ((200, 120), (60, 300)):
        edges = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(1000, 1060)] + [(7000, 7000)]
        parent = {x: x for e in edges for x in e}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
        got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {x: find(x) for x in parent}


def test_pairs(spark):
    c = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "d")], "x string, y string")
    assert [tuple(r) for r in pairs.new_pairs(c, spark.createDataFrame([("b", "a")], c.schema), "x", "y").collect()] == [("c", "d")]
    assert pairs.Spec.parse("a,b:*:3:0.2") == pairs.Spec(["a", "b"], ["*"], 3, 0.2, float("inf"))
    with pytest.raises(ValueError):
        pairs.Spec.parse("a:b:0")


def test_fixed_point(spark):
    base = spark.createDataFrame([("f", str(i)) for i in range(6)], "fold_id string, file string")
    build = lambda drops: base.join(drops, ["fold_id", "file"], "left_anti")
    found = lambda result, drops: result.where(F.col("file") == F.lit(str(drops.count()))).where("file < '3'")
    result, drops, n = pairs.fixed_point(build, found, base.limit(0))
    assert (result.count(), drops.count(), n) == (3, 3, 4)


def test_average_precision(spark):
    truth = spark.createDataFrame([(1, 0, False, 0.0, 0.0, 10.0, 10.0), (1, 1, False, 20.0, 0.0, 10.0, 10.0), (2, 0, False, 0.0, 0.0, 5.0, 5.0)], "image_id long, class_id int, crowd boolean, x double, y double, w double, h double")
    det = truth.select("image_id", "class_id", F.lit(0).cast("long").alias("det"), F.lit(0.9).alias("score"), "x", "y", "w", "h")
    classes = spark.createDataFrame([(0,), (1,), (2,)], "class_id int")
    ap = metrics.average_precision(det, truth, classes)
    assert sorted((r.class_id, round(r.ap, 9), r.support) for r in ap.collect()) == [(0, 1.0, 2), (1, 1.0, 1), (2, -1.0, 0)]
    assert [round(x, 9) for x in metrics.mean_ap(ap).first()] == [1, 1, 1]
    assert list(metrics.mean_ap(metrics.average_precision(det.limit(0), truth, classes)).first()) == [0, 0, 0]


def test_fold_sides(spark):
    rows = [(["A", "C"],), (["B", "C"],), (["C"],), (["A", "B"],)]
    got = spark.createDataFrame(rows, "d array<string>").select(splits.fold_side(F.col("d"), F.lit("A"), F.array(F.lit("B"))).alias("s")).collect()
    assert [r.s for r in got] == ["test", "sidelined", "train", "test"]


def test_folds_hold_their_invariants(spark):
    rnd = np.random.default_rng(3)
    rows = []
    for i in range(240):
        v = rnd.normal(size=6)
        g = i // 3
        rows.append((i, f"d{g % 4}", g, i // 2, f"s{i - (i % 11 == 0)}", f"f{i}", int(rnd.integers(0, 4)), 2, 1.0, (v / np.linalg.norm(v)).tolist()))
    im = spark.createDataFrame(rows, "id long, dataset string, group_id long, subscene_id long, sha string, file string, n_boxes long, n_classes long, area double, embedding array<double>")
    rules = splits.FoldRules(near=0.9, least_boxes=3, least_groups=1, val_fraction=0.2)
    got = splits.build_folds(im, ["d0", "d1"], rules).cache()
    assert splits.violations(got).isEmpty() and {r.split for r in got.collect()} == {"train", "val", "test"}
    vec = {r[0]: np.array(r[-1]) for r in rows}
    for held in ("d0", "d1"):
        side = {s: [r.id for r in got.collect() if r.held == held and r.split == s] for s in ("train", "val", "test")}
        for other in ("test", "val"):
            assert all(vec[a] @ vec[b] < 0.9 for a in side["train"] for b in side[other])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, splits.build_folds(im.orderBy(F.rand(1)), ["d0", "d1"], rules).collect()))


def test_shingle_pairs_equal_brute_force(spark):
    rnd = random.Random(8)
    base = [[rnd.choice("abcdefghij") for _ in range(40)] for _ in range(10)]
    docs = []
    for i in range(40):
        w = list(rnd.choice(base))
        for _ in range(rnd.randrange(4)):
            w[rnd.randrange(40)] = "z"
        docs.append((i, " ".join(w)))
    sets = {i: {tuple(t.split()[k : k + 3]) for k in range(38)} for i, t in docs}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b])}
    got = [(r.a, r.b) for r in jaccard_pairs(spark.createDataFrame([*docs, (99, None)], "doc_id long, text string"), 0.7).collect()]
    assert sorted(got) == sorted(want)


def test_index_is_contiguous(spark):
    got = ids.with_index(spark.range(1000).withColumn("k", -F.col("id")), [F.col("k")], "n").collect()
    assert all(r.n == 999 - r.id for r in got)


def test_perceptual_hash():
    rnd = np.random.default_rng(0)
    m = rnd.random((32, 32))
    a, b = (vectors.perceptual_hashes(x.ravel().tolist()) for x in (m, np.rot90(m)))
    assert len(a) == 8 and b[0] == a[1] and vectors.perceptual_hashes([1.0]) is None


def test_average_precision_query_reads_all_of_lineitem(spark):
    sf_dir = "/root/testdata/sf0.001"
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    det, truth = curves._detections(spark, sf_dir)
    assert det.count() == lines.count() and det.select("image_id").distinct().count() == lines.select("l_orderkey").distinct().count()
    support = {r.class_id: r.support for r in curves.average_precision(spark, sf_dir).collect()}
    assert sum(support.values()) == lines.where("l_linenumber <= 3").count() and set(support) == {0, 1, 2, 9}


def test_prompts_and_masks(spark):
    from foldsmith.operators import masking

    assert masking.prompts(spark, {"bare": {"dent": "dent", "hole": "a hole"}}, "bare", ["hole", "dent"]).first().prompt == "a hole"
    for name, classes in (("none", []), ("bare", ["dent", "rust"])):
        with pytest.raises(ValueError):
            masking.prompts(spark, {"bare": {"dent": "dent"}}, name, classes)
    spans = F.create_map(F.lit(0), F.struct(F.lit(1).alias("start"), F.lit(3).alias("end")), F.lit(1), F.struct(F.lit(3).alias("start"), F.lit(9).alias("end")))
    assert spark.range(1).select(masking.token_mask(F.array(F.lit(0), F.lit(1), F.lit(7)), spans, 5).alias("m")).first().m == [False, True, True, False, False]
    q = spark.createDataFrame([(1, [0.0, 2.0, 9.0], [1, 0, 0], [True, True, False], 2)], "b int, logits array<double>, targets array<int>, mask array<boolean>, n int")
    sig = 1 / (1 + np.exp(-2.0))
    want = (0.25 * np.log(2) * 0.25 + 0.75 * -np.log(1 - sig) * sig**2) / 2
    assert masking.focal_loss(q, ["b"], "n").first().loss == pytest.approx(want)


def test_leakage_and_fold_files(spark):
    from foldsmith.operators import leakage
    from foldsmith.operators.audit import Unreadable

    assert leakage.known_pairs(None, {"a": "b", "c": "a", "b": "z"}, ["a", "b"]) == (["a", "b"], {"a": "b"})
    assert leakage.known_pairs(["b", "q"], None, ["a", "b"]) == (["b"], {})
    files = spark.createDataFrame([("0", "train.jsonl"), ("0", "val.jsonl"), ("1", "train.jsonl")], "fold string, name string")
    maps = spark.createDataFrame([("0", {"0": "dent"}), ("1", {"0": "dent", "1": "hole"})], "fold string, classes map<string,string>")
    got = {(r.fold, r.problem) for r in leakage.file_problems(files, ["0", "1"], ["train.jsonl", "val.jsonl"], maps, 2).collect()}
    assert got == {("1", "missing: val.jsonl"), ("0", "label map of 1 classes")}
    m = spark.createDataFrame([(1, 2, 0.7, 16), (3, 4, 0.5, 16), (5, 6, 0.9, None)], "id long, near long, cosine double, inliers int")
    with pytest.raises(Unreadable, match="1 validation"):
        leakage.refuse_matches(m)
    assert leakage.refuse_matches(m.where("id > 1")).count() == 2


def test_group_split_against_a_loop(spark):
    import hashlib
    import random

    for seed, most, fraction in ((1, 9, 0.1), (2, 40, 0.1), (3, 3, 0.5), (4, 60, 0.01)):
        rnd = random.Random(seed)
        sizes = {g: rnd.randint(1, most) for g in range(80)}
        df = spark.createDataFrame([(g * 100 + i, g) for g, n in sizes.items() for i in range(n)], "id long, group_id long")
        order = sorted(sizes, key=lambda g: hashlib.sha1(f"{seed}:{g}".encode()).hexdigest())
        room, want = max(1, int(sum(sizes.values()) * fraction)), set()
        for g in order:
            if sizes[g] <= room:
                want.add(g)
                room -= sizes[g]
        want = want or {min(order, key=lambda g: sizes[g])}
        got = splits.split_by_group(df, fraction, seed)
        assert {r.id // 100 for r in got.where("to_val").collect()} == want and got.count() == df.count()


def test_jaccard_pairs_with_copies_against_brute_force(spark):
    import random

    rnd = random.Random(2)
    base = [[f"w{rnd.randrange(30)}" for _ in range(rnd.randint(2, 25))] for _ in range(25)]
    texts = [" ".join(b) for b in base] + [" ".join([*b[:-1], "x"]) for b in base] + [" ".join(base[0])] * 4 + [None, "", "a b"]
    grams = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in ((t or "").split() for t in texts)]
    want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if grams[i] and grams[j] and len(grams[i] & grams[j]) >= 0.6 * len(grams[i] | grams[j])}
    got = [(r.a, r.b) for r in jaccard_pairs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 0.6).collect()]
    assert sorted(got) == sorted(want)
