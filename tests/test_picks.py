"""Greedy picking in rounds against one pass in order; audits that must not lose images; specifications with several targets."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldsmith.operators import leakage, pairs, splits
from foldsmith.operators.audit import Unreadable

IMAGES = "held string, group_id long, id long, sha string, cap_key string, embedding array<double>, n_boxes int, n_classes int, area double"


def scene(n, groups=2, shas=0.8, caps=40, dims=6, seed=1):
    rnd, rng = random.Random(seed), np.random.default_rng(seed)
    v = rng.normal(size=(n, dims))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = []
    for i in range(n):
        vector = None if i % 41 == 0 else v[i if rnd.random() < 0.6 else rnd.randrange(n)].tolist()
        rows.append((rnd.choice("xy"), i % groups, i, f"s{rnd.randrange(int(n * shas) + 1)}" if i % 53 else None, f"c{min(int(rnd.expovariate(0.2)), caps)}", vector, rnd.randrange(4), rnd.randrange(3), float(rnd.randrange(9))))
    return rows


@pytest.mark.parametrize("cap,thin", [(5, 0.9), (1, None), (1000, 0.8), (30, 0.99)])
def test_rounds_equal_one_pass(spark, cap, thin):
    df = spark.createDataFrame(scene(700), IMAGES).repartition(4)
    by = ["held", "group_id"]
    want = sorted(r.id for r in splits.picked(df, by, cap, thin).collect())
    got = sorted(r.id for r in splits.picked(df, by, cap, thin, group_rows=20).collect())
    assert got == want and len(got) > 20


def test_rounds_on_one_huge_group(spark):
    rows = [("x", 7, i, f"s{i % 30_000}", f"c{i % 900}", None, i % 3, 1, float(i % 7)) for i in range(40_000)]
    df = spark.createDataFrame(rows, IMAGES).repartition(8)
    got = sorted(r.id for r in splits.picked(df, ["held", "group_id"], 5, 0.95, group_rows=2000).collect())
    assert got == sorted(r.id for r in splits.picked(df, ["held", "group_id"], 5, 0.95, group_rows=100_000).collect()) and len(got) == 4500


FOLDS = "held string, split string, id long, embedding array<double>, bits array<long>, source string"


def test_audit_refuses_unreadable_images_and_sees_turned_copies(spark):
    ok = [("h", "train", 1, [1.0, 0.0], [5, 9, 77], "a"), ("h", "val", 2, [0.0, 1.0], [77, 1, 2], None), ("h", "val", 3, [0.6, 0.8], [-1, 1, 2], "a")]
    rows = sorted(map(tuple, leakage.nearest_in_training(spark.createDataFrame(ok, FOLDS), "h", "val").collect()))
    assert [r[2:] for r in rows] == [(2, 1, 0.0, 0, False), (3, 1, 0.6, rows[1][5], True)] and rows[1][5] > 50
    alone = leakage.nearest_in_training(spark.createDataFrame(ok[1:], FOLDS), "h", "val").collect()
    assert len(alone) == 2 and all(r.near is None and r.distance == 64 for r in alone)
    for bad in (("h", "val", 4, None, [1], "a"), ("h", "train", 5, [1.0, 0.0], None, "a")):
        with pytest.raises(Unreadable):
            leakage.nearest_in_training(spark.createDataFrame([*ok, bad], FOLDS), "h", "val").collect()
    with pytest.raises(Unreadable):
        leakage.sampled_matches(spark.createDataFrame([*ok, ("h", "val", 4, None, [1], "a")], FOLDS), "h", spark.createDataFrame([], "a long, b long, inliers int"), 9, 1, 0.0, 1)


def test_named_targets_are_one_pool(spark):
    rows = [(i, [float(np.cos(i / 10)), float(np.sin(i / 10))], "abc"[i % 3]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, dataset string")
    got = pairs.candidates(df, pairs.Spec.parse("a:b,c:3")).collect()
    assert len(got) == 10 * 3
    for r in got:
        near = sorted((abs(r.q - i), i) for i in range(30) if i % 3)[:3]
        assert r.t % 3 and abs(r.q - r.t) <= near[-1][0]
    each = pairs.candidates(df, pairs.Spec.parse("a:*:1"))
    assert each.count() == 10 * 3
    own = pairs.candidates(df, pairs.Spec.parse("a:=:2")).select((F.col("t") % 3).alias("d")).distinct().collect()
    assert [r.d for r in own] == [0]
