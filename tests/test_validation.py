"""Validation groups picked in rounds against one task, and hashes of a batch against one by one."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldsmith.functions import vectors
from foldsmith.operators import splits, validation

SCHEMA = "held string, group_id long, dataset string, n_train long, n_val long, class_boxes map<int,long>, eligible boolean"


def summary(seed, groups=160, most=9):
    rnd, rows = random.Random(seed), []
    for held in ("x", "y"):
        for g in range(groups):
            names = rnd.sample("abcd", rnd.choice([1, 1, 1, 2]))
            boxes = {c: rnd.randrange(0, 6) for c in range(7) if rnd.random() < 0.3 / (c + 1) + 0.05}
            for i, d in enumerate(names):
                n = rnd.randrange(most) if rnd.random() < 0.95 else rnd.randrange(60)
                rows.append((held, g, d, n, rnd.randrange(n + 1), boxes if i == 0 and boxes else None, rnd.random() < 0.9))
    return rows


@pytest.mark.parametrize("seed,page", [(1, 1000), (2, 3), (3, 50)])
def test_rounds_equal_one_task(spark, monkeypatch, seed, page):
    monkeypatch.setattr(validation, "PAGE", page)
    df = spark.createDataFrame(summary(seed), SCHEMA).repartition(3)
    rules = splits.FoldRules(val_fraction=0.1, least_boxes=9, least_groups=3, seed=seed)
    key = lambda x: sorted(map(tuple, x.collect()))
    want = key(splits.validation_groups(df, rules))
    got = key(splits.validation_groups(df, rules, summary_rows=10))
    assert got == want and 0 < sum(r[2] for r in got) < len(got)


def test_phash_of_a_batch(spark):
    rng = np.random.default_rng(1)
    squares = [rng.random(1024).tolist() for _ in range(9)] + [None, [1.0], [float("nan")] * 1024, [0.5] * 1024]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(squares)], "i int, p array<double>")
    got = {r.i: r.h for r in df.select("i", vectors.phash8(F.col("p")).alias("h")).collect()}
    for i, s in enumerate(squares[:12]):
        want = vectors.perceptual_hashes(s) if s else None
        assert got[i] == want
