"""Running aggregates against plain Python, with a key over many ranges."""

import random

import pytest
from pyspark.sql import functions as F

from foldsmith.operators.scan import running


def brute(rows):
    state, out = {}, []
    for k, i, v in sorted(rows, key=lambda r: (r[0] is not None, str(r[0]), r[1])):
        s = state.setdefault(k, {"n": 0, "s": None, "x": None, "m": None, "l": None})
        s["n"] += 1
        if v is not None:
            s["s"] = (s["s"] or 0) + v
            s["x"] = (s["x"] or 0) ^ v
            s["m"] = v if s["m"] is None else max(s["m"], v)
            s["l"] = v
        out.append((k, i, s["n"], s["s"], s["x"], s["m"], s["l"]))
    return sorted(out, key=str)


@pytest.mark.parametrize("share", [0.0, 0.9, 1.0])
def test_running(spark, share):
    rnd = random.Random(7)
    rows = [("hot" if rnd.random() < share else rnd.choice(["a", "b", None, *"cdefgh"]), i, rnd.choice([None, rnd.randrange(100)])) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, i long, v long").repartition(7)
    got = running(df, ["k"], [F.col("i")], {"n": ("sum", F.lit(1).cast("long")), "s": ("sum", F.col("v")), "x": ("bit_xor", F.col("v")), "m": ("max", F.col("v")), "l": ("last", F.col("v"))})
    assert sorted((tuple(r) for r in got.drop("v").collect()), key=str) == brute(rows)


def test_no_key_no_rows_clashes(spark):
    df = spark.createDataFrame([(3, 1), (1, 1), (2, 1)], "_part long, _Nth long")
    got = running(df, [], [F.col("_part")], {"up": ("sum", F.col("_Nth"))})
    assert sorted(map(tuple, got.collect())) == [(1, 1, 1), (2, 1, 2), (3, 1, 3)]
    assert running(df.limit(0), ["_part"], [F.col("_Nth")], {"up": ("sum", F.col("_Nth"))}).count() == 0
