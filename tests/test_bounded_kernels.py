"""What tasks hold and get does not grow with one block or one split."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from foldsmith.operators import similarity
from foldsmith.plans import nearby
from foldsmith.sources import sinks


def test_hamming_kernel_holds_few_rows_at_once(monkeypatch, spark):
    held = {}
    monkeypatch.setattr(similarity, "tile_self_join", lambda rows, key, kernel, ddl: held.setdefault("kernel", kernel))
    similarity.hamming_pairs(spark.createDataFrame([(1, [1, 2])], "vec_id long, h8 array<long>"), 18)
    r = np.random.default_rng(1)
    table = lambda n, first: pa.table({"k": np.arange(first, first + n), "h": pa.array(list(r.integers(-(2**62), 2**62, (n, 2))))})
    x, y = table(2048, 0), table(2048, 5000)
    tracemalloc.start()
    got = held["kernel"](x, y).to_pylist()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40e6
    h, g = (np.array(t["h"].to_pylist()).view(np.uint64) for t in (x, y))
    to = np.minimum(*(np.bitwise_count(h[:, :1] ^ g[None, :, k]) for k in range(2)))
    back = np.minimum(*(np.bitwise_count(h[:, k : k + 1] ^ g[None, :, 0]) for k in range(2)))
    i, j = np.nonzero(np.minimum(to, back) <= 18)
    assert sorted((r["a"], r["b"], r["a_to_b"], r["b_to_a"]) for r in got) == sorted((int(a), int(b) + 5000, int(to[a, b]), int(back[a, b])) for a, b in zip(i, j)) and got
    assert all(r["distance"] == min(r["a_to_b"], r["b_to_a"]) for r in got)


def test_a_large_split_of_nearest_pairs_is_written_by_many_tasks(spark, tmp_path):
    n = spark.range(4000).select(F.lit("h").alias("held"), F.lit("s").alias("split"), "id", F.col("id").alias("near"), (F.col("id") / 4000).alias("cosine"), F.lit(1).alias("distance"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_nearest(n, n.groupBy("held", "split").count(), str(tmp_path / "out"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted((tmp_path / "out/nearest/held=h/split=s").glob("part-*"))
    ids = [int(line.split(",")[0]) for f in files for line in f.read_text().splitlines()[1:]]
    assert len(files) > 1 and ids == list(range(3999, -1, -1))


def test_far_hashes_are_not_looked_up_by_segments(monkeypatch, spark):
    def refuse(*_):
        raise AssertionError("segments beyond MOST_BY_SEGMENTS")

    monkeypatch.setattr(similarity, "_hamming_by_segments", refuse)
    assert nearby.hamming_near_pairs(spark, "/root/testdata/sf0.001").columns == ["a", "b", "distance", "a_to_b", "b_to_a"]
