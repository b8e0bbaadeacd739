"""Ranks, ties and bands of the most similar, against SQL and against sums added term after term."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from foldsmith.operators import cells
from foldsmith.plans import nearby, similarity


@pytest.mark.parametrize("plan,name", [(similarity, "topk_per_query_band"), (similarity, "pair_specification"), (nearby, "topk_apart")])
def test_bands_take_rounded_cosines_and_nulls_match_nothing(spark, tmp_path, plan, name):
    first = [1.0, 0.4199998, 0.2999997, 0.42, 0.3, 0.35, 0.1999998, 0.3999997, 0.25, 0.25, 0.31, 0.32]
    labels = [0, 1, 1, 2, 2, 3, 1, 1, 3, 3, None, None]
    vectors = [[x, (1 - x * x) ** 0.5 if i == 0 else 0.0, *[0.0] * 62] for i, x in enumerate(first)]
    # Only id 0 and one of those without a label are divisible by 5.
    ids = [0, *(5 * i + 1 for i in range(1, 10)), 55, 57]
    data = pa.table({"vec_id": ids, "embedding": pa.array(vectors, pa.list_(pa.float32())), "label": pa.array(labels, pa.int32())})
    pq.write_table(data, tmp_path / "embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    want = con.execute(f"SELECT q, t, cosine, rank FROM ({plan.SQL[name]})").fetchall()
    assert sorted(map(tuple, plan.QUERIES[name](spark, str(tmp_path)).select("q", "t", "cosine", "rank").collect())) == sorted(want) and want


@pytest.mark.parametrize("k", [3, 20])
def test_products_are_added_in_order_and_ties_go_to_the_least_id(k):
    r = np.random.default_rng(5)
    v = r.normal(size=(300, 64)).astype(np.float32)
    v[200:260] = v[7]
    ids = r.permutation(300)
    whole = pa.table({"k": ids, "v": pa.array(list(v)), "p": np.zeros(300, np.int64)})
    x = v.astype(float)
    sums = np.zeros((300, 300))
    for d in range(64):
        sums += x[:, d, None] * x[None, :, d]
    np.fill_diagonal(sums, -np.inf)
    got = cells.best_of(whole.select(["k", "v"]), whole, k, []).to_pylist()
    want = [(ids[i], ids[j], sums[i, j]) for i in range(300) for j in np.lexsort((ids, -sums[i]))[:k]]
    assert sorted((g["q"], g["t"], g["cosine"]) for g in got) == sorted(want)
