"""Near pairs of shingle sets: what is moved, prefixes in any order, groups cut into parts, links."""

import random

import numpy as np
import pytest

from foldsmith.operators import similarity as S
from foldsmith.operators.graph import connected_components


def moved(spark) -> int:
    found = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


def families(seed, n, size, edits):
    """Texts in families of near copies of many sizes, and copies."""
    rnd = random.Random(seed)
    base = [[rnd.choice("abcdefghijklm") + rnd.choice("nopq") for _ in range(rnd.randint(3, size))] for _ in range(n // 8)]
    texts = []
    for _ in range(n):
        w = list(rnd.choice(base))
        for _ in range(rnd.randrange(edits)):
            at = rnd.randrange(len(w))
            w[at : at + rnd.randrange(3)] = ["z"] * rnd.randrange(3)
        texts.append(" ".join(w))
    return texts


def near(texts, threshold):
    grams = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in (t.split() for t in texts)]
    score = lambda x, y: len(x & y) / len(x | y)
    return {(i, j): score(x, grams[j]) for i, x in enumerate(grams) for j in range(i + 1, len(texts)) if x and grams[j] and score(x, grams[j]) >= threshold}


@pytest.mark.parametrize("query", [S.jaccard_components, S.jaccard_pairs])
def test_shingles_that_match_nothing_are_not_shuffled(spark, query, tmp_path):
    rnd = random.Random(4)
    texts = [" ".join(f"w{rnd.randrange(10**5)}" for _ in range(1000)) for _ in range(300)]
    made = spark.createDataFrame(list(enumerate([*texts, texts[7] + " end", texts[9]])), "doc_id long, text string")
    made.repartition(4).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    before = moved(spark)
    got = sorted((r[0], r[1]) for r in query(docs, 0.7).collect())
    assert got == ([(7, 7), (9, 9), (300, 7), (301, 9)] if query is S.jaccard_components else [(7, 300), (9, 301)])
    assert moved(spark) - before < 8 * 302 * 998  # the hashes of all shingles


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.9])
def test_pairs_and_links_against_brute_force_in_parts(spark, monkeypatch, threshold):
    from foldsmith.operators import shingles

    for name, least in (("SHINGLE_PART", 5), ("PART_SHINGLES", 200), ("TASK_SHINGLES", 300)):
        monkeypatch.setattr(shingles, name, least)
    texts = families(int(threshold * 10), 160, 60, 6)
    docs = spark.createDataFrame([*enumerate(texts), (None, texts[0]), (999, None)], "doc_id long, text string").repartition(4)
    want = near(texts, threshold)
    got = {(r.a, r.b): r.jaccard for r in S.jaccard_pairs(docs, threshold).collect()}
    assert got == want and S.jaccard_pairs(docs, threshold).count() == len(want)
    edges = spark.createDataFrame(list(want), "a long, b long")
    assert sorted(map(tuple, S.jaccard_components(docs, threshold).collect())) == sorted(map(tuple, connected_components(edges).collect()))
    found, _ = S.jaccard_classes(docs, threshold)
    links, _ = S.jaccard_classes(docs, threshold, links=True)
    assert 0 < links.count() <= found.count()


def test_no_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, "a b"), (3, "")], "doc_id long, text string")
    for rows in (docs, docs.limit(0)):
        assert S.jaccard_pairs(rows, 0.7).count() == 0 and S.jaccard_components(rows, 0.7).count() == 0


def test_prefixes_meet_in_any_order():
    from foldsmith.operators import shingles

    rnd = np.random.default_rng(3)
    for t in (0.5, 0.7, 0.9):
        met = 0
        sketch = rnd.integers(2, 6, shingles.COUNTERS).astype(np.uint16)
        for _ in range(300):
            x = np.unique(rnd.integers(0, 2**63, rnd.integers(1, 60)).astype(np.uint64))
            y = np.unique(np.concatenate([x[rnd.random(len(x)) < 0.9], rnd.integers(0, 2**63, rnd.integers(0, 8)).astype(np.uint64)]))
            both = len(np.intersect1d(x, y))
            if len(y) and both >= t * (len(x) + len(y) - both):
                (p, _), (q, heads) = (shingles.prefix_of(s, sketch, t) for s in sorted((x, y), key=len, reverse=True))
                met += len(np.intersect1d(p, q[:heads])) > 0 or pytest.fail(f"{t}: {x} {y}")
        assert met > 20


def test_words_are_parted_as_in_sql():
    from foldsmith.operators import shingles

    one = lambda t: shingles.shingle_set(t.encode(), 3, shingles._Words()).tolist()
    assert one(" a\tb\n\nc\x0bd\x0c\r") == one("a b c d") and len(one("a b c d")) == 2 and one("a b c") != one("c b a")
    assert len(one("a\xa0b c d")) == 1 and len(one("a\x1cb c d")) == 1 and one("a b") == [] and len(one("a a a a a")) == 1


def test_shingles_that_repeat_by_chance_are_shuffled_once(spark, tmp_path):
    rnd = random.Random(5)
    texts = [" ".join(f"w{rnd.randrange(60)}" for _ in range(1000)) for _ in range(400)]
    made = spark.createDataFrame(list(enumerate([*texts, texts[7] + " end", texts[9]])), "doc_id long, text string")
    made.repartition(4).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    before = moved(spark)
    assert sorted((r.a, r.b) for r in S.jaccard_pairs(docs, 0.7).collect()) == [(7, 400), (9, 401)]
    # 30 of 100 shingles are in a prefix; the sketch takes less than 2 MB.
    assert moved(spark) - before < 402 * 300 * 12 + (2 << 20)


def test_ids_that_a_filter_cannot_tell_from_those_of_copies(spark):
    from foldsmith.operators.shingles import FILTER_BITS

    one, other = "a b c d e f g h i j k l m n", "p q r s t u v w x y z"
    rows = [(0, one), (1, one), (2, other), (1 + FILTER_BITS, other + " end"), (2 - FILTER_BITS, one + " end"), (3 * FILTER_BITS, other)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ids, texts = zip(*sorted(rows))
    want = {(ids[i], ids[j]): value for (i, j), value in near(texts, 0.7).items()}
    assert len(want) == 6 and {(r.a, r.b): r.jaccard for r in S.jaccard_pairs(docs, 0.7).collect()} == want
