import random

import numpy as np
import xxhash

from foldsmith.llm import simhash
from foldsmith.operators.graph import connected_components


def brute_fp(text):
    import re

    words = [w for w in re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))]
    if not words:
        return 0
    parts = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_against_brute_force(odd):
    rows = odd.select("doc_id", "text").collect()
    fps = [brute_fp(r.text) for r in rows]
    root = brute_components(fps)
    ids = {}
    for r, x in zip(rows, root):
        if r.doc_id is not None:
            ids[x] = min(ids.get(x, r.doc_id), r.doc_id)
    want = sorted((str(r.doc_id), f"{f:016x}", ids.get(x)) for r, f, x in zip(rows, fps, root))
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.near_duplicates(odd).collect())
    assert got == want


def test_empty(empty):
    assert simhash.near_duplicates(empty).collect() == []


def test_columns_with_the_names_of_inner_ones_are_kept(spark):
    rows = [(i, t, f"r{i}", i, f"x{i}", f"y{i}") for i, t in enumerate(["one two three four five", "one two three four five", "six", None, "", "seven eight nine ten"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, _row string, _nth int, row string, root string")
    got = simhash.keep_one(df)
    assert got.columns == df.columns and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [rows[i] for i in (0, 2, 3, 5)]))


def near_group(n, seed):
    rnd = random.Random(seed)
    out, base = set(), rnd.getrandbits(64)
    while len(out) < n:
        x = base
        for _ in range(rnd.randint(0, 5)):
            x ^= 1 << rnd.randrange(64)
        out.add(x)
    return [*out, *(rnd.getrandbits(64) for _ in range(n))]


def test_links_connect_what_all_links_connect(spark):
    for n, cell in ((150, 4096), (150, 16)):  # whole cells, then tiles
        fps = near_group(n, n + cell)
        df = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in fps], "fp long")
        comp = {r.node: r.component for r in connected_components(simhash.links(df, cell=cell)).collect()}
        root = brute_components(fps)
        mine = [comp.get(int(np.uint64(x).view(np.int64)), int(np.uint64(x).view(np.int64))) for x in fps]
        assert len(set(zip(root, mine))) == len(set(root)) == len(set(mine))


def test_every_choice_of_groups_finds_every_pair():
    rnd = random.Random(3)
    for n in (10, 10**6, 10**10):
        masks = simhash.grid_masks(n, 4)
        for _ in range(300):
            a = rnd.getrandbits(64)
            b = a
            for _ in range(4):
                b ^= 1 << rnd.randrange(64)
            un = lambda x: ((x | x >> 1) & simhash.LOW) | ((x & x >> 1 & simhash.LOW) << 1)
            assert bin(un(a) ^ un(b)).count("1") <= 4
            assert any(un(a) & m == un(b) & m for m in masks)
