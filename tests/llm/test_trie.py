"""The trie of conversations against a dictionary of all prefixes."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from foldsmith.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, c long, POS string, slot int"


def brute(rows):
    convs = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    for v in convs.values():
        v.sort(key=lambda t: t[:2])
    said = {c: [t[2:] for t in v] for c, v in convs.items()}
    members, ends = {}, {}
    for c, own in said.items():
        h = zlib.crc32(str(c).encode()) % 4
        path = tuple(said.get(c - int(np.fmod(c, 20)), [])[:h] + own[h:])
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
        ends.setdefault(path, []).append(c)
    kids = {p: [] for p in members}
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved, out = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        leaves[p] = sum(leaves[x] for x in kids[p]) or 1
        saved[p] = (len(members[p]) - 1) * words + sum(saved[x] for x in kids[p])
    for p, m in members.items():
        sha = hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], sha))
    return sorted(out, key=str)


def made(n=150, seed=3, hot=0.4):
    """Conversations of which many are equal or begin alike; null turns, roles and texts; one long; rows out of order."""
    rnd = random.Random(seed)
    turns = [(rnd.choice(["user", "assistant", None]), rnd.choice([None, "", " ", "a b c", "é\tü x", "the same\nline"]) if rnd.random() < 0.4 else f"w{rnd.randrange(40)} v") for _ in range(60)]
    rows = []
    for c in [*range(-45, n), 1005]:
        if rnd.random() < 0.06:
            continue
        path = turns[:6] if rnd.random() < hot else turns[: rnd.randrange(4)] + [rnd.choice(turns) for _ in range(rnd.randrange(6))]
        if c == 31:
            path = [turns[i % 7] for i in range(300)]
        rows += [(c, i if i or rnd.random() < 0.8 else None, r, t, 7, "x", 1) for i, (r, t) in enumerate(path or [turns[0]])]
    rows += [(None, 0, "user", "no conversation", 1, "y", 2)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("shard", [3, 40, 4096])
def test_nodes(spark, shard):
    rows = made()
    got = trie.prefix_nodes(spark.createDataFrame(rows, SCHEMA).repartition(5), shard).collect()
    assert sorted((tuple(r)[:-1] for r in got), key=str) == brute(rows)
    assert any(r.slot is None for r in got) and any(r.slot is not None for r in got)


def test_repeated_rows_and_turnless(spark):
    # 41 begins with turns of conversation 40, which is absent, and has fewer of its own than it gives up.
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in range(41, 60)}
    c = next(c for c in h if h[c] >= 2)
    rows = [(c, 0, "user", "a", 1, "x", 1), (100, 0, "user", "a b", 1, "x", 1), (100, 0, "user", "a b", 1, "x", 1)]
    got = trie.prefix_nodes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((tuple(r)[:-1] for r in got), key=str) == brute(rows)
    root = next(r for r in got if r.depth == 0)
    assert root.n_convs == 2 and root.ends_sha256 == hashlib.sha256(str(c).encode()).hexdigest()


def test_empty(spark):
    assert trie.prefix_nodes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_double_array_packs_and_refuses():
    rnd = random.Random(5)
    paths = [[rnd.randrange(30) for _ in range(rnd.randint(1, 8))] for _ in range(400)]
    rows = [(i, k, s) for i, p in enumerate(paths) for k, s in enumerate(p)]
    array, slots = trie.pack(*(np.array(x) for x in zip(*rows)))
    at = {}
    for (i, k, _), slot in zip(rows, slots):
        assert at.setdefault(tuple(paths[i][: k + 1]), slot) == slot
    assert len(set(at.values())) == len(at)
    used = (array.check[: array.end] >= 0).sum()
    assert used == len(at) and array.end < 1.5 * used + 30
    assert (array.step(np.array([0, int(slots[0])]), np.array([10_000, -5])) == -1).all()
