"""Line dedup against dictionaries of lines, and the index against one that is built anew."""

import random

import numpy as np
import pytest

from foldsmith.llm import lines

SCHEMA = "doc_id long, text string, K1 string, n_lines int"
SPACE = " \t\n\x0b\x0c\r"


def key(line):
    k = "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))
    return k if len(k) >= 10 else None


def brute(rows, among=None):
    """(doc_id, n_lines, n_dropped, text) of the rows; the index holds `among` (the rows themselves by default)."""
    last = (1 << 63) - 1
    holders = {}
    for doc, text, *_ in among if among is not None else rows:
        for line in (text or "").split("\n"):
            if key(line):
                holders.setdefault(key(line), set()).add(last if doc is None else doc)
    out = []
    for doc, text, *_ in rows:
        own = (text or "").split("\n")
        kept = [x for x in own if not (key(x) and len(holders[key(x)]) > 1 and min(holders[key(x)]) != (last if doc is None else doc))]
        out.append((doc, len(own), len(own) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def made(n=120, seed=2):
    rnd = random.Random(seed)
    pool = [f"Line number {i} of the pool" for i in range(30)] + ["short", "  ", "", "éééééééééé", "ééééééééé", " padded line here", "PADDED line"]
    pool += ["  Line number 3 OF the pool\t", "line number 4 of the pool\r", "\x0bLine number 5 of the pool\x0c", "All documents have this line", "\x1cnot a space 123"]
    rows = []
    for i in range(n):
        text = "\n".join(rnd.choice([*pool, f"only here {i} {rnd.random()}"]) for _ in range(rnd.randint(1, 12)))
        rows.append((i, text + "\nAll documents have this line" * (i % 3 > 0), "x", 5))
    rows += [(500, None, None, 1), (501, "", "y", 1), (502, "\n\n", None, 1), (None, pool[1] + "\nnobody but the nameless", "z", 1), (None, "nobody but the nameless", "z", 1), (7, rows[7][1], "again", 2), (7, "another row of document seven\n" + pool[2], "again", 2)]
    rows += [(503, pool[0] + "\n" + "\n".join(f"long text {i}" for i in range(120_000)) + "\n" + pool[0], "w", 1), (504, "long text 119999\nlong text 5", "w", 1)]
    rnd.shuffle(rows)
    return rows


def test_deduplicate(spark):
    rows = made()
    got = lines.deduplicate_lines(spark.createDataFrame(rows, SCHEMA).repartition(6)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    assert sum(r.n_dropped for r in got) > 100


def test_empty(spark):
    assert lines.deduplicate_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def state(index):
    return sorted(map(tuple, index.counts().collect())), sorted(map(tuple, index.holders().collect()))


def in_filters(index):
    """Whether all keys that are held are in the filters, and how many fingerprints those hold."""
    held = {r.shard: lines.CuckooFilter.load(bytes(r.filter)) for r in index.filters.collect()}
    keys = index.counts().collect()
    ok = all(held[r.k1 % index.shards].has(np.array([r.k2], np.int64))[0] for r in keys)
    return ok, sum(map(len, held.values())), len(keys)


def test_inserts_and_deletions_are_reversible(spark):
    rows = [r for r in made(60) if r[0] is None or r[0] < 503]
    make = lambda rs: spark.createDataFrame(rs, SCHEMA)
    first, second = [r for r in rows if (r[0] or 0) % 3], [r for r in rows if not (r[0] or 0) % 3]
    start = lines.LineIndex(spark)
    a = start.insert(make(first))
    both = a.insert(make(second))
    assert state(both) == state(start.insert(make(rows)))
    assert in_filters(both) == (True, len(state(both)[0]), len(state(both)[0]))
    # Taking the second batch out again leaves what the first one had made, in the filters too.
    back = both.delete(make(second))
    assert state(back) == state(a) and in_filters(back) == in_filters(a)
    # Deleting a smallest document hands its lines on to the next one.
    least = make([(i, "", "", 0) for i in range(0, 30)])
    rest = [r for r in rows if r[0] is None or r[0] >= 30]
    less = both.delete(least).compact()
    assert state(less) == state(start.insert(make(rest)))
    assert sorted(map(tuple, less.deduplicate(make(rest)).collect()), key=str) == brute(rest)
    # A document that comes again takes its own place; one that is unknown can be deleted without effect.
    again = [(r[0], "A new line of the document\n" + (r[1] or ""), "x", 1) for r in rest[:9]]
    ids = {r[0] for r in again}
    now = [r for r in rest if r[0] not in ids] + again
    assert state(less.insert(make(again))) == state(start.insert(make(now)))
    assert state(less.delete(make([(99_999, "", "", 0)]))) == state(less)


@pytest.mark.parametrize("n", [1, 50, 9000])
def test_filter(n):
    rnd = np.random.default_rng(n)
    keys, others = (rnd.integers(-(1 << 63), 1 << 63, n, dtype=np.int64) for _ in range(2))
    f = lines.CuckooFilter.sized(n)
    f.insert(keys)
    f.insert(keys[: n // 2])
    f = lines.CuckooFilter.load(f.dump())
    assert f.has(keys).all() and len(f) == n + n // 2
    assert f.has(others).mean() < 0.01 or n < 1000
    f.delete(keys[: n // 2])
    assert f.has(keys).all() and len(f) == n
    f.delete(keys)
    assert len(f) == 0 and not f.has(keys).any()


def test_filter_beyond_its_size_keeps_a_stash():
    rnd = np.random.default_rng(1)
    keys = rnd.integers(-(1 << 63), 1 << 63, 400, dtype=np.int64)
    f = lines.CuckooFilter(64)
    f.insert(keys)
    assert len(f.stash) and f.has(keys).all()
    f = lines.CuckooFilter.load(f.dump())
    f.delete(keys)
    assert len(f) == 0


def test_filters_grow(spark, monkeypatch):
    monkeypatch.setattr(lines, "SHARD_KEYS", 8)
    make = lambda a, b: spark.createDataFrame([(i, f"some line of number {i}", "", 0) for i in range(a, b)], SCHEMA)
    index = lines.LineIndex(spark).insert(make(0, 40)).insert(make(20, 900))
    assert in_filters(index) == (True, 900, 900)
