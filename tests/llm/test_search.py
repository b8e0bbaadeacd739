"""Ranked search against dictionaries of all terms."""

import math
import random
import re
from collections import Counter

import pytest

from foldsmith.llm import search

DOCS, ITEMS = "doc_id long, text string, item_id string, Score long", "item_id long, text string, doc_id string, rank int"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]


def brute(docs, items, k=20):
    said = [(d, Counter(terms(t)), len(terms(t))) for d, t, *_ in docs]
    n, total = sum(size > 0 for *_, size in said), sum(size for *_, size in said)
    df = Counter(t for _, c, _ in said for t in c)
    out = []
    for item, text, *_ in items:
        scores, asked = [], Counter(terms(text))
        for doc, c, size in said:
            m = 75 + 25 * size * n // max(1, total)
            s = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t, times in asked.items() if c[t])
            if s > 0:
                scores.append((-s, doc is None, doc or 0, doc))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def made(seed=4, n=300):
    rnd = random.Random(seed)
    words = ["the", "The", "été", "Élan", "a1", "x", *(f"w{i}" for i in range(120))]
    pick = lambda m: rnd.choice([" ", "\n", "-", ", "]).join(words[min(int(rnd.expovariate(0.05)), len(words) - 1)] for _ in range(m))
    docs = [(i, pick(rnd.randint(1, 80)), "x", 3) for i in range(n)]
    docs += [(1000 + i, docs[7][1], "copy", 1) for i in range(40)] + [(2000, None, "", 1), (2001, "", "", 1), (2002, "?! .\t", "", 1), (None, docs[7][1], "", 1), (None, "w100 w101", "", 1), (5, docs[5][1], "again", 1), (2003, "long " * 300_000 + "w119 " + "y" * 3_000_000, "", 1)]
    items = [(i, pick(rnd.randint(1, 30)), "x", 1) for i in range(40)] + [(900, docs[7][1], "", 1), (901, None, "", 1), (902, "", "", 1), (903, "nowhere", "", 1), (None, "w100 the", "", 1), (3, "w3 W3 w3", "", 1), (904, "y" * 3_000_000 + " long", "", 1)]
    rnd.shuffle(docs)
    return docs, items


@pytest.mark.parametrize("block,bundle", [(4096, 256), (16, 7)])
def test_rank(spark, monkeypatch, block, bundle):
    monkeypatch.setattr(search, "BLOCK", block)
    monkeypatch.setattr(search, "BUNDLE", bundle)
    docs, items = made()
    got = search.rank_documents(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS)).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, items)


def test_empty(spark):
    docs, items = (spark.createDataFrame(x[:3], s) for x, s in zip(made(), (DOCS, ITEMS)))
    assert search.rank_documents(docs.limit(0), items).count() == 0
    assert search.rank_documents(docs, items.limit(0)).count() == 0


def test_windows_cut_no_term(monkeypatch):
    text = made()[0][3][1] * 5
    for window in (1, 7, 64):
        monkeypatch.setattr(search, "WINDOW", window)
        assert search.term_counts(text.encode()) == Counter(t.encode() for t in terms(text))
