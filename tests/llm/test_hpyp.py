import re
from collections import Counter

import numpy as np
import pytest

from foldsmith.llm import hpyp


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def marked(df):
    return df.withColumn("train", ~hpyp.held_out())


def test_base_and_counts_against_brute_force(spark, odd):
    df = marked(odd)
    rows = df.select("doc_id", "text", "train").collect()
    c = Counter(t for r in rows if r.train for t in tokens(r.text))
    n, v = sum(c.values()), len(c)
    want = sorted((str(r.doc_id), len(tokens(r.text)), sum(c[t] > 0 for t in tokens(r.text)), n, round(sum(np.log10((c[t] + 1) / (n + v + 1)) for t in tokens(r.text)), 6)) for r in rows)
    got = hpyp.score(df).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and abs(r.perplexity - 10 ** (-r.score / r.n_tokens)) < 1e-6 * r.perplexity for r in got)


def test_predictive_sums_to_one(spark):
    """P(w | u) over all known words, the end and the unknown word, from scores of short texts."""
    vocab = ["a", "b", "c", "d"]
    rows = [(i, t, True) for i, t in enumerate(["a b a b c", "b c a", "c c a b", "d a"] * 3)]
    probe = [(1000 + 10 * i + j, f"{u} {w}", False) for i, u in enumerate([*vocab, "zzz"]) for j, w in enumerate([*vocab, "zzz"])]
    probe += [(2000 + j, w, False) for j, w in enumerate([*vocab, "zzz"])] + [(3000 + i, f"{u} {u}", False) for i, u in enumerate(vocab)] + [(4000, "", False)]
    s = {r.doc_id: 10**r.score for r in hpyp.score(spark.createDataFrame(rows + probe, "doc_id long, text string, train boolean")).collect()}
    # With a(u) = P(u | start), e(u) = P(end | u), q = P(w | u): texts give a(u) e(u) and a(u) q e(w), so
    # q(u, u) = s(u u) / s(u), and P(w | u) / P(w | start) follows up to a(u); the sums over w then give a(u).
    for i, u in enumerate(vocab):
        ratio = sum(s[1000 + 10 * i + j] / s[2000 + j] * x for j, x in enumerate(start_probabilities(s, vocab)))
        a = start_probabilities(s, vocab)[i]
        assert ratio / a + s[2000 + i] / a == pytest.approx(1, abs=1e-4)


def start_probabilities(s, vocab):
    """a(w) = P(w | start), from q(w, w) = s(w w) / s(w) and the sums to 1, by least squares over all contexts."""
    n = len(vocab) + 1
    # Unknown: a(w), w in vocab and zzz. For each known u: sum_w s(u w)/s(w) a(w) + s(u) = a(u).  And sum_w a(w) + s("") = 1.
    rows, right = [], []
    for i in range(n):  # the unknown word is a context too, so there is one equation more than unknowns
        row = np.array([s[1000 + 10 * i + j] / s[2000 + j] for j in range(n)])
        row[i] -= 1
        rows.append(row)
        right.append(-s[2000 + i])
    rows.append(np.ones(n))
    right.append(1 - s[4000])
    got = np.linalg.lstsq(np.array(rows), np.array(right), rcond=None)
    assert np.abs(np.array(rows) @ got[0] - right).max() < 1e-4 and (got[0] > 0).all()
    return got[0]


def test_better_than_the_base_on_texts_held_out(spark):
    rnd = np.random.default_rng(2)
    nouns = [f"n{i}" for i in range(400)]
    rows = []
    for i in range(300):
        words = []
        for _ in range(40):
            a = int(rnd.zipf(1.4)) % 400
            words += [["the", "a", "of"][a % 3], nouns[a]]
        rows.append((i, " ".join(words)))
    got = hpyp.score(marked(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    held = [r for r, h in ((r, __import__("zlib").crc32(str(r.doc_id).encode()) % 7 == 2) for r in got) if h]
    assert len(held) > 20 and sum(r.score for r in held) > 0.9 * sum(r.base_score for r in held)


def seatings(n, d, fresh):
    """Weight of each number of tables, by enumeration of all seatings of n customers."""
    weight = Counter()

    def seat(sizes, left, w):
        if not left:
            weight[len(sizes)] += w
            return
        for i, x in enumerate(sizes):
            seat([*sizes[:i], x + 1, *sizes[i + 1 :]], left - 1, w * (x - d))
        seat([*sizes, 1], left - 1, w * fresh)

    seat([], n, 1.0)
    want = np.array([weight[t] for t in range(1, n + 1)])
    return want / want.sum()


def test_seating_matches_the_exact_posterior_of_tables():
    """Draws of dishes with few customers against enumeration of all seatings."""
    rnd = np.random.default_rng(4)
    for n, d, fresh in [(2, 0.5, 0.8), (4, 0.5, 0.8), (6, 0.8, 0.1), (7, 0.2, 3.0)]:
        want = seatings(n, d, fresh)
        mean, t = hpyp.draw_tables(np.full(40000, n), np.full(40000, fresh), d, rnd)
        assert np.abs(np.bincount(t, minlength=n + 1)[1:] / 40000 - want).max() < 0.01
        assert mean == pytest.approx(want @ np.arange(1, n + 1))


def test_dishes_of_thousands_of_customers():
    """Beyond the table of Stirling numbers, against their recursion."""
    rnd = np.random.default_rng(5)
    for d in (0.3, 0.8):
        table = hpyp.log_stirling(d, 3000)
        for c in (hpyp.EXACT + 1, 3000):
            for y in (1e-3, 0.5, 40.0, 900.0):
                t = np.arange(1, c + 1)
                w = table[c, 1 : c + 1] + t * np.log(y)
                w = np.exp(w - w.max())
                want = w @ t / w.sum()
                sd = np.sqrt(w @ (t - want) ** 2 / w.sum())
                mean, drawn = hpyp.draw_tables(np.full(3000, c), np.full(3000, y), d, rnd)
                assert mean[0] == pytest.approx(want, rel=0.04) and drawn.mean() == pytest.approx(want, rel=0.05)
                assert drawn.std() == pytest.approx(sd, rel=0.15, abs=0.1) and drawn.min() >= 1 and drawn.max() <= c


class Restaurants:
    """One customer at a time in plain Python: {context: {word: table sizes}}, None the root."""

    def __init__(self, pairs, d, d0, base, rnd):
        self.d, self.base, self.rnd, self.pairs = {1: d, 0: d0}, base, rnd, pairs
        self.seats, self.c, self.t = {}, Counter(), Counter()
        for u, w in pairs:
            self.add((u,), w)

    def p(self, u, w):
        d, up = self.d[u is not None], self.p(None, w) if u is not None else self.base
        own = self.seats.get(u, {}).get(w, [])
        return (sum(own) - d * len(own) + (1 + d * self.t[u]) * up) / (1 + self.c[u])

    def add(self, u, w):
        d, up = self.d[u is not None], self.p(None, w) if u is not None else self.base
        own = self.seats.setdefault(u, {}).setdefault(w, [])
        weight = [x - d for x in own] + [(1 + d * self.t[u]) * up]
        i = self.rnd.choices(range(len(weight)), weight)[0]
        self.c[u] += 1
        if i < len(own):
            own[i] += 1
            return
        own.append(1)
        self.t[u] += 1
        if u is not None:
            self.add(None, w)

    def remove(self, u, w):
        own = self.seats[u][w]
        i = self.rnd.choices(range(len(own)), own)[0]
        self.c[u] -= 1
        own[i] -= 1
        if not own[i]:
            own.pop(i)
            self.t[u] -= 1
            if u is not None:
                self.remove(None, w)

    def sweep(self):
        for u, w in self.pairs:
            self.remove((u,), w)
            self.add((u,), w)


def small_corpus():
    rnd = np.random.default_rng(8)
    follow = {i: rnd.zipf(1.6, 12) % 60 for i in range(60)}
    rows = []
    for i in range(70):
        w = int(rnd.integers(60))
        words = []
        for _ in range(30):
            words.append(f"w{w}")
            w = int(rnd.choice(follow[w])) if rnd.random() < 0.7 else int(rnd.zipf(1.5) % 60)
        rows.append((i, " ".join(words), i % 7 > 0))
    return rows


def test_scores_match_a_sampler_of_single_customers(spark):
    rows = small_corpus()
    pairs = [(u, w) for _, t, train in rows if train for u, w in zip([None, *tokens(t)[:-1]], tokens(t))]
    n = Counter(Counter(pairs).values())
    d = min(max(n[1] / (n[1] + 2 * n[2]), 0.1), 0.95)
    m = Counter(Counter(w for _, w in set(pairs)).values())
    d0 = min(max(m[1] / max(m[1] + 2 * m[2], 1), 0.1), 0.95)
    words = {w for _, w in pairs}
    import random

    r = Restaurants(pairs, d, d0, 1 / (len(words) + 1), random.Random(3))
    total, tables = Counter(), 0
    for k in range(60):
        r.sweep()
        if k >= 20:
            tables += sum(r.t[u] for u in r.t if u is not None) / 40
            for i, t, _ in rows:
                for j, (u, w) in enumerate(zip([None, *tokens(t)[:-1]], tokens(t))):
                    total[i, j] += r.p((u,), w) / 40
    want = Counter()
    for (i, _), p in total.items():
        want[i] += np.log10(p)
    df = spark.createDataFrame(rows, "doc_id long, text string, train boolean")
    for bucket_tokens in (hpyp.BUCKET, 300):
        got = {x.doc_id: x for x in hpyp.score(df, bucket_tokens=bucket_tokens, passes=6).collect()}
        off = [(got[i].score - want[i]) / got[i].n_tokens for i in want]
        assert max(map(abs, off)) < 0.04 and abs(np.mean(off)) < 0.01, bucket_tokens
    drawn = hpyp.Contexts(*bucket_of(pairs))
    word_p = np.array([r.p(None, w) for w in drawn.names])
    mean, _ = drawn.sweeps(word_p[drawn.words], d, np.random.default_rng(1), 60, 40)
    assert mean.sum() + (drawn.c == 1).sum() == pytest.approx(tables, rel=0.04)


def bucket_of(pairs):
    """The packed contexts of pairs in one bucket; the words' names in order of their numbers go with the class."""
    names = sorted({x for p in pairs for x in p}, key=str)
    number = {x: i for i, x in enumerate(names)}
    hpyp.Contexts.names = names
    count = Counter((number[u], number[w]) for u, w in pairs)
    key = sorted(count)
    u, k = np.unique([a for a, _ in key], return_counts=True)
    own = np.array([a for a, _ in key])
    w = hpyp._steps(np.array([b for _, b in key], np.uint32), own)
    return hpyp.pack(hpyp._steps(u.astype(np.uint32)), k.astype(np.uint32), np.ones(len(u), np.uint32), w, np.array([count[x] for x in key])), 1


def test_contexts_in_several_buckets(spark):
    """A context that is dealt to several buckets scores as a whole one does, but for chance."""
    df = spark.createDataFrame(small_corpus(), "doc_id long, text string, train boolean")
    want = {x.doc_id: x for x in hpyp.score(df).collect()}
    got = {x.doc_id: x for x in hpyp.score(df, bucket_tokens=300, hot=40).collect()}
    for i, x in want.items():
        assert (got[i].n_known, got[i].train_tokens) == (x.n_known, x.train_tokens)
        assert got[i].base_score == pytest.approx(x.base_score) and abs(got[i].score - x.score) < 0.06 * x.n_tokens


def test_repeated_texts_score_apart(spark):
    """Texts that occur twice in training have clearly less perplexity than those that occur once."""
    rnd = np.random.default_rng(9)
    vocab = [f"v{i}" for i in range(3000)]
    texts = [" ".join(vocab[int(x) % 3000] for x in rnd.zipf(1.3, 80)) for _ in range(120)]
    rows = [(i, t, True) for i, t in enumerate(texts + texts[:12])]
    got = {x.doc_id: x.perplexity for x in hpyp.score(spark.createDataFrame(rows, "doc_id long, text string, train boolean")).collect()}
    once = sorted(got[i] for i in range(12, 120))
    assert sum(got[i] < once[10] for i in range(12)) >= 11


def test_packed_arrays():
    x = np.array([3, 9, 1 << 40, 7], np.int64)
    y = np.array([0.5, -2], np.float32)
    a, b, c = hpyp.unpack(hpyp.pack(x, y, x[:0]), np.int64, np.float32, np.int64)
    assert (a == x).all() and (b == y).all() and len(c) == 0
    w, group = np.array([4, 9, 2, 2, 8], np.uint32), np.array([0, 0, 5, 6, 6])
    assert hpyp._sums(hpyp._steps(w, group), np.array([2, 0, 1, 2])).tolist() == w.tolist()


def test_empty(spark, empty, odd):
    assert hpyp.score(marked(empty)).collect() == []
    none = hpyp.score(odd.selectExpr("*", "false AS train")).collect()
    assert len(none) == odd.count() and all(r.score == pytest.approx(0) and r.base_score == 0 and r.n_known == 0 for r in none)
