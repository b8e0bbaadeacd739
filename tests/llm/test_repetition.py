import random
import re

import numpy as np

from foldsmith.llm import repetition


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = {}
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {i + j for v in seen.values() if len(v) > 1 for i in v for j in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)

    def again(k):
        return len({tuple(words[i : i + k]) for i in range(n - k + 1)}) < n - k + 1

    longest, high = 0, n
    while longest < high:  # a repeat of k words has one of k - 1
        mid = (longest + high + 1) // 2
        longest, high = (mid, high) if again(mid) else (longest, mid - 1)
    longest = longest if longest >= 5 else 0
    failed = n < 10 or 100 * len(covered) > 20 * n
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), longest, failed, not failed and longest <= 100)


def test_against_brute_force(odd):
    want = sorted((str(r.doc_id), *brute(r.text)) for r in odd.select("doc_id", "text").collect())
    got = sorted((str(r[0]), *r[1:]) for r in repetition.quality_rules(odd).collect())
    assert got == want


def test_empty(empty):
    assert repetition.quality_rules(empty).collect() == []


def test_longest_repeats_of_random_strings():
    rnd = random.Random(5)
    for _ in range(60):
        docs = [[rnd.randrange(3) for _ in range(rnd.randrange(60))] for _ in range(4)]
        ids = np.array([x for d in docs for x in d], np.int64)
        doc = np.repeat(np.arange(4), [len(d) for d in docs])
        got = dict(zip(*(x.tolist() for x in repetition.repeat_spans(ids, doc, 4))))
        want, base = {}, 0
        for d in docs:
            for i in range(len(d)):
                best = 0
                for j in range(len(d)):
                    k = 0
                    while i != j and max(i, j) + k < len(d) and d[i + k] == d[j + k]:
                        k += 1
                    best = max(best, k)
                if best >= 4:
                    want[base + i] = best
            base += len(d)
        assert got == want
