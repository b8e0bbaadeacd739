"""Linear-chain conditional random field over words, in NumPy, for use inside tasks.

A word's emission is the sum of weights of its hashed features: byte n-grams of the word with its
two ends marked (those at an end are its affixes) and the word itself (the lexicon). Labels follow
each other with learned transitions. A document is cut into chains of `CHAIN` words, and all chains
of a slice of documents go through forward-backward side by side. The messages across the cuts come first,
from the products of the chains' transfer matrices, so the marginals are those of the whole document.

Texts are bytes; bytes that are no UTF-8 count as characters that are no letters.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from foldsmith.llm._kept import Codes, kept

CHAIN, GRAMS, BITS = 64, 4, 18
_P = np.uint64(0x9E3779B97F4A7C15)


def word_features(words: list[bytes], grams: int = GRAMS, bits: int = BITS) -> tuple[list[np.ndarray], np.ndarray]:
    """(bucket of each n-gram at each byte, one array for each n and one for whole words; the words' first bytes).

    Bucket 2**bits stands for none: an n-gram that would leave its word.
    """
    buf = np.frombuffer(b"\x02" + b"\x03\x02".join(words) + b"\x03", np.uint8).astype(np.uint64)
    size = np.array([len(w) + 2 for w in words], np.int64)
    start = np.cumsum(size) - size
    left = np.repeat(start + size, size) - np.arange(len(buf))  # bytes to the word's end
    out, h = [], np.zeros(len(buf), np.uint64)
    for n in range(1, grams + 1):
        h = h * np.uint64(0x100000001B3) + np.append(buf[n - 1 :], np.zeros(n - 1, np.uint64)) + np.uint64(n)
        mixed = ((h ^ (h >> np.uint64(29))) * _P) >> np.uint64(64 - bits)
        if n > 1:
            out.append(np.where(left >= n, mixed, np.uint64(1 << bits)).astype(np.int64))
    power = np.cumprod(np.append(np.uint64(1), np.full(int(size.max()) - 1, 0xD6E8FEB86659FD93, np.uint64)))
    whole = np.add.reduceat(buf * power[np.arange(len(buf)) - np.repeat(start, size)], start)
    whole = ((whole ^ (whole >> np.uint64(31))) * _P) >> np.uint64(64 - bits)
    lexicon = np.full(len(buf), 1 << bits, np.int64)
    lexicon[start] = whole.astype(np.int64)
    return [*out, lexicon], start


@dataclass
class Model:
    """Weights of features (one row more for none) and of transitions, by label."""

    weights: np.ndarray
    trans: np.ndarray
    labels: list

    def emissions(self, words: list[bytes]) -> np.ndarray:
        """Score of each label for each word."""
        out, bits = np.empty((len(words), len(self.labels)), np.float32), (len(self.weights) - 1).bit_length() - 1
        for at in range(0, len(words), 20_000):
            feats, start = word_features(words[at : at + 20_000], bits=bits)
            out[at : at + 20_000] = sum(np.add.reduceat(self.weights[f], start, axis=0) for f in feats)
        return out


def chains(sizes: np.ndarray, chain: int = CHAIN) -> np.ndarray:
    """Token numbers by chain and place, -1 for none; sizes: tokens of each document."""
    doc = chain_documents(sizes, chain)
    n = -(-sizes // chain)
    first = (np.cumsum(sizes) - sizes)[doc] + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * chain
    end = np.cumsum(sizes)[doc]
    at = first[:, None] + np.arange(chain)
    return np.where(at < end[:, None], at, -1)


def chain_documents(sizes: np.ndarray, chain: int = CHAIN) -> np.ndarray:
    """The document of each chain, ascending."""
    return np.repeat(np.arange(len(sizes)), -(-sizes // chain))


def _messages(p: np.ndarray, a: np.ndarray, there: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(chains that go on from another, forward message into each chain, backward message into its end).

    A chain's transfer matrix leads from the label before it (its own first one in a document's first chain) to its last.
    """
    length, n, k = p.shape
    goes_on = np.append(False, doc[1:] == doc[:-1])
    before, after = np.ones((n, k), np.float32), np.ones((n, k), np.float32)
    some = np.flatnonzero(goes_on | np.append(goes_on[1:], False))
    if not len(some):
        return goes_on, before, after
    m = np.where(goes_on[some][:, None, None], a, np.eye(k, dtype=np.float32)) * p[0, some][:, None, :]
    for t in range(1, length):
        m = np.where(there[t, some][:, :, None], (m @ a) * p[t, some][:, None, :], m)
        m /= m.max(axis=(1, 2), keepdims=True)
    at = np.arange(len(some))
    nth = at - np.maximum.accumulate(np.where(goes_on[some], 0, at))
    ranks = np.split(np.argsort(nth, kind="stable"), np.cumsum(np.bincount(nth))[:-1])
    end = m.sum(axis=1)  # right for first chains
    for r in ranks[1:]:
        before[some[r]] = end[r - 1] / end[r - 1].sum(axis=1, keepdims=True)
        end[r] = (before[some[r]][:, None, :] @ m[r])[:, 0]
    for r in ranks[:0:-1]:
        y = (m[r] @ after[some[r]][:, :, None])[:, :, 0]
        after[some[r - 1]] = y / y.sum(axis=1, keepdims=True)
    return goes_on, before, after


def marginals(emit: np.ndarray, trans: np.ndarray, at: np.ndarray, doc: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(label probabilities by token of `emit`; sums of pair probabilities): forward-backward over all chains.

    doc: the document of each chain, ascending; without it every chain stands alone.
    """
    n, length = at.shape
    k = emit.shape[1]
    a = np.exp(trans).astype(np.float32)
    p = np.exp(emit - emit.max(axis=1, keepdims=True)) if len(emit) else emit
    p = np.concatenate([p, np.ones((1, k), p.dtype)])[at.T].astype(np.float32)  # place, chain, label
    there = (at.T >= 0)[:, :, None]
    goes_on, before, back = _messages(p, a, there, np.arange(n) if doc is None else doc)
    fwd = np.empty((length, n, k), np.float32)
    fwd[0] = np.where(goes_on[:, None], before @ a, 1) * p[0]
    fwd[0] /= fwd[0].sum(axis=1, keepdims=True)
    for t in range(1, length):
        x = (fwd[t - 1] @ a) * p[t]
        fwd[t] = x / x.sum(axis=1, keepdims=True)
    pairs = np.zeros((k, k))
    out = np.zeros((len(emit) + 1, k), np.float32)
    for t in range(length - 1, -1, -1):
        x = fwd[t] * back
        x /= x.sum(axis=1, keepdims=True)
        out[at[:, t]] = x
        on = p[t] * back
        last, linked = (fwd[t - 1], there[t]) if t else (before, goes_on[:, None])
        both = last.T @ np.where(linked, on / np.maximum(((last @ a) * on).sum(axis=1, keepdims=True), 1e-30), 0)
        pairs += both * a
        if t:
            y = on @ a.T
            back = np.where(there[t], y / y.sum(axis=1, keepdims=True), back).astype(np.float32)
    return out[:-1], pairs


def train(docs: list[tuple[list[bytes], np.ndarray]], labels: list, epochs: int = 4, rate: float = 0.3, seed: int = 11, l2: float = 1e-6) -> Model:
    """Fit by AdaGrad on the log-likelihood of (words, label number of each word) sequences.

    Beyond 64 labels the features share fewer buckets, so a model keeps its size.
    """
    k, rnd = len(labels), np.random.default_rng(seed)
    bits = max(10, BITS - max(0, (k - 1).bit_length() - 6))
    size = (1 << bits) + 1
    w, wg = np.zeros((size, k), np.float32), np.full((size, k), 1e-3, np.float32)
    tr, tg = np.zeros((k, k), np.float32), np.full((k, k), 1e-3, np.float32)
    runs = [(words, y) for words, y in docs if words]
    for _ in range(epochs):
        order = rnd.permutation(len(runs))
        for lo in range(0, len(order), 128):
            batch = [runs[i] for i in order[lo : lo + 128]]
            own: dict = {}
            code = np.array([own.setdefault(x, len(own)) for words, _ in batch for x in words])
            feats, start = word_features(list(own), bits=bits)
            emit = sum(np.add.reduceat(w[f], start, axis=0) for f in feats)[code]
            sizes = np.array([len(words) for words, _ in batch])
            gold = np.concatenate([y for _, y in batch])
            got, pairs = marginals(emit, tr, chains(sizes), chain_documents(sizes))
            miss = -got
            miss[np.arange(len(gold)), gold] += 1
            grad = np.zeros((len(own), k), np.float32)
            np.add.at(grad, code, miss)
            spread = np.repeat(grad, np.diff(np.append(start, len(feats[0]))), axis=0)
            for f in feats:
                used, inv = np.unique(f, return_inverse=True)
                g = np.stack([np.bincount(inv, spread[:, j], len(used)) for j in range(k)], axis=1) - l2 * w[used]
                g[used == size - 1] = 0
                wg[used] += g * g
                w[used] += (rate / len(feats)) * g / np.sqrt(wg[used])
            seen = np.zeros((k, k))
            for _, y in batch:
                np.add.at(seen, (y[:-1], y[1:]), 1)
            g = seen - pairs
            tg += g * g
            tr += 0.1 * g / np.sqrt(tg)
    return Model(w, tr, labels)


def runs(words: list[bytes], marks: np.ndarray | None = None, size: int = 4 * CHAIN):
    """(words, their marks) of the runs of `size` words that a text is cut into: the rows that a CRF is trained on."""
    for i in range(0, len(words), size):
        yield words[i : i + size], None if marks is None else marks[i : i + size]


class Tagger:
    """Label probabilities of the words of many texts; emissions of words met are kept, up to `limit`.

    Texts without a word have no rows. letters_only: words without a letter are left out, and those around them are neighbours.
    """

    def __init__(self, model: Model, letters_only: bool = False, limit: int = 300_000):
        self.model, self.letters, self.limit = model, letters_only, limit
        self.reset()

    def reset(self):
        self.codes = Codes()
        self.emit, self.used = np.empty((1 << 12, len(self.model.labels)), np.float32), np.empty(1 << 12, bool)

    def tag(self, words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document of each tagged word, place of the word in its document, probabilities)."""
        if len(self.codes) > self.limit:
            self.reset()
        sizes = np.array([len(w) for w in words], np.int64)
        get, total = self.codes.__getitem__, len(self.codes)
        code = np.fromiter((c for w in words for c in map(get, w)), np.int64, int(sizes.sum()))
        new, self.codes.new = self.codes.new, []
        if new:
            while len(self.emit) < len(self.codes):
                self.emit, self.used = np.concatenate([self.emit] * 2), np.concatenate([self.used] * 2)
            self.emit[total : len(self.codes)] = self.model.emissions(new)
            self.used[total : len(self.codes)] = [has_letter(w) for w in new] if self.letters else True
        doc = np.repeat(np.arange(len(words)), sizes)
        keep = np.flatnonzero(self.used[code])
        doc, place = doc[keep], keep - (np.cumsum(sizes) - sizes)[doc[keep]]
        left = np.bincount(doc, minlength=len(words))
        if not len(keep):
            return doc, place, np.empty((0, len(self.model.labels)), np.float32)
        return doc, place, marginals(self.emit[code[keep]], self.model.trans, chains(left), chain_documents(left))[0]


def has_letter(word: bytes) -> bool:
    return word.isalpha() or any(map(str.isalpha, word.decode("utf-8", "replace")))


def tagger(key: str, model: Model, letters_only: bool = False) -> Tagger:
    """The worker's tagger of a model; later tasks of the worker go on with its kept words."""
    return kept(("crf", key), lambda: Tagger(model, letters_only))
