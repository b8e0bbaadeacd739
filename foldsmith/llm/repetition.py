"""Quality rules on repetition inside a document, by suffix arrays.

The words of many documents are laid end to end. Only suffixes that begin with a window of
`min_words` words that occurs again in the same document can take part in a repeat of that length, so
the suffix array is built over those alone: prefix doubling from the window's rank, keeping the ranks
of every level. Neighbours' longest common prefixes come from the levels; of more than SCAN suffixes, whose levels would
take too much memory, they come from a scan in the order of the text (Kasai's). A suffix's deepest LCP
interval gives its longest repeat; the union of these spans is the union of all maximal repeated
substrings of `min_words` words or more.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldsmith.llm._text import binary_text, record, text_slices

#: Suffixes from which on longest common prefixes are found without the ranks of every level; bytes of a long text that are split at a time.
SCAN, PART = 1 << 19, 4 << 20
SYMBOLS = b"#*$%&|<>"
SPACE_OR_TAIL = b" \t\n\r\x0b\x0c" + bytes(range(0x80, 0xC0))


def repeat_spans(ids: np.ndarray, doc: np.ndarray, min_words: int, scan: int = SCAN) -> tuple[np.ndarray, np.ndarray]:
    """(positions, lengths): the longest repeat that begins at each position, where it has min_words or more.

    ids: word ids of all documents, laid end to end; doc: the document of each word, ascending.
    """
    n = len(ids)
    none = np.empty(0, np.int64), np.empty(0, np.int64)
    if n < min_words:
        return none
    m = n - min_words + 1
    rng = np.random.default_rng(7)
    odd = rng.integers(1, 1 << 63, min_words + 1, np.uint64) | np.uint64(1)
    key = doc[:m].astype(np.uint64) * odd[-1]
    for j in range(min_words):
        key += ids[j : j + m].astype(np.uint64) * odd[j]
    inside = doc[:m] == doc[min_words - 1 :]
    # Candidates: windows whose key occurs again.
    ranked = np.sort(key[inside])
    twice = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
    del ranked
    if not len(twice):
        return none
    at = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
    pos = np.flatnonzero((twice[at] == key) & inside)
    del key, at, inside, twice
    # Prefix doubling compares a suffix with what follows its first h words; both begin in one of these places.
    pos = np.union1d(pos, np.minimum(pos + min_words, n - 1))
    by, same = _by_window(ids, doc, pos, min_words)
    order = by  # places in pos by their suffixes
    start = np.maximum.accumulate(np.where(np.append(True, ~same), np.arange(len(order)), 0))
    # rank[i]: of the first h words of the suffix at pos[i] among all places; equal where those words are. The last entry stands for no place.
    rank = np.full(len(pos) + 1, -1, np.int32)
    rank[order] = start
    levels, h, tied = [(min_words, rank)], min_words, np.append(same, False) | np.append(False, same)
    del by, same, start
    keep_levels = len(pos) <= scan
    while tied.any():
        place = np.flatnonzero(tied)
        live = order[place]
        first, ahead = rank[live].astype(np.int64), rank[_place(pos, pos[live] + h)]
        ahead[doc[np.minimum(pos[live] + h, n - 1)] != doc[pos[live]]] = -1  # the text ends there, as in a window
        by = np.argsort(first << 32 | ahead + 1, kind="stable")
        live, first, ahead = live[by], first[by], ahead[by]
        equal = (first[1:] == first[:-1]) & (ahead[1:] == ahead[:-1])
        order[place] = live  # groups stay in place, as `first` ascends with it
        if keep_levels:
            rank = rank.copy()
        rank[live] = np.maximum.accumulate(np.where(np.append(True, ~equal), place, 0))
        tied = np.zeros(len(order), bool)
        tied[place] = np.append(equal, False) | np.append(False, equal)
        h *= 2
        if tied.any() and keep_levels:
            levels.append((h, rank))
    if keep_levels:
        lcp = _lcp_by_levels(ids, doc, pos, order, levels, min_words)
    else:
        del levels, rank, tied
        lcp = _lcp_by_scan(ids, doc, pos[order], min_words)
    deepest = np.maximum(np.append(lcp, 0), np.append(0, lcp))
    keep = deepest >= min_words
    return pos[order][keep], deepest[keep]


def _place(pos: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Index in pos of positions, len(pos) for those that are not in it."""
    i = np.minimum(np.searchsorted(pos, at), len(pos) - 1)
    return np.where(pos[i] == at, i, len(pos))


def _by_window(ids: np.ndarray, doc: np.ndarray, pos: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of pos by document and the first words there, where a place and the next one have all of them equal)."""
    n = len(ids)
    word = []
    for j in range(min_words):
        q = np.minimum(pos + j, n - 1)
        word.append(np.where((doc[q] == doc[pos]) & (pos + j < n), ids[q], -1 - q))
    by = np.lexsort((*word[::-1], doc[pos]))
    order = pos[by]
    same = (doc[order][1:] == doc[order][:-1]) & np.all([w[by][1:] == w[by][:-1] for w in word], axis=0)
    same &= order[1:] + min_words <= n
    same &= order[:-1] + min_words <= n
    return by, same


def _lcp_by_levels(ids, doc, pos, order, levels, min_words: int) -> np.ndarray:
    """Common words of neighbouring suffixes, from the highest level down."""
    n, own = len(ids), doc[pos[order[:-1]]]
    a, b = pos[order[:-1]].copy(), pos[order[1:]].copy()
    lcp = np.zeros(len(a), np.int64)
    for h, rank in reversed(levels):
        x, y = rank[_place(pos, a)], rank[_place(pos, b)]
        more = (x == y) & (x >= 0)
        for z in (lcp, a, b):
            z[more] += h
    for _ in range(min_words - 1):  # what is shorter than a window
        ok = (np.maximum(a, b) < n) & (lcp > 0)
        ok[ok] = (ids[a[ok]] == ids[b[ok]]) & (doc[a[ok]] == doc[b[ok]]) & (doc[a[ok]] == own[ok])
        for z in (lcp, a, b):
            z[ok] += 1
    return lcp


def _lcp_by_scan(ids: np.ndarray, doc: np.ndarray, order: np.ndarray, min_words: int) -> np.ndarray:
    """Common words of neighbouring suffixes: one that begins a word later than the last has one less at least, if that is a window or more."""
    n, lcp = len(ids), np.zeros(len(order) - 1, np.int64)
    ends = np.searchsorted(doc, doc, "right")  # of the document of each word
    rank = np.argsort(order, kind="stable")  # of the suffixes in the order of the text
    place = order[rank]
    before = np.where(rank > 0, order[rank - 1], -1)
    word, end, h, last = memoryview(np.ascontiguousarray(ids)), memoryview(ends), 0, -2
    for lo in range(0, len(place), 1 << 16):
        own = slice(lo, lo + (1 << 16))
        for p, q, r in zip(place[own].tolist(), before[own].tolist(), rank[own].tolist()):
            h = h - 1 if p == last + 1 and h > min_words else 0
            last = p
            if q < 0 or end[p] != end[q]:
                h = 0
                continue
            most = min(end[p] - p, end[q] - q)
            while h < most and word[p + h] == word[q + h]:
                h += 1
            lcp[r - 1] = h
    return lcp


def _word_ids(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word ids of all texts laid end to end, words of each); a long text is split in parts, so its words are not all held."""
    vocab: dict = defaultdict(count().__next__)
    get, out, sizes = vocab.__getitem__, [], []
    for t in texts:
        n, at = 0, 0
        while at < len(t):
            cut = t.find(b" ", at + PART) if len(t) - at > PART else -1
            words = t[at : cut if cut >= 0 else len(t)].split()
            out.append(np.fromiter(map(get, words), np.int32, len(words)))
            n += len(words)
            at = cut if cut >= 0 else len(t)
        sizes.append(n)
    return np.concatenate([np.empty(0, np.int32), *out]), np.array(sizes, np.int64)


def _per_doc(texts: list[bytes], min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, covered words, longest repeat) of each document."""
    ids, sizes = _word_ids(texts)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    pos, length = repeat_spans(ids, doc, min_words)
    covered, longest = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    if len(pos):
        edge = np.zeros(len(ids) + 1, np.int32)
        np.add.at(edge, pos, 1)
        np.add.at(edge, pos + length, -1)
        covered = np.bincount(doc[np.cumsum(edge)[:-1] > 0], minlength=len(texts))
        np.maximum.at(longest, doc[pos], length)
    return sizes, covered, longest


def _stats(texts: list[bytes], min_words: int) -> list:
    """The columns of COLUMNS for a slice of texts."""
    lines = ([x for x in t.split(b"\n") if x.strip()] for t in texts)
    dup = np.array([len(x) - len(set(x)) for x in lines], np.int64)
    n, covered, longest = _per_doc(texts, min_words)
    return [
        n,
        np.array([len(t.translate(None, SPACE_OR_TAIL)) for t in texts], np.int64),
        np.array([len(t) - len(t.translate(None, SYMBOLS)) for t in texts], np.int64),
        dup,
        covered,
        longest,
    ]


COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, longest_repeat long"


def repetition_stats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = 5) -> DataFrame:
    """Per document: counts of words, their code points, symbols, repeated lines, and repeated words.

    n_repeat_words: words covered by repeated substrings of min_words words or more, first copies
    included; longest_repeat: words of the longest. A null or empty text has zeros. Repeated rows and null ids keep a row each,
    an empty table gives none, other columns are left out. No shuffle.
    """
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    schema = pa.schema([(doc_id, pa.int64()), *((c, pa.int64()) for c in names)])

    def run(batches):
        for piece, texts in text_slices(batches):
            yield record(schema, piece.column(0), *_stats(texts, min_words))

    return binary_text(docs.withColumn(doc_id, F.col(doc_id).cast("long")), doc_id, text).mapInArrow(run, f"{doc_id} long, {COLUMNS}")


def quality_rules(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = 5, max_covered: float = 0.2, max_repeat: int = 100
) -> DataFrame:
    """repetition_stats with the verdicts base_failed and kept.

    kept: not base_failed, repeats cover at most max_covered of the words, and no repeat has more
    than max_repeat words. Every input row gives one row, repeated and null doc_id included; a null
    text counts as empty and fails. An empty table gives an empty result, other columns are ignored.
    """
    s = repetition_stats(docs, doc_id, text, min_words)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    verdict = (F.col("n_repeat_words") <= max_covered * F.col("n_words")) & (F.col("longest_repeat") <= max_repeat)
    return s.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict)


def keep_quality(docs: DataFrame, text: str = "text", min_words: int = 5, max_covered: float = 0.2, max_repeat: int = 100) -> DataFrame:
    """The rows that quality_rules would keep, with all their columns, whatever their names; no shuffle.

    Null, empty and blank texts go, as they have too few words; repeated rows stay or go together, an empty table stays empty.
    """
    at = docs.columns.index(text)

    def run(batches):
        for piece, texts in text_slices(batches, at):
            n, *_, covered, longest = _stats(texts, min_words)
            keep = (n >= 10) & (100 * covered <= 20 * n) & (covered <= max_covered * n) & (longest <= max_repeat)
            yield piece.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
