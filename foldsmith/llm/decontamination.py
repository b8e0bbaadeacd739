"""Benchmark decontamination: BM25 over test items with block-max WAND.

The inverted index holds the test items; every passage of every document is a query. An item's score
is divided by its own threshold, so all items share the threshold 1. The threshold is the least score of a
passage that has `overlap` of the item's shingles: each missing shingle accounts for one missing term
at most, so it is the item's full score less its heaviest terms of that number. Hence no passage
that would be verified is lost. An item of so few distinct words that all of them may be missing by this count
has the lightest of its shingles as its threshold, as a verified passage holds one shingle whole.

Passages are pruned by upper bounds, tightest last, for many passages at once: the sum of the
terms' greatest weights, then the sums of their greatest weights in each block of items, then the
scores of the items in the blocks that are left. What reaches 1 is verified on its shingles.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldsmith.llm._text import binary_text, record, text_slices
from foldsmith.session import materialize

#: Items of one index, and of one block of it. More items make more indexes, each with its own pass.
INDEX_ITEMS, BLOCK_ITEMS = 20_000, 16
K1, B = 1.2, 0.75
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass
class Index:
    """Postings in two levels, as arrays: term -> (block, greatest weight) and (term, block) -> (item, weight)."""

    terms: dict
    item_ids: list
    item_words: list
    answer_at: list
    stride: int
    top: np.ndarray
    block_at: np.ndarray
    block: np.ndarray
    block_top: np.ndarray
    post_at: np.ndarray
    post_item: np.ndarray
    post_weight: np.ndarray
    k: int
    overlap: float


def split_answer(text: str) -> int:
    """Number of words of the question: all but the last sentence, or three quarters of a single sentence."""
    words = text.encode().split()
    ends = [i + 1 for i, w in enumerate(words[:-1]) if w[-1:] in b".?!:"]
    return ends[-1] if ends else max(1, len(words) * 3 // 4)


def shingles_of(words: list[bytes], k: int) -> list[bytes]:
    k = min(k, len(words))
    return [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if k else []


@dataclass
class Collection:
    """Statistics of all items that have a word: their number, mean number of words, and items that hold each word."""

    n: int
    mean: float
    df: dict


def build_index(items: list[tuple[int, str]], collection: Collection, k: int = 5, overlap: float = 0.8) -> Index | None:
    """The index of some (item id, text) pairs of a collection; items without a word are left out."""
    kept = [(i, (t or "").encode().lower().split(), split_answer(t or "")) for i, t in items if (t or "").encode().split()]
    if not kept:
        return None
    n, mean = collection.n, collection.mean
    df = {w: collection.df[w] for _, words, _ in kept for w in words}
    terms = {w: i for i, w in enumerate(sorted(df))}
    rows = []
    for item, (_, words, _) in enumerate(kept):
        tf: dict = {}
        for w in words:
            tf[w] = tf.get(w, 0) + 1
        norm = K1 * (1 - B + B * len(words) / mean)
        weight = {w: np.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * c * (K1 + 1) / (c + norm) for w, c in tf.items()}
        missing = int((1 - overlap) * len(shingles_of(words, k)) + 1e-9)
        heavy = sorted(weight.values(), reverse=True)
        least = sum(heavy[missing:]) or min(sum(weight[w] for w in set(part.split())) for part in shingles_of(words, k))
        threshold = least * (1 - 1e-9)
        rows += [(terms[w], item // BLOCK_ITEMS, item, x / threshold) for w, x in weight.items()]
    rows.sort()
    term, block, item, weight = (np.array(c) for c in zip(*rows))
    new = np.append(True, (term[1:] != term[:-1]) | (block[1:] != block[:-1]))
    at = np.flatnonzero(new)
    block_top = np.maximum.reduceat(weight, at)
    first = np.searchsorted(term[at], np.arange(len(terms) + 1))
    longest = max(len(w) for _, w, _ in kept)
    return Index(
        terms, [i for i, _, _ in kept], [w for _, w, _ in kept], [a for _, _, a in kept], max(16, longest * 5 // 4), np.maximum.reduceat(block_top, first[:-1]),
        first, block[at], block_top, np.append(at, len(rows)), item, weight, k, overlap,
    )


def _expand(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, position) for each position of the ranges [start, end)."""
    size = end - start
    row = np.repeat(np.arange(len(start)), size)
    return row, np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + start[row]


def _sums(a: np.ndarray, b: np.ndarray, width: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sum x by the pairs (a, b), b < width."""
    key, at = np.unique(a * width + b, return_inverse=True)
    return key // width, key % width, np.bincount(at, x, len(key))


def search(ix: Index, words: list[list[bytes]]) -> list[tuple[int, int, float, float, float]]:
    """(text number, item number, score, question overlap, answer overlap) of the verified passages."""
    get, none = ix.terms.get, len(ix.top)
    sizes = np.array([len(w) for w in words], np.int64)
    term = np.fromiter((get(w, none) for ws in words for w in ws), np.int64, int(sizes.sum()))
    s = ix.stride
    strides = np.maximum(1, -(-sizes // s))
    begin = np.cumsum(sizes) - sizes
    n_pass = int(strides.sum())
    text = np.repeat(np.arange(len(words)), strides)
    nth = np.arange(n_pass) - np.repeat(np.cumsum(strides) - strides, strides)
    lo = begin[text] + nth * s
    hi = np.minimum(lo + 2 * s, begin[text] + sizes[text])
    upto = np.append(0.0, np.cumsum(np.append(np.minimum(ix.top, 1.0), 0.0)[term]))  # one term of 1 is enough; large ones would cost the sums' digits
    alive = np.flatnonzero(upto[hi] - upto[lo] >= 1 - 1e-6)
    out = []
    for at in range(0, len(alive), 1024):
        part = alive[at : at + 1024]
        row, pos = _expand(lo[part], hi[part])
        known = term[pos] < none
        pair = np.unique(row[known] * none + term[pos[known]])  # a term counts once in a passage
        p, t = pair // none, pair % none
        ok = np.bincount(p, ix.top[t], len(part)) >= 1 - 1e-6
        p, t = p[ok[p]], t[ok[p]]
        r, e = _expand(ix.block_at[t], ix.block_at[t + 1])
        width = int(ix.block.max()) + 1
        bp, bb, bs = _sums(p[r], ix.block[e], width, ix.block_top[e])
        good = bs >= 1 - 1e-6
        hot = np.isin(p[r] * width + ix.block[e], bp[good] * width + bb[good])
        r, e = r[hot], e[hot]
        r2, q = _expand(ix.post_at[e], ix.post_at[e + 1])
        ip, it, sc = _sums(p[r[r2]], ix.post_item[q], len(ix.item_ids), ix.post_weight[q])
        good = sc >= 1 - 1e-6
        for a, i, x in zip(ip[good].tolist(), it[good].tolist(), sc[good].tolist()):
            d = int(text[part[a]])
            own = words[d][lo[part[a]] - begin[d] : hi[part[a]] - begin[d]]
            want = shingles_of(ix.item_words[i], ix.k)
            have = set(shingles_of(own, min(ix.k, len(ix.item_words[i]))))
            question = max(0, ix.answer_at[i] - min(ix.k, len(ix.item_words[i])) + 1)
            hit = [w in have for w in want]
            q_over = sum(hit[:question]) / question if question else 1.0
            a_over = sum(hit[question:]) / (len(hit) - question) if len(hit) > question else 1.0
            if sum(hit) >= ix.overlap * len(hit) - 1e-9 and q_over > 0 and a_over > 0:
                out.append((d, i, x, q_over, a_over))
    return out


def contaminated(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = 5, overlap: float = 0.8
) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap): the test items that a document holds.

    A document holds an item if one of its passages (twice 1.25 times the longest item's words, every
    half of it) has at least `overlap` of the item's k-word shingles, some of them in the question and some in
    the answer; words are lower-cased A-Z and cut at ASCII white space. score: the best passage's BM25
    over the item's threshold. Null and empty texts and items without a word match nothing; an item without an id
    cannot be named and is left out; repeated documents give a row each, repeated item ids one row for each document (the
    best); no items or no documents give an empty result. Other columns are ignored.

    Items are indexed on the driver by length, and INDEX_ITEMS of them go out with each pass over the
    documents, so no more than that is ever broadcast. The statistics of BM25 are those of all items.
    """
    ddl = f"`{doc_id}` long, `{item_id}` long, score double, question_overlap double, answer_overlap double"
    schema = pa.schema([(doc_id, pa.int64()), (item_id, pa.int64()), *((c, pa.float64()) for c in ("score", "question_overlap", "answer_overlap"))])
    source = binary_text(docs.withColumn(doc_id, F.col(doc_id).cast("long")), doc_id, text)
    out = docs.sparkSession.createDataFrame([], ddl)
    for built in _indexes(items.where(F.col(item_id).isNotNull()), item_id, item_text, k, overlap):
        sent = docs.sparkSession.sparkContext.broadcast(built)

        def run(batches, sent=sent):
            for piece, texts in text_slices(batches):
                words, best = [t.lower().split() for t in texts], {}
                for ix in sent.value:
                    for d, i, *x in search(ix, words):
                        key = d, ix.item_ids[i]
                        best[key] = max(best.get(key, x), x)
                if best:
                    who = piece.column(0).to_pylist()
                    yield record(schema, [who[d] for d, _ in best], [i for _, i in best], *zip(*best.values()))

        out = out.union(source.mapInArrow(run, ddl))
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = 5, overlap: float = 0.8) -> DataFrame:
    """The rows that hold no test item, as contaminated() has it, with all their columns, whatever their names; no shuffle.

    Items without an id count here. Rows with null and empty texts stay, repeated rows stay or go together; without items all stay.
    """
    at = docs.columns.index(text)
    for built in _indexes(items, item_id, item_text, k, overlap):
        sent = docs.sparkSession.sparkContext.broadcast(built)

        def run(batches, sent=sent):
            for piece, texts in text_slices(batches, at):
                words = [t.lower().split() for t in texts]
                keep = np.ones(len(texts), bool)
                for ix in sent.value:
                    keep[[d for d, *_ in search(ix, words)]] = False
                yield piece.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def _indexes(items: DataFrame, item_id: str, item_text: str, k: int, overlap: float):
    """Lists of indexes, INDEX_ITEMS items or so in each list; an index has items of about one length."""
    words = F.filter(F.split(F.translate(F.coalesce(F.col(item_text), F.lit("")), UPPER, UPPER.lower()), r"[\x09-\x0D\x20]+"), lambda w: w != "")
    sized = items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t"), words.alias("w")).where(F.size("w") > 0)
    sized = materialize(sized.withColumn("c", F.floor(F.log2(F.size("w") + 1))).withColumn("r", F.xxhash64("i", "t")), "items")
    ranked = sized.groupBy("c").agg(F.count("*").alias("n"), F.sum(F.size("w")).alias("words")).collect()  # one row for each doubling of the length
    n = sum(r.n for r in ranked)
    df = materialize(sized.select(F.explode(F.array_distinct("w")).alias("w")).groupBy("w").agg(F.count("*").alias("df")), "items-df")
    for group in _passes([(r["c"], r["n"]) for r in ranked]):
        built = []
        for c, part, parts in group:
            own = sized.where((F.col("c") == c) & (F.pmod("r", F.lit(parts)) == part))
            known = own.select(F.explode("w").alias("w")).distinct().join(df, "w").collect()  # the words of this index
            collection = Collection(n, sum(r.words for r in ranked) / n, {r.w.encode(): r["df"] for r in known})
            built.append(build_index([(r.i, r.t) for r in own.orderBy("i", "t").collect()], collection, k, overlap))
        built = [ix for ix in built if ix]
        if built:
            yield built


def _passes(counts: list[tuple[int, int]]) -> list[list[tuple[int, int, int]]]:
    """Deal the lengths' items to passes of about INDEX_ITEMS items: lists of (length class, part, parts)."""
    out, room = [], 0
    for c, n in sorted(counts):
        parts = -(-n // INDEX_ITEMS)
        for part in range(parts):
            if room < n / parts:
                out.append([])
                room = INDEX_ITEMS
            out[-1].append((c, part, parts))
            room -= n / parts
    return out
