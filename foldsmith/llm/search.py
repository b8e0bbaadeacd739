"""Ranked lexical search over a term-partitioned index, term owners one after the other.

Documents become blocks of at most BLOCK, and the index has a row for each term and block. Terms belong to owners by how
many documents hold them, the rarest first. A bundle is a set of items over one block of documents: it goes from owner to owner
with sparse accumulators, meets the owner's postings of its block in a cogroup, adds their integer contributions and goes on;
the last owner has the commonest terms, so the accumulators are still sparse when they are sent. What comes out of a block are the
`k` best of each item, of which the best over all blocks are the result. Nothing is pruned or estimated.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldsmith.llm._text import record, text_slices
from foldsmith.operators.ids import with_index
from foldsmith.session import materialize

#: Documents of a block, and postings from which on a block is closed early.
BLOCK, BLOCK_POSTINGS = 4096, 1 << 20
#: Items of a bundle.
BUNDLE = 256
#: Owners of terms: those that at most this share of all documents hold, the last one has the others.
OWNERS = (1 / 512, 1 / 24, 1.0)
#: Bits of the filter on the items' terms; its size does not depend on the items.
FILTER_BITS = 1 << 24
#: Bytes of a text that are split at a time, and words that a worker keeps the hashes of.
WINDOW, WORDS = 1 << 20, 1 << 19

#: Term characters are ASCII letters and digits and all code points from U+0080 on.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if chr(b).isalnum() or b >= 128 else 32 for b in range(256))


def term_counts(text: bytes) -> Counter:
    """Occurrences of every term of a UTF-8 text, split in windows."""
    counts: Counter = Counter()
    rest: list[bytes] = []  # the term that goes on in the next window
    for at in range(0, len(text), WINDOW):
        part = text[at : at + WINDOW].translate(_FOLD)
        cut = part.rfind(b" ")
        if cut < 0:
            rest.append(part)
        else:
            counts.update(b"".join([*rest, part[:cut]]).split())
            rest = [part[cut + 1 :]]
    counts.update(b"".join(rest).split())
    return counts


def term_hash(term: bytes) -> int:
    """XXH64 with seed 42, as a signed number; never 0."""
    h = xxhash.xxh64_intdigest(term, 42) or 1
    return h - (1 << 64) if h >> 63 else h


ITEM_TERM = pa.schema([("item", pa.int64()), ("term", pa.int64()), ("times", pa.int64())])


def _item_terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in text_slices(batches):
        rows = [(i, term_hash(t), n) for i, text in zip(batch.column(0).to_pylist(), texts) for t, n in term_counts(text).items()]
        if rows:
            yield record(ITEM_TERM, *map(list, zip(*rows)))


def term_filter(terms: DataFrame) -> bytes:
    """A bit for each hash of a term (column term) modulo FILTER_BITS: FILTER_BITS / 8 bytes, whatever the number of terms.

    A term of no item may pass and costs a few postings; one of an item always does.
    """
    bit = F.pmod(F.col("term"), F.lit(FILTER_BITS)) + 1  # Spark's bitmaps count from 1
    maps = terms.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("m"))
    out = np.zeros(FILTER_BITS // 8 + 8192, np.uint8)
    for r in maps.collect():  # at most FILTER_BITS / 32768 + 1 rows of 4 kB
        at = (r.b - 1) * 4096
        out[at : at + 4096] |= np.frombuffer(bytes(r.m), np.uint8)
    return out.tobytes()


INDEX = pa.schema([("block", pa.int64()), ("term", pa.int64()), ("local", pa.binary()), ("tf", pa.binary()), ("df", pa.int64()), ("ids", pa.binary()), ("sizes", pa.binary()), ("n", pa.int64()), ("total", pa.int64())])
INDEX_DDL = "block long, term long, local binary, tf binary, df long, ids binary, sizes binary, n long, total long"


class _Hashes(dict):
    """Hashes of words; 0 for those that the filter does not know."""

    def __init__(self, bits: bytes):
        self.bits = np.frombuffer(bits, np.uint8)

    def __missing__(self, word: bytes) -> int:
        h = term_hash(word)
        bit = h % FILTER_BITS
        h = h if self.bits[bit >> 3] >> (bit & 7) & 1 else 0
        if len(self) >= WORDS:
            self.clear()
        self[word] = h
        return h


def _indexer(bits: bytes) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known, part, nth = _Hashes(bits), TaskContext.get().partitionId(), 0
        ids, valid, sizes, hashes, times, owner = [], [], [], [], [], []

        def block() -> pa.RecordBatch:
            local = np.repeat(np.arange(len(ids)), owner)
            h, tf = np.concatenate([*hashes, np.empty(0, np.int64)]), np.concatenate([*times, np.empty(0, np.int64)])
            order = np.argsort(h, kind="stable")
            h, tf, local = h[order], tf[order].astype(np.uint32), local[order].astype(np.uint16)
            term, first = np.unique(h, return_index=True)
            cuts = [*first.tolist(), len(h)]
            number = (part << 32) + nth
            m = len(term)
            docs = np.where(valid, ids, 0).astype(np.int64).tobytes() + np.packbits(valid).tobytes()
            columns = (
                [number] * (m + 1), [*term.tolist(), None], [*(local[a:b].tobytes() for a, b in zip(cuts, cuts[1:])), None], [*(tf[a:b].tobytes() for a, b in zip(cuts, cuts[1:])), None],
                [*np.diff(cuts).tolist(), None], [None] * m + [docs], [None] * m + [np.array(sizes, np.int64).tobytes()], [None] * m + [int((np.array(sizes) > 0).sum())], [None] * m + [int(sum(sizes))],
            )
            for x in (ids, valid, sizes, hashes, times, owner):
                x.clear()
            return record(INDEX, *columns)

        postings = 0
        for batch, texts in text_slices(batches):
            for doc, text in zip(batch.column(0).to_pylist(), texts):
                counts = term_counts(text)
                h = np.fromiter(map(known.__getitem__, counts), np.int64, len(counts))
                ok = h != 0
                ids.append(0 if doc is None else doc)
                valid.append(doc is not None)
                sizes.append(sum(counts.values()))
                hashes.append(h[ok])
                times.append(np.fromiter(counts.values(), np.int64, len(counts))[ok])
                owner.append(int(ok.sum()))
                postings += owner[-1]
                if len(ids) >= BLOCK or postings >= BLOCK_POSTINGS:
                    yield block()
                    nth, postings = nth + 1, 0
        if ids:
            yield block()

    return run


STATE = pa.schema([("bundle", pa.int64()), ("block", pa.int64()), ("ids", pa.binary()), ("norms", pa.binary()), ("cell", pa.binary()), ("score", pa.binary())])
STATE_DDL = "bundle long, block long, ids binary, norms binary, cell binary, score binary"
FOUND = pa.schema([("bundle", pa.int64()), ("slot", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])
FOUND_DDL = "bundle long, slot int, doc_id long, score long"


def _doc_ids(ids: bytes, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, whether each is one) of a block of `docs` documents."""
    return np.frombuffer(ids, np.int64, docs), np.unpackbits(np.frombuffer(ids, np.uint8, -1, 8 * docs), count=docs).astype(bool)


def _add(state: pa.Table, postings: pa.Table) -> np.ndarray:
    """Scores (item, document) of a bundle over a block: what it brings along plus the owner's postings."""
    norms = np.frombuffer(state["norms"][0].as_py(), np.int64)
    docs = len(norms)
    total = np.zeros(BUNDLE * docs, np.int64)
    cell = state["cell"][0].as_py()
    if cell:
        total[np.frombuffer(cell, np.uint32)] = np.frombuffer(state["score"][0].as_py(), np.int64)
    total = total.reshape(BUNDLE, docs)
    if postings.num_rows:
        columns = (postings[x].combine_chunks() for x in ("weight", "slots", "times", "local", "tf"))
        for w, slots, times, local, tf in zip(*columns):
            at, tf = np.frombuffer(local.as_py(), np.uint16).astype(np.int64), np.frombuffer(tf.as_py(), np.uint32).astype(np.int64)
            gain = w.as_py() * (1_000_000_000 * tf // (1000 * tf + 12 * norms[at]))
            for slot, n in zip(slots.as_py(), times.as_py()):
                total[slot, at] += n * gain
    return total


def _owner_stage(state: pa.Table, postings: pa.Table) -> pa.Table:
    """The bundle with the owner's contributions, for the next owner."""
    if not state.num_rows:
        return STATE.empty_table()
    total = _add(state, postings).ravel()
    cell = np.flatnonzero(total)
    row = [[state[x][0].as_py()] for x in ("bundle", "block", "ids", "norms")]
    return pa.Table.from_batches([record(STATE, *row, [cell.astype(np.uint32).tobytes()], [total[cell].tobytes()])])


def _last_stage(k: int) -> Callable:
    def run(state: pa.Table, postings: pa.Table) -> pa.Table:
        """The k best documents of each item in the block, equal scores by ascending id, null ids last."""
        if not state.num_rows:
            return FOUND.empty_table()
        total = _add(state, postings)
        docs = total.shape[1]
        ids, valid = _doc_ids(state["ids"][0].as_py(), docs)
        order = np.lexsort((ids, ~valid))
        total = total[:, order]
        slots, found, scores = [], [], []
        for slot in np.flatnonzero(total.any(axis=1)):
            row = total[slot]
            some = np.flatnonzero(row > 0)
            if len(some) > k:
                some = some[row[some] >= np.partition(row[some], len(some) - k)[len(some) - k]]
            best = some[np.argsort(-row[some], kind="stable")[:k]]
            slots.append(np.full(len(best), slot))
            found.append(order[best])
            scores.append(row[best])
        at = np.concatenate([*found, np.empty(0, np.int64)]).astype(np.int64)
        n = len(at)
        return pa.Table.from_batches([record(FOUND, np.full(n, state["bundle"][0].as_py()), np.concatenate([*slots, np.empty(0, np.int64)]).astype(np.int32), pa.array(ids[at], mask=~valid[at]), np.concatenate([*scores, np.empty(0, np.int64)]).astype(np.int64))])

    return run


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every item with a score above 0, or fewer if there are fewer.

    docs: doc_id, text; items: item_id, text; other columns are not looked at. Terms are runs of ASCII letters, digits
    and characters beyond ASCII, A-Z lower-cased; null and empty texts have none, find nothing and are found by nothing. The score
    of a document is the sum over the item's terms, repeats included, of w * ((10**9 tf) div (1000 tf + 12 m)) with
    w = floor(1000 ln((2 N + 2) / (2 df + 1))) and m = 75 + (25 n N) div L; N documents have a term, L terms in all. Equal scores go
    by ascending doc_id, null last; repeated rows are documents and items of their own. Without items or documents there is no row.
    Terms are known by XXH64.
    """
    spark = docs.sparkSession
    named = materialize(with_index(items.select("item_id", F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text")), [F.col("item_id"), F.col("text")], "item"), "search-items")
    terms = materialize(named.select("item", "text").mapInArrow(_item_terms, "item long, term long, times long"), "search-terms")
    bits = term_filter(terms)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    index = materialize(slim.mapInArrow(_indexer(bits), INDEX_DDL), "search-index")
    blocks, postings = index.where("ids IS NOT NULL").select("block", "ids", "sizes", "n", "total"), index.where("ids IS NULL").select("block", "term", "local", "tf", "df")
    n, total = blocks.agg(F.sum("n"), F.sum("total")).first()
    asked = terms.groupBy("term", F.floor(F.col("item") / BUNDLE).alias("bundle")).agg(F.collect_list((F.col("item") % BUNDLE).cast("int")).alias("slots"), F.collect_list("times").alias("times"))
    df = postings.groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(n or 0) + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("long")
    owner = sum(((F.col("df") > share * (n or 0)).cast("int") for share in OWNERS[:-1]), F.lit(0))
    asked = materialize(asked.join(df, "term").select("term", "bundle", "slots", "times", weight.alias("weight"), owner.alias("owner")).where("weight > 0"), "search-asked")
    norm = _norms(n or 0, max(1, total or 0))
    last = max(0, named.count() - 1) // BUNDLE
    no = F.lit(None).cast("binary")
    # A bundle of items is a stated set of queries that goes to every block.
    bundle = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"))).alias("bundle")
    state = blocks.select(bundle, "block", "ids", norm("sizes").alias("norms"), no.alias("cell"), no.alias("score"))
    for stage in range(len(OWNERS)):
        mine = postings.join(asked.where(F.col("owner") == stage), "term")
        mine = mine.select(*(F.col(c).alias(c) for c in ("bundle", "block", "weight", "slots", "times", "local", "tf")))  # columns of their own, as both sides come from the index
        both = state.groupBy("bundle", "block").cogroup(mine.groupBy("bundle", "block"))
        if stage < len(OWNERS) - 1:
            state = materialize(both.applyInArrow(_owner_stage, STATE_DDL), "search-state")
        else:
            found = both.applyInArrow(_last_stage(k), FOUND_DDL)
    rank = F.row_number().over(Window.partitionBy("bundle", "slot").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    best = found.withColumn("rank", rank).where(F.col("rank") <= k).withColumn("item", F.col("bundle") * BUNDLE + F.col("slot"))
    return best.join(named.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def _norms(n: int, total: int) -> Callable:
    """m of every document from its size, as bytes of 64-bit integers; products beyond 64 bits are taken as Python numbers."""

    @F.pandas_udf(T.BinaryType())
    def norms(sizes):
        def one(raw: bytes) -> bytes:
            size = np.frombuffer(raw, np.int64)
            if int(size.max(initial=0)) * 25 * n < 1 << 62:
                return (75 + 25 * size * n // total).tobytes()
            return np.array([75 + 25 * int(x) * n // total for x in size], np.int64).tobytes()

        return sizes.map(one)

    return norms
