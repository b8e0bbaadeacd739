"""Reversible line dedup: sharded cuckoo filters before exact reference-count tables.

The index knows every line key by 128 bits and is a set of tables that only grow by runs: `pairs` (which document holds which key),
`refs` (how many documents hold a key, and the smallest) with a version, of which the newest row of a key counts, and one cuckoo
filter for each shard of keys. A batch asks the filters first: a key that they have never seen is new for certain and
needs no look at the tables, all others are looked up exactly. Deleting documents takes their keys out of the counts, and
keys that nobody holds any more out of the filters, so that the result is as if the documents had never come.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldsmith.llm._text import binary_text, record, text_slices
from foldsmith.session import materialize

#: Code points from which on a key counts.
LEAST_CHARS = 10
#: Keys of a shard when an index begins; filters grow beyond that.
SHARD_KEYS = 1 << 14
#: Share of a filter's slots that may be taken before it is built anew.
FULL = 0.8
#: Rounds in which fingerprints may push each other on before the rest goes to the stash.
ROUNDS = 200
SPACE = b" \t\n\x0b\x0c\r"
WINDOW = 1 << 20


class CuckooFilter:
    """16-bit fingerprints in buckets of four, each in one of two buckets; what finds no place is kept in a stash."""

    def __init__(self, buckets: int):
        self.table, self.stash = np.zeros((buckets, 4), np.uint16), np.empty((0, 2), np.uint32)

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        """An empty filter that `keys` fill to FULL at most."""
        return cls(1 << max(3, int(np.ceil(np.log2(max(1, keys) / (4 * FULL))))))

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        buckets, held = np.frombuffer(data, np.uint32, 2)
        out = cls(int(buckets))
        out.stash = np.frombuffer(data, np.uint32, 2 * int(held), 8).reshape(-1, 2).copy()
        out.table = np.frombuffer(data, np.uint16, -1, 8 + 8 * int(held)).reshape(-1, 4).copy()
        return out

    def dump(self) -> bytes:
        return np.array([len(self.table), len(self.stash)], np.uint32).tobytes() + self.stash.astype(np.uint32).tobytes() + self.table.tobytes()

    def __len__(self) -> int:
        return int((self.table > 0).sum()) + len(self.stash)

    def _places(self, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(fingerprint, first bucket) of keys by their second 64 bits."""
        u = k2.view(np.uint64)
        prints = np.maximum(u >> np.uint64(48), np.uint64(1)).astype(np.uint16)
        return prints, (u & np.uint64(len(self.table) - 1)).astype(np.int64)

    def _other(self, bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
        return bucket ^ ((prints.astype(np.int64) * 0x5BD1E995 >> 7) & (len(self.table) - 1))

    def _settle(self, prints: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Put fingerprints into free slots of the buckets; True where one has found a slot."""
        order = np.argsort(bucket, kind="stable")
        b = bucket[order]
        nth = np.arange(len(b)) - np.searchsorted(b, b)
        free = self.table[b] == 0
        ok = nth < free.sum(axis=1)
        slot = (np.cumsum(free[ok], axis=1) == nth[ok, None] + 1).argmax(axis=1)
        self.table[b[ok], slot] = prints[order[ok]]
        done = np.zeros(len(b), bool)
        done[order[ok]] = True
        return done

    def insert(self, k2: np.ndarray) -> None:
        """Add keys, once for each time that they are given."""
        prints, bucket = self._places(k2)
        for kick in range(ROUNDS):
            left = ~self._settle(prints, bucket)
            prints, bucket = prints[left], bucket[left]
            if not len(prints):
                return
            bucket = self._other(bucket, prints)
            left = ~self._settle(prints, bucket)
            prints, bucket = prints[left], bucket[left]
            if not len(prints):
                return
            # One fingerprint for each full bucket takes a slot, whose owner goes on to its other bucket.
            own = np.unique(bucket, return_index=True)[1]
            slot = (prints[own].astype(np.int64) + kick) % 4
            out = self.table[bucket[own], slot].copy()
            self.table[bucket[own], slot] = prints[own]
            prints[own] = out
            bucket[own] = self._other(bucket[own], out)
        self.stash = np.concatenate([self.stash, np.stack([bucket, prints], axis=1).astype(np.uint32)])

    def has(self, k2: np.ndarray) -> np.ndarray:
        """True for every key that is in; rarely for one that is not, never False for one that is."""
        prints, bucket = self._places(k2)
        other = self._other(bucket, prints)
        found = (self.table[bucket] == prints[:, None]).any(axis=1) | (self.table[other] == prints[:, None]).any(axis=1)
        for b, p in self.stash:
            found |= (prints == p) & ((bucket == b) | (other == b))
        return found

    def delete(self, k2: np.ndarray) -> None:
        """Take out one copy for each key given; every key must be in."""
        prints, bucket = self._places(k2)
        for second in (False, True):
            at = self._other(bucket, prints) if second else bucket
            code, left, done = at * 65536 + prints, np.arange(len(prints)), np.zeros(len(prints), bool)
            while len(left):  # keys of one fingerprint and bucket take a copy each, round by round
                first = left[np.unique(code[left], return_index=True)[1]]
                hit = self.table[at[first]] == prints[first, None]
                ok = hit.any(axis=1)
                self.table[at[first[ok]], hit[ok].argmax(axis=1)] = 0
                done[first[ok]] = True
                left = left[~done[left] & ~np.isin(code[left], code[first[~ok]])]
            prints, bucket = prints[~done], bucket[~done]
        for b, p in zip(bucket, prints):
            both = {int(b), int(self._other(np.array([b]), np.array([p]))[0])}
            hit = [i for i, (x, y) in enumerate(self.stash) if y == p and int(x) in both][:1]
            self.stash = np.delete(self.stash, hit, axis=0)


def line_lists(text: bytes) -> Iterator[list[bytes]]:
    """The lines of a text in lists of about WINDOW bytes, whatever the text's length."""
    at = 0
    while True:
        end = text.find(b"\n", at + WINDOW) if len(text) - at > WINDOW else -1
        if end < 0:
            yield text[at:].split(b"\n")
            return
        yield text[at:end].split(b"\n")
        at = end + 1


def line_digest(line: bytes) -> bytes | None:
    """128 bits of a line's key (stripped of ASCII white space, A-Z lower-cased); None if it has fewer than LEAST_CHARS code points."""
    key = line.strip(SPACE)
    if len(key) < LEAST_CHARS or len(key) < 4 * LEAST_CHARS and not key.isascii() and len(key.decode("utf-8", "replace")) < LEAST_CHARS:
        return None
    return xxhash.xxh3_128_digest(key.lower())


#: The id of documents without one: they count as one document, the largest.
NO_ID = (1 << 63) - 1
PAIR = pa.schema([("doc_id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64())])


def _doc() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))


def _keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in text_slices(batches):
        ids = batch.column(0).to_pylist()
        docs, digests = [], []
        for doc, text in zip(ids, texts):
            seen: set[bytes] = set()
            for lines in line_lists(text):
                seen.update(d for d in map(line_digest, lines) if d)
            docs.append(np.full(len(seen), doc))
            digests.extend(seen)
        both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        yield record(PAIR, np.concatenate([*docs, np.empty(0, np.int64)]).astype(np.int64), np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1]))


def line_pairs(docs: DataFrame) -> DataFrame:
    """(doc_id, k1, k2): the different line keys of every document; rows of equal doc_id are one document."""
    slim = binary_text(docs.select(_doc().alias("doc_id"), F.col("text").cast("string").alias("text")), "doc_id", "text")
    return slim.mapInArrow(_keys, "doc_id long, k1 long, k2 long").distinct()


ASKED = pa.schema([("shard", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("n_docs", pa.int64()), ("first_doc", pa.int64()), ("maybe", pa.bool_()), ("filter", pa.binary()), ("held", pa.int64())])
ASKED_DDL = "shard long, k1 long, k2 long, n_docs long, first_doc long, maybe boolean, filter binary, held long"


def _ask(key: tuple[pa.Scalar, ...], batch: pa.Table, state: pa.Table) -> pa.Table:
    """A shard's new keys with the filter's answer, and the filter with them in; state: the filter, or the exact keys to build it from."""
    shard = key[0].as_py()
    k2 = batch["k2"].to_numpy()
    old = [x for x in state["filter"].to_pylist() if x is not None]
    if old:
        held = CuckooFilter.load(old[0])
    else:
        exact = state["k2"].to_numpy() if state.num_rows else np.empty(0, np.int64)
        held = CuckooFilter.sized(max(SHARD_KEYS, 2 * (len(exact) + len(k2))))
        held.insert(exact.astype(np.int64))
    maybe = held.has(k2) if len(k2) else np.empty(0, bool)
    # A key that may be in is entered once it is known to be new: see LineIndex.insert.
    held.insert(k2[~maybe])
    n = len(k2)
    own = record(ASKED, np.full(n, shard), batch["k1"].to_numpy(), k2, batch["n_docs"].to_numpy(), batch["first_doc"].to_numpy(), maybe, pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()))
    none = [None]
    return pa.Table.from_batches([own, record(ASKED, [shard], none, none, none, none, none, [held.dump()], [len(held)])])


def _change(key: tuple[pa.Scalar, ...], batch: pa.Table, state: pa.Table) -> pa.Table:
    """The shard's filter with the keys of the batch entered (in) or taken out."""
    held = CuckooFilter.load(state["filter"].to_pylist()[0])
    if batch.num_rows:
        k2, enter = batch["k2"].to_numpy(), batch["enter"].to_numpy()
        held.insert(k2[enter])
        held.delete(k2[~enter])
    return pa.table({"shard": [key[0].as_py()], "filter": [held.dump()], "held": [len(held)]})


@dataclass(frozen=True)
class LineIndex:
    """An index of the lines of documents; every change returns a new one and leaves the old one as it was."""

    spark: SparkSession
    shards: int = 0
    version: int = 0
    refs: tuple[DataFrame, ...] = ()
    pairs: tuple[DataFrame, ...] = ()
    deleted: tuple[DataFrame, ...] = ()
    filters: DataFrame | None = None

    def _union(self, runs: tuple[DataFrame, ...], ddl: str) -> DataFrame:
        out = self.spark.createDataFrame([], ddl) if not runs else runs[0]
        for run in runs[1:]:
            out = out.unionByName(run)
        return out

    def _shard(self) -> Column:
        return F.pmod(F.col("k1"), F.lit(self.shards)).alias("shard")

    def counts(self, keys: DataFrame | None = None) -> DataFrame:
        """(k1, k2, n_docs, first_doc): documents that hold each key now, and the smallest; with `keys` (k1, k2) only of those."""
        rows = self._union(self.refs, "k1 long, k2 long, n_docs long, first_doc long, version long")
        if keys is not None:
            rows = rows.join(keys.select("k1", "k2"), ["k1", "k2"], "left_semi")
        if len(self.refs) > 1:
            rows = rows.groupBy("k1", "k2").agg(F.max_by(F.struct("n_docs", "first_doc"), "version").alias("r")).select("k1", "k2", "r.*")
        return rows.where("n_docs > 0").select("k1", "k2", "n_docs", "first_doc")

    def holders(self) -> DataFrame:
        """(doc_id, k1, k2) of the documents that are in."""
        rows = self._union(self.pairs, "doc_id long, k1 long, k2 long, version long")
        if self.deleted:
            last = self._union(self.deleted, "doc_id long, gone long").groupBy("doc_id").agg(F.max("gone").alias("gone"))
            rows = rows.join(last, "doc_id", "left").where("gone IS NULL OR gone < version")
        return rows.select("doc_id", "k1", "k2")

    def insert(self, docs: DataFrame) -> LineIndex:
        """The index with the documents (doc_id, text) in it; one whose id is in already takes the place of that one.

        A null text is one empty line. Documents without an id count as one, the largest; no rows change nothing.
        """
        found = materialize(line_pairs(docs), "line-pairs")
        before = self
        if self.pairs:
            there = docs.select(_doc().alias("doc_id")).distinct().join(self.holders().select("doc_id").distinct(), "doc_id", "left_semi")
            there = materialize(there, "line-again")
            before = self if there.isEmpty() else self.delete(there)
        return before._enter(found)

    def _enter(self, found: DataFrame) -> LineIndex:
        # The number of shards follows from the first batch and stays.
        new = replace(self, shards=self.shards or max(8, -(-found.count() // SHARD_KEYS)), version=self.version + 1)
        delta = found.groupBy("k1", "k2").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))
        delta = materialize(delta.select(new._shard(), "*"), "line-delta")
        none = F.lit(None)
        if self.filters is None:
            state = self.spark.createDataFrame([], "shard long, k2 long, filter binary")
        else:
            many = delta.groupBy("shard").agg(F.count("*").alias("more"))
            room = self.filters.join(many, "shard", "left").withColumn("full", F.col("held") + F.coalesce("more", F.lit(0)) > FULL * (F.octet_length("filter") / 2))
            exact = self.counts().select(new._shard(), "k2").join(room.where("full").select("shard"), "shard", "left_semi")
            state = room.where("NOT full").select("shard", none.cast("long").alias("k2"), "filter").union(exact.select("shard", "k2", none.cast("binary")))
        asked = materialize(delta.groupBy("shard").cogroup(state.groupBy("shard")).applyInArrow(_ask, ASKED_DDL), "line-asked")
        filters = asked.where("filter IS NOT NULL").select("shard", "filter", "held")
        rows = asked.where("filter IS NULL").select("k1", "k2", "n_docs", "first_doc", "maybe")
        sure, maybe = rows.where("NOT maybe"), rows.where("maybe")
        old = self.counts(maybe).select("k1", "k2", F.col("n_docs").alias("n"), F.col("first_doc").alias("f"))
        looked = materialize(maybe.join(old, ["k1", "k2"], "left"), "line-looked")
        total = F.col("n_docs") + F.coalesce("n", F.lit(0).cast("long"))
        run = sure.select("k1", "k2", "n_docs", "first_doc").union(looked.select("k1", "k2", total, F.least("first_doc", "f")))
        run = materialize(run.withColumn("version", F.lit(new.version).cast("long")), "line-refs")
        # Keys that only looked like ones seen before are in no filter yet.
        filters = _changed(filters, looked.where("n IS NULL").select(new._shard(), "k2", F.lit(True).alias("enter")))
        pairs = materialize(found.withColumn("version", F.lit(new.version).cast("long")), "line-held")
        return replace(new, refs=(*self.refs, run), pairs=(*self.pairs, pairs), filters=filters)

    def delete(self, docs: DataFrame) -> LineIndex:
        """The index without the documents of these ids (column doc_id); ids that are not in change nothing."""
        if not self.pairs:
            return self
        new = replace(self, version=self.version + 1)
        ids = docs.select(_doc().alias("doc_id")).distinct()
        held = materialize(self.holders(), "line-holders")
        lost = materialize(held.join(ids, "doc_id", "left_semi").select("k1", "k2").distinct(), "line-lost")
        still = held.join(lost, ["k1", "k2"], "left_semi").join(ids, "doc_id", "left_anti").groupBy("k1", "k2").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))
        run = lost.join(still, ["k1", "k2"], "left").select("k1", "k2", F.coalesce("n_docs", F.lit(0).cast("long")).alias("n_docs"), "first_doc", F.lit(new.version).cast("long").alias("version"))
        run = materialize(run, "line-refs")
        filters = _changed(self.filters, run.where("n_docs = 0").select(new._shard(), "k2", F.lit(False).alias("enter")))
        gone = materialize(ids.withColumn("gone", F.lit(new.version).cast("long")), "line-gone")
        return replace(new, refs=(*self.refs, run), deleted=(*self.deleted, gone), filters=filters)

    def compact(self) -> LineIndex:
        """The same index in one run of each table."""
        pairs = materialize(self.holders().withColumn("version", F.lit(self.version).cast("long")), "line-held")
        refs = materialize(self.counts().withColumn("version", F.lit(self.version).cast("long")), "line-refs")
        return replace(self, refs=(refs,), pairs=(pairs,), deleted=())

    def deduplicate(self, docs: DataFrame) -> DataFrame:
        """(doc_id, n_lines, n_dropped, text) of documents that are in the index: lines go whose key another, smaller document holds.

        The smallest document keeps all its lines of a key, keys of fewer than LEAST_CHARS code points never go. A null
        text is one empty line. Every row gives one row; rows of equal doc_id are one document and lose the same keys.
        """
        many = self.counts().where("n_docs > 1").select("k1", "k2", "first_doc")
        drops = self.holders().join(many, ["k1", "k2"]).where("doc_id <> first_doc")
        drops = drops.groupBy("doc_id").agg(F.collect_list(F.struct("k1", "k2")).alias("d"))
        drops = drops.select(F.col("doc_id").alias("_id"), F.col("d.k1").alias("k1"), F.col("d.k2").alias("k2"))
        slim = docs.select(F.col("doc_id"), _doc().alias("_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
        both = slim.join(drops, "_id", "left").select("doc_id", "text", "k1", "k2")
        kind = docs.schema["doc_id"].dataType.simpleString()
        out = both.mapInArrow(_without, f"doc_id {kind}, n_lines long, n_dropped long, text binary")
        return out.withColumn("text", F.col("text").cast("string"))


def _changed(filters: DataFrame, keys: DataFrame) -> DataFrame:
    out = keys.groupBy("shard").cogroup(filters.groupBy("shard")).applyInArrow(_change, "shard long, filter binary, held long")
    return materialize(out, "line-filters")


def _without(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the lines of their own lists of keys."""
    for batch, texts in text_slices(batches):
        schema = pa.schema([batch.schema.field(0), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("text", pa.binary())])
        total, dropped, kept = [], [], []
        for text, k1, k2 in zip(texts, batch.column(2), batch.column(3)):
            total.append(text.count(b"\n") + 1)
            dropped.append(0)
            if not k1.is_valid:
                kept.append(text)
                continue
            both = np.stack([np.asarray(k.values, np.int64) for k in (k1, k2)], axis=1).tobytes()
            bad = {both[i : i + 16] for i in range(0, len(both), 16)}
            left = [line for lines in line_lists(text) for line in lines if line_digest(line) not in bad]
            dropped[-1] = total[-1] - len(left)
            kept.append(b"\n".join(left))
        yield record(schema, batch.column(0), total, dropped, kept)


def deduplicate_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text) of all documents without the lines that a smaller document holds: see LineIndex."""
    return LineIndex(docs.sparkSession).insert(docs).deduplicate(docs)
