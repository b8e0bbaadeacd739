"""Token-id files with a static range asymmetric numeral system.

One frequency table, counted over all documents, serves every block. A block holds whole documents of
about `BLOCK` ids and is coded by `LANES` interleaved coders whose words share one stream, so blocks
decode alone and in any order, and NumPy runs the lanes of many blocks side by side. Each block row
is a checkpoint: it has its lane states, its first id's place in the shard and a CRC-32 of its ids.

Format: a folder of three Parquet tables. `blocks` has one row per block, `table` the frequencies,
`manifest` the number of ids before each shard. Shards ascend in doc_id, blocks ascend in a shard.
"""

from __future__ import annotations

import os
import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldsmith.llm._kept import Codes, Runs, gather, kept
from foldsmith.llm._text import record, text_slices
from foldsmith.session import drop_scratch, materialize, scratch_path

LANES, BLOCK, WIDTH = 256, 1 << 16, 16  # WIDTH: blocks coded side by side
LOW = np.uint64(1 << 31)
#: Texts with any of these may have white space after a space that is not ASCII.
RARE_SPACE = re.compile("[\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def quantise(counts: np.ndarray, bits: int) -> np.ndarray:
    """Frequencies that add up to 2**bits, at least 1 for each symbol that occurs."""
    total, size = int(counts.sum()), 1 << bits
    if not total:
        return np.zeros(len(counts), np.uint64)
    if np.count_nonzero(counts) > size:
        raise ValueError(f"{np.count_nonzero(counts)} symbols do not fit in 2**{bits} slots")
    freq = np.where(counts > 0, np.maximum(1, (counts.astype(np.float64) * size / total).astype(np.int64)), 0)
    spare = size - int(freq.sum())
    for i in np.argsort(-freq, kind="stable"):  # the most frequent give or take the rest
        step = spare if spare > 0 else -min(-spare, int(freq[i]) - 1)
        freq[i] += step
        spare -= step
        if not spare:
            break
    return freq.astype(np.uint64)


def encode_blocks(blocks: list[np.ndarray], freq: np.ndarray, cum: np.ndarray, bits: int) -> list[tuple[bytes, bytes]]:
    """(lane states, words) of each block of symbols."""
    steps = [-(-len(b) // LANES) for b in blocks]
    order = sorted(range(len(blocks)), key=lambda i: -steps[i])
    most = steps[order[0]]
    pad = int(np.argmax(freq))
    sym = np.full((most, len(blocks), LANES), pad, np.uint32)
    for k, i in enumerate(order):
        whole, rest = divmod(len(blocks[i]), LANES)
        sym[:whole, k] = blocks[i][: whole * LANES].reshape(-1, LANES)
        if rest:
            sym[whole, k, :rest] = blocks[i][whole * LANES :]
    x = np.full((len(blocks), LANES), LOW)
    words, owner = [], []  # what the steps put out, last step first
    sizes = np.array([steps[i] for i in order])
    b, top = np.uint64(bits), np.uint64(63 - bits)
    for t in range(most - 1, -1, -1):
        m = int((sizes > t).sum())
        f, c, y = freq[sym[t, :m]], cum[sym[t, :m]], x[:m]
        over = y >= (f << top)
        words.append(y[over].astype(np.uint32))  # the low half
        owner.append(over.sum(axis=1))
        y = np.where(over, y >> np.uint64(32), y)
        q = y // f
        x[:m] = (q << b) + (y - q * f) + c
    out: list = [None] * len(blocks)
    flat = np.concatenate(words[::-1])
    size = np.array([np.append(n, np.zeros(len(blocks) - len(n), np.int64)) for n in owner[::-1]])
    ends = np.cumsum(size.ravel()).reshape(size.shape)
    for k, i in enumerate(order):
        out[i] = (x[k].tobytes(), gather(flat, ends[:, k] - size[:, k], size[:, k]).tobytes())
    return out


def decode_blocks(coded: list[tuple[bytes, bytes, int]], freq: np.ndarray, cum: np.ndarray, slots: np.ndarray, bits: int) -> list[np.ndarray]:
    """The symbols of blocks of (lane states, words, number of symbols)."""
    steps = [-(-n // LANES) for _, _, n in coded]
    order = sorted(range(len(coded)), key=lambda i: -steps[i])
    most, sizes = steps[order[0]], np.array([steps[i] for i in order])
    x = np.stack([np.frombuffer(coded[i][0], np.uint64) for i in order])
    parts = [np.frombuffer(coded[i][1], np.uint32) for i in order]
    words = np.concatenate([*parts, np.zeros(1, np.uint32)]).astype(np.uint64)
    at = np.cumsum([0, *(len(p) for p in parts[:-1])])
    sym = np.zeros((most, len(coded), LANES), np.uint32)
    b, low = np.uint64(bits), np.uint64((1 << bits) - 1)
    for t in range(most):
        m = int((sizes > t).sum())
        y = x[:m]
        slot = y & low
        s = slots[slot]
        sym[t, :m] = s
        y = freq[s] * (y >> b) + slot - cum[s]
        need = y < LOW
        nth = np.cumsum(need, axis=1)
        got = words[np.where(need, at[:m, None] + nth - 1, len(words) - 1)]
        x[:m] = np.where(need, (y << np.uint64(32)) | got, y)
        at[:m] += nth[:, -1]
    out: list = [None] * len(coded)
    for k, i in enumerate(order):
        out[i] = sym[: steps[i], k].reshape(-1)[: coded[i][2]]
    return out


#: Where a long text may be cut, and the characters of a part of it.
CUT_PLACE, PART = re.compile(r" (?=\S)"), 1 << 20
#: Texts on which a vocabulary file has to agree with WordEncoder's cuts.
PROBES = [
    "", " ", "\n", "a", " a", "a b", "The quick brown fox, and the lazy dog; it's 12 o'clock!", "  two  spaces   and\ttab \t mixed\n", "line\nend\n\nempty \n x\r\ny",
    "word. word.. Word!? (word) [word] word-word word_word #tag @name 3.14 1,000 $5 50% a|b x*y", "don't I'll we've they'd  she's 'quoted' \"quoted\"", "été Äpfel ß ÑANDÚ naïve 中文 字 日本語 текст ünï",
    "camelCase HTTPServer ABC123 123abc a1b2 ½ ² №5", "a\u00a0b \u2003c d\u3000 e", "emoji 😀😀 x 👩‍👩‍👧 y", "http://a.b/c?d=e&f=1#g name@host.org", "x" * 200 + " " + "ab" * 100,
]
#: Signs that end a word as a pre-token of their own.
SIGNS = ".,;:!?*#$%&|"


class WordEncoder:
    """Byte-level BPE ids of whole texts, by the tokenizers library, one call for each different word.

    The pre-tokenizer never joins what stands before a space to that space and a following character
    that is no white space, so a text's ids are those of its pieces at these places. A piece is cut again,
    where that holds too, at single line ends and between letters and the signs after them. The ids of
    pieces are kept, up to `limit` pieces at a time. PROBES are encoded both ways at first: with a vocabulary file whose
    pre-tokenizer does otherwise, texts are encoded whole. Texts of more than PART characters are taken in parts, cut at such a
    place.
    """

    def __init__(self, path: str, end: int, limit: int = 1_000_000):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs the tasks side by side
        self.tok, self.end, self.limit = Tokenizer.from_file(path), end, limit
        self.size = max(self.tok.get_vocab_size(), end + 1)
        one = self.tok.encode("\n", add_special_tokens=False).ids
        self.line_end, self.by_pieces = one[0] if len(one) == 1 else -1, len(one) == 1
        self.reset()
        if self.by_pieces:
            whole = [[*self.tok.encode(t, add_special_tokens=False).ids, end] for t in PROBES]
            ids, sizes = self.encode(PROBES)
            self.by_pieces = ids.tolist() == list(chain.from_iterable(whole)) and sizes.tolist() == [len(w) for w in whole]

    def cut_long(self, text: str) -> list[str]:
        """The text in parts whose ids, one after the other, are those of the text."""
        out, at = [], 0
        while self.by_pieces and len(text) - at > PART:
            cut = CUT_PLACE.search(text, at + PART)
            if not cut:
                break
            out.append(text[at : cut.start()])
            at = cut.start()
        return [*out, text[at:]]

    def reset(self):
        self.pieces = Codes(1)  # pieces stand after a space; code 0 is the end id
        self.reset_parts()
        self.runs = Runs()
        self.runs.add(np.array([self.end]), np.array([1]))

    def reset_parts(self):
        self.parts, self.part_runs = Codes(), Runs()

    def _cut(self, piece: str) -> list[str]:
        """Parts whose ids, one after the other, are those of a piece after a space that is not letters and signs alone."""
        lines = piece.split("\n")
        if len(lines) == 1 or not all(x and not x[0].isspace() and not x[-1].isspace() for x in lines):
            return [" " + piece]  # one part, as white space in a row is
        out, space = [], " "
        for k, line in enumerate(lines):
            if k:
                out.append("\n")
                space = ""
            base = line.rstrip(SIGNS)
            out += [space + base, line[len(base) :]] if base and len(base) < len(line) and base.isalpha() else [space + line]
        return out

    def _learn(self) -> None:
        """Encode the pieces met for the first time."""
        new, self.pieces.new = self.pieces.new, []
        if not new:
            return
        if len(self.parts) > self.limit // 2:
            self.reset_parts()
        get = self.parts.__getitem__
        flat, size = [], []
        for p in new:
            if p.isalpha():
                flat.append(get(" " + p))
                size.append(1)
                continue
            base = p.rstrip(SIGNS)
            if base and base.isalpha():
                flat += (get(" " + base), get(p[len(base) :]))
                size.append(2)
            else:
                codes = [get(x) for x in self._cut(p)]
                flat += codes
                size.append(len(codes))
        self._learn_parts()
        ids, length = self.part_runs.get(np.array(flat, np.int64))
        first = np.cumsum(size) - size
        self.runs.add(ids, np.add.reduceat(length, first))

    def _learn_parts(self) -> None:
        """Encode the parts met for the first time; many words go through the library as the lines of one text.

        A word with a space before it and no other white space keeps its ids between line ends, and no word has a
        line end's id.
        """
        new, self.parts.new = self.parts.new, []
        done, flat, size = [], [], []
        word = [i for i, x in enumerate(new) if x[0] == " " and x[1:].isalpha()]
        for at in range(0, len(word), 1000):
            own = word[at : at + 1000]
            got = np.array(self.tok.encode_batch_fast(["\n".join([new[i] for i in own])], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(got == self.line_end)
            if len(ends) == len(own) - 1:
                done += own
                flat.append(np.delete(got, ends))
                size.append(np.diff(np.append(ends, len(got)), prepend=-1) - 1)
        rest = sorted(set(range(len(new))).difference(done))
        lists = [e.ids for e in self.tok.encode_batch_fast([new[i] for i in rest], add_special_tokens=False)]
        flat.append(np.fromiter(chain.from_iterable(lists), np.uint32))
        size.append(np.fromiter(map(len, lists), np.int64, len(lists)))
        size = np.concatenate(size)
        start, order = np.cumsum(size) - size, np.argsort(np.array(done + rest, np.int64))
        self.part_runs.add(gather(np.concatenate(flat), start[order], size[order]), size[order])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with the end id, laid end to end; number of ids of each)."""
        if not self.by_pieces:
            lists = [[*e.ids, self.end] for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
            return np.fromiter(chain.from_iterable(lists), np.uint32), np.array([len(x) for x in lists], np.int64)
        if len(self.pieces) > self.limit:
            self.reset()
        get = self.pieces.__getitem__
        codes, sizes, heads = [], [], []
        for text in texts:
            pieces = text.split(" ")
            if min(pieces) < "!" or not text.isascii() and RARE_SPACE.search(text):
                pieces = re.split(r" (?=\S)", text)
            heads.append(pieces[0])
            codes += map(get, pieces[1:])
            codes.append(0)
            sizes.append(len(pieces))
        self._learn()
        code = np.array(codes, np.int64)
        ids, length = self.runs.get(code)
        # What stands before a text's first space has no space before it.
        first = [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(heads, add_special_tokens=False)]
        at = np.cumsum(sizes) - sizes
        ids = np.insert(ids, np.repeat(np.append(0, np.cumsum(length))[at], [len(f) for f in first]), np.concatenate([*first, np.empty(0, np.uint32)]))
        ends = np.cumsum(np.insert(length, at, [len(f) for f in first]))
        last = np.cumsum(np.array(sizes, np.int64) + 1) - 1
        return ids, np.diff(ends[last], prepend=0)


def encoder(path: str, end: int) -> WordEncoder:
    """The worker's encoder of a vocabulary file; later tasks of the worker go on with it."""
    return kept(("rans", path, end), lambda: WordEncoder(path, end))


RAW = "shard int, block int, first_token long, doc_ids binary, lens binary, ids binary, counts binary"
CODED = "shard int, block int, first_token long, doc_ids binary, lens binary, n_tokens long, states binary, words binary, ids_crc32 long"


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end: int = 2, bits: int = 18, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode every text (null: empty; bytes that are no UTF-8 count as U+FFFD) and write the ids, each document with the end id, below path.

    Documents are dealt to shards by ranges of doc_id and sorted within, ties by text; a null doc_id
    comes first. An empty table gives an empty file. Texts are tokenized once; the ids wait in the shared folder
    until all are counted.
    """
    spark = docs.sparkSession
    raw_schema, coded_schema = _arrow(RAW), _arrow(CODED)

    def tokenize(batches):
        enc = encoder(vocabulary, end)
        kind = np.uint16 if enc.size <= 1 << 16 else np.uint32
        shard, block, first, counts = TaskContext.get().partitionId(), 0, 0, np.zeros(enc.size, np.int64)
        held, held_ids = [], 0

        def flush(last):
            nonlocal block, first, held, held_ids
            ids = np.concatenate([h[2] for h in held]) if held else np.empty(0, np.uint32)
            row = [[shard], [block], [first], *([b"".join(h[i].tobytes() for h in held)] for i in (0, 1)), [ids.astype(kind).tobytes()], [counts.tobytes() if last else None]]
            block, first, held, held_ids = block + 1, first + len(ids), [], 0
            return record(raw_schema, *row)

        for piece, texts in text_slices(batches, limit=1 << 20):
            if len(texts) == 1 and len(texts[0]) > PART:  # a long text in parts, of which the last alone has the end id
                parts = enc.cut_long(texts[0].decode("utf-8", "replace"))
                found = [enc.encode([p])[0][: None if i == len(parts) - 1 else -1] for i, p in enumerate(parts)]
                ids = np.concatenate(found)
                lens = np.array([len(ids)])
            else:
                ids, lens = enc.encode([t.decode("utf-8", "replace") for t in texts])
            counts += np.bincount(ids, minlength=enc.size)
            who = piece.column(0).fill_null(-1)
            null = np.asarray(piece.column(0).is_null())
            who = np.where(null, np.iinfo(np.int64).min, np.asarray(who))
            ends = np.cumsum(lens)
            a = 0
            while a < len(lens):
                room = BLOCK - held_ids + (ends[a - 1] if a else 0)
                b = max(a + 1, int(np.searchsorted(ends, room, "right")))  # a document is whole in one block, a long one alone in it
                lo, hi = (ends[a - 1] if a else 0), ends[b - 1]
                if held and held_ids + hi - lo > 2 * BLOCK:
                    yield flush(False)
                held.append((who[a:b], lens[a:b].astype(np.int64), ids[lo:hi]))
                held_ids += int(hi - lo)
                if held_ids >= BLOCK * 15 // 16:
                    yield flush(False)
                a = b
        if block or held:
            yield flush(True)

    ordered = docs.select(F.col(doc_id).cast("long").alias(doc_id), F.coalesce(F.col(text), F.lit("")).cast("binary").alias(text))
    ordered = ordered.repartitionByRange(F.col(doc_id)).sortWithinPartitions(doc_id, text)
    raw = materialize(ordered.mapInArrow(tokenize, RAW), "rans-raw")

    def sums(batches):
        total = None
        for batch in batches:
            for c in batch.column(0).to_pylist():
                got = np.frombuffer(c, np.int64)
                total = got if total is None else total + got
        if total is not None:
            some = np.flatnonzero(total)
            yield record(pa.schema([("id", pa.int64()), ("n", pa.int64())]), some, total[some])

    counted = raw.where("counts is not null").select("counts").mapInArrow(sums, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    rows = counted.collect()  # one row for each entry of the vocabulary at most
    counts = np.zeros(max((r.id for r in rows), default=0) + 1, np.int64)
    for r in rows:
        counts[r.id] = r.n
    freq = quantise(counts, bits)
    cum = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
    spark.createDataFrame([(int(i), int(freq[i]), bits) for i in np.flatnonzero(freq)], "id int, freq long, bits int").coalesce(1).write.parquet(f"{path}/table")

    def code(batches):
        def flush(rows):
            # As wide as they were written, which depends on the vocabulary and not on the ids that occur.
            wide = [len(r["ids"]) > 2 * int(np.frombuffer(r["lens"], np.int64).sum()) for r in rows]
            ids = [np.frombuffer(r["ids"], np.uint32 if w else np.uint16).astype(np.uint32) for r, w in zip(rows, wide)]
            some = [i for i, x in enumerate(ids) if len(x)]
            done = dict(zip(some, encode_blocks([ids[i] for i in some], freq, cum, bits))) if some else {}
            cols = [[r[c] for r in rows] for c in ("shard", "block", "first_token", "doc_ids", "lens")]
            return record(coded_schema, *cols, [len(x) for x in ids], *([done.get(i, (b"", b""))[k] for i in range(len(ids))] for k in (0, 1)), [zlib.crc32(x.tobytes()) for x in ids])

        held = []
        for batch in batches:
            for r in range(len(batch)):
                own = batch.slice(r, 1).to_pylist()
                if held and (len(held) == WIDTH or len(own[0]["ids"]) > 8 * BLOCK):  # blocks side by side are as wide as the longest
                    yield flush(held)
                    held = []
                held += own
                if len(own[0]["ids"]) > 8 * BLOCK:
                    yield flush(held)
                    held = []
        if held:
            yield flush(held)

    raw.select("shard", "block", "first_token", "doc_ids", "lens", "ids").mapInArrow(code, CODED).write.parquet(f"{path}/blocks")
    drop_scratch(raw)
    totals = spark.read.parquet(f"{path}/blocks").groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect()  # a row for each shard
    first, manifest = 0, []
    for r in sorted(totals, key=lambda r: r.shard):
        manifest.append((r.shard, first))
        first += r.n
    spark.createDataFrame(manifest, "shard int, first long").coalesce(1).write.parquet(f"{path}/manifest")


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document, decoded block by block.

    start: ids of all documents before it. ids: little-endian unsigned 32-bit integers. A block whose
    checksum fails raises an error. The file of an empty table gives no rows; null ids and repeated documents
    keep a row each.
    """
    table = spark.read.parquet(f"{path}/table").collect()  # bounded by the vocabulary
    bits = table[0].bits if table else 1
    freq = np.zeros(max((r.id for r in table), default=0) + 1, np.uint64)
    for r in table:
        freq[r.id] = r.freq
    cum = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
    before = {r.shard: r.first for r in spark.read.parquet(f"{path}/manifest").collect()}  # a row for each shard
    ddl = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    schema = _arrow(ddl)

    def run(batches):
        slots = np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64))

        def flush(rows):
            some = [r for r in rows if r["n_tokens"]]
            parts = decode_blocks([(r["states"], r["words"], r["n_tokens"]) for r in some], freq, cum, slots, bits) if some else []
            for r, ids in zip(some, parts):
                if zlib.crc32(ids.tobytes()) != r["ids_crc32"]:
                    raise ValueError(f"checksum of block {r['shard']}/{r['block']} fails")
                who, lens = np.frombuffer(r["doc_ids"], np.int64), np.frombuffer(r["lens"], np.int64)
                ends = np.cumsum(lens)
                own = [ids[b - n : b].tobytes() for b, n in zip(ends, lens)]
                who = pa.array(who, mask=who == np.iinfo(np.int64).min)
                yield record(schema, who, before[r["shard"]] + r["first_token"] + ends - lens, lens, [zlib.crc32(x) for x in own], *([own] if with_ids else []))

        held = []
        for batch in batches:
            for k in range(len(batch)):
                own = batch.slice(k, 1).to_pylist()
                if held and (len(held) == WIDTH or own[0]["n_tokens"] > 4 * BLOCK):
                    yield from flush(held)
                    held = []
                held += own
                if own[0]["n_tokens"] > 4 * BLOCK:
                    yield from flush(held)
                    held = []
        if held:
            yield from flush(held)

    return spark.read.parquet(f"{path}/blocks").mapInArrow(run, ddl)


def token_digest(docs: DataFrame, vocabulary: str, end: int = 2) -> DataFrame:
    """Write the ids of docs to a new file in the shared folder and read their digests back.

    As in write_tokens: null texts are empty, a null doc_id comes first, repeated rows keep a row each with ties by text, an empty table
    gives no rows, other columns are not looked at.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "tokens")
    write_tokens(docs, path, vocabulary, end)
    return read_tokens(spark, path, with_ids=False)
