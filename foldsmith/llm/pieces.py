"""SentencePiece encoding and decoding by a max-plus parallel scan.

A text's pieces are the path with the greatest sum of scores through the lattice of the vocabulary's
pieces. Long documents are cut into chunks of characters. A cut's state is the number of characters
that the piece across it reaches beyond, so a chunk is a matrix of best scores from its entry to its exit
states, and chunks combine by the associative max-plus product. The states at all cuts follow from the
matrices alone; every chunk then finds its own pieces between its two states.

Scores are whole numbers in float64, so sums are exact in any order. A piece never holds a word start
(the sign U+2581) but at its own beginning, or is a run of that sign alone. So no piece goes on from another
character to a word start: a word is a unit with the run of signs before it, and units met are kept.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldsmith.llm._kept import Codes, Runs, kept
from foldsmith.llm._text import record, set_aside, text_slices, unused
from foldsmith.session import materialize

#: The sign of a word start, what stands for that sign where the text itself has it, and a cut between units; no text has the last two.
START, MARK, CUT = "▁", "\ud800", "\ud801"
#: The beginning of a run of word starts.
RUN = re.compile(f"[^{START}]{START}")
#: Least score of a piece (a lone word start and the runs of it have no score of their own), and that of a character spelt by its bytes.
LEAST_SCORE, BYTES_SCORE = -50_000.0, -100_000.0
#: Multipliers of the piece table's hash; characters of units whose paths are found side by side.
FACTOR, MIX, SHORT = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15), 48
#: Characters of a chunk; documents of fewer than two chunks are encoded in one.
CHUNK = 16_384
NONE = -np.inf


class Vocabulary:
    """Pieces of a model file with their scores, and its bytes."""

    def __init__(self, path: str, limit: int = 300_000):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids, self.text, self.byte = {}, [], [0] * 256
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.text.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.text.append(b"")
            else:
                self.text.append(piece.replace(START, " ").encode())
                self.ids[piece] = (max(sp.get_score(i), LEAST_SCORE), i)
                if START in piece[1:] and piece.strip(START):
                    raise ValueError(f"piece {i} goes on to a word start, where units are cut")
        self.longest = max(map(len, self.ids))
        self.line_ends = not any("\n" in p for p in self.ids)
        self.limit = limit
        self.reset()
        # Pieces by a hash of their characters, in an open table.
        size = 1 << 18
        self.slot_hash, self.slot_score, self.slot_id = np.zeros(size, np.uint64), np.full(size, NONE), np.zeros(size, np.int64)
        for piece, (score, i) in self.ids.items():
            h = 0
            for c in piece:
                h = (h * int(FACTOR) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
            at = h * int(MIX) >> 46 & size - 1
            while self.slot_hash[at]:
                at = (at + 1) % size
            self.slot_hash[at], self.slot_score[at], self.slot_id[at] = h, score, i

    def reset(self):
        self.codes, self.runs, self.scores = Codes(), Runs(), np.zeros(1 << 12)

    def forward(self, s: str, start: int = 0) -> tuple[list[float], list[str]]:
        """Best score and last piece of every prefix of s[start:]; ties go to the longest last piece."""
        best, last = [NONE] * (len(s) + 1), [""] * (len(s) + 1)
        best[start] = 0.0
        get, longest = self.ids.get, self.longest
        for j in range(start + 1, len(s) + 1):
            top, piece = best[j - 1] + BYTES_SCORE, ""
            for i in range(max(start, j - longest), j):
                hit = get(s[i:j])
                if hit and best[i] + hit[0] > top:
                    top, piece = best[i] + hit[0], s[i:j]
            best[j], last[j] = top, piece
        return best, last

    def unit(self, s: str) -> tuple[float, list[int]]:
        """(score, ids) of the best path through a text, usually a run of word starts and the word after it."""
        best, last = self.forward(s)
        out, j = [], len(s)
        while j:
            if last[j]:
                out.append((self.ids[last[j]][1],))
                j -= len(last[j])
            else:
                out.append(tuple(self.byte[b] for b in s[j - 1].replace(MARK, START).encode()))
                j -= 1
        return best[len(s)], [i for part in reversed(out) for i in part]

    def units(self, s: str) -> list[str]:
        """The text cut before runs of word starts and, as no piece has them, around line ends; some units may be empty."""
        s = s.replace(START, CUT + START).replace(START + CUT, START)
        return (s.replace("\n", f"{CUT}\n{CUT}") if self.line_ends else s).split(CUT)

    def segment(self, s: str) -> tuple[float, list[int]]:
        """(score, ids) of the best path through a text whose spaces are word starts."""
        ids, _, score = self.segment_all([self.units(s)])
        return float(score[0]), ids.tolist()

    def segment_all(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids end to end, number of ids of each, score of each) of texts given by their units."""
        if len(self.codes) > self.limit or self.runs.n > 16 * self.limit:
            self.reset()
        get = self.codes.__getitem__
        code = np.array([c for units in texts for c in map(get, units)], np.int64)
        new, self.codes.new = self.codes.new, []
        self._learn(new)
        ids, length = self.runs.get(code)
        text = np.repeat(np.arange(len(texts)), [len(u) for u in texts])
        return ids, np.bincount(text, length, len(texts)).astype(np.int64), np.bincount(text, self.scores[code], len(texts))

    def _learn(self, new: list[str]) -> None:
        """Find the paths of units met for the first time, short ones side by side."""
        paths: list = [None] * len(new)
        score = np.zeros(len(new))
        short = [i for i, u in enumerate(new) if 0 < len(u) <= SHORT]
        for at in range(0, len(short), 8192):
            part = short[at : at + 8192]
            best, found = self._paths([new[i] for i in part])
            score[part] = best
            for i, ids in zip(part, found):
                paths[i] = ids
        for i, u in enumerate(new):
            if paths[i] is None:
                score[i], paths[i] = self.unit(u)
        first = self.runs.count
        self.runs.add(np.array([x for ids in paths for x in ids], np.uint32), np.array([len(ids) for ids in paths], np.int64))
        while self.runs.count > len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
        self.scores[first : self.runs.count] = score

    def _paths(self, units: list[str]) -> tuple[np.ndarray, list]:
        """unit() of many short units in NumPy; None for a path that needs bytes."""
        order = sorted(range(len(units)), key=lambda i: -len(units[i]))
        size = np.array([len(units[i]) for i in order])
        n, width = len(units), int(size[0])
        text = "".join(units[i].ljust(width, "\0") for i in order)
        chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, width).astype(np.uint64)
        power = np.cumprod(np.append(np.uint64(1), np.full(self.longest, FACTOR)))
        prefix = np.zeros((n, width + 1), np.uint64)
        for j in range(width):
            prefix[:, j + 1] = prefix[:, j] * FACTOR + chars[:, j] + np.uint64(1)
        best, back, last = np.full((n, width + 1), NONE), np.zeros((n, width + 1), np.int64), np.full((n, width + 1), -1, np.int64)
        best[:, 0] = 0
        mask = len(self.slot_hash) - 1
        for j in range(1, width + 1):
            m = int(np.searchsorted(-size, -j, "right"))  # units of j characters or more
            lo = max(0, j - self.longest)
            h = prefix[:m, j : j + 1] - prefix[:m, lo:j] * power[j - lo : 0 : -1]
            slot = (h * MIX >> np.uint64(46)).astype(np.int64) & mask
            open_ = np.nonzero((self.slot_hash[slot] != h) & (self.slot_hash[slot] != 0))
            while len(open_[0]):
                slot[open_] = (slot[open_] + 1) & mask
                seen = self.slot_hash[slot[open_]]
                go = (seen != h[open_]) & (seen != 0)
                open_ = open_[0][go], open_[1][go]
            total = best[:m, lo:j] + np.where(self.slot_hash[slot] == h, self.slot_score[slot], NONE)
            top = total.argmax(axis=1)  # ties go to the longest last piece
            rows = np.arange(m)
            value, spelt = total[rows, top], best[:m, j - 1] + BYTES_SCORE
            piece = value > spelt
            best[:m, j] = np.where(piece, value, spelt)
            back[:m, j] = np.where(piece, lo + top, j - 1)
            last[:m, j] = np.where(piece, self.slot_id[slot[rows, top]], -1)
        at, trail = size.copy(), []
        spelt = np.zeros(n, bool)
        while at.any():
            ids = np.where(at > 0, last[np.arange(n), at], -2)
            spelt |= ids == -1
            trail.append(ids)
            at = back[np.arange(n), at]
        trail = np.array(trail[::-1]).T.tolist()
        paths: list = [None] * n
        for k, i in enumerate(order):
            if not spelt[k]:
                paths[i] = [x for x in trail[k] if x >= 0]
        score = np.zeros(n)
        score[order] = best[np.arange(n), size]
        return score, paths

    def normalise(self, text: str) -> str:
        """Spaces as word starts, one more in front; an empty text stays empty."""
        return self.signs(" " + text) if text else ""

    def signs(self, text: str) -> str:
        return text.replace(START, MARK).replace(" ", START)

    def decode(self, ids: list[int]) -> str:
        """The text of ids that segment() gave for a normalised text."""
        table = self.text
        out = b"".join([table[i] for i in ids])
        return (out[1:] if out[:1] == b" " else out).decode("utf-8", "replace")

    def matrix(self, s: str, size: int) -> np.ndarray:
        """Best scores from entry state a to exit state b of a chunk: s begins at the chunk and goes on `longest` - 1 characters beyond its `size`."""
        k = self.longest
        out = np.full((k, k), NONE)
        found = RUN.search(s, k - 1)
        sync = found.end() - 1 if found else size  # every path has a cut here, before a run of word starts
        if sync < size:
            tail = s.rfind(START, sync, size)
            while s[tail - 1] == START:
                tail -= 1
            mid = self.segment(s[sync:tail])[0]
            ends = self._exits(s[tail:], size - tail, 0)
            for a in range(k):
                head = self.forward(s[:sync], a)[0][sync]
                out[a] = head + mid + ends
            return out
        for a in range(min(k, size + 1)):
            out[a] = self._exits(s, size, a)
        return out

    def _exits(self, s: str, size: int, a: int) -> np.ndarray:
        """Best scores of paths from a to size + b whose pieces begin before size."""
        k = self.longest
        best = self.forward(s[:size], a)[0]
        out = np.full(k, NONE)
        out[0] = best[size]
        for b in range(1, min(k, len(s) - size + 1)):
            for i in range(max(a, size + b - k), size):
                hit = self.ids.get(s[i : size + b])
                if hit:
                    out[b] = max(out[b], best[i] + hit[0])
        return out


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product of (stacks of) matrices."""
    return (a[..., :, :, None] + b[..., None, :, :]).max(axis=-2)


def prefix_products(mats: np.ndarray) -> np.ndarray:
    """All prefix products in a logarithmic number of rounds; the product's order is kept."""
    out, d = mats.copy(), 1
    while d < len(out):
        nxt = out.copy()
        for at in range(d, len(out), 4096):  # bounds the product's temporary array
            nxt[at : at + 4096] = max_plus(out[at - d : min(at + 4096, len(out)) - d], out[at : at + 4096])
        out, d = nxt, 2 * d
    return out


def cut_states(mats: np.ndarray) -> np.ndarray:
    """Entry state of every chunk and, last, the state at the end (0), on a best path; ties go to the least state."""
    before = prefix_products(mats)[:, 0, :]  # best score of each exit state
    states = np.zeros(len(mats) + 1, np.int64)
    for c in range(len(mats) - 1, 0, -1):
        states[c] = int(np.argmax(before[c - 1] + mats[c][:, states[c + 1]]))
    return states


def vocabulary(path: str) -> Vocabulary:
    """The worker's vocabulary of a model file; later tasks of the worker go on with its kept units."""
    return kept(("pieces", path), lambda: Vocabulary(path))


def encode(docs: DataFrame, model: str, text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """docs with n_tokens long, score double and ids binary (little-endian unsigned 32-bit integers).

    Every row is kept with all its columns; one that is named like a new column is renamed, `score` to `score_in`. A null or
    empty text has no ids and score 0, bytes that are no UTF-8 count as U+FFFD, an empty table stays empty. Documents of two
    chunks or more go through the scan; all others are a single chunk and need no shuffle.
    """
    longest = Vocabulary(model).longest
    chunk = max(chunk, 2 * longest)
    docs = set_aside(docs, "n_tokens", "score", "ids")
    size = F.length(F.coalesce(F.col(text), F.lit("")))
    short = _encode_whole(docs.where(size < 2 * chunk), model, text)
    row = unused(docs, "_row")
    giants = materialize(docs.where(size >= 2 * chunk).withColumn(row, F.monotonically_increasing_id()), "pieces-giants")
    if giants.isEmpty():
        return short
    made = _encode_chunks(giants.select(F.col(row).alias("_row"), F.col(text).alias("text")), model, chunk, longest)
    long = giants.join(made.withColumnRenamed("_row", row), row).drop(row)
    return short.unionByName(long)


def _encode_whole(docs: DataFrame, model: str, text: str) -> DataFrame:
    at = docs.columns.index(text)
    names = [*docs.columns, "n_tokens", "score", "ids"]
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "n_tokens long, score double, ids binary"])

    def run(batches):
        voc = vocabulary(model)
        for piece, texts in text_slices(batches, at, 1 << 20):
            ids, size, score = voc.segment_all([voc.units(voc.normalise(t.decode("utf-8", "replace"))) for t in texts])
            ends = np.cumsum(size)
            cells = [ids[b - n : b].astype("<u4").tobytes() for b, n in zip(ends, size)]
            more = [pa.array(size, pa.int64()), pa.array(score, pa.float64()), pa.array(cells, pa.binary())]
            yield pa.RecordBatch.from_arrays([*piece.columns, *more], names)

    return docs.mapInArrow(run, ddl)


def _encode_chunks(giants: DataFrame, model: str, chunk: int, longest: int) -> DataFrame:
    """(_row, n_tokens, score, ids) of documents (_row, text) of two chunks or more."""
    cut_schema = pa.schema([("_row", pa.int64()), ("c", pa.int64()), ("size", pa.int64()), ("s", pa.string())])

    def cut(batches):
        for piece, texts in text_slices(batches):
            for row, t in zip(piece.column(0).to_pylist(), texts):
                s = " " + t.decode("utf-8", "replace")
                n = len(s) // chunk
                for c in range(n):
                    size = chunk if c < n - 1 else len(s) - c * chunk
                    yield record(cut_schema, [row], [c], [size], [s[c * chunk : c * chunk + size + longest - 1]])

    # Chunks of one document go to different tasks.
    chunks = giants.mapInArrow(cut, "_row long, c long, size long, s string").repartition("_row", "c")
    schema = pa.schema([("_row", pa.int64()), ("c", pa.int64()), ("size", pa.int64()), ("s", pa.string()), ("m", pa.binary())])

    def matrices(batches):
        voc = vocabulary(model)
        for batch in batches:
            for k in range(0, len(batch), 64):
                rows = batch.slice(k, 64).to_pylist()
                m = [voc.matrix(voc.signs(r["s"]), r["size"]).tobytes() for r in rows]
                yield record(schema, *([r[c] for r in rows] for c in ("_row", "c", "size", "s")), m)

    made = materialize(chunks.mapInArrow(matrices, "_row long, c long, size long, s string, m binary"), "pieces-chunks")
    state_schema = pa.schema([("_row", pa.int64()), ("c", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def scan(t: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(t["c"]), kind="stable")
        m = t["m"].to_pylist()
        states = cut_states(np.stack([np.frombuffer(m[i], np.float64).reshape(longest, longest) for i in order]))
        n = len(order)
        return pa.table([pa.array([t["_row"][0].as_py()] * n), pa.array(np.arange(n)), pa.array(states[:-1]), pa.array(states[1:])], schema=state_schema)

    # A group has a matrix of 2 KB for each chunk of one document, whose text is itself one cell of the input.
    states = made.select("_row", "c", "m").groupBy("_row").applyInArrow(scan, "_row long, c long, a long, b long")
    done_schema = pa.schema([("_row", pa.int64()), ("c", pa.int64()), ("score", pa.float64()), ("ids", pa.binary())])

    def backtrace(batches):
        voc = vocabulary(model)
        for batch in batches:
            for k in range(0, len(batch), 64):
                rows = batch.slice(k, 64).to_pylist()
                got = [voc.segment(voc.signs(r["s"][r["a"] : r["size"] + r["b"]])) for r in rows]
                yield record(done_schema, [r["_row"] for r in rows], [r["c"] for r in rows], [x for x, _ in got], [np.array(i, "<u4").tobytes() for _, i in got])

    parts = made.drop("m").join(states, ["_row", "c"]).mapInArrow(backtrace, "_row long, c long, score double, ids binary")
    whole_schema = pa.schema([("_row", pa.int64()), ("n_tokens", pa.int64()), ("score", pa.float64()), ("ids", pa.binary())])

    def whole(t: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(t["c"]), kind="stable")
        own = t["ids"].to_pylist()
        ids = b"".join([own[i] for i in order])
        return pa.table([[t["_row"][0].as_py()], [len(ids) // 4], [float(np.asarray(t["score"]).sum())], [ids]], schema=whole_schema)

    # A group has the ids of one document, which are one cell of the result.
    return parts.groupBy("_row").applyInArrow(whole, "_row long, n_tokens long, score double, ids binary")


def decode(encoded: DataFrame, model: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """encoded with the text of its ids in a new column; null ids give null, an empty table stays empty. Repeated rows keep a row each.

    A column that is named like the new one is renamed, `decoded` to `decoded_in`.
    """
    encoded = set_aside(encoded, into)
    at = encoded.columns.index(ids)
    names = [*encoded.columns, into]
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema), f"`{into}` string"])

    def run(batches):
        voc = vocabulary(model)
        for piece, raw in text_slices(batches, at):
            null = np.asarray(piece.column(at).is_null())
            text = [None if x else voc.decode(np.frombuffer(r, "<u4").tolist()) for r, x in zip(raw, null)]
            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(text, pa.string())], names)

    return encoded.mapInArrow(run, ddl)


def digest(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_tokens, score, ids_crc32, round_trip) of every document, encoded and decoded again.

    A null text has no ids and counts as empty. Null ids and repeated rows keep a row each, other columns are left out, an empty table
    gives no rows.
    """
    own = docs.select(F.col(doc_id).cast("long").alias(doc_id), text)
    back = decode(encode(own, model, text, chunk), model)
    same = F.col("decoded") == F.coalesce(F.col(text), F.lit(""))
    return back.select(doc_id, "n_tokens", "score", F.crc32("ids").alias("ids_crc32"), same.alias("round_trip"))
