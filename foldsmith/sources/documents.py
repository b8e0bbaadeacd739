"""One JSON document of any size as rows, by many tasks [S3, S14, S20].

A document `{"key": [element, ...], ...}` is read as text that is cut at every `}`, so that Spark splits the file. Whether a place is
inside a string, and how deep, depends on all that stands before it: each split tells what it changes for both cases, the driver adds
that up, a row for each split, and each split then finds its elements alone. White space and the order of the keys do not matter.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldsmith.operators.audit import Unreadable
from foldsmith.session import materialize

QUOTE, OPEN, CLOSE = 1, 2, 3
_KIND = np.zeros(256, np.uint8)
_KIND[[ord('"')]], _KIND[[ord("{"), ord("[")]], _KIND[[ord("}"), ord("]")]] = QUOTE, OPEN, CLOSE
#: What follows the name of a part of the document.
_NAMED = re.compile(rb"\s*:\s*[\[{]")
WHOLE, NAME, PIECE = 0, 1, 2


def _pieces(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(doc, block, value): the text up to each `}`, in order within a block, which is a split of the file that begins at that byte."""
    each = (spark.read.text(p, lineSep="}").select(F.lit(i).alias("doc"), F.col("_metadata.file_block_start").alias("block"), F.concat("value", F.lit("}")).cast("binary").alias("value")) for i, p in enumerate(paths))
    return reduce(DataFrame.union, each)


def _stretches(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], bytes]]:
    """((doc, block), text) of the rows of one block that come together."""
    for batch in batches:
        if not batch.num_rows:
            continue
        doc, block = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        cuts = [0, *(np.flatnonzero((np.diff(doc) != 0) | (np.diff(block) != 0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield (int(doc[a]), int(block[a])), b"".join(batch.column(2).slice(a, b - a).to_pylist())


def _signs(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, kinds, quotes so far mod 2) of the quotes and brackets of a text that does not begin after an open backslash."""
    if b"\\" in text:
        text = text.replace(b"\\\\", b"__").replace(b'\\"', b"__")
    kind = _KIND[np.frombuffer(text, np.uint8)]
    at = np.flatnonzero(kind)
    kind = kind[at]
    return at, kind, np.cumsum(kind == QUOTE, dtype=np.uint8) & 1


def _changes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, block, bytes, odd, out, inside): whether the block turns a string's state, and its change of depth if it begins outside or inside one."""
    found: dict[tuple[int, int], list[int]] = {}
    for key, text in _stretches(batches):
        _, kind, odd = _signs(text)
        own = found.setdefault(key, [0, 0, 0, 0])
        step = (kind == OPEN).astype(np.int64) - (kind == CLOSE)
        change = [int(step[odd == 0].sum()), int(step[odd == 1].sum())]
        own[0] += len(text)
        own[2] += change[own[1]]
        own[3] += change[1 - own[1]]
        own[1] ^= int(odd[-1]) if len(odd) else 0
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*((*k, *v) for k, v in found.items()))], names=["doc", "block", "bytes", "odd", "out", "inside"])


def _begins(pieces: DataFrame, paths: list[str]) -> dict[tuple[int, int], tuple[int, int, int]]:
    """(place in the document, inside a string, depth) at which each block begins; raises where a document does not end as it began."""
    rows = pieces.mapInArrow(_changes, "doc long, block long, bytes long, odd long, out long, inside long").collect()  # a row for each split of a file
    begins, state = {}, {i: (0, 0, 0) for i in range(len(paths))}
    for r in sorted(rows, key=lambda r: (r.doc, r.block)):
        at, string, depth = begins[r.doc, r.block] = state[r.doc]
        state[r.doc] = at + r.bytes, string ^ r.odd, depth + (r.inside if string else r.out)
    for i, (_, string, depth) in state.items():
        if string or depth not in (0, -1):  # what stands after the last bracket is taken for one more
            raise Unreadable(f"{paths[i]} is no whole JSON document")
    return begins


def _events(begins: dict[tuple[int, int], tuple[int, int, int]]):
    """A function of pieces to (doc, at, kind, opens, value): elements, names of the document's parts, and pieces of elements that reach over a block's end."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at, string, depth, held, since, opens = None, 0, 0, 0, [], 0, True

        def rows(doc, out):
            cols = list(zip(*out))
            return pa.RecordBatch.from_arrays([pa.array([doc] * len(out), pa.int32()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.bool_()), pa.array(cols[3], pa.binary())], names=["doc", "at", "kind", "opens", "value"])

        for key, text in _stretches(batches):
            if key != now:
                if held:
                    yield rows(now[0], [(since, PIECE, opens, b"".join(held))])
                now, held = key, []
                at, string, depth = begins[key]
                since, opens = at, depth < 3
                in_element = depth >= 3
            place, kind, odd = _signs(text)
            out_of = (odd ^ string) == 0
            step = np.where(out_of, (kind == OPEN).astype(np.int64) - (kind == CLOSE), 0)
            deep = depth + np.cumsum(step)
            first, last = place[(step > 0) & (deep == 3)].tolist(), (place[(step < 0) & (deep == 2)] + 1).tolist()
            out = []
            if in_element:  # begun before this text
                if last:
                    end = last.pop(0)
                    out.append((since, WHOLE if opens else PIECE, opens, b"".join([*held, text[:end]])))
                    in_element, held = False, []
                else:
                    held.append(text)
            out += [(at + a, WHOLE, True, text[a:b]) for a, b in zip(first, last)]
            if len(first) > len(last):
                in_element, held, since, opens = True, [text[first[-1] :]], at + first[-1], True
            ends = np.flatnonzero((kind == QUOTE) & out_of & (deep == 1))  # a string at the top ends there
            for i in ends.tolist():
                if _NAMED.match(text, int(place[i]) + 1):
                    begun = int(place[i - 1]) if i else -1
                    name = json.loads(text[begun : place[i] + 1]) if begun >= 0 and kind[i - 1] == QUOTE else ""
                    out.append((at + int(place[i]), NAME, True, name.encode()))
            if out:
                yield rows(key[0], out)
            at, string, depth = at + len(text), string ^ (int(odd[-1]) if len(odd) else 0), int(deep[-1]) if len(deep) else depth
        if held:
            yield rows(now[0], [(since, PIECE, opens, b"".join(held))])

    return run


def _split(spark: SparkSession, paths: list[str]) -> tuple[dict[tuple[int, int], tuple[int, int, int]], DataFrame]:
    """(where the blocks begin, the events of all documents as a table). Both passes see the same blocks, even if executors come or go between them."""
    setting = "spark.sql.files.minPartitionNum"
    was = spark.conf.get(setting, None)
    spark.conf.set(setting, was or str(max(1, spark.sparkContext.defaultParallelism)))
    try:
        pieces = _pieces(spark, paths)
        begins = _begins(pieces, paths)
        return begins, materialize(pieces.mapInArrow(_events(begins), "doc int, at long, kind int, opens boolean, value binary"), "elements")
    finally:
        spark.conf.set(setting, was) if was else spark.conf.unset(setting)


def elements(spark: SparkSession, paths: list[str], names: list[str]) -> list[DataFrame]:
    """(doc, value) of the objects in each named list of JSON documents, doc the place in paths; raises where a document breaks off.

    The elements are written to the shared folder once. A block that begins inside an element gives its piece, and the pieces of such elements, two at most for a
    block, are put together again.
    """
    begins, found = _split(spark, paths)
    text = F.col("value").cast("string")
    whole = found.where(F.col("kind") == WHOLE).select("doc", "at", text.alias("value"))
    if any(depth >= 3 for _, _, depth in begins.values()):
        nth = F.sum(F.col("opens").cast("int")).over(Window.partitionBy("doc").orderBy("at"))
        cut = found.where(F.col("kind") == PIECE).withColumn("nth", nth).groupBy("doc", "nth").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("p"))
        joined = F.aggregate(F.col("p.value"), F.lit(b""), lambda a, b: F.concat(a, b))
        whole = whole.union(cut.select("doc", F.col("p")[0]["at"].alias("at"), joined.cast("string").alias("value")))
    parts = found.where(F.col("kind") == NAME).select("doc", "at", text.alias("name")).orderBy("doc", "at").collect()  # a row for each part of a document
    spans = [(p.doc, p.at, q.at if q and q.doc == p.doc else None, p.name) for p, q in zip(parts, [*parts[1:], None])]

    def inside(name: str) -> Column:
        own = (((F.col("doc") == d) & (F.col("at") > a) & (F.lit(True) if b is None else F.col("at") < b)) for d, a, b, n in spans if n == name)
        return reduce(Column.__or__, own, F.lit(False))

    return [whole.where(inside(n) & F.col("value").startswith("{")).select("doc", "value") for n in names]
