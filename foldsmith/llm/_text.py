"""Helpers that the text operators share inside Arrow tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame

#: Bytes of text that a task holds as Python objects at a time.
SLICE_BYTES = 2 << 20


def text_slices(batches: Iterable[pa.RecordBatch], text: int = 1, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cut record batches so that each piece has about `limit` bytes of text, or one row.

    Yields the piece and its texts as UTF-8 bytes; a null text counts as empty.
    """
    for batch in batches:
        col = batch.column(text)
        if not pa.types.is_binary(col.type):
            col = col.cast(pa.binary())
        size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(col), 0))
        block = np.cumsum(size) // limit
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1), len(batch)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a), [t or b"" for t in col.slice(a, b - a).to_pylist()]


def binary_text(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns, the last one as bytes, so that no task decodes text it only splits."""
    *head, text = columns
    return docs.select(*head, docs[text].cast("binary").alias(text))


def record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    """A record batch of the schema from lists, NumPy or Arrow arrays."""
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def set_aside(docs: DataFrame, *names: str) -> DataFrame:
    """docs with its columns of these names renamed to make room for new ones: `score` becomes `score_in`, or `score_in_in` if that is taken.

    Names that differ in case alone are the same, as they are to Spark.
    """
    wanted = {n.lower() for n in names}
    for name in docs.columns:
        if name.lower() in wanted:
            taken = {c.lower() for c in docs.columns}
            new = name
            while new.lower() in taken | wanted:
                new += "_in"
            docs = docs.withColumnRenamed(name, new)
    return docs


def unused(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have, in any case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name
