"""Running aggregates by key over range partitions, whatever share of the rows one key holds [T10, T12, T17, G5, G8]."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldsmith.session import materialize

#: What two neighbouring stretches of a key's rows have together, by the kind of the aggregate.
MERGED = {
    "sum": F.sum,
    "max": F.max,
    "min": F.min,
    "bit_xor": F.bit_xor,
    "last": lambda c: F.last(c, ignorenulls=True),
}
_BOTH = {"sum": lambda a, b: a + b, "max": F.greatest, "min": F.least, "bit_xor": lambda a, b: a.bitwiseXOR(b), "last": lambda a, b: F.coalesce(b, a)}


def running(df: DataFrame, by: list[str], order: list[Column], columns: dict[str, tuple[str, Column]]) -> DataFrame:
    """df with a running aggregate for each entry name: (kind of MERGED, value), over the rows of equal `by` up to the row itself.

    A window would send all rows of a key to one task. Here the rows are dealt to ranges of (by, order), so that a key with
    many rows covers several ranges; each range aggregates its own rows and takes over what its first key had in the ranges
    before. Those carries are rows of keys that begin or end a range, two for each range at most, and so are broadcast. Rows
    that are equal in `by` and `order` follow each other in some order. Null keys are keys like any other; a value that is
    null adds nothing. The order of the result is not defined.
    """
    taken = [*df.columns, *columns]
    part, nth, key, end, at = (_unused(n, taken) for n in ("_part", "_nth", "_key", "_end", "_at"))
    own = {n: _unused(f"_own_{i}", taken) for i, n in enumerate(columns)}
    x = df.withColumns({own[n]: v for n, (_, v) in columns.items()}).withColumn(key, F.struct(*by) if by else F.lit(0))
    ranged = x.repartitionByRange(*by, *order) if by or order else x
    mono = F.monotonically_increasing_id()
    ranged = ranged.sortWithinPartitions(*by, *order).withColumn(part, F.shiftright(mono, 33).cast("int")).withColumn(nth, mono.bitwiseAND(F.lit((1 << 33) - 1)))
    ranged = materialize(ranged, "running")
    ends = ranged.groupBy(part).agg(F.min_by(key, nth).alias("a"), F.max_by(key, nth).alias("b")).select(F.explode(F.array("a", "b")).alias(end)).distinct()
    edge = ranged.join(F.broadcast(ends), F.col(key).eqNullSafe(F.col(end)), "left_semi")
    held = edge.groupBy(key, part).agg(*(MERGED[kind](own[n]).alias(own[n]) if kind != "last" else F.max_by(own[n], F.when(F.col(own[n]).isNotNull(), F.col(nth))).alias(own[n]) for n, (kind, _) in columns.items()))
    before = Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range that the key covers
    carry = held.select(F.col(key).alias(end), F.col(part).alias(at), *(MERGED[kind](F.col(own[n])).over(before).alias("c" + own[n]) for n, (kind, _) in columns.items()))
    inside = Window.partitionBy(part, key).orderBy(nth).rowsBetween(Window.unboundedPreceding, 0)
    x = ranged.withColumns({own[n]: MERGED[kind](F.col(own[n])).over(inside) for n, (kind, _) in columns.items()})
    x = x.join(F.broadcast(carry), F.col(key).eqNullSafe(F.col(end)) & (F.col(part) == F.col(at)), "left")
    total = {}
    for n, (kind, _) in columns.items():
        a, b = F.col("c" + own[n]), F.col(own[n])
        total[n] = F.coalesce(_BOTH[kind](a, b), a, b)
    return x.select(*(F.col(c) for c in df.columns if c not in columns), *(c.alias(n) for n, c in total.items()))


def _unused(name: str, taken: list[str]) -> str:
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name += "_"
    return name
