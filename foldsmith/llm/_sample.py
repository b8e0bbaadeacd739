"""Bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounded_sample(df: DataFrame, keys: list[str], limit: int, seed: int = 17) -> DataFrame:
    """`limit` rows of df, those with the least hashes of the keys; all rows if there are fewer.

    Rows with equal keys count as equal, and the keys should be all that tells rows apart: then the same rows are chosen
    at every run and partitioning, of repeated rows as many as fit. A count, and a filter by hash that leaves
    about limit / 3 rows too many, come before the ordering, so each task sends few rows.
    """
    n = df.select(*keys).count()
    if n <= limit:
        return df
    share = int(min(1.0, (limit + 4 * limit**0.5) * 4 / 3 / n) * (1 << 62))
    order = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 2)
    near = df.withColumn("_order", order)
    first = near.where(F.col("_order") < share)
    # With many equal keys the filter may leave too few.
    return (first if first.limit(limit).count() == limit else near).orderBy("_order", *keys).limit(limit).drop("_order")
