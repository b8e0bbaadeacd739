"""Contiguous numbers in a given order without a one-task window [I1-I8]."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldsmith.session import materialize


def with_index(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with 0, 1, 2, ... in the order of the columns, which must be total.

    Range partitions are numbered on their own; the driver only sums their sizes.
    """
    part = df.repartitionByRange(*order).sortWithinPartitions(*order)
    mono = F.monotonically_increasing_id()
    part = materialize(part.withColumn("_part", F.shiftright(mono, 33)).withColumn("_nth", mono.bitwiseAND(F.lit((1 << 33) - 1))), "index")
    total, rows = 0, []
    for r in sorted(part.groupBy("_part").count().collect(), key=lambda r: r["_part"]):  # a row for each partition
        rows.append((r["_part"], total))
        total += r["count"]
    first = df.sparkSession.createDataFrame(rows, "_part long, _first long")
    return part.join(F.broadcast(first), "_part").withColumn(name, F.col("_first") + F.col("_nth")).drop("_part", "_nth", "_first")


def split_offsets(images: DataFrame, split_ord: str = "split_ord", image_id: str = "id") -> DataFrame:
    """(split_ord, offset): each split starts after the greatest id of all earlier ones; one row for each split."""
    top = images.groupBy(split_ord).agg((F.max(image_id) + 1).alias("n"))
    before = Window.orderBy(split_ord).rowsBetween(Window.unboundedPreceding, -1)
    return top.select(split_ord, F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("offset"))


def category_numbers(categories: DataFrame, name: str = "name", seen: str = "seen") -> DataFrame:
    """I8: (category, category_id): trimmed lower-case names in first-seen order, one registry for all splits."""
    key = F.lower(F.trim(F.col(name)))
    return with_index(categories.groupBy(key.alias("category")).agg(F.min(seen).alias("_seen")), [F.col("_seen"), F.col("category")], "category_id").drop("_seen")


def merged_annotation_ids(kept: DataFrame, image: str = "image_id", nth: str = "ord") -> DataFrame:
    """Numbers by image and then by order inside the image."""
    return with_index(kept, [F.col(image), F.col(nth)], "ann_id")
