"""Annotation merge [J1, J2, G1, J23, I6]."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldsmith.functions.boxes import iou
from foldsmith.operators.ids import merged_annotation_ids


def attach(annotations: DataFrame, images: DataFrame, on: list[str]) -> DataFrame:
    """Annotations of known images; orphans drop."""
    return annotations.join(images, on)


def remap(annotations: DataFrame, mapping: DataFrame, on: list[str]) -> DataFrame:
    """Annotations with new image ids; those whose image has none drop."""
    return annotations.join(mapping.where("new_id IS NOT NULL"), on)


def greedy_keep(ordered: Column, most: float = 0.9) -> Column:
    """G1: of ordered structs (class_id, box, ...) those that overlap no kept one of their class by more than `most`."""
    empty = F.slice(ordered, 1, 0)
    clash = lambda acc, b: F.exists(acc, lambda k: (k["class_id"] == b["class_id"]) & (iou(k["box"], b["box"]) > most))
    return F.aggregate(ordered, empty, lambda acc, b: F.when(clash(acc, b), acc).otherwise(F.concat(acc, F.array(b))))


def merge_annotations(annotations: DataFrame, most: float = 0.9) -> DataFrame:
    """(ann_id, image_id, ord, class_id, box): the greedy result of every image, numbered by image and order.

    annotations: image_id, ord (total within the image), class_id, box. Only boxes of one class clash, so the boxes of a class in an image
    are one array and the unit of work; those are spread by image and class.
    """
    one = F.struct("ord", "class_id", "box")
    kept = annotations.groupBy("image_id", "class_id").agg(F.sort_array(F.collect_list(one)).alias("b")).select("image_id", F.explode(greedy_keep(F.col("b"), most)).alias("k"))
    return merged_annotation_ids(kept.select("image_id", "k.ord", "k.class_id", "k.box"))


def overlapping(annotations: DataFrame, most: float = 0.9) -> DataFrame:
    """(image_id, class_id, a, b, iou): pairs of one image and class, a < b in order, above the overlap."""
    x = annotations.select("image_id", "class_id", F.col("ord").alias("a"), F.col("box").alias("ba"))
    y = annotations.select("image_id", "class_id", F.col("ord").alias("b"), F.col("box").alias("bb"))
    both = x.join(y, ["image_id", "class_id"]).where("a < b")
    return both.select("image_id", "class_id", "a", "b", iou(F.col("ba"), F.col("bb")).alias("iou")).where(F.col("iou") > most)


def annotated_classes(images: DataFrame) -> DataFrame:
    """(image_id, classes): what an image's dataset labels; absent boxes of other classes mean nothing."""
    return images.select("image_id", F.array_sort(F.array_distinct("classes")).alias("classes"))
