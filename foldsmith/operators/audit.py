"""Audits of folds and annotations [C2, C4, C7, C8, U1, U2, U7, J21, J24, A5, A6, A17]."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldsmith.functions.boxes import grid, inside, iou


class Unreadable(ValueError):
    """Input that would look clean if it were skipped."""


def multiset_difference(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of either side that the other has fewer of, once for each, with side missing or extra."""
    cols = expected.columns
    missing = expected.exceptAll(found.select(cols)).withColumn("side", F.lit("missing"))
    return missing.union(found.select(cols).exceptAll(expected).withColumn("side", F.lit("extra")))


def on_grid(boxes: DataFrame, box: str = "box", tolerance: float = 0.05) -> DataFrame:
    """Boxes as whole numbers of the grid, for comparison as multisets."""
    return boxes.withColumns({f"g_{c}": grid(F.col(box)[c], tolerance) for c in "xywh"})


def explained(missing: DataFrame, kept: DataFrame, most: float = 0.9) -> DataFrame:
    """Missing boxes that a kept one of the same image and class overlaps by more than `most`."""
    k = kept.select(F.col("image_id").alias("ki"), F.col("class_id").alias("kc"), F.col("box").alias("kb"))
    near = (F.col("image_id") == F.col("ki")) & (F.col("class_id") == F.col("kc")) & (iou(F.col("box"), F.col("kb")) > most)
    return missing.join(k, near, "left_semi")


def annotation_check(expected: DataFrame, found: DataFrame) -> DataFrame:
    """C4: (image_id, verdict): exact, merged (all missing boxes explained, none extra) or error."""
    keys = ["image_id", "class_id", "g_x", "g_y", "g_w", "g_h"]
    diff = multiset_difference(on_grid(expected).select(keys), on_grid(found).select(keys))
    lost = on_grid(expected).join(diff.where("side = 'missing'").distinct(), keys, "left_semi")
    open_ = lost.join(explained(lost, found).select(keys).distinct(), keys, "left_anti").select("image_id").distinct().withColumn("open", F.lit(True))
    any_ = diff.groupBy("image_id").agg(F.count_if(F.col("side") == "extra").alias("extra"))
    images = expected.select("image_id").union(found.select("image_id")).distinct()
    x = images.join(any_, "image_id", "left").join(open_, "image_id", "left")
    return x.select("image_id", F.when(F.col("extra").isNull(), "exact").when((F.col("extra") == 0) & F.col("open").isNull(), "merged").otherwise("error").alias("verdict"))


def shared_groups(folds: DataFrame) -> DataFrame:
    """Groups in more than one split of a fold."""
    g = folds.groupBy("held", "group_id").agg(F.array_sort(F.collect_set("split")).alias("splits"))
    return g.where(F.size("splits") > 1)


def split_counts(folds: DataFrame) -> DataFrame:
    """A5: images by fold, dataset and split, one column for each split."""
    return folds.groupBy("held", "dataset").pivot("split", ["train", "val", "test"]).count().fillna(0)


def over_cap(folds: DataFrame, caps: dict[str, int], per_dataset: list[str]) -> DataFrame:
    """Sub-scenes with more images of a split than its cap; counted by dataset too for the named ones."""
    key = F.when(F.col("dataset").isin(per_dataset or [""]), F.col("dataset"))
    cap = F.coalesce(*(F.when(F.col("split") == s, F.lit(n)) for s, n in caps.items()))
    g = folds.groupBy("held", "split", "subscene_id", key.alias("only")).agg(F.count("*").alias("n"))
    return g.withColumn("cap", cap).where("n > cap")


def unexpected(folds: DataFrame, known: DataFrame) -> DataFrame:
    """Datasets of the folds that are not known."""
    return folds.select("dataset").distinct().join(known.select("dataset"), "dataset", "left_anti")


def checked_lookup(files: DataFrame, registry: DataFrame, on: str = "file") -> DataFrame:
    """Files joined to the registry; raises if any is unknown."""
    n = files.join(registry, on, "left_anti").count()
    if n:
        raise Unreadable(f"{n} files are not in the registry")
    return files.join(registry, on)


def refuse_unreadable(images: DataFrame, *needed: str) -> DataFrame:
    """The images; raises if any lacks a needed column."""
    n = images.where(" OR ".join(f"{c} IS NULL" for c in needed)).count()
    if n:
        raise Unreadable(f"{n} images lack one of {', '.join(needed)}")
    return images


def manifest_check(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(path, problem) of files missing, unlisted or changed; both sides have path and sha256."""
    x = manifest.select("path", F.col("sha256").alias("want")).join(files.select("path", F.col("sha256").alias("have")), "path", "full")
    problem = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "unlisted").when(F.col("want") != F.col("have"), "changed")
    return x.select("path", problem.alias("problem")).where("problem IS NOT NULL")


def bad_boxes(boxes: DataFrame, n_classes: int) -> DataFrame:
    """Boxes of an unknown class or outside their image."""
    ok = F.col("class_id").between(0, n_classes - 1) & inside(F.col("box"), F.col("width"), F.col("height"))
    return boxes.where(~ok)


def dropped_labels(raw: DataFrame, class_map: DataFrame) -> DataFrame:
    """Annotations by dataset and raw class that no mapping takes in."""
    lost = raw.join(F.broadcast(class_map.select("dataset", "raw_class")), ["dataset", "raw_class"], "left_anti")
    return lost.groupBy("dataset", "raw_class").agg(F.count("*").alias("n"))
