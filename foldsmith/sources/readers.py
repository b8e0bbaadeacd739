"""Readers of annotation formats, each to the canonical image and annotation columns [S1-S22].

Images: dataset, split, old_id, file_name, width, height. Annotations: dataset, split, old_image_id, ann_id, raw_class, box,
area, iscrowd. Classes are mapped afterwards, by a broadcast join, so what no mapping takes in can be
counted. Sizes that only the pixels hold come as a table of paths.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldsmith.functions import boxes as B
from foldsmith.operators.audit import Unreadable
from foldsmith.operators.balance import hash_sample
from foldsmith.operators.ids import with_index
from foldsmith.operators.scan import running
from foldsmith.session import drop_path, scratch_path
from foldsmith.sources.documents import elements

COCO = {
    "images": "id bigint, file_name string, width int, height int",
    "annotations": "id bigint, image_id bigint, category_id int, bbox array<double>, area double, iscrowd int",
    "categories": "id int, name string",
}
PER_IMAGE_FIELDS = "image:string,annotations:array<struct<label:string,coordinates:struct<x:double,y:double,width:double,height:double>>>"
ODVG = "filename string, height int, width int, detection struct<instances:array<struct<bbox:array<double>,label:int,category:string>>>, annotated_classes array<int>"
PAIRS = "path_a string, path_b string, cosine double, inliers int"


def load_config(path: str) -> dict:
    """A JSON or, where the module is there, YAML configuration; driver side and small."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        return json.loads(text)
    import yaml

    return yaml.safe_load(text)


def config_rows(spark: SparkSession, config: dict) -> DataFrame:
    """(dataset, dataset_ord, format, raw_class, unified): the class maps as a table to broadcast."""
    rows = [(d["name"], i, d["format"], raw, unified) for i, d in enumerate(config["datasets"]) for raw, unified in d.get("class_map", {}).items()]
    return spark.createDataFrame(rows, "dataset string, dataset_ord int, format string, raw_class string, unified string")


def _shown(spark: SparkSession, base: str, name: str) -> list[str]:
    """Links to, or copies of, `<base>/<split>/<name>` in the shared folder: Spark takes names that begin with _ for hidden. One file for each split.

    Files of a mounted file system are linked, which takes no disk; other stores know no links, so there it is copies.
    """
    jvm = spark._jvm
    conf = jvm.org.apache.hadoop.conf.Configuration(spark._jsc.hadoopConfiguration())
    conf.setInt("io.file.buffer.size", 1 << 20)
    pattern = jvm.org.apache.hadoop.fs.Path(f"{base}/*/{name}")
    fs, to = pattern.getFileSystem(conf), scratch_path(spark, "shown")
    out = []
    for f in fs.globStatus(pattern) or []:
        target = jvm.org.apache.hadoop.fs.Path(f"{to}/{f.getPath().getParent().getName()}/{name.lstrip('_')}")
        there = target.getFileSystem(conf)
        if fs.getUri().getScheme() == there.getUri().getScheme() == "file":
            there.mkdirs(target.getParent())
            os.symlink(os.path.abspath(f.getPath().toUri().getPath()), target.toUri().getPath())
        else:
            jvm.org.apache.hadoop.fs.FileUtil.copy(fs, f.getPath(), there, target, False, conf)
        out.append(target.toString())
    if not out:
        raise FileNotFoundError(f"no {name} below {base}")
    return out


def _coco_parts(spark: SparkSession, base: str, names: list[str]) -> tuple[list[str], list[DataFrame]]:
    """(splits, the objects of each named list) of the documents of all splits; what _shown made is deleted, as the objects are kept."""
    paths = _shown(spark, base, "_annotations.coco.json")
    try:
        return [p.split("/")[-2] for p in paths], elements(spark, paths, names)
    finally:
        drop_path(spark, paths[0].rsplit("/", 2)[0])


def coco(spark: SparkSession, base: str, dataset: str) -> tuple[DataFrame, DataFrame]:
    """S3: `<base>/<split>/_annotations.coco.json`; boxes as they are, area with a default of w * h, crowd of 0."""
    splits, parts = _coco_parts(spark, base, [*COCO])
    split = F.element_at(F.array(*map(F.lit, splits)), F.col("doc") + 1).alias("split")
    i, a, c = (x.select(split, F.from_json("value", COCO[n]).alias("r")).select("split", "r.*") for n, x in zip(COCO, parts))
    head = [F.lit(dataset).alias("dataset"), "split"]
    images = i.select(*head, F.col("id").alias("old_id"), "file_name", "width", "height")
    names = c.select("split", F.col("id").alias("category_id"), F.col("name").alias("raw_class"))
    ann = a.join(F.broadcast(names), ["split", "category_id"])
    box = B.box(*(F.col("bbox")[k] for k in range(4)))
    ann = ann.select(*head, F.col("image_id").alias("old_image_id"), F.col("id").alias("ann_id"), "raw_class", box.alias("box"), F.coalesce("area", F.col("bbox")[2] * F.col("bbox")[3]).alias("area"), F.coalesce("iscrowd", F.lit(0)).alias("iscrowd"))
    return images, ann


def existing(images: DataFrame, files: DataFrame, on: str = "file_name") -> tuple[DataFrame, DataFrame]:
    """S3: (images whose file is there, issues of the others)."""
    missing = images.join(files.select(on), on, "left_anti").select("dataset", F.concat(F.lit("missing file: "), on).alias("issue"))
    return images.join(files.select(on), on, "left_semi"), missing


def yolo(spark: SparkSession, label_glob: str, sizes: DataFrame, dataset: str) -> tuple[DataFrame, DataFrame]:
    """One text file for each image, lines `class cx cy w h`; sizes: stem, file_name, width, height. Images without a label file drop."""
    stem = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.txt$", 1)
    lines = spark.read.text(label_glob).select(stem.alias("stem"), F.split(F.trim("value"), r"\s+").alias("t"))
    # No reader of Spark gives rows for an empty file, so the names come from the reader's file index, which the driver holds anyway.
    found = [(x.rsplit("/", 1)[-1].removesuffix(".txt"),) for x in spark.read.text(label_glob).inputFiles()]
    files = spark.createDataFrame(found, "stem string")
    images = sizes.join(files, "stem", "left_semi").select(F.lit(dataset).alias("dataset"), F.lit(None).cast("string").alias("split"), F.col("stem").alias("old_id"), "file_name", "width", "height")
    n = [F.col("t")[k].cast("double") for k in range(1, 5)]
    ann = lines.where(F.size("t") >= 5).join(sizes, "stem")
    box = B.from_normal_centre(*n, F.col("width"), F.col("height"))
    ann = ann.select(F.lit(dataset).alias("dataset"), F.col("stem").alias("old_image_id"), F.col("t")[0].alias("raw_class"), box.alias("box")).where(B.has_area(F.col("box")))
    return images, ann.withColumns({"area": F.col("box.w") * F.col("box.h"), "iscrowd": F.lit(0)})


def per_image(spark: SparkSession, glob: str, sizes: DataFrame, dataset: str) -> tuple[DataFrame, DataFrame]:
    """A JSON list for each image, of which the first record counts; boxes by pixel centre, clipped. sizes: file_name, width, height."""
    raw = spark.read.text(glob, wholetext=True).select(F.try_element_at(F.from_json("value", f"array<struct<{PER_IMAGE_FIELDS}>>"), F.lit(1)).alias("r"))
    images = raw.where("r IS NOT NULL").select("r.*").join(sizes, F.col("image") == F.col("file_name")).select(F.lit(dataset).alias("dataset"), F.lit(None).cast("string").alias("split"), F.col("file_name").alias("old_id"), "file_name", "width", "height", "annotations")
    ann = images.select("dataset", F.col("old_id").alias("old_image_id"), "width", "height", F.explode("annotations").alias("a"))
    c = F.col("a.coordinates")
    box = B.from_centre(c["x"], c["y"], c["width"], c["height"], F.col("width"), F.col("height"))
    ann = ann.select("dataset", "old_image_id", F.col("a.label").alias("raw_class"), box.alias("box")).where(B.has_area(F.col("box")))
    return images.drop("annotations"), ann.withColumns({"area": F.col("box.w") * F.col("box.h"), "iscrowd": F.lit(0)})


#: Formats by name.
READERS: dict[str, Callable] = {"coco_roboflow": coco, "yolo": yolo, "fuselage_json": per_image}


def read_dataset(spark: SparkSession, kind: str, *args) -> tuple[DataFrame, DataFrame]:
    """Dispatch; raises on an unknown format."""
    if kind not in READERS:
        raise ValueError(f"unknown format: {kind}")
    return READERS[kind](spark, *args)


def read_all(spark: SparkSession, sources: Iterable[tuple[str, str, tuple]]) -> tuple[DataFrame, DataFrame]:
    """(images, annotations) of all sources (dataset, format, reader's arguments before the name) in config order.

    dataset_ord is the place in that order; old ids, whose types differ by format, are strings. A source is asked for when those before it have
    been handed to their readers; a COCO document is then read whole.
    """
    images, annotations = [], []
    for nth, (dataset, kind, args) in enumerate(sources):
        i, a = read_dataset(spark, kind, *args, dataset)
        images.append(i.withColumns({"old_id": F.col("old_id").cast("string"), "dataset_ord": F.lit(nth)}))
        annotations.append(a.withColumns({"old_image_id": F.col("old_image_id").cast("string"), "dataset_ord": F.lit(nth)}))
    return tuple(_stack(x) for x in (images, annotations))


def _stack(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def embedding_cache(spark: SparkSession, path: str) -> DataFrame:
    """(path, embedding) of a Parquet cache; empty where there is none yet."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.read.parquet(path).select("path", F.col("embedding").cast("array<float>").alias("embedding"))
    return spark.createDataFrame([], "path string, embedding array<float>")


#: What the check reader takes of each format; it shares no schema and no box code with the readers above.
CHECK_COCO = {"categories": "struct<id:string,name:string>", "images": "struct<id:string,file_name:string>", "annotations": "struct<image_id:string,category_id:string,bbox:array<double>>"}
CHECK_PER_IMAGE = "array<struct<image:string,annotations:array<struct<label:string,coordinates:map<string,double>>>>>"


def check_boxes(spark: SparkSession, kind: str, path: str, dataset: str, class_map: DataFrame, sizes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(boxes, dropped) of one source, read a second way to verify the readers.

    boxes: image, class_id, corners x1, y1, x2, y2 (cropped to the image where the format is relative or centred). dropped: dataset, reason,
    n: raw classes that class_map (raw_class, class_id) lacks, and boxes without an area. path: the folder of splits, or a
    glob of files; sizes: file_name, stem, width, height.
    """
    if kind == "coco_roboflow":
        _, parts = _coco_parts(spark, path, [*CHECK_COCO])
        name, image, found = (x.select("doc", F.inline(F.array(F.from_json("value", kind)))) for x, kind in zip(parts, CHECK_COCO.values()))
        name, image = name.toDF("f", "category_id", "raw_class"), image.toDF("f", "image_id", "image")
        b = F.col("bbox")
        boxes = found.withColumnRenamed("doc", "f").join(F.broadcast(name), ["f", "category_id"]).join(image, ["f", "image_id"])
        boxes = boxes.select("image", "raw_class", b[0].alias("x1"), b[1].alias("y1"), (b[0] + b[2]).alias("x2"), (b[1] + b[3]).alias("y2"))
    elif kind == "yolo":
        part = F.split(F.trim("value"), "[ \t]+")
        raw = spark.read.text(path).select(F.regexp_extract("_metadata.file_name", "^(.*)[.]txt$", 1).alias("stem"), part.alias("p")).where(F.size("p") > 4).join(sizes, "stem")
        boxes = _cropped(raw, F.col("file_name"), F.col("p")[0], *((F.col("p")[k].cast("double") * F.col(size)) for k, size in ((1, "width"), (2, "height"), (3, "width"), (4, "height"))))
    elif kind == "fuselage_json":
        raw = spark.read.text(path, wholetext=True).select(F.try_element_at(F.from_json("value", CHECK_PER_IMAGE), F.lit(1)).alias("r")).where("r IS NOT NULL")
        raw = raw.select(F.col("r.image").alias("file_name"), F.explode("r.annotations").alias("a")).join(sizes, "file_name")
        boxes = _cropped(raw, F.col("file_name"), F.col("a.label"), *(F.col("a.coordinates")[k] for k in ("x", "y", "width", "height")))
    else:
        raise ValueError(f"unknown format: {kind}")
    known = boxes.join(F.broadcast(class_map.select("raw_class", "class_id")), "raw_class", "left")
    flat = (F.col("x2") <= F.col("x1")) | (F.col("y2") <= F.col("y1"))
    reason = F.when(F.col("class_id").isNull(), F.col("raw_class")).when(flat, F.concat("raw_class", F.lit(" (without an area)")))
    known = known.withColumn("reason", reason)
    dropped = known.where("reason IS NOT NULL").groupBy(F.lit(dataset).alias("dataset"), "reason").agg(F.count("*").alias("n"))
    return known.where("reason IS NULL").select("image", "class_id", "x1", "y1", "x2", "y2"), dropped


def _cropped(raw: DataFrame, image, label, cx, cy, w, h) -> DataFrame:
    """Corners of centred boxes in pixels, held inside the image."""
    within = lambda v, size: F.least(F.greatest(v, F.lit(0.0)), F.col(size).cast("double"))
    return raw.select(image.alias("image"), label.alias("raw_class"), within(cx - w / 2, "width").alias("x1"), within(cy - h / 2, "height").alias("y1"), within(cx + w / 2, "width").alias("x2"), within(cy + h / 2, "height").alias("y2"))


INLINE = """images array<struct<file_name:string,annotations:array<struct<category_name:string,
    bounding_box_normalized:struct<x_center:double,y_center:double,width:double,height:double>>>>>"""


def inline_json(spark: SparkSession, path: str, sizes: DataFrame, dataset: str, default_class: str = "defect") -> tuple[DataFrame, DataFrame]:
    """One document with the boxes inside its images; sizes: file_name, width, height. Raises if an image has no size, that is no file.

    Images and boxes are numbered from 1 in the document's order; boxes are not clipped; a box without a class has the default.
    """
    raw = spark.read.schema(INLINE).option("multiLine", True).json(path).select(F.posexplode("images").alias("pos", "i"))
    raw = raw.select(F.lit(dataset).alias("dataset"), (F.col("pos") + 1).cast("long").alias("old_id"), F.col("i.file_name").alias("file_name"), F.col("i.annotations").alias("a"))
    known = _with_files(raw, sizes)
    ann = known.select("dataset", F.col("old_id").alias("old_image_id"), "width", "height", F.posexplode("a").alias("nth", "a"))
    n = F.col("a.bounding_box_normalized")
    w, h = n["width"] * F.col("width"), n["height"] * F.col("height")
    box = B.box(n["x_center"] * F.col("width") - w / 2, n["y_center"] * F.col("height") - h / 2, w, h)
    ann = with_index(ann, [F.col("old_image_id"), F.col("nth")], "at").withColumn("ann_id", F.col("at") + 1)
    ann = ann.select("dataset", "old_image_id", "ann_id", F.coalesce("a.category_name", F.lit(default_class)).alias("raw_class"), box.alias("box"), (w * h).alias("area"), F.lit(0).alias("iscrowd"))
    return known.drop("a"), ann


def coco_again(spark: SparkSession, base: str, files: DataFrame, dataset: str) -> tuple[DataFrame, DataFrame]:
    """coco() with ids from 1 in order, areas of w * h, and an error where coco() would report a missing file."""
    images, ann = coco(spark, base, dataset)
    images = with_index(_with_files(images, files.select("file_name")), [F.col("split"), F.col("old_id")], "at").withColumn("id", F.col("at") + 1).drop("at")
    ann = ann.join(images.select("split", F.col("old_id").alias("old_image_id"), F.col("id").alias("image_id")), ["split", "old_image_id"])
    ann = with_index(ann, [F.col("split"), F.col("ann_id")], "at").withColumn("id", F.col("at") + 1).drop("at")
    return images, ann.withColumn("area", F.col("box.w") * F.col("box.h"))


def _with_files(images: DataFrame, files: DataFrame) -> DataFrame:
    """images joined to their files; raises if any has none."""
    lost = images.join(files, "file_name", "left_anti").limit(1).collect()
    if lost:
        raise Unreadable(f"no file {lost[0].file_name}")
    return images.join(files, "file_name")


def truth_sample(lines: DataFrame, n_classes: int, n: int, seed: int = 1) -> DataFrame:
    """truth_of_lines of n lines with boxes, the first in hash order; without any mask of classes."""
    boxed = lines.where(F.size("detection.instances") > 0)
    return truth_of_lines(hash_sample(boxed, n, F.lit(seed), F.col("filename")), n_classes)


def decode_samples(lines: DataFrame, n_classes: int) -> DataFrame:
    """(filename, boxes, labels, annotated_classes) of ODVG lines: unknown labels drop, a missing class list means all classes.

    A line without a file name is refused rather than replaced by another one.
    """
    if not lines.where("filename IS NULL").isEmpty():
        raise Unreadable("lines without a file name")
    kept = F.filter(F.coalesce("detection.instances", F.array().cast(lines.schema["detection"].dataType["instances"].dataType)), lambda i: i["label"] < n_classes)
    every = F.sequence(F.lit(0), F.lit(n_classes - 1))
    known = F.array_sort(F.array_distinct(F.filter(F.coalesce("annotated_classes", every), lambda c: c < n_classes)))
    return lines.select("filename", F.transform(kept, lambda i: i["bbox"]).alias("boxes"), F.transform(kept, lambda i: i["label"]).alias("labels"), known.alias("annotated_classes"))


def remap_classes(annotations: DataFrame, class_map: DataFrame, numbers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(annotations with class_id, dropped ones); class_map: dataset, raw_class, unified; numbers: unified, class_id."""
    m = F.broadcast(class_map.join(numbers, "unified").select("dataset", "raw_class", "class_id"))
    return annotations.join(m, ["dataset", "raw_class"]), annotations.join(m, ["dataset", "raw_class"], "left_anti")


def pair_csv(spark: SparkSession, path: str, least: int = 0) -> DataFrame:
    """Pairs with at least so many inliers; the bound is pushed to the scan."""
    return spark.read.schema(PAIRS).option("header", True).csv(path).where(F.col("inliers") >= least)


def fold_lines(spark: SparkSession, path: str, root: str = "") -> DataFrame:
    """ODVG lines, relative file names below root."""
    rows = spark.read.schema(ODVG).json(path).where("filename IS NOT NULL")
    return rows.withColumn("filename", F.when(F.col("filename").startswith("/"), F.col("filename")).otherwise(F.concat(F.lit(root), "filename")))


def fold_numbers(spark: SparkSession, base: str) -> list[int]:
    """Numbers of the folders fold_<n>; raises if there are none. The driver lists folder names only."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/fold_*")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    numbers = sorted(int(x) for x in (f.getPath().getName().removeprefix("fold_") for f in found) if x.isdigit())
    if not numbers:
        raise FileNotFoundError(f"no folds below {base}")
    return numbers


def truth_of_lines(lines: DataFrame, n_classes: int, line_no: str = "line_no") -> DataFrame:
    """(image_id, class_id, crowd, x, y, w, h): true boxes, images by line number, unknown labels dropped."""
    i = lines.select(F.col(line_no).alias("image_id"), F.explode("detection.instances").alias("i")).where(F.col("i.label").between(0, n_classes - 1))
    b = [F.col("i.bbox")[k] for k in range(4)]
    return i.select("image_id", F.col("i.label").alias("class_id"), F.lit(False).alias("crowd"), b[0].alias("x"), b[1].alias("y"), (b[2] - b[0]).alias("w"), (b[3] - b[1]).alias("h"))


def drop_lists(spark: SparkSession, path: str, key: str = "drops") -> DataFrame:
    """(fold_id, file) of a JSON object {key: {fold: [files]}}."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", f"{key} map<string,array<string>>").alias("j"))
    return raw.select(F.explode(f"j.{key}").alias("fold_id", "files")).select("fold_id", F.explode("files").alias("file"))


def section_pairs(lines: DataFrame, order: str, line: str) -> DataFrame:
    """(section, nth, first, second): path lines below `=== Exact matches (Distance 0): X ===`, two by two.

    A header begins a section, any other line with === in front ends it. Each line takes the last header before it: the
    lines are dealt to ranges by their order, each range passes its last header on to those after it.
    """
    head = F.when(F.col(line).startswith("=== "), F.regexp_extract(line, r"^=== Exact matches \(Distance 0\): (.*) ===$", 1))
    mark = F.when(head.isNotNull(), F.struct(F.col(order).alias("o"), head.alias("h")))
    x = lines.select(F.col(order).alias("_o"), F.col(line).alias("_line"), mark.alias("_mark"))
    x = running(x, [], [F.col("_o"), F.col("_line")], {"s": ("last", F.col("_mark"))})
    x = x.select("_o", "_line", "s").where(F.col("s.h").isNotNull() & (F.col("s.h") != "") & F.col("_line").rlike(r"^  \S"))
    x = running(x, ["s"], [F.col("_o"), F.col("_line")], {"k": ("sum", F.lit(1).cast("long"))}).withColumn("k", F.col("k") - 1)
    g = x.groupBy("s", F.floor(F.col("k") / 2).cast("int").alias("nth")).agg(F.max(F.when(F.col("k") % 2 == 0, F.trim("_line"))).alias("first"), F.max(F.when(F.col("k") % 2 == 1, F.trim("_line"))).alias("second"))
    return g.where("second IS NOT NULL").select(F.col("s.h").alias("section"), "nth", "first", "second")


def files(spark: SparkSession, base: str, pattern: str = "*") -> DataFrame:
    """(path, length, sha256) of the files below a folder."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(base)
    return raw.select("path", "length", F.sha2("content", 256).alias("sha256"))


def results(spark: SparkSession, base: str) -> DataFrame:
    """One evaluation document for each fold folder, missing ones left out."""
    schema = "mAP double, mAP_50 double, mAP_75 double, per_class map<string,struct<AP:double,AP_50:double,support:bigint>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(f"{base}/fold_*/eval_results.json")
    return raw.withColumn("fold_id", F.regexp_extract(F.col("_metadata.file_path"), r"fold_(\d+)", 1).cast("int"))
