"""Tables written in a format and read back [S3-S8, S10-S12, S14, S16, S17, S19-S22, K1-K12, T16, I8, J1, J2, J9, J21, C2, C7-C9, F7, F12].

Orders are images and their line items boxes, regions the classes. Everything is written below the shared folder.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldsmith.functions import boxes as B
from foldsmith.functions.vectors import normalise, sigmoid
from foldsmith.operators import audit, ids, leakage, merge, registry
from foldsmith.session import drop_path, scratch_path, swept, table
from foldsmith.sources import readers, sinks

WIDTH, HEIGHT = 640, 512


def _images(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("image_id"), F.concat(F.col("o_orderkey").cast("string"), F.lit(".jpg")).alias("file"), F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"), (F.col("o_custkey") % 3).cast("int").alias("fold_id"), F.when(F.col("o_orderstatus") == "F", "val").otherwise("train").alias("split"))


def _boxes(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    box = B.box((F.col("l_partkey") % 500).cast("double"), F.col("l_linenumber") * 40.0, F.col("l_quantity"), F.col("l_linenumber") + 10.0)
    return l.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ann_id"), F.col("l_orderkey").alias("image_id"), (F.col("l_suppkey") % 5).cast("int").alias("class_id"), box.alias("box"))


def _names(spark, sf_dir):
    return table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("class_id"), F.col("r_name").alias("name"))


_SQL_BOXES = """b AS (SELECT l_orderkey * 10 + l_linenumber AS ann_id, l_orderkey AS image_id, CAST(l_suppkey % 5 AS INTEGER) AS class_id, (l_partkey % 500)::DOUBLE AS x, l_linenumber * 40.0::DOUBLE AS y, l_quantity AS w, l_linenumber + 10.0::DOUBLE AS h FROM lineitem),
      n AS (SELECT r_regionkey AS class_id, r_name AS name FROM region),
      i AS (SELECT o_orderkey AS image_id, o_orderkey || '.jpg' AS file, CAST(o_custkey % 3 AS INTEGER) AS fold_id, CASE WHEN o_orderstatus = 'F' THEN 'val' ELSE 'train' END AS split FROM orders)"""


def _flat(df: DataFrame) -> DataFrame:
    return df.select(*(c for c in df.columns if c != "box"), *(F.col("box")[c].alias(c) for c in "xywh"))


def coco_round_trip(spark, sf_dir):
    """All boxes through one COCO document for each split."""
    base = scratch_path(spark, "coco")
    sinks.write_coco_splits(_images(spark, sf_dir), _boxes(spark, sf_dir), _names(spark, sf_dir), base, ["train", "val"])
    found, ann = readers.coco(spark, base, "d")
    drop_path(spark, base)  # read whole; what comes next needs its room
    known = found.select("split", F.col("old_id").alias("old_image_id"), "file_name")
    return _flat(ann.join(known, ["split", "old_image_id"]).select("split", "file_name", "ann_id", "raw_class", "box", "area", "iscrowd"))


def coco_canonical(spark, sf_dir):
    """Numbers of images and boxes in a canonical document."""
    path = f"{scratch_path(spark, 'coco')}/train/_annotations.coco.json"
    sinks.write_coco(_images(spark, sf_dir), _boxes(spark, sf_dir), _names(spark, sf_dir), path, canonical=True)
    found, ann = readers.coco(spark, path.rsplit("/", 2)[0], "d")
    return _flat(ann.join(found.select(F.col("old_id").alias("old_image_id"), "file_name"), "old_image_id").select("ann_id", "old_image_id", "file_name", "raw_class", "box"))


def coco_checked(spark, sf_dir):
    """The same documents read by the second reader, with two classes mapped and the others counted as dropped."""
    path = f"{scratch_path(spark, 'coco')}/all/_annotations.coco.json"
    sinks.write_coco(_images(spark, sf_dir), _boxes(spark, sf_dir), _names(spark, sf_dir), path)
    some = _names(spark, sf_dir).where("class_id < 2").select(F.col("name").alias("raw_class"), "class_id")
    boxes, dropped = readers.check_boxes(spark, "coco_roboflow", path.rsplit("/", 2)[0], "d", some)
    kept = boxes.groupBy(F.col("class_id").cast("string").alias("what")).agg(F.count("*").alias("n"), F.sum(F.col("x2") - F.col("x1")).alias("widths"))
    return kept.union(dropped.select("reason", "n", F.lit(None).cast("double")))


def coco_renumbered(spark, sf_dir):
    """Ids from 1 in the order of the old ones: those of every image, and its area in boxes."""
    path = f"{scratch_path(spark, 'coco')}/train/_annotations.coco.json"
    images = _images(spark, sf_dir).where("split = 'train'")
    sinks.write_coco(images, merge.attach(_boxes(spark, sf_dir), images.select("image_id"), ["image_id"]), _names(spark, sf_dir), path)
    found, ann = readers.coco_again(spark, path.rsplit("/", 2)[0], images.select(F.col("file").alias("file_name")), "d")
    known = ann.join(found.select(F.col("id").alias("image_id"), "file_name"), "image_id")
    return known.groupBy("image_id", "file_name").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n"), F.sum("area").alias("area"))


def odvg_round_trip(spark, sf_dir):
    """Boxes of all folds through ODVG lines, as true boxes."""
    path, images = scratch_path(spark, "odvg"), _images(spark, sf_dir)
    classes = images.select("image_id", F.array(F.lit(0), F.lit(3)).alias("classes"))
    sinks.write_odvg(sinks.odvg_rows(images, _boxes(spark, sf_dir), classes, _names(spark, sf_dir)), path)
    parts = []
    for fold in range(3):
        lines = readers.fold_lines(spark, f"{path}/fold_id={fold}/split=*", "/data/")
        no = F.regexp_extract("filename", r"(\d+)\.jpg$", 1).cast("long")
        parts.append(readers.truth_of_lines(lines.withColumn("line_no", no), 4).withColumn("fold", F.lit(fold)))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("fold", "image_id", "class_id", "x", "y", "w", "h")


def odvg_decoded(spark, sf_dir):
    """Lines of one fold decoded as samples: number of boxes and the annotated classes."""
    path, images = scratch_path(spark, "odvg"), _images(spark, sf_dir)
    classes = images.select("image_id", F.array(F.lit(3), F.lit(0), F.lit(9)).alias("classes"))
    sinks.write_odvg(sinks.odvg_rows(images, _boxes(spark, sf_dir), classes, _names(spark, sf_dir)), path)
    lines = readers.fold_lines(spark, f"{path}/fold_id=*/split=*")
    s = readers.decode_samples(lines, 4)
    return s.select("filename", F.size("boxes").cast("long").alias("n"), F.array_join("annotated_classes", ",").alias("classes"))


def _one_file_each(spark: SparkSession, rows: DataFrame, end: str) -> str:
    """A folder with a file <stem><end> for each row (stem, value); Spark writes them, the driver only renames."""
    base = scratch_path(spark, "each")
    # The tasks put their files in place themselves; by default the driver moves them one after the other when the job ends.
    with swept(spark):
        rows.repartition("stem").write.option("mapreduce.fileoutputcommitter.algorithm.version", 2).partitionBy("stem").text(base)
    hadoop = spark._jvm.org.apache.hadoop.fs
    parts = hadoop.Path(f"{base}/stem=*/part-*")
    fs = parts.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop.Path(f"{base}-named"))

    def rename(f) -> None:
        path = f.getPath()
        name = path.toString().rsplit("/", 2)[1].removeprefix("stem=")
        fs.rename(path, hadoop.Path(f"{base}-named/{name}{end}"))

    with ThreadPoolExecutor(16) as pool:
        for _ in pool.map(rename, fs.globStatus(parts) or []):
            pass
    return f"{base}-named"


def _suppliers(spark, sf_dir):
    """Suppliers as images; every third has no box."""
    s = table(spark, sf_dir, "supplier")
    sizes = s.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("stem"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit(".png")).alias("file_name"), F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"), "s_suppkey")
    boxes = table(spark, sf_dir, "lineitem").where("l_suppkey % 3 <> 0").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("stem"), (F.col("l_orderkey") % 5).cast("string").alias("label"), (F.col("l_partkey") % 64).alias("cx"), (F.col("l_linenumber") * 8).alias("cy"), (F.col("l_quantity").cast("int") % 16).alias("w"), F.lit(32).alias("h"))
    return sizes, boxes


_SQL_SUPPLIERS = """l AS (SELECT 's' || l_suppkey AS stem, CAST(l_orderkey % 5 AS VARCHAR) AS label, (l_partkey % 64) * 10.0::DOUBLE AS cx, l_linenumber * 64.0::DOUBLE AS cy, (l_quantity::INTEGER % 16) * 10.0::DOUBLE AS w, 256.0::DOUBLE AS h FROM lineitem WHERE l_suppkey % 3 <> 0),
      c AS (SELECT stem, label, greatest(0, cx - w / 2) AS x1, greatest(0, cy - h / 2) AS y1, least(640, cx + w / 2) AS x2, least(512, cy + h / 2) AS y2 FROM l),
      k AS (SELECT * FROM c WHERE x2 > x1 AND y2 > y1)"""


def yolo_round_trip(spark, sf_dir):
    """Boxes of every supplier through a text file each, empty ones too: images, boxes and their total area."""
    sizes, boxes = _suppliers(spark, sf_dir)
    # Fractions of the image in binary steps, so that nothing is rounded: 640 = 64 * 10, 512 = 64 * 8.
    line = F.concat_ws(" ", "label", *((F.col(c) / 64).cast("string") for c in ("cx", "cy", "w", "h")))
    per = boxes.groupBy("stem").agg(F.array_join(F.collect_list(line), "\n").alias("value"))
    texts = sizes.join(per, "stem", "left").select("stem", F.coalesce("value", F.lit("")).alias("value"))
    images, ann = readers.yolo(spark, _one_file_each(spark, texts, ".txt"), sizes.drop("s_suppkey"), "y")
    per = ann.groupBy(F.col("old_image_id").alias("old_id")).agg(F.count("*").alias("n"), F.sum("area").alias("area"))
    return images.join(per, "old_id", "left").select("file_name", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.round(F.coalesce("area", F.lit(0.0)), 3).alias("area"))


def per_image_round_trip(spark, sf_dir):
    """Boxes of every supplier through a JSON list each, by the reader and by the check reader."""
    sizes, boxes = _suppliers(spark, sf_dir)
    c = F.struct((F.col("cx") * 10.0).alias("x"), (F.col("cy") * 8.0).alias("y"), (F.col("w") * 10.0).alias("width"), (F.col("h") * 8.0).alias("height"))
    per = boxes.groupBy("stem").agg(F.collect_list(F.struct("label", c.alias("coordinates"))).alias("annotations"))
    texts = sizes.join(per, "stem").select("stem", F.to_json(F.array(F.struct(F.col("file_name").alias("image"), "annotations"))).alias("value"))
    folder, known = _one_file_each(spark, texts, ".json"), sizes.drop("s_suppkey")
    images, ann = readers.per_image(spark, folder, known, "f")
    numbers = spark.createDataFrame([(str(k), k) for k in range(5)], "raw_class string, class_id int")
    check, _ = readers.check_boxes(spark, "fuselage_json", folder, "f", numbers, known)
    a = ann.groupBy(F.col("old_image_id").alias("file_name")).agg(F.count("*").alias("n"), F.sum("area").alias("area"))
    b = check.groupBy(F.col("image").alias("file_name")).agg(F.count("*").alias("n_check"), F.sum((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).alias("area_check"))
    return images.select("file_name").join(a, "file_name").join(b, "file_name").select("file_name", "n", F.round("area", 3).alias("area"), "n_check", F.round("area_check", 3).alias("area_check"))


def inline_round_trip(spark, sf_dir):
    """Customers as boxes inside the images of their nation, in one document."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    k = F.col("c_custkey")
    b = F.struct(((k % 8) / 8).alias("x_center"), ((k % 4) / 4).alias("y_center"), F.lit(0.25).alias("width"), F.lit(0.5).alias("height"))
    one = F.struct(k.alias("k"), F.struct(F.when(k % 3 > 0, F.col("c_mktsegment")).alias("category_name"), b.alias("bounding_box_normalized")).alias("a"))
    per = c.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.sort_array(F.collect_list(one)).alias("a"))
    images = n.join(per, "n_nationkey", "left").select("n_nationkey", F.struct(F.col("n_name").alias("file_name"), F.coalesce(F.transform("a", lambda x: x["a"]), F.array()).alias("annotations")).alias("i"))
    doc = images.agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "i"))).alias("i")).select(F.to_json(F.struct(F.transform("i", lambda x: x["i"]).alias("images"))).alias("value"))  # the format is one document
    path = scratch_path(spark, "inline")
    doc.coalesce(1).write.text(path)
    sizes = n.select(F.col("n_name").alias("file_name"), F.lit(80).alias("width"), F.lit(40).alias("height"))
    found, ann = readers.inline_json(spark, path, sizes, "k", "none")
    return ann.join(found.select(F.col("old_id").alias("old_image_id"), "file_name"), "old_image_id").select("ann_id", "old_image_id", "file_name", "raw_class", F.col("box")["x"].alias("x"), F.col("box")["y"].alias("y"), "area")


def all_sources(spark, sf_dir):
    """Images and boxes of a COCO and a per-image source, stacked in config order; the document of the first is gone before the files of the second are written."""

    def sources():
        base = scratch_path(spark, "coco")
        sinks.write_coco(_images(spark, sf_dir), _boxes(spark, sf_dir), _names(spark, sf_dir), f"{base}/train/_annotations.coco.json")
        yield "orders", "coco_roboflow", (base,)
        drop_path(spark, base)
        sizes, boxes = _suppliers(spark, sf_dir)
        c = F.struct((F.col("cx") * 10.0).alias("x"), (F.col("cy") * 8.0).alias("y"), (F.col("w") * 10.0).alias("width"), (F.col("h") * 8.0).alias("height"))
        per = boxes.groupBy("stem").agg(F.collect_list(F.struct("label", c.alias("coordinates"))).alias("annotations"))
        texts = sizes.join(per, "stem").select("stem", F.to_json(F.array(F.struct(F.col("file_name").alias("image"), "annotations"))).alias("value"))
        yield "suppliers", "fuselage_json", (_one_file_each(spark, texts, ".json"), sizes.drop("s_suppkey"))

    i, a = readers.read_all(spark, sources())
    n = a.groupBy("dataset").agg(F.count("*").alias("boxes"))
    return i.groupBy("dataset", "dataset_ord").agg(F.count("*").alias("images")).join(n, "dataset")


def drops_round_trip(spark, sf_dir):
    """Parts dropped from the fold of their size."""
    path, p = scratch_path(spark, "drops"), table(spark, sf_dir, "part")
    sinks.write_drops(p.select((F.col("p_size") % 6).alias("fold_id"), F.col("p_name").alias("file")), path)
    return readers.drop_lists(spark, path)


def pair_csv_round_trip(spark, sf_dir):
    """Line items as matched pairs of part and order with at least 30 inliers."""
    path, l = scratch_path(spark, "pairs"), table(spark, sf_dir, "lineitem")
    l.select(F.concat(F.lit("p"), "l_partkey").alias("path_a"), F.concat(F.lit("o"), "l_orderkey").alias("path_b"), (F.col("l_discount") * 10).alias("cosine"), F.col("l_quantity").cast("int").alias("inliers")).write.option("header", True).csv(path)
    return readers.pair_csv(spark, path, 30).withColumn("cosine", F.round("cosine", 6))


def embedding_cache_units(spark, sf_dir):
    """Embeddings scaled, cached, read and brought to unit length: the first element, and its sigmoid."""
    path = scratch_path(spark, "cache")
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("path"), F.transform("embedding", lambda x: x.cast("double") * 4).alias("embedding"))
    e.write.parquet(path)
    x = readers.embedding_cache(spark, path).withColumn("u", normalise(F.col("embedding")))
    return x.select("path", F.round(F.col("u")[0], 5).alias("first"), F.round(sigmoid(F.col("u")[0]), 5).alias("gate"))


def manifest_round_trip(spark, sf_dir):
    """Problems of a folder whose manifest lists one file too many and has one wrong hash; the files are regions."""
    r = table(spark, sf_dir, "region")
    base = _one_file_each(spark, r.select(F.col("r_name").alias("stem"), F.concat("r_name", F.lit(":"), F.col("r_regionkey").cast("string")).alias("value")), ".txt")
    have = sinks.manifest(spark, base)
    sha = F.sha2(F.concat("r_name", F.lit(":"), F.when(F.col("r_regionkey") == 2, "other").otherwise(F.col("r_regionkey").cast("string")), F.lit("\n")), 256)
    listed = r.where("r_regionkey <> 3").select(F.concat("r_name", F.lit(".txt")).alias("path"), sha.alias("sha256"))
    listed = listed.union(r.where("r_regionkey = 0").select(F.lit("nowhere.txt"), F.lit("0")))
    return audit.manifest_check(listed, have)


def registry_round_trip(spark, sf_dir):
    """Registry tables written as Parquet and JSON: rows and distinct ids of both."""
    path = scratch_path(spark, "registry")
    images, boxes = _images(spark, sf_dir), _boxes(spark, sf_dir)
    groups = images.groupBy(F.col("fold_id").alias("group_id")).agg(F.count("*").alias("n_images"))
    sinks.write_registry(path, images, boxes, groups, images.select("fold_id", "split", "image_id"), as_json=True)
    parts = [spark.read.format(kind).load(f"{path}/{sub}{name}").agg(F.lit(kind).alias("kind"), F.lit(name).alias("name"), F.count("*").alias("n"), F.countDistinct(key).alias("ids")) for kind, sub in (("parquet", ""), ("json", "json/")) for name, key in (("images", "image_id"), ("annotations", "ann_id"), ("groups", "group_id"), ("folds", "fold_id"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def nearest_round_trip(spark, sf_dir):
    """Nearest pairs as CSV for each fold and split, closest first."""
    l, path = table(spark, sf_dir, "lineitem"), scratch_path(spark, "nearest")
    n = l.select(F.col("l_returnflag").alias("held"), F.col("l_linestatus").alias("split"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("near"), (F.col("l_quantity") / 64).alias("cosine"), F.col("l_suppkey").alias("distance"))
    sinks.write_nearest(n, leakage.leakage_counts(n.withColumn("same_name", F.lit(False)), [0.5], 30), path)
    rows = spark.read.option("header", True).csv(f"{path}/nearest").groupBy("held", "split").agg(F.count("*").alias("n"), F.round(F.sum(F.col("cosine").cast("double")), 3).alias("cosines"))
    counts = spark.read.json(f"{path}/summary").select("held", "split", "near_bits", "cosine_50")
    return rows.join(counts, ["held", "split"])


def report_lines(spark, sf_dir):
    """A formatted report of the suppliers' balances."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    return sinks.report(s, [("s_name", "%-20s"), ("s_acctbal", "%12.2f")], ["s_suppkey"])


def label_map_document(spark, sf_dir):
    return sinks.label_map(_names(spark, sf_dir))


def append_new_rows(spark, sf_dir):
    """Events appended in three overlapping runs: every key once."""
    path, e = scratch_path(spark, "append"), table(spark, sf_dir, "events").select("event_id", "user_id")
    for keep in ("event_id % 3 = 0", "event_id % 2 = 0", "true"):
        sinks.append_new(e.where(keep), path, ["event_id"])
    return spark.read.parquet(path)


def fold_results(spark, sf_dir):
    """Evaluation documents of every market segment as a fold, read with the folds' numbers."""
    base = scratch_path(spark, "results")
    c = table(spark, sf_dir, "customer").groupBy((F.col("c_nationkey") % 4).alias("fold")).agg(F.count("*").alias("support"), F.avg("c_nationkey").alias("m"))
    doc = F.to_json(F.struct((F.col("m") / 100).alias("mAP"), F.lit(0.5).alias("mAP_50"), F.create_map(F.lit("dent"), F.struct((F.col("m") / 50).alias("AP"), F.lit(0.25).alias("AP_50"), "support")).alias("per_class")))
    each = _one_file_each(spark, c.select(F.col("fold").cast("string").alias("stem"), doc.alias("value")), ".json")
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(each).getFileSystem(spark._jsc.hadoopConfiguration())
    for f in fs.globStatus(hadoop.Path(f"{each}/*.json")):
        folder = hadoop.Path(f"{base}/fold_{f.getPath().getName().removesuffix('.json')}")
        fs.mkdirs(folder)
        fs.rename(f.getPath(), hadoop.Path(folder, "eval_results.json"))
    numbers = spark.createDataFrame([(n,) for n in readers.fold_numbers(spark, base)], "fold_id int")
    r = readers.results(spark, base).join(numbers, "fold_id")
    dent = F.col("per_class")["dent"]
    return r.select("fold_id", F.round("mAP", 6).alias("map"), F.round(dent["AP"], 6).alias("ap"), dent["support"].alias("support"))


def category_registry(spark, sf_dir):
    """Numbers of the names of brands and types in first-seen order, spaces and case aside."""
    p = table(spark, sf_dir, "part")
    seen = p.select(F.concat(F.lit(" "), "p_brand").alias("name"), (F.col("p_partkey") * 2).alias("seen")).union(p.select(F.upper("p_type"), F.col("p_partkey") * 2 + 1))
    return ids.category_numbers(seen)


def remapped_boxes(spark, sf_dir):
    """Boxes with new image ids; those of images without one drop."""
    m = _images(spark, sf_dir).select("image_id", F.when(F.col("fold_id") > 0, F.col("image_id") + 1_000_000).alias("new_id"))
    return merge.remap(_boxes(spark, sf_dir), m, ["image_id"]).select("ann_id", "new_id", "class_id")


def listed_pair_edges(spark, sf_dir):
    """Edges of an outside list of pairs: documents and the one a third of their id; unknown and equal ones are ignored."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"))
    pairs = d.select(F.col("path").alias("path_a"), F.concat(F.lit("d"), (F.col("idx") / 3).cast("long").cast("string")).alias("path_b"))
    return registry.pair_edges(pairs.union(pairs.select("path_b", "path_a")).union(pairs.select("path_a", F.lit("nowhere"))), d)


def registered_files(spark, sf_dir):
    """Files looked up in the registry; all of them must be known and readable."""
    images = _images(spark, sf_dir)
    files = _boxes(spark, sf_dir).select(F.concat(F.col("image_id").cast("string"), F.lit(".jpg")).alias("file")).distinct()
    return audit.refuse_unreadable(audit.checked_lookup(files, images.select("file", "image_id", "fold_id")), "file", "image_id").select("file", "image_id", "fold_id")


def fold_file_problems(spark, sf_dir):
    """Missing files of the folds of the market segments, and label maps of a wrong size."""
    c = table(spark, sf_dir, "customer")
    files = c.where("c_nationkey > 2").select(F.col("c_mktsegment").alias("fold"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("name")).distinct()
    maps = c.groupBy(F.col("c_mktsegment").alias("fold")).agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct((F.col("c_nationkey") % 5).cast("string").alias("k"), F.lit("x").alias("v"))))).alias("classes"))
    folds = sorted(r.fold for r in maps.select("fold").collect())  # a row for each segment
    return leakage.file_problems(files, folds, ["n1", "n7"], maps, 4)


QUERIES = {f.__name__: f for f in (coco_round_trip, coco_canonical, coco_checked, coco_renumbered, odvg_round_trip, odvg_decoded, yolo_round_trip, per_image_round_trip, inline_round_trip, all_sources, drops_round_trip, pair_csv_round_trip, embedding_cache_units, manifest_round_trip, registry_round_trip, nearest_round_trip, report_lines, label_map_document, append_new_rows, fold_results, category_registry, remapped_boxes, listed_pair_edges, registered_files, fold_file_problems)}

_REG = lambda kind: f"SELECT '{kind}' AS kind, 'images' AS name, count(*) AS n, count(DISTINCT image_id) AS ids FROM i UNION ALL SELECT '{kind}', 'annotations', count(*), count(DISTINCT ann_id) FROM b UNION ALL SELECT '{kind}', 'groups', count(DISTINCT fold_id), count(DISTINCT fold_id) FROM i UNION ALL SELECT '{kind}', 'folds', count(*), count(DISTINCT fold_id) FROM i"
SQL = {
    "coco_round_trip": f"WITH {_SQL_BOXES} SELECT split, file AS file_name, ann_id, name AS raw_class, x, y, w, h, w * h AS area, 0 AS iscrowd FROM b JOIN i USING (image_id) JOIN n USING (class_id)",
    "coco_canonical": f"""WITH {_SQL_BOXES}, k AS (SELECT *, row_number() OVER (ORDER BY file, image_id) - 1 AS new FROM i)
        SELECT row_number() OVER (ORDER BY new, class_id, y, x, ann_id) - 1 AS ann_id, new AS old_image_id, file AS file_name, name AS raw_class, x, y, w, h FROM b JOIN k USING (image_id) JOIN n USING (class_id)""",
    "coco_checked": f"WITH {_SQL_BOXES} SELECT CAST(class_id AS VARCHAR) AS what, count(*) AS n, sum(w) AS widths FROM b WHERE class_id < 2 GROUP BY 1 UNION ALL SELECT name, count(*), NULL FROM b JOIN n USING (class_id) WHERE class_id >= 2 GROUP BY 1",
    "coco_renumbered": f"""WITH {_SQL_BOXES}, k AS (SELECT *, row_number() OVER (ORDER BY image_id) AS new FROM i WHERE split = 'train')
        SELECT image_id, file_name, min(id) AS first, max(id) AS last, count(*) AS n, sum(area) AS area FROM (
          SELECT row_number() OVER (ORDER BY ann_id) AS id, new AS image_id, file AS file_name, w * h AS area FROM b JOIN k USING (image_id) JOIN n USING (class_id)) GROUP BY 1, 2""",
    "odvg_round_trip": f"WITH {_SQL_BOXES} SELECT fold_id AS fold, image_id, class_id, x, y, w, h FROM b JOIN i USING (image_id) WHERE class_id < 4",
    "odvg_decoded": f"WITH {_SQL_BOXES} SELECT file AS filename, count(*) FILTER (class_id < 4) AS n, '0,3' AS classes FROM i LEFT JOIN b USING (image_id) GROUP BY 1",
    "yolo_round_trip": f"WITH {_SQL_SUPPLIERS} SELECT 's' || s_suppkey || '.png' AS file_name, count(k.stem) AS n, round(coalesce(sum((x2 - x1) * (y2 - y1)), 0), 3) AS area FROM supplier LEFT JOIN k ON k.stem = 's' || s_suppkey GROUP BY 1",
    "per_image_round_trip": f"WITH {_SQL_SUPPLIERS} SELECT stem || '.png' AS file_name, count(*) AS n, round(sum((x2 - x1) * (y2 - y1)), 3) AS area, count(*) AS n_check, round(sum((x2 - x1) * (y2 - y1)), 3) AS area_check FROM k GROUP BY 1",
    "inline_round_trip": """
        WITH c AS (SELECT n_nationkey, n_name, row_number() OVER (ORDER BY n_nationkey, c_custkey) AS ann_id, c_custkey AS k, c_mktsegment FROM customer JOIN nation ON n_nationkey = c_nationkey),
        i AS (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) AS old FROM nation)
        SELECT ann_id, old AS old_image_id, n_name AS file_name, CASE WHEN k % 3 > 0 THEN c_mktsegment ELSE 'none' END AS raw_class, (k % 8) / 8 * 80 - 10.0::DOUBLE AS x, (k % 4) / 4 * 40 - 10.0::DOUBLE AS y, 400.0::DOUBLE AS area FROM c JOIN i USING (n_nationkey)""",
    "all_sources": f"""WITH {_SQL_BOXES}, {_SQL_SUPPLIERS} SELECT 'orders' AS dataset, 0 AS dataset_ord, (SELECT count(*) FROM i) AS images, (SELECT count(*) FROM b) AS boxes
        UNION ALL SELECT 'suppliers', 1, (SELECT count(DISTINCT stem) FROM l JOIN supplier ON stem = 's' || s_suppkey), (SELECT count(*) FROM k JOIN supplier ON stem = 's' || s_suppkey)""",
    "drops_round_trip": "SELECT DISTINCT CAST(p_size % 6 AS VARCHAR) AS fold_id, p_name AS file FROM part",
    "pair_csv_round_trip": "SELECT 'p' || l_partkey AS path_a, 'o' || l_orderkey AS path_b, round(l_discount * 10, 6) AS cosine, l_quantity::INTEGER AS inliers FROM lineitem WHERE l_quantity >= 30",
    "embedding_cache_units": """
        WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: (x::DOUBLE * 4)::FLOAT::DOUBLE) AS v FROM embeddings), u AS (SELECT vec_id, v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))) AS f FROM e)
        SELECT CAST(vec_id AS VARCHAR) AS path, round(f, 5) AS first, round(1 / (1 + exp(-f)), 5) AS gate FROM u""",
    "manifest_round_trip": "SELECT r_name || '.txt' AS path, CASE r_regionkey WHEN 2 THEN 'changed' ELSE 'unlisted' END AS problem FROM region WHERE r_regionkey IN (2, 3) UNION ALL SELECT 'nowhere.txt', 'missing'",
    "registry_round_trip": f"WITH {_SQL_BOXES} {_REG('parquet')} UNION ALL {_REG('json')}",
    "nearest_round_trip": "SELECT l_returnflag AS held, l_linestatus AS split, count(*) AS n, round(sum(round(l_quantity / 64, 4)), 3) AS cosines, count(*) FILTER (l_suppkey <= 30) AS near_bits, count(*) FILTER (l_quantity / 64 >= 0.5) AS cosine_50 FROM lineitem GROUP BY 1, 2",
    "report_lines": """SELECT row_number() OVER (ORDER BY s_suppkey) + 1 AS nth, printf('%-20s %12.2f', s_name, s_acctbal) AS line FROM supplier
        UNION ALL SELECT 0, printf('%-20s %12s', 's_name', 's_acctbal') UNION ALL SELECT 1, repeat('-', 33)""",
    "label_map_document": "SELECT '{' || string_agg('\"' || r_regionkey || '\":\"' || r_name || '\"', ',' ORDER BY CAST(r_regionkey AS VARCHAR)) || '}' AS value FROM region",
    "append_new_rows": "SELECT event_id, user_id FROM events",
    "fold_results": "SELECT CAST(c_nationkey % 4 AS INTEGER) AS fold_id, round(avg(c_nationkey) / 100, 6) AS map, round(avg(c_nationkey) / 50, 6) AS ap, count(*) AS support FROM customer GROUP BY 1",
    "category_registry": """
        WITH s AS (SELECT lower(p_brand) AS category, p_partkey * 2 AS seen FROM part UNION ALL SELECT lower(p_type), p_partkey * 2 + 1 FROM part)
        SELECT category, row_number() OVER (ORDER BY min(seen), category) - 1 AS category_id FROM s GROUP BY 1""",
    "remapped_boxes": f"WITH {_SQL_BOXES} SELECT ann_id, image_id + 1000000 AS new_id, class_id FROM b JOIN i USING (image_id) WHERE fold_id > 0",
    "listed_pair_edges": "SELECT DISTINCT doc_id // 3 AS a, doc_id AS b FROM documents WHERE doc_id // 3 <> doc_id AND doc_id // 3 IN (SELECT doc_id FROM documents)",
    "registered_files": f"WITH {_SQL_BOXES} SELECT DISTINCT file, image_id, fold_id FROM b JOIN i USING (image_id)",
    "fold_file_problems": """
        WITH f AS (SELECT DISTINCT c_mktsegment AS fold FROM customer), h AS (SELECT DISTINCT c_mktsegment AS fold, 'n' || c_nationkey AS name FROM customer WHERE c_nationkey > 2)
        SELECT fold, 'missing: ' || name AS problem FROM f, (VALUES ('n1'), ('n7')) v(name) WHERE (fold, name) NOT IN (SELECT (fold, name) FROM h)
        UNION ALL SELECT c_mktsegment, 'label map of ' || count(DISTINCT c_nationkey % 5) || ' classes' FROM customer GROUP BY 1 HAVING count(DISTINCT c_nationkey % 5) <> 4""",
}
