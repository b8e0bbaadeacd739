"""File formats with a few rows, written and read back."""

import json

import pytest
from pyspark.sql import functions as F

from foldsmith.sources import readers, sinks
from foldsmith.streaming import events


def put(path, obj):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(obj if isinstance(obj, str) else json.dumps(obj))


def test_coco(spark, tmp_path):
    doc = {"images": [{"id": 0, "file_name": "a.jpg", "width": 10, "height": 10}, {"id": 1, "file_name": "gone.jpg", "width": 10, "height": 10}], "categories": [{"id": 1, "name": "dent"}, {"id": 2, "name": "odd"}],
           "annotations": [{"id": 1, "image_id": 0, "category_id": 1, "bbox": [1, 2, 30, 4]}, {"id": 2, "image_id": 0, "category_id": 2, "bbox": [0, 0, 1, 1], "area": 9.0, "iscrowd": 1}]}
    put(tmp_path / "train/_annotations.coco.json", doc)
    images, ann = readers.coco(spark, str(tmp_path), "d")
    kept, missing = readers.existing(images, spark.createDataFrame([("a.jpg",)], "file_name string"))
    assert kept.count() == 1 and missing.first().issue == "missing file: gone.jpg"
    mapped, dropped = readers.remap_classes(ann, spark.createDataFrame([("d", "dent", "damage")], "dataset string, raw_class string, unified string"), spark.createDataFrame([("damage", 0)], "unified string, class_id int"))
    r = mapped.first()
    assert (tuple(r.box), r.area, r.iscrowd, r.class_id, r.split) == ((1, 2, 30, 4), 120, 0, 0, "train") and dropped.count() == 1
    with pytest.raises(ValueError):
        readers.read_dataset(spark, "nothing")


def test_yolo(spark, tmp_path):
    put(tmp_path / "a.txt", "0 0.95 0.5 0.2 0.5\n1 0.5 0.5\n")
    put(tmp_path / "empty.txt", "")
    sizes = spark.createDataFrame([("a", "a.jpg", 100, 200), ("empty", "empty.jpg", 5, 5), ("none", "none.jpg", 5, 5)], "stem string, file_name string, width int, height int")
    images, ann = readers.yolo(spark, str(tmp_path / "*.txt"), sizes, "y")
    assert {r.old_id for r in images.collect()} == {"a", "empty"}
    assert [([round(x, 6) for x in r.box], round(r.area, 6)) for r in ann.collect()] == [([85, 50, 15, 100], 1500)]


def test_per_image(spark, tmp_path):
    one = lambda label, x: {"label": label, "coordinates": {"x": x, "y": 5, "width": 4, "height": 4}}
    put(tmp_path / "a.json", [{"image": "a.png", "annotations": [one("dent", 9), one("out", 90)]}, {"image": "b.png", "annotations": [one("dent", 5)]}])
    put(tmp_path / "e.json", [])
    images, ann = readers.per_image(spark, str(tmp_path / "*.json"), spark.createDataFrame([("a.png", 10, 10), ("b.png", 10, 10)], "file_name string, width int, height int"), "f")
    assert images.count() == 1 and [(r.raw_class, tuple(r.box)) for r in ann.collect()] == [("dent", (7, 3, 3, 4))]


def test_odvg_and_back(spark, tmp_path):
    images = spark.createDataFrame([(0, "train", 1, "b.jpg", 5, 6), (0, "train", 2, "a.jpg", 5, 6)], "fold_id int, split string, image_id long, file string, height int, width int")
    ann = spark.createDataFrame([(1, 1, 2.0, 0.0), (1, 0, 1.0, 3.0)], "image_id long, class_id int, x double, y double").select("image_id", "class_id", F.struct("x", "y", F.lit(2.0).alias("w"), F.lit(1.0).alias("h")).alias("box"))
    names = spark.createDataFrame([(0, "dent"), (1, "scratch")], "class_id int, name string")
    rows = sinks.odvg_rows(images, ann, spark.createDataFrame([(1, [0, 1])], "image_id long, classes array<int>"), names)
    out = str(tmp_path / "out")
    sinks.write_odvg(rows, out)
    with pytest.raises(Exception, match="exist"):
        sinks.write_odvg(rows, out)
    back = readers.fold_lines(spark, f"{out}/fold_id=0/split=train", "/root/").orderBy("filename").collect()
    assert [r.filename for r in back] == ["/root/a.jpg", "/root/b.jpg"] and back[0].detection.instances == []
    assert [(i.label, i.bbox) for i in back[1].detection.instances] == [(0, [1, 3, 3, 4]), (1, [2, 0, 4, 1])]
    truth = readers.truth_of_lines(readers.fold_lines(spark, f"{out}/fold_id=0/split=train").withColumn("line_no", F.lit(0).cast("long")), 1)
    assert [(r.class_id, r.w) for r in truth.collect()] == [(0, 2)]
    m = sinks.manifest(spark, out).collect()
    assert m and all(len(r.sha256) == 64 and not r.path.startswith("/") for r in m)
    doc = sinks.coco_document(images, ann.withColumn("ann_id", F.monotonically_increasing_id()), names).first()
    assert len(doc.images) == 2 and len(doc.annotations) == 2 and json.loads(sinks.label_map(names).first().value) == {"0": "dent", "1": "scratch"}


def test_pairs_drops_folds_results(spark, tmp_path):
    put(tmp_path / "p.csv", "path_a,path_b,cosine,inliers\na,b,0.5,30\nb,c,0.4,3\n")
    assert readers.pair_csv(spark, str(tmp_path / "p.csv"), 25).count() == 1
    drops = spark.createDataFrame([(0, "x"), (0, "y"), (2, "z")], "fold_id int, file string")
    sinks.write_drops(drops, str(tmp_path / "d"))
    assert {(r.fold_id, r.file) for r in readers.drop_lists(spark, str(tmp_path / "d")).collect()} == {("0", "x"), ("0", "y"), ("2", "z")}
    put(tmp_path / "fold_10/eval_results.json", {"mAP": 0.5, "per_class": {"dent": {"AP": -1.0, "AP_50": 0.1, "support": 0}}})
    put(tmp_path / "fold_2/other.json", {})
    assert readers.fold_numbers(spark, str(tmp_path)) == [2, 10]
    assert [(r.fold_id, r.per_class["dent"].AP) for r in readers.results(spark, str(tmp_path)).collect()] == [(10, -1.0)]
    with pytest.raises(FileNotFoundError):
        readers.fold_numbers(spark, str(tmp_path / "none"))


def test_report_sections(spark):
    text = """=== Exact matches (Distance 0): A vs B ===
Names match: True | img_1 | img_1
  A/train/IMG_1_jpg.rf.aa.jpg
  B/test/img_1_jpg.rf.bb.jpg
=== Closest fuzzy matches: A vs B ===
  A/x.jpg
  A/y.jpg"""
    lines = spark.createDataFrame(list(enumerate(text.split("\n"))), "n long, line string")
    assert [tuple(r) for r in readers.section_pairs(lines, "n", "line").collect()] == [("A vs B", 0, "A/train/IMG_1_jpg.rf.aa.jpg", "B/test/img_1_jpg.rf.bb.jpg")]


def test_append_and_resume(spark, tmp_path):
    t = str(tmp_path / "t")
    df = spark.createDataFrame([(1, 0.5), (2, 0.6)], "k long, v double")
    assert (sinks.append_new(df, t, ["k"]), sinks.append_new(df, t, ["k"])) == (2, 0)
    src = str(tmp_path / "s")
    for part in ([1, 2], [3]):
        spark.createDataFrame([(x,) for x in part], "k long").coalesce(1).write.mode("append").parquet(src)
        events.resume(spark, src, "k long", lambda s: s.withColumn("d", F.col("k") * 2), str(tmp_path / "o"), str(tmp_path / "c"))
    assert sorted(r.d for r in spark.read.parquet(str(tmp_path / "o")).collect()) == [2, 4, 6]


def test_upsert_and_windows(spark, tmp_path):
    u = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, None)], "k string, o int, value string")
    s = events.upsert(spark.createDataFrame([("b", "old"), ("c", "z")], "k string, value string"), u, ["k"], "o")
    assert sorted(map(tuple, s.collect())) == [("a", "y"), ("c", "z")]
    src = str(tmp_path / "e")
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    q = events.windowed_counts(events.without_repeats(stream), None).writeStream.outputMode("append").format("memory").queryName("w").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert 0 < spark.table("w").agg(F.sum("n")).first()[0] <= 1000


def test_all_sources_and_the_check_reader(spark, tmp_path):
    coco = {"images": [{"id": 0, "file_name": "a.jpg", "width": 10, "height": 10}], "categories": [{"id": 1, "name": "dent"}, {"id": 2, "name": "odd"}],
            "annotations": [{"id": 1, "image_id": 0, "category_id": 1, "bbox": [1, 2, 3, 4]}, {"id": 2, "image_id": 0, "category_id": 2, "bbox": [0, 0, 1, 1]}, {"id": 3, "image_id": 0, "category_id": 1, "bbox": [1, 2, 0, 4]}]}
    put(tmp_path / "c/train/_annotations.coco.json", coco)
    put(tmp_path / "y/a.txt", "0 0.95 0.5 0.2 0.5\n7 0.5 0.5 0.1 0.1\n0 3.0 0.5 0.1 0.1\nshort\n")
    put(tmp_path / "y/none.txt", "")
    put(tmp_path / "f/a.json", [{"image": "a.png", "annotations": [{"label": "dent", "coordinates": {"x": 9, "y": 5, "width": 4, "height": 4}}]}])
    put(tmp_path / "f/e.json", [])
    sizes = spark.createDataFrame([("a", "a.jpg", 100, 200), ("none", "none.jpg", 5, 5)], "stem string, file_name string, width int, height int")
    png = spark.createDataFrame([("a", "a.png", 10, 10)], sizes.schema)
    c, y, f = str(tmp_path / "c"), str(tmp_path / "y/*.txt"), str(tmp_path / "f/*.json")
    images, ann = readers.read_all(spark, [("d", "coco_roboflow", (c,)), ("y", "yolo", (y, sizes)), ("f", "fuselage_json", (f, png))])
    assert {(r.dataset, r.dataset_ord, r.old_id) for r in images.collect()} == {("d", 0, "0"), ("y", 1, "a"), ("y", 1, "none"), ("f", 2, "a.png")}
    assert ann.groupBy("dataset").count().count() == 3
    names = spark.createDataFrame([("dent", 0), ("0", 0)], "raw_class string, class_id int")
    boxes, dropped = readers.check_boxes(spark, "coco_roboflow", c, "d", names)
    assert [tuple(r) for r in boxes.collect()] == [("a.jpg", 0, 1, 2, 4, 6)]
    assert {(r.reason, r.n) for r in dropped.collect()} == {("odd", 1), ("dent (without an area)", 1)}
    boxes, dropped = readers.check_boxes(spark, "yolo", y, "y", names, sizes)
    assert [(r.image, round(r.x1, 6), r.y1, r.x2, r.y2) for r in boxes.collect()] == [("a.jpg", 85, 50, 100, 150)]
    assert {(r.dataset, r.reason, r.n) for r in dropped.collect()} == {("y", "7", 1), ("y", "0 (without an area)", 1)}
    boxes, _ = readers.check_boxes(spark, "fuselage_json", f, "f", names, png)
    assert [tuple(r) for r in boxes.collect()] == [("a.png", 0, 7, 3, 10, 7)]
    with pytest.raises(ValueError):
        readers.check_boxes(spark, "nothing", c, "d", names)


def test_inline_and_renumbered(spark, tmp_path):
    norm = {"x_center": 0.5, "y_center": 0.25, "width": 0.2, "height": 0.1}
    put(tmp_path / "i.json", {"images": [{"file_name": "b.jpg", "annotations": [{"bounding_box_normalized": norm}, {"category_name": "dent", "bounding_box_normalized": norm}]}, {"file_name": "a.jpg"}]})
    sizes = spark.createDataFrame([("a.jpg", 10, 20), ("b.jpg", 100, 200)], "file_name string, width int, height int")
    images, ann = readers.inline_json(spark, str(tmp_path / "i.json"), sizes, "k")
    assert [(r.old_id, r.file_name, r.width) for r in images.orderBy("old_id").collect()] == [(1, "b.jpg", 100), (2, "a.jpg", 10)]
    assert [(r.ann_id, r.old_image_id, r.raw_class, [round(x, 6) for x in r.box]) for r in ann.orderBy("ann_id").collect()] == [(1, 1, "defect", [40, 40, 20, 20]), (2, 1, "dent", [40, 40, 20, 20])]
    with pytest.raises(readers.Unreadable):
        readers.inline_json(spark, str(tmp_path / "i.json"), sizes.where("width > 50"), "k")
    doc = {"images": [{"id": 7, "file_name": "b.jpg", "width": 1, "height": 1}, {"id": 3, "file_name": "a.jpg", "width": 1, "height": 1}], "categories": [{"id": 1, "name": "dent"}], "annotations": [{"id": 9, "image_id": 7, "category_id": 1, "bbox": [0, 0, 3, 4], "area": 99.0}]}
    put(tmp_path / "c/train/_annotations.coco.json", doc)
    images, ann = readers.coco_again(spark, str(tmp_path / "c"), sizes, "r")
    assert {(r.old_id, r.id) for r in images.collect()} == {(3, 1), (7, 2)} and [(r.id, r.image_id, r.area) for r in ann.collect()] == [(1, 2, 12)]
    with pytest.raises(readers.Unreadable):
        readers.coco_again(spark, str(tmp_path / "c"), sizes.where("width > 50"), "r")


def test_embedding_cache(spark, tmp_path):
    assert readers.embedding_cache(spark, str(tmp_path / "no")).count() == 0
    spark.createDataFrame([("a", [1.0, 0.0])], "path string, embedding array<double>").write.parquet(str(tmp_path / "e"))
    assert readers.embedding_cache(spark, str(tmp_path / "e")).first().embedding == [1.0, 0.0]


def test_reports_and_registry_files(spark, tmp_path):
    box = F.struct(F.lit(1.0).alias("x"), F.col("y"), F.lit(2.0).alias("w"), F.lit(2.0).alias("h"))
    images = spark.createDataFrame([(5, "b.jpg", 4, 4), (6, "a.jpg", 4, 4)], "image_id long, file string, width int, height int")
    ann = spark.createDataFrame([(1, 5, 0, 3.0), (2, 6, 1, 2.0), (3, 6, 0, 9.0)], "ann_id long, image_id long, class_id int, y double").select("ann_id", "image_id", "class_id", box.alias("box"))
    names = spark.createDataFrame([(0, "dent"), (1, "hole")], "class_id int, name string")
    doc = sinks.canonical_coco(images, ann, names).first()
    assert [(i.id, i.file_name) for i in doc.images] == [(0, "a.jpg"), (1, "b.jpg")]
    assert [(a.id, a.image_id, a.category_id, a.bbox[1]) for a in doc.annotations] == [(0, 0, 0, 9), (1, 0, 1, 2), (2, 1, 0, 3)]
    near = spark.createDataFrame([("h", "val", 1, 2, 0.5, 3), ("h", "val", 4, 2, 0.75, 3)], "held string, split string, id long, near long, cosine double, distance long")
    sinks.write_nearest(near, near.groupBy("held", "split").count(), str(tmp_path / "n"))
    back = spark.read.option("header", True).csv(str(tmp_path / "n/nearest"))
    assert [(r.id, r.cosine) for r in back.collect()] == [("4", "0.7500"), ("1", "0.5000")]
    lines = sinks.report(names.withColumn("ap", F.lit(0.12345)), [("name", "%-8s"), ("ap", "%10.4f")], ["class_id"]).orderBy("nth").collect()
    assert [r.line for r in lines] == ["name             ap", "-" * 19, "dent         0.1235", "hole         0.1235"] or lines[2].line.endswith("0.1234")
    sinks.write_registry(str(tmp_path / "r"), images, ann, names, names, as_json=True)
    assert spark.read.parquet(str(tmp_path / "r/annotations")).count() == 3 and spark.read.json(str(tmp_path / "r/json/images")).count() == 2
    meta = json.loads(sinks.run_metadata(spark, {"train": 3}, {"lr": 1}, 42).first().value)
    assert (meta["seed"], meta["train"], meta["config"], meta["spark"]) == (42, 3, {"lr": 1}, spark.version)


def test_states_of_another_configuration_and_unfinished_ones_do_not_count(spark, tmp_path):
    path = str(tmp_path / "s")
    assert events.load_state(spark, path, "x") == (None, -1)
    for n in (1, 2, 3):
        events.save_state(spark.createDataFrame([(n,)], "v int"), path, n, "x" if n < 3 else "y")
    (tmp_path / "s/version=000000002/_SUCCESS").unlink()
    state, n = events.load_state(spark, path, "x")
    assert (state.first().v, n, state.columns) == (1, 1, ["v"]) and events.load_state(spark, path, "y")[1] == 3 and events.load_state(spark, path, "z")[0] is None
