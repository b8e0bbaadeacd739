"""JSON documents read by many tasks, against json.loads."""

import json
import random

import pytest
from pyspark.sql import functions as F

from foldsmith.operators.audit import Unreadable
from foldsmith.plans import roundtrips
from foldsmith.sources import readers, sinks
from foldsmith.sources.documents import elements


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def document(seed):
    r = random.Random(seed)
    odd = ['a"b', "x}y{", "\\", '\\"}', "é中}", "", '": [{"id": 7}', "a" * 150 + "}" * 40, "\n]"]
    deep = lambda k: {"size": [k, {"n": r.choice(odd)}], "counts": [[r.random()] * r.randrange(30)], "more": {r.choice(odd): {"deep": [{}] * r.randrange(60)}}}
    parts = [("info", {"images": [{"id": -1}], "note": r.choice(odd)}), ("version", r.choice(odd)), ("images", [{"id": k, "file_name": r.choice(odd)} for k in range(r.randrange(9))]), ("annotations", [{"id": k, "rle": deep(k)} for k in range(r.randrange(9))]), ("a}b", [{"id": 1}]), ("categories", [{"id": 0, "name": r.choice(odd)}]), ("n", None), ("x", [[{"id": 3}], 4, "}"])]
    r.shuffle(parts)
    return json.dumps(dict(parts), indent=r.choice([None, 1]), ensure_ascii=r.random() < 0.5) + r.choice(["", "\n"])


def test_elements_of_split_documents(spark, tmp_path, small_splits):
    names, docs = ["images", "annotations", "categories", "absent"], [document(seed) for seed in range(6)]
    for k, d in enumerate(docs):
        (tmp_path / f"{k}.json").write_text(d, encoding="utf-8")
    found = elements(spark, [str(tmp_path / f"{k}.json") for k in range(len(docs))], names)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64m")
    key = lambda doc, x: (doc, json.dumps(x, sort_keys=True))
    for name, rows in zip(names, found):
        got = sorted(key(r.doc, json.loads(r.value)) for r in rows.collect())
        assert got == sorted(key(k, x) for k, d in enumerate(docs) for x in json.loads(d).get(name) or [])


def test_a_document_that_breaks_off(spark, tmp_path, small_splits):
    (tmp_path / "a.json").write_text('{"images": [{"id": 1}, {"id": "x')
    with pytest.raises(Unreadable, match="whole"):
        elements(spark, [str(tmp_path / "a.json")], ["images"])


def test_no_task_reads_a_whole_coco_document(spark, tmp_path):
    box = roundtrips.B.box(F.lit(1), F.lit(2), F.lit(3), F.lit(4))
    images = spark.range(300).select(F.col("id").alias("image_id"), F.concat(F.col("id").cast("string"), F.lit(".jpg")).alias("file"), F.lit(9).alias("width"), F.lit(8).alias("height"))
    boxes = spark.range(3000).select(F.col("id").alias("ann_id"), (F.col("id") % 300).alias("image_id"), F.lit(0).alias("class_id"), box.alias("box"))
    names = spark.createDataFrame([(0, "dent")], "class_id int, name string")
    sinks.write_coco(images, boxes, names, str(tmp_path / "train/_annotations.coco.json"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        _, ann = readers.coco(spark, str(tmp_path), "d")
        checked, dropped = readers.check_boxes(spark, "coco_roboflow", str(tmp_path), "d", names.select(F.col("name").alias("raw_class"), "class_id"))
        for rows in (ann, checked):
            assert rows.count() == 3000
            assert ann.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 2000
        assert dropped.count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
