"""What documents take of the disk while they are written and read."""

import json
import os

import pytest
from pyspark.sql import functions as F

from foldsmith.functions import boxes as B
from foldsmith.plans import roundtrips
from foldsmith.session import shared_dir
from foldsmith.sources import readers, sinks


def held(folder):
    """Bytes of the files below a folder, without what is only linked there."""
    files = (os.path.join(at, f) for at, _, names in os.walk(folder) for f in names)
    return sum(os.lstat(f).st_size for f in files)


def tables(spark, n):
    images = spark.range(n // 10).select(F.col("id").alias("image_id"), F.concat(F.col("id").cast("string"), F.lit(".jpg")).alias("file"), F.lit(9).alias("width"), F.lit(8).alias("height"), F.when(F.col("id") % 3 == 0, "val").otherwise("train").alias("split"))
    box = B.box(F.lit(1), F.lit(2), F.lit(3), F.lit(4))
    boxes = spark.range(n).select(F.col("id").alias("ann_id"), (F.col("id") % (n // 10 + 1)).alias("image_id"), F.lit(0).alias("class_id"), box.alias("box"))
    return images, boxes, spark.createDataFrame([(0, "dent")], "class_id int, name string")


def test_splits_are_whole_documents_in_order(spark, tmp_path):
    images, boxes, names = tables(spark, 3000)
    sinks.write_coco_splits(images, boxes, names, str(tmp_path), ["train", "val", "none"])
    for split in ("train", "val", "none"):
        d = json.loads((tmp_path / split / "_annotations.coco.json").read_text())
        own = [i for i in range(300) if (i % 3 == 0) == (split == "val") and split != "none"]
        assert [i["id"] for i in d["images"]] == own and d["categories"] == [{"id": 0, "name": "dent"}]
        assert [(a["id"], a["image_id"]) for a in d["annotations"]] == [(k, k % 301) for k in range(3000) if k % 301 in set(own)]


def test_a_document_is_neither_copied_nor_kept_as_parts(spark, tmp_path, monkeypatch):
    images, boxes, names = tables(spark, 20_000)
    before, most = held(shared_dir(spark)), []
    join = sinks._join_parts
    monkeypatch.setattr(sinks, "_join_parts", lambda *a: (most.append(held(shared_dir(spark))), join(*a)))
    sinks.write_coco(images, boxes, names, str(tmp_path / "train/_annotations.coco.json"))
    size = (tmp_path / "train/_annotations.coco.json").stat().st_size
    assert max(most) - before < size / 2 and held(shared_dir(spark)) == before
    elements = readers.elements
    monkeypatch.setattr(readers, "elements", lambda *a: (most.append(held(shared_dir(spark))), elements(*a))[1])
    _, ann = readers.coco(spark, str(tmp_path), "d")
    assert most[-1] - before < size / 100 and held(shared_dir(spark)) - before < size / 2
    assert ann.count() == 20_000


@pytest.mark.parametrize("query", ["coco_round_trip", "all_sources"])
def test_a_read_document_is_deleted(spark, query):
    def documents():
        return [f for _, _, names in os.walk(shared_dir(spark)) for f in names if f.endswith("annotations.coco.json")]

    before = documents()
    rows = roundtrips.QUERIES[query](spark, "/root/testdata/sf0.001")
    assert documents() == before and rows.count() > 0


def test_all_sources_writes_the_second_source_after_the_first_is_read(spark, monkeypatch):
    seen, each, coco = [], roundtrips._one_file_each, readers.coco
    monkeypatch.setattr(roundtrips, "_one_file_each", lambda *a: (seen.append("files"), each(*a))[1])
    monkeypatch.setitem(readers.READERS, "coco_roboflow", lambda *a: (seen.append("document"), coco(*a))[1])
    rows = roundtrips.all_sources(spark, "/root/testdata/sf0.001")
    assert seen == ["document", "files"] and rows.count() == 2
