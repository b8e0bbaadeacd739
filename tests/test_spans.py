"""Token spans of classes against loops, and documents written in parts."""

import json
import random

import pytest
from pyspark.sql import functions as F

from foldsmith.operators import masking, spans
from foldsmith.sources import sinks

CAPTIONS, OFFSETS = "caption_id long, caption string, classes array<string>", "caption_id long, token int, start int, end int"


def brute(captions, offsets):
    out = []
    for cid, text, classes in captions:
        tokens = [(t, s, e) for c, t, s, e in offsets if c == cid and (s, e) != (0, 0)]
        rows = []
        for k, name in enumerate(classes or []):
            at = -1 if text is None or name is None else text.find(name)
            hit = [t for t, s, e in tokens if at >= 0 and s < at + len(name) and e > at]
            rows.append([cid, k, name, min(hit) if hit else None, max(hit) + 1 if hit else None, "not_in_caption" if at < 0 else None if hit else "no_token"])
        reach = 0
        for r in sorted((r for r in rows if r[3] is not None), key=lambda r: (r[3], r[1])):
            r[5] = "overlap" if reach > r[3] else None
            reach = max(reach, r[4])
        out += map(tuple, rows)
    return sorted(out, key=str)


def cut(text, rnd):
    """Offsets of made-up tokens: pieces of words, blanks between, special ones around."""
    at, out = 0, [(0, 0)]
    for word in text.split(" "):
        while word:
            n = rnd.randint(1, 3)
            out.append((at, at + len(word[:n])))
            at, word = at + len(word[:n]), word[n:]
        at += 1
    return [*out, (0, 0), (0, 0)]


def test_spans(spark):
    rnd = random.Random(3)
    captions = [(1, "dent . long scratch . hole .", ["dent", "long scratch", "hole"]), (2, "a b", ["a", "x", "b", None]), (3, None, ["a"]), (4, "aa bb", ["aa bb", "bb", "", " "]), (5, "dent dentist", ["dent", "ist"]), (6, "", []), (7, " ".join(f"w{i}" for i in range(4000)), ["w3999", "w0", "w17"])]
    offsets = [(c, t, s, e) for c, text, _ in captions for t, (s, e) in enumerate(cut(text or "", rnd))]
    got = spans.class_token_spans(spark.createDataFrame(captions, CAPTIONS), spark.createDataFrame(offsets, OFFSETS).repartition(3))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(captions, offsets)
    assert {r.problem for r in got.collect()} == {None, "not_in_caption", "no_token", "overlap"}
    with pytest.raises(ValueError, match="caption 2"):
        spans.refuse_span_problems(got)
    good = spans.refuse_span_problems(got.where("caption_id IN (1, 7)")).where("caption_id = 1")
    mask = good.select(masking.token_mask(F.array(F.lit(0), F.lit(2)), F.col("spans"), 24).alias("m")).first().m
    first = brute(captions, offsets)[0]
    assert mask[first[3]] and not mask[0] and sum(mask) >= 2


def test_a_document_in_parts(spark, tmp_path):
    box = F.struct(F.col("x"), F.lit(2.5).alias("y"), F.lit(3.0).alias("w"), F.lit(4.0).alias("h"))
    images = spark.range(50).select(F.col("id").alias("image_id"), F.concat(F.lit('q"'), "id").alias("file"), F.lit(9).alias("width"), F.lit(8).alias("height"))
    boxes = spark.range(200).select(F.col("id").alias("ann_id"), (F.col("id") % 50).alias("image_id"), F.lit(0).alias("class_id"), F.col("id").cast("double").alias("x")).select("ann_id", "image_id", "class_id", box.alias("box"))
    names = spark.createDataFrame([(0, "dent")], "class_id int, name string")
    path = str(tmp_path / "doc.json")
    sinks.write_coco(images.repartition(5), boxes.repartition(7), names, path)
    doc = json.loads(open(path, encoding="utf-8").read())
    assert [i["id"] for i in doc["images"]] == list(range(50)) and [a["id"] for a in doc["annotations"]] == list(range(200)) and doc["categories"] == [{"id": 0, "name": "dent"}]
    assert doc["annotations"][7]["bbox"] == [7.0, 2.5, 3.0, 4.0] and doc["annotations"][7]["area"] == 12.0
    with pytest.raises(FileExistsError):
        sinks.write_coco(images, boxes, names, path)
    empty = str(tmp_path / "empty.json")
    sinks.write_coco(images.limit(0), boxes.limit(0), names.limit(0), empty)
    assert json.loads(open(empty, encoding="utf-8").read()) == {"images": [], "annotations": [], "categories": []}
