"""Queries on boxes, generated from line items [P1-P10, P14, P16, P22, P23, F4, F14, G1, I1, I6, J23, J24, T5, T6, U1, C4, A17]."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldsmith.functions import boxes as B
from foldsmith.functions.vectors import span_max
from foldsmith.operators import audit, ids, merge, metrics
from foldsmith.session import table
from foldsmith.sources import readers


def _raw(spark, sf_dir):
    """Normalised centre boxes on images of 100 to 149 by 80 pixels."""
    l = table(spark, sf_dir, "lineitem")
    return l.select(
        "l_orderkey", "l_linenumber", (100 + F.col("l_orderkey") % 50).cast("int").alias("width"), F.lit(80).alias("height"),
        (F.col("l_quantity") / 50).alias("cx"), (F.col("l_tax") * 10).alias("cy"), (F.col("l_discount") * 4).alias("w"), (0.05 + F.col("l_linenumber") / 10).alias("h"), "l_returnflag", "l_suppkey",
    )


RAW = """SELECT l_orderkey, l_linenumber, CAST(100 + l_orderkey % 50 AS INTEGER) AS width, 80 AS height, l_quantity / 50 AS cx, l_tax * 10 AS cy,
                l_discount * 4 AS w, 0.05::DOUBLE + l_linenumber / 10 AS h, l_returnflag, l_suppkey FROM lineitem"""
_r = lambda c: F.round(c, 4)


def box_convert_clip(spark, sf_dir):
    """Clipped pixel boxes with an area, and their normalised centre."""
    x = _raw(spark, sf_dir).withColumn("b", B.from_normal_centre(*map(F.col, ("cx", "cy", "w", "h", "width", "height"))))
    x = x.where(B.has_area(F.col("b")) & B.min_side(F.col("b"), 1.0))
    c = B.to_normal_centre(F.col("b"), F.col("width"), F.col("height"))
    return x.select("l_orderkey", "l_linenumber", *(_r(F.col("b")[k]).alias(k) for k in "xywh"), _r(c[0]).alias("ncx"), _r(c[1]).alias("ncy"))


def box_validity(spark, sf_dir):
    """Boxes that are not clipped and leave their image by more than a pixel, by return flag."""
    x = _raw(spark, sf_dir).withColumn("b", B.from_normal_centre_whole(*map(F.col, ("cx", "cy", "w", "h", "width", "height"))))
    bad = x.where(~B.inside(F.col("b"), F.col("width"), F.col("height")))
    return bad.groupBy("l_returnflag").agg(F.count("*").alias("n_bad"))


def resize_geometry(spark, sf_dir):
    """Sizes after a short-side resize, flip, and the padded square's scale."""
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * 37 % 900 + 100).cast("int").alias("w"), (F.col("p_size") * 29 + 60).cast("int").alias("h"))
    nw, nh = B.short_side_size(F.col("w"), F.col("h"), 480, 800)
    side, _ = B.frame(F.col("w"), F.col("h"), True, False)
    f = B.flip(B.box(F.lit(10), F.lit(5), F.lit(30), F.lit(20)), F.col("w"))
    return p.select("p_partkey", nw.alias("new_w"), nh.alias("new_h"), side.alias("side"), _r(B.square_scale(F.col("w"), F.col("h"), 640)).alias("scale"), f["x"].alias("flip_x"))


def _annotations(spark, sf_dir):
    """Boxes of orders, one class for each return flag, that overlap often."""
    cls = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    nth = F.col("l_linenumber") * 1_000_000_000_000 + F.col("l_partkey") * 1_000_000 + F.col("l_suppkey")
    b = B.box((F.col("l_partkey") % 3) * 2, F.lit(0), 60 + (F.col("l_suppkey") % 2) * 2, F.lit(50))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image_id"), nth.alias("ord"), cls.alias("class_id"), b.alias("box"))


ANN = """SELECT l_orderkey AS image_id, l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey AS ord, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS class_id,
                CAST((l_partkey % 3) * 2 AS DOUBLE) AS x, 0.0::DOUBLE AS y, CAST(60 + (l_suppkey % 2) * 2 AS DOUBLE) AS w, 50.0::DOUBLE AS h FROM lineitem"""
IOU = "(greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * 50 / (a.w * 50 + b.w * 50 - greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * 50))"


def iou_pairs(spark, sf_dir):
    """Overlapping pairs of one image and class."""
    return merge.overlapping(_annotations(spark, sf_dir), 0.9).withColumn("iou", _r(F.col("iou")))


def greedy_iou_dedup(spark, sf_dir):
    """Boxes that the greedy merge keeps, numbered by image and order."""
    return merge.merge_annotations(_annotations(spark, sf_dir), 0.9).select("ann_id", "image_id", "ord", "class_id")


def annotation_check(spark, sf_dir):
    """Images whose merged boxes are exact or explained."""
    a = _annotations(spark, sf_dir)
    return audit.annotation_check(a, merge.merge_annotations(a, 0.9)).groupBy("verdict").agg(F.count("*").alias("n_images"))


def multiset_diff(spark, sf_dir):
    """Multiset difference of line keys on a price grid."""
    l = table(spark, sf_dir, "lineitem").select("l_suppkey", B.grid(F.col("l_tax"), 0.02).alias("g"), "l_returnflag")
    a, b = (l.where(F.col("l_returnflag") == f).select("l_suppkey", "g") for f in ("A", "R"))
    return audit.multiset_difference(a, b)


def class_remap(spark, sf_dir):
    """Raw part types mapped by two tables; and what is dropped [P1]."""
    raw = table(spark, sf_dir, "part").select(F.lit("parts").alias("dataset"), F.split(F.lower("p_type"), " ")[0].alias("raw_class"))
    maps = spark.createDataFrame([("parts", "economy", "cheap"), ("parts", "standard", "plain"), ("parts", "promo", "cheap")], "dataset string, raw_class string, unified string")
    mapped, dropped = readers.remap_classes(raw, maps, spark.createDataFrame([("cheap", 0), ("plain", 1)], "unified string, class_id int"))
    m = mapped.select("raw_class", "class_id").union(dropped.select("raw_class", F.lit(None).cast("int").alias("class_id")))
    return m.groupBy(F.col("raw_class").alias("word"), "class_id").agg(F.count("*").alias("n"), F.count_if(F.col("class_id").isNull()).alias("n_issues"))


def split_offsets(spark, sf_dir):
    """Id offsets of order statuses as splits [I1]."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("split_ord"), F.col("o_orderkey").alias("id"))
    return ids.split_offsets(o)


def default_area(spark, sf_dir):
    """Areas with a default of width times height [P6]."""
    x = _annotations(spark, sf_dir).withColumn("area", F.when(F.col("ord") % 2 == 0, F.lit(7.0)))
    return x.groupBy("class_id").agg(F.sum(B.default_area(F.col("area"), F.col("box"))).alias("area"))


def dropped_labels(spark, sf_dir):
    raw = table(spark, sf_dir, "part").select(F.col("p_brand").alias("dataset"), F.split("p_type", " ")[0].alias("raw_class"))
    return audit.dropped_labels(raw, raw.where("raw_class IN ('ECONOMY', 'PROMO')").distinct())


def _scores(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    s = F.pmod(F.col("l_partkey") * 7919 + F.col("l_linenumber") * 104729, F.lit(1000)) / 1000
    return l.select(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("query"), (F.col("l_suppkey") % 3).cast("int").alias("class_id"), s.alias("score"))


def topk_detections(spark, sf_dir):
    """Three best scores of each image after the mask of its labelled classes, and the floor."""
    s = _scores(spark, sf_dir)
    labelled = s.select("image_id").distinct().select("image_id", F.when(F.col("image_id") % 2 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("classes"))
    return metrics.top_detections(s, labelled, 3, 0.05)


def span_scores(spark, sf_dir):
    """Class scores as the greatest of a span of an embedding [T6]."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", *(F.round(span_max(F.col("embedding"), F.lit(a), F.lit(b)).cast("double"), 6).alias(f"s{a}") for a, b in ((0, 8), (8, 20), (63, 64))))


QUERIES = {f.__name__: f for f in (box_convert_clip, box_validity, resize_geometry, iou_pairs, greedy_iou_dedup, annotation_check, multiset_diff, class_remap, split_offsets, default_area, dropped_labels, topk_detections, span_scores)}
SQL = {
    "box_convert_clip": f"""
        WITH r AS ({RAW}), c AS (SELECT *, greatest(0.0::DOUBLE, cx * width - w * width / 2) AS x1, greatest(0.0::DOUBLE, cy * height - h * height / 2) AS y1,
          least(width::DOUBLE, cx * width + w * width / 2) AS x2, least(height::DOUBLE, cy * height + h * height / 2) AS y2 FROM r)
        SELECT l_orderkey, l_linenumber, round(x1, 4) AS x, round(y1, 4) AS y, round(x2 - x1, 4) AS w, round(y2 - y1, 4) AS h,
          round((x1 + (x2 - x1) / 2) / width, 4) AS ncx, round((y1 + (y2 - y1) / 2) / height, 4) AS ncy
        FROM c WHERE x2 - x1 > 0 AND y2 - y1 > 0 AND least(x2 - x1, y2 - y1) >= 1""",
    "box_validity": f"""
        WITH r AS ({RAW}), c AS (SELECT *, cx * width - w * width / 2 AS x1, cy * height - h * height / 2 AS y1, w * width AS bw, h * height AS bh FROM r)
        SELECT l_returnflag, count(*) AS n_bad FROM c WHERE NOT (bw > 0 AND bh > 0 AND x1 >= -1 AND y1 >= -1 AND x1 + bw <= width + 1 AND y1 + bh <= height + 1) GROUP BY 1""",
    "resize_geometry": """
        WITH p AS (SELECT p_partkey, CAST(p_partkey * 37 % 900 + 100 AS INTEGER) AS w, CAST(p_size * 29 + 60 AS INTEGER) AS h FROM part),
        s AS (SELECT *, least(w, h)::DOUBLE AS lo, greatest(w, h)::DOUBLE AS hi FROM p),
        t AS (SELECT *, CASE WHEN hi / lo * 480 > 800 THEN round_even(800 * lo / hi, 0) ELSE 480.0::DOUBLE END AS sh FROM s),
        u AS (SELECT *, round_even(sh * hi / lo, 0) AS lg FROM t)
        SELECT p_partkey, CAST(CASE WHEN h <= w THEN lg ELSE sh END AS INTEGER) AS new_w, CAST(CASE WHEN h <= w THEN sh ELSE lg END AS INTEGER) AS new_h,
          greatest(w, h) AS side, round(640::DOUBLE / greatest(w, h), 4) AS scale, CAST(w - 40 AS DOUBLE) AS flip_x FROM u""",
    "iou_pairs": f"WITH t AS ({ANN}) SELECT a.image_id, a.class_id, a.ord AS a, b.ord AS b, round({IOU}, 4) AS iou FROM t a JOIN t b ON a.image_id = b.image_id AND a.class_id = b.class_id AND a.ord < b.ord WHERE {IOU} > 0.9",
    "greedy_iou_dedup": f"""
        WITH RECURSIVE t AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY ord) AS k FROM ({ANN})),
        g AS (SELECT image_id, 0::BIGINT AS k, [] :: STRUCT(c INTEGER, x DOUBLE, w DOUBLE)[] AS kept, NULL::BIGINT AS ord, NULL::INTEGER AS class_id, false AS ok FROM (SELECT DISTINCT image_id FROM t)
          UNION ALL
          SELECT image_id, k, CASE WHEN hit THEN kept ELSE list_append(kept, {{'c': class_id, 'x': x, 'w': w}}) END, ord, class_id, NOT hit FROM (
            SELECT b.image_id, b.k, g.kept, b.ord, b.class_id, b.x, b.w,
              len(list_filter(g.kept, lambda a: a.c = b.class_id AND greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) / (a.w + b.w - greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x))) > 0.9)) > 0 AS hit
            FROM g JOIN t b ON b.image_id = g.image_id AND b.k = g.k + 1))
        SELECT row_number() OVER (ORDER BY image_id, ord) - 1 AS ann_id, image_id, ord, class_id FROM g WHERE ok""",
    "annotation_check": f"""
        WITH RECURSIVE t AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY ord) AS k FROM ({ANN})),
        g AS (SELECT image_id, 0::BIGINT AS k, [] :: STRUCT(c INTEGER, x DOUBLE, w DOUBLE)[] AS kept FROM (SELECT DISTINCT image_id FROM t)
          UNION ALL
          SELECT b.image_id, b.k, CASE WHEN len(list_filter(g.kept, lambda a: a.c = b.class_id AND greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) / (a.w + b.w - greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x))) > 0.9)) > 0
            THEN g.kept ELSE list_append(g.kept, {{'c': b.class_id, 'x': b.x, 'w': b.w}}) END FROM g JOIN t b ON b.image_id = g.image_id AND b.k = g.k + 1),
        f AS (SELECT image_id, u.c, u.x, u.w FROM (SELECT image_id, unnest(arg_max(kept, k)) AS u FROM g GROUP BY 1)),
        e AS (SELECT image_id, class_id AS c, x, w, count(*) AS n FROM t GROUP BY ALL), n AS (SELECT image_id, c, x, w, count(*) AS n FROM f GROUP BY ALL),
        m AS (SELECT e.* FROM e LEFT JOIN n USING (image_id, c, x, w) WHERE e.n > coalesce(n.n, 0)),
        q AS (SELECT m.image_id, bool_and(EXISTS (SELECT 1 FROM f WHERE f.image_id = m.image_id AND f.c = m.c AND greatest(0, least(f.x + f.w, m.x + m.w) - greatest(f.x, m.x)) / (f.w + m.w - greatest(0, least(f.x + f.w, m.x + m.w) - greatest(f.x, m.x))) > 0.9)) AS ok FROM m GROUP BY 1)
        SELECT CASE WHEN q.ok IS NULL THEN 'exact' WHEN q.ok THEN 'merged' ELSE 'error' END AS verdict, count(*) AS n_images FROM (SELECT DISTINCT image_id FROM t) i LEFT JOIN q USING (image_id) GROUP BY 1""",
    "multiset_diff": """
        WITH l AS (SELECT l_suppkey, CAST(round_even(l_tax / 0.02, 0) AS BIGINT) AS g, l_returnflag AS f FROM lineitem)
        SELECT *, 'missing' AS side FROM (SELECT l_suppkey, g FROM l WHERE f = 'A' EXCEPT ALL SELECT l_suppkey, g FROM l WHERE f = 'R')
        UNION ALL SELECT *, 'extra' AS side FROM (SELECT l_suppkey, g FROM l WHERE f = 'R' EXCEPT ALL SELECT l_suppkey, g FROM l WHERE f = 'A')""",
    "class_remap": """
        WITH p AS (SELECT string_split(lower(p_type), ' ')[1] AS word FROM part)
        SELECT word, CASE word WHEN 'economy' THEN 0 WHEN 'promo' THEN 0 WHEN 'standard' THEN 1 END AS class_id, count(*) AS n,
          count(*) FILTER (word NOT IN ('economy', 'promo', 'standard')) AS n_issues FROM p GROUP BY 1, 2""",
    "split_offsets": """
        SELECT split_ord, CAST(coalesce(sum(n) OVER (ORDER BY split_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
        FROM (SELECT o_orderstatus AS split_ord, max(o_orderkey) + 1 AS n FROM orders GROUP BY 1)""",
    "default_area": f"SELECT class_id, sum(CASE WHEN ord % 2 = 0 THEN 7.0 ELSE w * h END)::DOUBLE AS area FROM ({ANN}) GROUP BY 1",
    "dropped_labels": """
        SELECT p_brand AS dataset, string_split(p_type, ' ')[1] AS raw_class, count(*) AS n FROM part
        WHERE string_split(p_type, ' ')[1] NOT IN ('ECONOMY', 'PROMO') GROUP BY 1, 2""",
    "topk_detections": """
        WITH s AS (SELECT l_orderkey AS image_id, l_linenumber AS query, CAST(l_suppkey % 3 AS INTEGER) AS class_id, ((l_partkey * 7919 + l_linenumber * 104729) % 1000) / 1000 AS score FROM lineitem),
        m AS (SELECT image_id, query, class_id, CASE WHEN image_id % 2 = 0 AND class_id = 2 THEN 0.0::DOUBLE ELSE score END AS score FROM s),
        r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, query, class_id) AS k FROM m)
        SELECT image_id, query, class_id, score FROM r WHERE k <= 3 AND score >= 0.05""",
    "span_scores": "SELECT vec_id, round(list_max(embedding[1:8])::DOUBLE, 6) AS s0, round(list_max(embedding[9:20])::DOUBLE, 6) AS s8, round(list_max(embedding[64:64])::DOUBLE, 6) AS s63 FROM embeddings",
}
