"""Queries on leakage, fold faults, masks and samples [A1, A10, A16, A22, C3, C5, C6, J22, P17, P21, F11, S21, S22, T7]."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldsmith.functions import boxes as B
from foldsmith.functions import names
from foldsmith.functions.vectors import sign_bits
from foldsmith.operators import leakage, masking, metrics
from foldsmith.plans import boxes as box_plans
from foldsmith.plans import folds as fold_plans
from foldsmith.session import table
from foldsmith.sources import readers

COSINES, BITS, LEAST = [0.35, 0.40, 0.45], 18, 0.2


def boxes_per_image(spark, sf_dir):
    """Boxes of every image, and its histogram of classes."""
    x = metrics.box_counts(box_plans._annotations(spark, sf_dir))
    return x.select("image_id", "n_boxes", F.array_join(F.transform("histogram", lambda h: F.concat_ws(":", h["class_id"], h["n"])), ",").alias("histogram"))


def epoch_means(spark, sf_dir):
    """Mean losses of made-up batches."""
    b = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("run"), F.col("l_linenumber").alias("epoch"), "l_tax", F.when(F.col("l_linenumber") < 6, F.col("l_discount")).alias("l_discount"))
    return metrics.epoch_means(b, ["run", "epoch"], ["l_tax", "l_discount"]).select("run", "epoch", *(F.round(c, 9).alias(c) for c in ("l_tax", "l_discount")))


def _documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source")


def confirmed_overlaps(spark, sf_dir):
    """Pairs of neighbouring documents as matches by distance, and those of one exported name."""
    d = _documents(spark, sf_dir)
    name = lambda n: names.original_name(F.concat(F.col(n), F.lit("_JPG.rf."), F.col(f"{n}_id").cast("string")))
    x = d.select((F.col("doc_id") + 1).alias("b_id"), F.col("doc_id").alias("a_id"), F.col("source").alias("a"), "lang")
    x = x.join(d.select(F.col("doc_id").alias("b_id"), F.col("source").alias("b")), "b_id")
    return leakage.confirmed_overlaps(x.select("lang", (F.col("a_id") % 4).alias("distance"), name("a").alias("name_a"), name("b").alias("name_b")), ["lang"])


def common_names(spark, sf_dir):
    """The first documents of every source that two languages have."""
    d = _documents(spark, sf_dir).select(F.col("lang").alias("dataset"), "source", F.col("doc_id").alias("file"), F.col("doc_id").alias("ord"))
    return leakage.common_names(d, "en", "de")


def clean_validation(spark, sf_dir):
    return leakage.clean_validation(fold_plans._folds(spark, sf_dir)).select("split", "id")


def exclusions(spark, sf_dir):
    """Images by split before and after the validation set is cleaned."""
    f = fold_plans._folds(spark, sf_dir)
    return leakage.exclusions(f, leakage.clean_validation(f), ["split"])


def fold_problems(spark, sf_dir):
    """Faults of a made-up fold by rule."""
    n = F.col("n_chars")
    box = B.box(F.col("doc_id") % 50, F.lit(2), n % 60, F.lit(9))
    b = table(spark, sf_dir, "documents").where(n % 6 > 0).select(F.col("doc_id").alias("id"), (F.col("doc_id") % 4).cast("int").alias("class_id"), box.alias("box"), F.lit(100).alias("width"), F.lit(50).alias("height"))
    barred = spark.createDataFrame([("src0", "src0"), ("src0", "src1")], "held string, dataset string")
    return leakage.fold_problems(fold_plans._folds(spark, sf_dir), b, {"train": 2, "val": 1, "test": 1}, ["src0"], barred, 3).select("split", "rule", "detail")


def _embedded(spark, sf_dir):
    """Vectors as images of one fold; every third has an exported name."""
    e = table(spark, sf_dir, "embeddings").withColumn("doc_id", F.col("vec_id"))
    name = F.when(F.col("vec_id") % 3 == 0, F.concat(F.lit("n"), (F.col("vec_id") % 50).cast("string")))
    return e.select(F.lit("h").alias("held"), F.expr(fold_plans.SIDE).alias("split"), F.col("vec_id").alias("id"), "embedding", sign_bits(F.col("embedding")).alias("bits"), name.alias("source"))


def leakage_audit(spark, sf_dir):
    """Counters of the nearest training images of validation and test."""
    f = _embedded(spark, sf_dir)
    near = leakage.nearest_in_training(f, "h", "val").union(leakage.nearest_in_training(f, "h", "test"))
    return leakage.leakage_counts(near, COSINES, BITS).drop("held")


def nearest_training_top(spark, sf_dir):
    """The thirty test images closest to training."""
    x = leakage.by_cosine(leakage.nearest_in_training(_embedded(spark, sf_dir), "h", "test"), 30)
    return x.select("id", "near", F.round("cosine", 6).alias("cosine"), "distance", "same_name")


def validation_sample(spark, sf_dir):
    """Forty sampled validation images with their three nearest training images, and whether a match says that they are one photo."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.explode(F.sequence(F.lit(1), F.lit(9))).alias("j"))
    known = e.select(F.col("vec_id").alias("b"), (F.col("vec_id") + F.col("j")).alias("a"), ((F.col("vec_id") * 7 + F.col("j")) % 60).alias("inliers"))
    x = leakage.sampled_matches(_embedded(spark, sf_dir), "h", known, 40, 3, LEAST, 7)
    return x.select("id", "near", F.round("cosine", 6).alias("cosine"), "inliers", leakage.same_photo(similar_cosine=0.3).alias("same"))


def token_mask(spark, sf_dir):
    """Caption tokens that each part's annotated classes cover."""
    spans = F.create_map(*(x for c, s, e in ((0, 0, 4), (1, 5, 9), (2, 8, 14), (3, 13, 20)) for x in (F.lit(c), F.struct(F.lit(s).alias("start"), F.lit(e).alias("end")))))
    p = table(spark, sf_dir, "part").select("p_partkey", F.array((F.col("p_size") % 5).cast("int"), (F.col("p_partkey") % 3).cast("int")).alias("classes"))
    mask = F.transform(masking.token_mask(F.col("classes"), spans, 16), lambda m: F.when(m, "1").otherwise("0"))
    return p.select("p_partkey", F.array_join(mask, "").alias("mask"))


def focal_loss(spark, sf_dir):
    """Masked focal loss of vectors as logits, by label."""
    v = F.transform("embedding", lambda x: x.cast("double") * 4)
    q = table(spark, sf_dir, "embeddings").select("label", v.alias("logits"), F.transform(F.reverse("embedding"), lambda x: F.when(x > 0.1, 1).otherwise(0)).alias("targets"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: i % 3 != 0).alias("mask"), (F.col("vec_id") % 2).alias("positives"))
    return masking.focal_loss(q, ["label"], "positives").select("label", F.round("loss", 6).alias("loss"))


def _odvg(spark, sf_dir):
    """Orders as lines of a training file; every fifth has no box, every second no class list."""
    l = table(spark, sf_dir, "lineitem")
    one = F.struct(F.col("l_linenumber").alias("nth"), F.col("l_partkey").alias("key"), F.array(F.lit(0.0), F.lit(0.0), F.col("l_quantity").cast("double"), F.lit(5.0)).alias("bbox"), (F.col("l_suppkey") % 5).cast("int").alias("label"))
    g = l.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(one)).alias("i"))
    inst = F.transform("i", lambda x: F.struct(x["bbox"].alias("bbox"), x["label"].alias("label"), F.lit("c").alias("category")))
    some = F.when(F.col("l_orderkey") % 5 == 0, F.slice(inst, 1, 0)).otherwise(inst)
    return g.select(F.col("l_orderkey").alias("line_no"), F.concat(F.col("l_orderkey").cast("string"), F.lit(".jpg")).alias("filename"), F.struct(some.alias("instances")).alias("detection"), F.when(F.col("l_orderkey") % 2 == 0, F.array(F.lit(1), F.lit(4), F.lit(0))).alias("annotated_classes"))


def sample_decode(spark, sf_dir):
    x = readers.decode_samples(_odvg(spark, sf_dir), 3)
    return x.select("filename", F.size("boxes").alias("n"), F.array_join("labels", ",").alias("labels"), F.array_join("annotated_classes", ",").alias("classes"))


def truth_sample(spark, sf_dir):
    """True boxes of fifty sampled lines."""
    return readers.truth_sample(_odvg(spark, sf_dir), 3, 50).select("image_id", "class_id", "w", "h")


QUERIES = {f.__name__: f for f in (boxes_per_image, epoch_means, confirmed_overlaps, common_names, clean_validation, exclusions, fold_problems, leakage_audit, nearest_training_top, validation_sample, token_mask, focal_loss, sample_decode, truth_sample)}

F_ = f"WITH f AS ({fold_plans.FOLDS}), c AS (SELECT * FROM f WHERE split <> 'val' OR group_id NOT IN (SELECT group_id FROM f WHERE split = 'train'))"
E_ = f"""e AS (SELECT vec_id AS id, {fold_plans.SIDE.replace('doc_id', 'vec_id')} AS split, embedding, CASE WHEN vec_id % 3 = 0 THEN 'n' || vec_id % 50 END AS source,
          list_transform(embedding, lambda x: x >= 0) AS s FROM embeddings),
        p AS (SELECT a.id, a.split, a.source, b.id AS near, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS cosine, len(list_filter(list_zip(a.s, b.s), lambda z: z[1] <> z[2])) AS d
          FROM e a JOIN e b ON b.split = 'train' WHERE a.split <> 'train'),
        n AS (SELECT id, split, arg_max(near, (cosine, -near)) AS near, max(cosine) AS cosine, min(d) AS distance, coalesce(bool_or(source IN (SELECT source FROM e WHERE split = 'train' AND source IS NOT NULL)), false) AS same_name FROM p GROUP BY 1, 2)"""
G_ = """l AS (SELECT l_orderkey AS k, list({'q': l_quantity::DOUBLE, 'c': CAST(l_suppkey % 5 AS INTEGER)} ORDER BY l_linenumber, l_partkey, l_quantity, l_suppkey % 5) AS i FROM lineitem GROUP BY 1),
        g AS (SELECT k, k || '.jpg' AS filename, CASE WHEN k % 5 = 0 THEN [] ELSE i END AS i FROM l)"""

SQL = {
    "boxes_per_image": "SELECT image_id, sum(n)::BIGINT AS n_boxes, string_agg(class_id || ':' || n, ',' ORDER BY class_id) AS histogram FROM (SELECT image_id, class_id, count(*) AS n FROM (" + box_plans.ANN + ") GROUP BY 1, 2) GROUP BY 1",
    "epoch_means": "SELECT l_returnflag AS run, l_linenumber AS epoch, round(avg(l_tax), 9) AS l_tax, round(coalesce(avg(CASE WHEN l_linenumber < 6 THEN l_discount END), 0), 9) AS l_discount FROM lineitem GROUP BY 1, 2",
    "confirmed_overlaps": "SELECT a.lang, count(*) FILTER (a.doc_id % 4 = 0) AS distance_zero, count(*) FILTER (a.doc_id % 4 = 0 AND a.source = b.source) AS confirmed FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 GROUP BY 1",
    "common_names": "SELECT source, a.f AS a, b.f AS b FROM (SELECT source, min(doc_id) AS f FROM documents WHERE lang = 'en' GROUP BY 1) a JOIN (SELECT source, min(doc_id) AS f FROM documents WHERE lang = 'de' GROUP BY 1) b USING (source)",
    "clean_validation": F_ + " SELECT split, id FROM c",
    "exclusions": F_ + " SELECT split, a.n AS before, coalesce(b.n, 0) AS after, a.n - coalesce(b.n, 0) AS dropped FROM (SELECT split, count(DISTINCT id) AS n FROM f GROUP BY 1) a LEFT JOIN (SELECT split, count(DISTINCT id) AS n FROM c GROUP BY 1) b USING (split)",
    "fold_problems": f"""
        WITH f AS ({fold_plans.FOLDS}), b AS (SELECT doc_id AS id, doc_id % 4 AS c, doc_id % 50 AS x, n_chars % 60 AS w FROM documents WHERE n_chars % 6 > 0)
        SELECT split, 'beyond_cap' AS rule, CAST(subscene_id AS VARCHAR) AS detail FROM f GROUP BY split, subscene_id, CASE WHEN dataset = 'src0' THEN dataset END HAVING count(*) > CASE split WHEN 'train' THEN 2 ELSE 1 END
        UNION ALL SELECT split, 'wrong_dataset', CAST(id AS VARCHAR) FROM f WHERE (split = 'test' AND dataset <> 'src0') OR (split <> 'test' AND dataset = 'src0')
        UNION ALL SELECT split, 'wrong_dataset', CAST(id AS VARCHAR) FROM f WHERE split <> 'test' AND dataset = 'src1'
        UNION ALL SELECT split, 'no_boxes', CAST(id AS VARCHAR) FROM f WHERE split = 'train' AND id NOT IN (SELECT id FROM b)
        UNION ALL SELECT split, 'bad_box', CAST(id AS VARCHAR) FROM f JOIN b USING (id) WHERE c > 2 OR w <= 0 OR x + w > 101""",
    "leakage_audit": f"WITH {E_} SELECT split, count(*) AS n, count(*) FILTER (distance <= {BITS}) AS near_bits, count(*) FILTER (same_name) AS same_name, " + ", ".join(f"count(*) FILTER (cosine >= {t}) AS cosine_{round(100 * t)}" for t in COSINES) + " FROM n GROUP BY 1",
    "nearest_training_top": f"WITH {E_} SELECT id, near, round(cosine, 6) AS cosine, distance, same_name FROM n WHERE split = 'test' ORDER BY n.cosine DESC, id LIMIT 30",
    "validation_sample": f"""
        WITH {E_}, v AS (SELECT id FROM e WHERE split = 'val' ORDER BY sha1('7:' || id), id LIMIT 40), r AS (SELECT p.*, row_number() OVER (PARTITION BY id ORDER BY cosine DESC, near) AS k FROM p JOIN v USING (id)),
        m AS (SELECT vec_id AS lo, vec_id + j AS hi, (vec_id * 7 + j) % 60 AS inliers FROM embeddings, range(1, 10) t(j))
        SELECT r.id, near, round(cosine, 6) AS cosine, inliers, coalesce(inliers >= 40 OR inliers >= 15 AND cosine >= 0.3, false) AS same FROM r LEFT JOIN m ON lo = least(r.id, near) AND hi = greatest(r.id, near) WHERE k <= 3 AND cosine >= {LEAST}""",
    "token_mask": """
        WITH s AS (SELECT * FROM (VALUES (0, 0, 4), (1, 5, 9), (2, 8, 14)) t(c, a, z)), p AS (SELECT p_partkey, p_size % 5 AS u, p_partkey % 3 AS v FROM part)
        SELECT p_partkey, (SELECT string_agg(CASE WHEN EXISTS (SELECT 1 FROM s WHERE c IN (u, v) AND i >= a AND i < z) THEN '1' ELSE '0' END, '' ORDER BY i) FROM range(16) t(i)) AS mask FROM p""",
    "focal_loss": """
        WITH q AS (SELECT vec_id, label, i, embedding[i + 1]::DOUBLE * 4 AS x, (embedding[64 - i] > 0.1)::INT::DOUBLE AS y FROM embeddings, range(64) t(i) WHERE i % 3 <> 0),
        r AS (SELECT *, 1 / (1 + exp(-x)) AS p FROM q), s AS (SELECT label, sum((greatest(x, 0) - x * y + ln(1 + exp(-abs(x)))) * pow(1 - (p * y + (1 - p) * (1 - y)), 2) * (0.25 * y + 0.75 * (1 - y))) AS l FROM r GROUP BY 1)
        SELECT label, round(l / greatest((SELECT sum(vec_id % 2) FROM embeddings e WHERE e.label = s.label), 1), 6) AS loss FROM s""",
    "sample_decode": f"""
        WITH {G_} SELECT filename, len(list_filter(i, lambda z: z.c < 3))::INTEGER AS n, array_to_string(list_transform(list_filter(i, lambda z: z.c < 3), lambda z: z.c), ',') AS labels, CASE WHEN k % 2 = 0 THEN '0,1' ELSE '0,1,2' END AS classes FROM g""",
    "truth_sample": f"""
        WITH {G_}, s AS (SELECT * FROM g WHERE len(i) > 0 ORDER BY sha1('1:' || filename) LIMIT 50)
        SELECT k AS image_id, u.c AS class_id, u.q AS w, 5.0::DOUBLE AS h FROM (SELECT k, unnest(i) AS u FROM s) WHERE u.c < 3""",
}
