"""Queries on folds, balance and audits [P18, G2, G4, G8, G9, U2, U4, U7, C1, A5, A6, A14, A15, T8-T10]."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldsmith.operators import audit, balance, splits
from foldsmith.session import table

SIDE = "CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 < 9 THEN 'val' ELSE 'test' END"


def images(spark, sf_dir):
    """Documents as images: dataset = source, groups of seven and sub-scenes of four neighbours, boxes from the text's length."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text", "n_chars")
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return d.join(e, "doc_id", "left").select(
        F.col("doc_id").alias("id"), F.col("source").alias("dataset"), F.floor(F.col("doc_id") / 7).alias("group_id"), F.floor(F.col("doc_id") / 4).alias("subscene_id"),
        F.md5(F.col("text").cast("binary")).alias("sha"), F.col("doc_id").cast("string").alias("file"), (F.col("n_chars") % 6).alias("n_boxes"), (F.col("n_chars") % 3).alias("n_classes"), F.col("n_chars").cast("double").alias("area"), "embedding",
    )


def _folds(spark, sf_dir):
    """A made-up assignment with faults, for the audits."""
    return images(spark, sf_dir).select(F.lit("src0").alias("held"), F.expr(SIDE.replace("doc_id", "id")).alias("split"), "id", "dataset", "group_id", "subscene_id", "file")


IMG = "SELECT doc_id AS id, source AS dataset, doc_id // 7 AS group_id, doc_id // 4 AS subscene_id, n_chars % 6 AS n_boxes, n_chars % 3 AS n_classes, n_chars::DOUBLE AS area FROM documents"
FOLDS = f"SELECT 'src0' AS held, {SIDE} AS split, doc_id AS id, source AS dataset, doc_id // 7 AS group_id, doc_id // 4 AS subscene_id FROM documents"


def fold_side(spark, sf_dir):
    """Side of every scene group in the folds of two sources."""
    g = images(spark, sf_dir).groupBy("group_id").agg(F.collect_set("dataset").alias("ds"))
    f = spark.createDataFrame([("src0", ["src1"]), ("src3", ["src4", "src5"])], "held string, out array<string>")
    return g.crossJoin(F.broadcast(f)).select("held", "group_id", splits.fold_side(F.col("ds"), F.col("held"), F.col("out")).alias("side"))


def sidelined(spark, sf_dir):
    """Partners that are left out with a held-out source; sets of sources with one remainder."""
    n = F.regexp_extract("source", r"\d+", 0).cast("int")
    together = table(spark, sf_dir, "documents").select((n % 7).alias("set_id"), F.col("source").alias("dataset")).distinct()
    f = spark.createDataFrame([("src0", None), ("src1", "src2"), ("src19", None)], "held string, val string")
    return splits.sidelined(f, together).select("held", F.array_join("sidelined", ",").alias("sidelined"))


def cross_copy_resolution(spark, sf_dir):
    """Of each sub-scene the images of the best image's source, and of sources kept together with it."""
    return splits.one_dataset_per_scene(images(spark, sf_dir), [], [["src0", "src1", "src2"]]).select("id", "dataset", "subscene_id")


def fold_violations(spark, sf_dir):
    return splits.violations(_folds(spark, sf_dir)).groupBy("rule").agg(F.count("*").alias("n"))


def split_disjointness(spark, sf_dir):
    return audit.shared_groups(_folds(spark, sf_dir)).select("group_id", F.array_join("splits", ",").alias("splits"))


def lodo_fold_counts(spark, sf_dir):
    return audit.split_counts(_folds(spark, sf_dir))


def cap_check(spark, sf_dir):
    x = audit.over_cap(_folds(spark, sf_dir), {"train": 2, "val": 1, "test": 1}, ["src0"])
    return x.select("split", "subscene_id", "n", "cap")


def unexpected_datasets(spark, sf_dir):
    return audit.unexpected(_folds(spark, sf_dir), spark.createDataFrame([("src0",), ("src1",)], "dataset string"))


def greedy_pick(spark, sf_dir):
    """Images that the capped, thinned pick keeps of every group."""
    x = images(spark, sf_dir).withColumn("cap_key", F.col("subscene_id").cast("string"))
    return splits.picked(x, ["group_id"], 2, 0.95).select("group_id", "id")


def val_group_split(spark, sf_dir):
    """Whole groups in hash order to a tenth."""
    return splits.split_by_group(images(spark, sf_dir), 0.1, 42)


def lodo_folds(spark, sf_dir):
    """A full build of two folds: sides, copies, picks, validation groups, near-copy filters."""
    rules = splits.FoldRules(near=0.40, thin=0.40, least_boxes=5, least_groups=2, hold_out_together=[["src0", "src1"]], keep_together=[["src2", "src3"]])
    im = images(spark, sf_dir)
    boxes = im.where("n_boxes > 0").select("id", (F.col("id") % 3).cast("int").alias("class_id"), F.col("n_boxes").alias("n"))
    return splits.build_folds(im, ["src0", "src7"], rules, boxes).select("held", "split", "id", "dataset", "group_id")


def _lines(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("dataset"))
    l = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic")
    classes = F.array_compact(F.array(F.when(F.col("quality") == 1, 0), F.when(F.col("toxic") == 1, 1), F.when(F.col("quality") == 0, 2)))
    return d.join(l, "id").select("id", "dataset", classes.alias("classes"))


LINES = """l AS (SELECT doc_id AS id, lang AS dataset, quality, toxic FROM documents JOIN labels USING (doc_id)),
      k AS (SELECT id, 0 AS c FROM l WHERE quality = 1 UNION ALL SELECT id, 1 FROM l WHERE toxic = 1 UNION ALL SELECT id, 2 FROM l WHERE quality = 0),
      fd AS (SELECT dataset, count(*) / (SELECT count(*) FROM l) AS f FROM l GROUP BY 1), fc AS (SELECT c, count(*) / (SELECT count(*) FROM l) AS f FROM k GROUP BY 1),
      rd AS (SELECT dataset, sqrt(1 / (SELECT count(*) FROM fd) / f) AS r FROM fd), rc AS (SELECT c, sqrt(1 / (SELECT count(*) FROM fc) / f) AS r FROM fc),
      fa AS (SELECT l.id, l.dataset, least(3.0::DOUBLE, greatest(1.0::DOUBLE, rd.r, coalesce((SELECT max(rc.r) FROM k JOIN rc USING (c) WHERE k.id = l.id), 1.0::DOUBLE))) AS factor FROM l JOIN rd USING (dataset))"""


def repeat_factors(spark, sf_dir):
    return balance.repeat_factors(_lines(spark, sf_dir)).select("id", "dataset", F.round("factor", 6).alias("factor"))


def balance_report(spark, sf_dir):
    r = balance.balance_report(balance.repeat_factors(_lines(spark, sf_dir)))
    return r.select("kind", "name", F.round("before", 6).alias("before"), F.round("after", 6).alias("after"))


def hash_sample(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    return balance.hash_sample(d, 100, F.lit(7), F.col("doc_id"))


def weighted_sample(spark, sf_dir):
    f = balance.repeat_factors(_lines(spark, sf_dir))
    return balance.weighted_sample(f, "factor", "id", f.count(), 3)


QUERIES = {f.__name__: f for f in (fold_side, sidelined, cross_copy_resolution, fold_violations, split_disjointness, lodo_fold_counts, cap_check, unexpected_datasets, greedy_pick, val_group_split, lodo_folds, repeat_factors, balance_report, hash_sample, weighted_sample)}
SQL = {
    "fold_side": f"""
        WITH g AS (SELECT group_id, list(DISTINCT dataset) AS ds FROM ({IMG}) GROUP BY 1), f AS (SELECT 'src0' AS held, ['src1'] AS o UNION ALL SELECT 'src3', ['src4', 'src5'])
        SELECT held, group_id, CASE WHEN list_contains(ds, held) THEN 'test' WHEN list_has_any(ds, o) THEN 'sidelined' ELSE 'train' END AS side FROM g, f""",
    "sidelined": r"""
        WITH t AS (SELECT DISTINCT CAST(regexp_extract(source, '\d+') AS INTEGER) % 7 AS s, source AS d FROM documents), f AS (SELECT 'src0' AS held, NULL AS val UNION ALL SELECT 'src1', 'src2' UNION ALL SELECT 'src19', NULL)
        SELECT held, coalesce(string_agg(DISTINCT o.d, ',' ORDER BY o.d) FILTER (o.d <> held AND o.d IS DISTINCT FROM val), '') AS sidelined
        FROM f LEFT JOIN t ON t.d = held OR t.d = val LEFT JOIN t o ON o.s = t.s GROUP BY 1""",
    "cross_copy_resolution": f"""
        WITH i AS ({IMG}), b AS (SELECT *, first_value(dataset) OVER (PARTITION BY subscene_id ORDER BY (n_boxes > 0)::INT DESC, n_classes DESC, n_boxes DESC, area DESC, id) AS best FROM i)
        SELECT id, dataset, subscene_id FROM b WHERE dataset = best OR dataset IN ('src0', 'src1', 'src2') AND best IN ('src0', 'src1', 'src2')""",
    "fold_violations": f"""
        WITH f AS ({FOLDS}) SELECT * FROM (SELECT 'group_in_two_splits' AS rule, count(*) AS n FROM (SELECT group_id FROM f GROUP BY 1 HAVING count(DISTINCT split) > 1)
        UNION ALL SELECT 'held_out_in_training', count(*) FROM f WHERE split <> 'test' AND dataset = held UNION ALL SELECT 'other_dataset_in_test', count(*) FROM f WHERE split = 'test' AND dataset <> held) WHERE n > 0""",
    "split_disjointness": f"SELECT group_id, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM ({FOLDS}) GROUP BY 1 HAVING count(DISTINCT split) > 1",
    "lodo_fold_counts": f"SELECT held, dataset, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test FROM ({FOLDS}) GROUP BY 1, 2",
    "cap_check": f"""
        SELECT split, subscene_id, count(*) AS n, CASE split WHEN 'train' THEN 2 ELSE 1 END AS cap FROM ({FOLDS})
        GROUP BY split, subscene_id, CASE WHEN dataset = 'src0' THEN dataset END HAVING count(*) > CASE split WHEN 'train' THEN 2 ELSE 1 END""",
    "unexpected_datasets": f"SELECT DISTINCT dataset FROM ({FOLDS}) WHERE dataset NOT IN ('src0', 'src1')",
    "greedy_pick": """
        WITH RECURSIVE i AS (SELECT doc_id AS id, doc_id // 7 AS g, doc_id // 4 AS s, md5(text) AS sha, embedding::DOUBLE[] AS v,
            row_number() OVER (PARTITION BY doc_id // 7 ORDER BY (n_chars % 6 > 0)::INT DESC, n_chars % 3 DESC, n_chars % 6 DESC, n_chars DESC, doc_id) AS k FROM documents LEFT JOIN embeddings ON vec_id = doc_id),
        p AS (SELECT g, 0::BIGINT AS k, []::STRUCT(id BIGINT, s BIGINT, sha VARCHAR, v DOUBLE[])[] AS kept FROM (SELECT DISTINCT g FROM i)
          UNION ALL
          SELECT i.g, i.k, CASE WHEN len(list_filter(p.kept, lambda a: a.sha = i.sha)) > 0 OR len(list_filter(p.kept, lambda a: a.s = i.s)) >= 2
              OR len(list_filter(p.kept, lambda a: a.v IS NOT NULL AND i.v IS NOT NULL AND list_dot_product(a.v, i.v) >= 0.95)) > 0
            THEN p.kept ELSE list_append(p.kept, {'id': i.id, 's': i.s, 'sha': i.sha, 'v': i.v}) END FROM p JOIN i ON i.g = p.g AND i.k = p.k + 1)
        SELECT g AS group_id, u.id AS id FROM (SELECT g, unnest(arg_max(kept, k)) AS u FROM p GROUP BY 1)""",
    "val_group_split": """
        WITH RECURSIVE s AS (SELECT doc_id // 7 AS g, count(*) AS n FROM documents GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY sha1('42:' || g)) AS k FROM s),
        r AS (SELECT 0::BIGINT AS k, greatest(1, floor((SELECT sum(n) FROM s) * 0.1::DOUBLE))::BIGINT AS room, NULL::BIGINT AS g, false AS ok
          UNION ALL SELECT o.k, CASE WHEN o.n <= r.room THEN r.room - o.n ELSE r.room END, o.g, o.n <= r.room FROM r JOIN o ON o.k = r.k + 1),
        f AS (SELECT g, ok OR (NOT bool_or(ok) OVER () AND g = (SELECT arg_min(g, (n, k)) FROM o)) AS ok FROM r WHERE g IS NOT NULL)
        SELECT doc_id AS id, ok AS to_val FROM documents JOIN f ON f.g = doc_id // 7""",
    "weighted_sample": f"""
        WITH {LINES}, w AS (SELECT id, factor, sum(factor) OVER (ORDER BY id ROWS UNBOUNDED PRECEDING) AS hi FROM fa), z AS (SELECT count(*) AS n, max(hi) AS total FROM w),
        p AS (SELECT ('0x' || substr(sha1('3:' || i), 1, 13))::BIGINT / (1::BIGINT << 52) * total AS p FROM (SELECT unnest(range(n)) AS i, total FROM z))
        SELECT id, count(*) AS draws FROM p JOIN w ON p >= hi - factor AND p < hi GROUP BY 1""",
    "repeat_factors": f"WITH {LINES} SELECT id, dataset, round(factor, 6) AS factor FROM fa",
    "balance_report": f"""
        WITH {LINES}, p AS (SELECT 'dataset' AS kind, dataset AS name, factor FROM fa UNION ALL SELECT 'class', CAST(c AS VARCHAR), factor FROM fa JOIN k USING (id))
        SELECT kind, name, round(count(*) / (SELECT count(*) FROM fa), 6) AS before, round(sum(factor) / (SELECT sum(factor) FROM fa), 6) AS after FROM p GROUP BY 1, 2""",
    "hash_sample": "SELECT doc_id FROM documents ORDER BY sha1('7:' || doc_id) LIMIT 100",
}
