"""Queries on vectors, hashes and shingles [J4-J7, J10-J17, J19, T2-T4, P12, P15, A7-A9, G3, G10, A3, I2-I5]."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldsmith.functions.vectors import sign_bits
from foldsmith.operators import pairs, registry
from foldsmith.operators import similarity as S
from foldsmith.operators.graph import connected_components
from foldsmith.session import materialize, table

T, CROSS = 0.40, 0.35
BITS = "list_sum(list_transform(range(64), lambda i: CASE WHEN embedding[i + 1] >= 0 THEN (1::HUGEINT << i::INTEGER) ELSE 0 END))"
COS = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


def emb(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


def hashes(spark, sf_dir):
    """Sign bits of each vector, and of the vector turned round as a second orientation."""
    bits = sign_bits(F.col("embedding"))
    return emb(spark, sf_dir).select("vec_id", "embedding", "label", bits.alias("bits"), F.array(bits, sign_bits(F.reverse("embedding"))).alias("h8"))


HASHES = f"""h AS (SELECT vec_id, label, embedding, {BITS} AS bits, {BITS.replace('embedding', 'list_reverse(embedding)')} AS turned FROM embeddings)"""
_r = lambda c: F.round(c, 6)


def cosine_pairs(spark, sf_dir):
    return S.cosine_pairs(emb(spark, sf_dir), T).withColumn("cosine", _r(F.col("cosine")))


def cosine_pairs_cross_label(spark, sf_dir):
    """Pairs of different labels already at a lower threshold; cross marks those that only it lets in."""
    p = S.cosine_pairs(emb(spark, sf_dir), 0.45, cross="label", cross_threshold=T)
    return p.select("a", "b", _r(F.col("cosine")).alias("cosine"), (F.col("cosine") < 0.45).alias("cross_only"))


def hamming_pairs(spark, sf_dir):
    return S.hamming_pairs(hashes(spark, sf_dir), 18)


def hamming_with_cosine_guard(spark, sf_dir):
    """Linked and rejected directed pairs under a cosine guard."""
    p = S.guarded_hamming_pairs(hashes(spark, sf_dir), 18, T)
    both = (F.col("a_to_b") <= 18).cast("long") + (F.col("b_to_a") <= 18).cast("long")
    return p.groupBy("kept").agg(F.count("*").alias("n_pairs"), F.sum(both).alias("n_directed"))


def distance_histogram(spark, sf_dir):
    """Pairs of labels 0 and 1 by Hamming distance above 0 in three buckets [J19, A9]."""
    h = hashes(spark, sf_dir).select("vec_id", "label", "bits")
    d = S.distance_counts(h.where("label = 0"), h.where("label = 1"), [24, 32])
    return d.select(F.element_at(F.array(*map(F.lit, ("1-24", "25-32", "33+"))), (F.col("bucket") + 1).cast("int")).alias("bucket"), "n")


def closest_pairs(spark, sf_dir):
    """The thirty pairs of vectors of different labels with the least distance above 0."""
    return S.closest_pairs(hashes(spark, sf_dir), 30, "label")


def nearest_neighbour(spark, sf_dir):
    """The odd vector nearest to each even one."""
    e = emb(spark, sf_dir)
    return S.most_similar(e.where("vec_id % 2 = 0"), e.where("vec_id % 2 = 1")).withColumn("cosine", _r(F.col("cosine")))


def nearest_hamming(spark, sf_dir):
    h = hashes(spark, sf_dir)
    return S.nearest_hamming(h.where("vec_id % 2 = 0"), h.where("vec_id % 2 = 1"))


def nearest_neighbour_labels(spark, sf_dir):
    """The vector of label 0 nearest to each of any other label, over all rows."""
    e = emb(spark, sf_dir)
    return S.most_similar(e.where("label <> 0"), e.where("label = 0")).withColumn("cosine", _r(F.col("cosine")))


def nearest_hamming_labels(spark, sf_dir):
    """Least distance of each vector of another label to label 0, over all rows."""
    h = hashes(spark, sf_dir)
    return S.nearest_hamming(h.where("label <> 0"), h.where("label = 0"))


def similarity_counters(spark, sf_dir):
    """Counters of the nearest cosines, and duplicates inside one side."""
    e = emb(spark, sf_dir)
    near = S.most_similar(e.where("vec_id % 2 = 0"), e.where("vec_id % 2 = 1"))
    inside = S.cosine_pair_count(e.where("vec_id % 2 = 0"), T).withColumnRenamed("n", "inside_40")
    return near.agg(*S.threshold_counts(near, "cosine", {"n_35": 0.35, "n_40": 0.40, "n_45": 0.45}), _r(F.max("cosine")).alias("top")).crossJoin(inside)


def topk_per_query_band(spark, sf_dir):
    """Five most similar targets of another label, then a band of the rounded cosine: what lies above takes a rank."""
    e = emb(spark, sf_dir)
    found = S.top_similar(e.where("vec_id % 5 = 0"), e, 5, other="label")
    return S.band(found.withColumn("cosine", _r(F.col("cosine"))), 0.30, 0.42)


def topk_per_pool(spark, sf_dir):
    """Two most similar targets of each label."""
    e = emb(spark, sf_dir)
    found = S.top_similar(e.where("vec_id % 10 = 0"), e, 2, pool="label")
    return found.select("q", "t", F.col("pool").alias("label"), _r(F.col("cosine")).alias("cosine"), "rank")


def pair_specification(spark, sf_dir):
    """Candidates by the specification `0,1:*:3:0.2:0.4`."""
    e = emb(spark, sf_dir).withColumn("dataset", F.col("label").cast("string"))
    return pairs.candidates(e, pairs.Spec.parse("0,1:*:3:0.2:0.4"), digits=6)


def proximity_anti_join(spark, sf_dir):
    """Even vectors that no vector of label 0 is near to."""
    e = emb(spark, sf_dir)
    return S.far_from(e.where("vec_id % 2 = 0 AND label <> 0"), e.where("label = 0"), 0.35).select("vec_id", "label")


def proximity_anti_join_labels(spark, sf_dir):
    """Vectors of any other label that no vector of label 0 is near to, over all rows."""
    e = emb(spark, sf_dir)
    return S.far_from(e.where("label <> 0"), e.where("label = 0"), 0.35).select("vec_id", "label")


def similarity_counters_labels(spark, sf_dir):
    """Counters of the cosines of all other labels nearest to label 0, and duplicates among all vectors."""
    e = emb(spark, sf_dir)
    near = S.most_similar(e.where("label <> 0"), e.where("label = 0"))
    inside = S.cosine_pair_count(e, T).withColumnRenamed("n", "inside_40")
    return near.agg(*S.threshold_counts(near, "cosine", {"n_35": 0.35, "n_40": 0.40, "n_45": 0.45}), _r(F.max("cosine")).alias("top")).crossJoin(inside)


def subscene_semi_drop(spark, sf_dir):
    """Documents of a language and source that hold a matched document."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), F.concat_ws("/", "source", "lang").alias("subscene_id"))
    return pairs.whole_scenes(d, d.where("file % 97 = 0")).select("file", "subscene_id")


def match_decisions(spark, sf_dir):
    """Photo-match decisions on generated pairs."""
    l = table(spark, sf_dir, "lineitem")
    side = F.when(F.col("l_returnflag") == "A", "test").otherwise("val")
    p = l.select((F.col("l_suppkey") % 3).alias("fold_id"), side.alias("side"), F.col("l_partkey").alias("file"), F.col("l_orderkey").alias("copy"), F.col("l_quantity").cast("long").alias("inliers"), (F.col("l_discount") * 10).alias("cosine"))
    return pairs.match_decisions(p, 45, 48, 40, 0.85)


def shingle_jaccard_pairs(spark, sf_dir):
    return S.jaccard_pairs(table(spark, sf_dir, "documents"), 0.7).withColumn("jaccard", _r(F.col("jaccard")))


def components_docs(spark, sf_dir):
    """Components of documents linked by shingles."""
    return S.jaccard_components(table(spark, sf_dir, "documents"), 0.7)


def components_embeddings(spark, sf_dir):
    return connected_components(S.cosine_links(emb(spark, sf_dir), T))


def rule_merge_counts(spark, sf_dir):
    """Unions that the Hamming rule and then the cosine rule add."""
    nodes = emb(spark, sf_dir).select(F.col("vec_id").alias("idx"))
    rules = [("hamming", S.hamming_links(hashes(spark, sf_dir), 18)), ("cosine", S.cosine_links(emb(spark, sf_dir), T))]
    return spark.createDataFrame(registry.rule_merges(nodes, rules), "rule string, merges long")


def _occurrences(spark, sf_dir):
    """Documents as images: dataset = source, path = id, content = text, name = the text's beginning."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("source").alias("dataset"), F.regexp_extract("source", r"\d+", 0).cast("int").alias("dataset_ord"), F.col("doc_id").alias("image_ord"), F.col("doc_id").cast("string").alias("path"),
        F.md5(F.col("text").cast("binary")).alias("sha"), F.lower(F.substring("text", 1, 12)).alias("source"), F.lit(None).cast("string").alias("space"),
    )


def group_id_assignment(spark, sf_dir):
    """Registry ids: name links within a source, and links between texts that begin alike in any source."""
    occ = _occurrences(spark, sf_dir)
    nodes = materialize(registry.nodes_of(occ), "nodes")
    strong = materialize(registry.name_edges(occ, nodes), "strong")
    weak = registry.name_edges(occ.withColumn("source", F.substring("source", 1, 8)).withColumn("space", F.lit("all")), nodes)
    return registry.build_registry(occ, strong, weak).select("path", "id", "group_id", "subscene_id")


def scene_group_rollup(spark, sf_dir):
    """Sizes of scene groups and how many span datasets."""
    occ = _occurrences(spark, sf_dir)
    nodes = materialize(registry.nodes_of(occ), "nodes")
    edges = materialize(registry.name_edges(occ, nodes), "strong")
    g = registry.group_rollup(registry.build_registry(occ, edges, edges.limit(0)))
    return g.groupBy("n_images", "cross_dataset").agg(F.count("*").alias("n_groups"))


QUERIES = {f.__name__: f for f in (cosine_pairs, cosine_pairs_cross_label, hamming_pairs, hamming_with_cosine_guard, distance_histogram, closest_pairs, nearest_neighbour, nearest_hamming, nearest_neighbour_labels, nearest_hamming_labels, similarity_counters, topk_per_query_band, topk_per_pool, pair_specification, proximity_anti_join, proximity_anti_join_labels, similarity_counters_labels, subscene_semi_drop, match_decisions, shingle_jaccard_pairs, components_docs, components_embeddings, rule_merge_counts, group_id_assignment, scene_group_rollup)}

_HAM = """hp AS (SELECT a.vec_id AS a, b.vec_id AS b, least(bit_count(xor(a.bits, b.bits)), bit_count(xor(a.bits, b.turned)))::BIGINT AS a_to_b,
            least(bit_count(xor(b.bits, a.bits)), bit_count(xor(b.bits, a.turned)))::BIGINT AS b_to_a FROM h a JOIN h b ON a.vec_id < b.vec_id)"""
_SHINGLES = r"""w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents),
      s AS (SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
      c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
      j AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
      jp AS (SELECT a, b, k / (x.n + y.n - k) AS jaccard FROM j JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b WHERE k / (x.n + y.n - k) >= 0.7)"""
_COMP = """e AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
      r AS (SELECT a AS node, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node)
      SELECT node, min(root) AS component FROM r GROUP BY 1"""
_TOP = """SELECT q, t{pool}, cosine, rank FROM (SELECT *, row_number() OVER (PARTITION BY q{pool} ORDER BY c DESC, t) AS rank, round(c, 6) AS cosine FROM
      (SELECT a.vec_id AS q, b.vec_id AS t, b.label, """ + COS + """ AS c FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND {cond})) WHERE rank <= {k}"""
_OCC = r"""o AS (SELECT source AS dataset, CAST(regexp_extract(source, '\d+') AS INTEGER) AS dord, doc_id, md5(text) AS sha, lower(substr(text, 1, 12)) AS name FROM documents),
      n AS (SELECT sha, row_number() OVER (ORDER BY min({'d': dord, 'i': doc_id})) - 1 AS idx FROM o GROUP BY 1),
      x AS (SELECT o.*, n.idx FROM o JOIN n USING (sha)),
      se AS (SELECT DISTINCT p.idx AS a, q.idx AS b FROM x p JOIN x q ON p.dataset = q.dataset AND p.name = q.name AND p.idx <> q.idx)"""
SQL = {
    "cosine_pairs": f"SELECT a.vec_id AS a, b.vec_id AS b, round({COS}, 6) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {COS} >= {T}",
    "cosine_pairs_cross_label": f"SELECT a.vec_id AS a, b.vec_id AS b, round({COS}, 6) AS cosine, {COS} < 0.45 AS cross_only FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {COS} >= 0.45 OR a.label <> b.label AND {COS} >= {T}",
    "hamming_pairs": f"WITH {HASHES}, {_HAM} SELECT a, b, least(a_to_b, b_to_a) AS distance, a_to_b, b_to_a FROM hp WHERE least(a_to_b, b_to_a) <= 18",
    "hamming_with_cosine_guard": f"""WITH {HASHES}, {_HAM}, g AS (SELECT hp.*, {COS} >= {T} AS kept FROM hp JOIN embeddings a ON a.vec_id = hp.a JOIN embeddings b ON b.vec_id = hp.b WHERE least(a_to_b, b_to_a) <= 18)
        SELECT kept, count(*) AS n_pairs, CAST(sum((a_to_b <= 18)::INT + (b_to_a <= 18)::INT) AS BIGINT) AS n_directed FROM g GROUP BY 1""",
    "distance_histogram": f"""WITH {HASHES}, d AS (SELECT bit_count(xor(a.bits, b.bits)) AS d FROM h a, h b WHERE a.label = 0 AND b.label = 1)
        SELECT CASE WHEN d <= 24 THEN '1-24' WHEN d <= 32 THEN '25-32' ELSE '33+' END AS bucket, count(*) AS n FROM d WHERE d > 0 GROUP BY 1""",
    "closest_pairs": f"WITH {HASHES} SELECT a.vec_id AS a, b.vec_id AS b, bit_count(xor(a.bits, b.bits))::BIGINT AS distance FROM h a JOIN h b ON a.vec_id < b.vec_id AND a.label <> b.label WHERE bit_count(xor(a.bits, b.bits)) > 0 ORDER BY 3, 1, 2 LIMIT 30",
    "nearest_neighbour": "SELECT q, t, cosine FROM (" + _TOP.format(pool="", cond="a.vec_id % 2 = 0 AND b.vec_id % 2 = 1", k=1) + ")",
    "nearest_hamming": f"WITH {HASHES} SELECT a.vec_id AS q, min(bit_count(xor(a.bits, b.bits)))::BIGINT AS distance FROM h a JOIN h b ON a.vec_id % 2 = 0 AND b.vec_id % 2 = 1 GROUP BY 1",
    "nearest_neighbour_labels": "SELECT q, t, cosine FROM (" + _TOP.format(pool="", cond="a.label <> 0 AND b.label = 0", k=1) + ")",
    "nearest_hamming_labels": f"WITH {HASHES} SELECT a.vec_id AS q, min(bit_count(xor(a.bits, b.bits)))::BIGINT AS distance FROM h a JOIN h b ON a.label <> 0 AND b.label = 0 GROUP BY 1",
    "similarity_counters": f"""WITH n AS (SELECT a.vec_id, max({COS}) AS c FROM embeddings a JOIN embeddings b ON a.vec_id % 2 = 0 AND b.vec_id % 2 = 1 GROUP BY 1)
        SELECT count(*) FILTER (c >= 0.35) AS n_35, count(*) FILTER (c >= 0.40) AS n_40, count(*) FILTER (c >= 0.45) AS n_45, round(max(c), 6) AS top,
          (SELECT count(*) FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND a.vec_id % 2 = 0 AND b.vec_id % 2 = 0 WHERE {COS} >= {T}) AS inside_40 FROM n""",
    "topk_per_query_band": "SELECT * FROM (" + _TOP.format(pool="", cond="a.vec_id % 5 = 0 AND a.label <> b.label", k=5) + ") WHERE cosine >= 0.30 AND cosine < 0.42",
    "topk_per_pool": _TOP.format(pool=", label", cond="a.vec_id % 10 = 0", k=2),
    "pair_specification": "SELECT q, t, cosine, rank FROM (" + _TOP.format(pool=", label", cond="a.label IN (0, 1)", k=3) + ") WHERE cosine >= 0.2 AND cosine < 0.4",
    "proximity_anti_join": f"SELECT vec_id, label FROM embeddings a WHERE vec_id % 2 = 0 AND label <> 0 AND NOT EXISTS (SELECT 1 FROM embeddings b WHERE b.label = 0 AND {COS} >= 0.35)",
    "proximity_anti_join_labels": f"SELECT vec_id, label FROM embeddings a WHERE label <> 0 AND NOT EXISTS (SELECT 1 FROM embeddings b WHERE b.label = 0 AND {COS} >= 0.35)",
    "similarity_counters_labels": f"""WITH n AS (SELECT a.vec_id, max({COS}) AS c FROM embeddings a JOIN embeddings b ON a.label <> 0 AND b.label = 0 GROUP BY 1)
        SELECT count(*) FILTER (c >= 0.35) AS n_35, count(*) FILTER (c >= 0.40) AS n_40, count(*) FILTER (c >= 0.45) AS n_45, round(max(c), 6) AS top,
          (SELECT count(*) FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {COS} >= {T}) AS inside_40 FROM n""",
    "subscene_semi_drop": "SELECT doc_id AS file, source || '/' || lang AS subscene_id FROM documents WHERE source || '/' || lang IN (SELECT source || '/' || lang FROM documents WHERE doc_id % 97 = 0)",
    "match_decisions": """
        SELECT DISTINCT l_suppkey % 3 AS fold_id, 'test' AS side, l_orderkey AS file, 'drop' AS decision FROM lineitem WHERE l_returnflag = 'A' AND l_quantity >= 45
        UNION SELECT DISTINCT l_suppkey % 3, 'val', l_partkey, 'to_train' FROM lineitem WHERE l_returnflag <> 'A' AND (l_quantity >= 48 OR l_quantity >= 40 AND l_discount * 10 >= 0.85)""",
    "shingle_jaccard_pairs": f"WITH {_SHINGLES} SELECT a, b, round(jaccard, 6) AS jaccard FROM jp",
    "components_docs": f"WITH RECURSIVE {_SHINGLES}, edges AS (SELECT a, b FROM jp), {_COMP}",
    "components_embeddings": f"WITH RECURSIVE edges AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {COS} >= {T}), {_COMP}",
    "rule_merge_counts": f"""
        WITH RECURSIVE {HASHES}, {_HAM}, he AS (SELECT a, b FROM hp WHERE least(a_to_b, b_to_a) <= 18),
        ce AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {COS} >= {T}),
        e1 AS (SELECT a, b FROM he UNION SELECT b, a FROM he UNION SELECT vec_id, vec_id FROM embeddings),
        e2 AS (SELECT a, b FROM e1 UNION SELECT a, b FROM ce UNION SELECT b, a FROM ce),
        r1 AS (SELECT vec_id AS node, vec_id AS root FROM embeddings UNION SELECT e1.b, r1.root FROM r1 JOIN e1 ON e1.a = r1.node),
        r2 AS (SELECT vec_id AS node, vec_id AS root FROM embeddings UNION SELECT e2.b, r2.root FROM r2 JOIN e2 ON e2.a = r2.node),
        c1 AS (SELECT count(DISTINCT root) AS n FROM (SELECT node, min(root) AS root FROM r1 GROUP BY 1)),
        c2 AS (SELECT count(DISTINCT root) AS n FROM (SELECT node, min(root) AS root FROM r2 GROUP BY 1))
        SELECT 'hamming' AS rule, (SELECT count(*) FROM embeddings) - c1.n AS merges FROM c1 UNION ALL SELECT 'cosine', c1.n - c2.n FROM c1, c2""",
    "group_id_assignment": f"""
        WITH RECURSIVE {_OCC}, we AS (SELECT DISTINCT p.idx AS a, q.idx AS b FROM x p JOIN x q ON substr(p.name, 1, 8) = substr(q.name, 1, 8) AND p.idx <> q.idx),
        ae AS (SELECT a, b FROM se UNION SELECT a, b FROM we),
        sr AS (SELECT idx AS node, idx AS root FROM n UNION SELECT se.b, sr.root FROM sr JOIN se ON se.a = sr.node),
        ar AS (SELECT idx AS node, idx AS root FROM n UNION SELECT ae.b, ar.root FROM ar JOIN ae ON ae.a = ar.node),
        f AS (SELECT x.doc_id, x.dord, x.idx, s.root AS sroot, a.root AS aroot FROM x
              JOIN (SELECT node, min(root) AS root FROM sr GROUP BY 1) s ON s.node = x.idx JOIN (SELECT node, min(root) AS root FROM ar GROUP BY 1) a ON a.node = x.idx),
        g AS (SELECT *, row_number() OVER (ORDER BY aroot, idx, dord, doc_id) - 1 AS id FROM f),
        k AS (SELECT *, min(id) OVER (PARTITION BY sroot) AS fid FROM g)
        SELECT CAST(doc_id AS VARCHAR) AS path, id, dense_rank() OVER (ORDER BY aroot) - 1 AS group_id, dense_rank() OVER (ORDER BY fid) - 1 AS subscene_id FROM k""",
    "scene_group_rollup": f"""
        WITH RECURSIVE {_OCC}, sr AS (SELECT idx AS node, idx AS root FROM n UNION SELECT se.b, sr.root FROM sr JOIN se ON se.a = sr.node),
        g AS (SELECT root, count(*) AS n_images, count(DISTINCT dataset) > 1 AS cross_dataset FROM x JOIN (SELECT node, min(root) AS root FROM sr GROUP BY 1) s ON s.node = x.idx GROUP BY 1)
        SELECT n_images, cross_dataset, count(*) AS n_groups FROM g GROUP BY 1, 2""",
}
