"""Queries on exact content and names [A2, A4, A20, A21, F1-F3, F9, F13, J3, J12, J18, J20, P11, S9, U2, U5]."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldsmith.functions import names
from foldsmith.functions.vectors import ordered_fingerprint
from foldsmith.operators import pairs
from foldsmith.session import table


def hashed(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.sha2("text", 256).alias("sha"))


def exact_dup_groups(spark, sf_dir):
    """Contents that occur more than once."""
    g = hashed(spark, sf_dir).groupBy("sha").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
    return g.where("n_docs > 1")


def cross_source_groups(spark, sf_dir):
    """Contents that occur in two sources or more, with their sizes."""
    g = hashed(spark, sf_dir).groupBy("sha").agg(F.count("*").alias("n_docs"), F.countDistinct("source").alias("n_sources"), F.min("doc_id").alias("first_doc"))
    return g.where("n_sources > 1")


def source_pair_overlap(spark, sf_dir):
    """Shared contents of every unordered pair of sources."""
    d = hashed(spark, sf_dir).select("source", "sha").distinct()
    both = d.select(F.col("source").alias("source_a"), "sha").join(d.select(F.col("source").alias("source_b"), "sha"), "sha").where("source_a < source_b")
    return both.groupBy("source_a", "source_b").agg(F.count("*").alias("shared"))


def exact_matches(spark, sf_dir):
    """Equal contents between two collections; repeats multiply."""
    d = hashed(spark, sf_dir)
    a = d.where("source = 'src0'").select(F.col("doc_id").alias("doc_a"), "sha")
    b = d.where("source <> 'src0'").select(F.col("doc_id").alias("doc_b"), "sha")
    return a.join(b, "sha").select("doc_a", "doc_b", "sha")


def largest_groups(spark, sf_dir):
    """The ten largest exact groups."""
    g = hashed(spark, sf_dir).groupBy("sha").agg(F.count("*").alias("n_docs"))
    return g.orderBy(F.desc("n_docs"), "sha").limit(10)


def class_distribution(spark, sf_dir):
    """Labelled documents by language and label, zero where there are none."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    n = d.groupBy("lang", "toxic").agg(F.count("*").alias("n"))
    langs, kinds = table(spark, sf_dir, "documents").select("lang").distinct(), table(spark, sf_dir, "labels").select("toxic").distinct()
    return langs.crossJoin(F.broadcast(kinds)).join(n, ["lang", "toxic"], "left").select("lang", "toxic", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def _exported(spark, sf_dir):
    """Part names as exported file names: some with the mark, some without."""
    p = table(spark, sf_dir, "part")
    mark = F.when(F.col("p_partkey") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit(".rf."), F.substring(F.md5(F.col("p_partkey").cast("string").cast("binary")), 1, 6)))
    ext = F.when(F.col("p_partkey") % 2 == 0, F.lit("_JPG")).otherwise(F.lit("_png"))
    return p.select("p_partkey", F.concat(F.regexp_replace("p_name", " ", "_"), F.lit("_"), F.col("p_size"), ext, mark).alias("name"))


def name_normalise(spark, sf_dir):
    """Source names, photo ids and original names of exported names."""
    x = _exported(spark, sf_dir).withColumn("source", names.source_name(F.col("name")))
    return x.select("p_partkey", "source", names.photo_id(F.col("source"), r"^(.*)_\d+$").alias("photo"), names.original_name(F.col("name")).alias("original"))


def dataset_of_path(spark, sf_dir):
    """Dataset part and comparison key of the pages' paths."""
    path = F.regexp_extract("url", r"://(.*)$", 1)
    path = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("images/"), path)).otherwise(path)
    return table(spark, sf_dir, "pages").select("page_id", names.dataset_of_path(path).alias("dataset"), names.path_key(path).alias("key"))


def class_captions(spark, sf_dir):
    """A caption of each source's languages, and the place of each in it."""
    c = table(spark, sf_dir, "documents").groupBy("source").agg(F.array_sort(F.collect_set("lang")).alias("c"))
    c = c.withColumn("caption", names.caption(F.col("c")))
    spans = names.token_spans(F.col("caption"), F.col("c"))
    return c.select("source", "caption", F.array_join(F.transform(spans, lambda s: F.concat_ws("-", s["start"], s["end"])), ",").alias("spans"))


def content_fingerprint(spark, sf_dir):
    """Order-sensitive fingerprint of each conversation."""
    c = table(spark, sf_dir, "conversations")
    g = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.concat_ws(":", "role", "text").alias("line")))).alias("t"))
    lines = F.transform("t", lambda t: t["line"])
    return g.select("conv_id", ordered_fingerprint(lines).alias("fingerprint"))


def same_text_elsewhere(spark, sf_dir):
    """Documents of one source whose content another source holds too."""
    d = hashed(spark, sf_dir)
    a, b = d.where("source = 'src0'"), d.where("source <> 'src0'").select("sha").distinct()
    return a.join(b, "sha", "left_semi").select("doc_id", "sha")


def last_of_pairs(spark, sf_dir):
    """The last value of every unordered customer and order-status pair list."""
    p = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("path_a"), F.col("l_suppkey").alias("path_b"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.col("l_quantity").cast("long").alias("inliers"))
    return pairs.last_of_pairs(p).select("path_a", "path_b", "inliers")


def distinct_pairs(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"))
    return pairs.distinct_pairs(p, "a", "b")


def known_pair_anti_join(spark, sf_dir):
    """Pairs of returned lines that no other line holds in either order."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), "l_returnflag")
    return pairs.new_pairs(l.where("l_returnflag = 'R'"), l.where("l_returnflag <> 'R'"), "a", "b")


QUERIES = {f.__name__: f for f in (exact_dup_groups, cross_source_groups, source_pair_overlap, exact_matches, largest_groups, class_distribution, name_normalise, dataset_of_path, class_captions, content_fingerprint, same_text_elsewhere, last_of_pairs, distinct_pairs, known_pair_anti_join)}
SQL = {
    "exact_dup_groups": "SELECT sha256(text) AS sha, count(*) AS n_docs, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM documents GROUP BY 1 HAVING count(*) > 1",
    "cross_source_groups": """
        SELECT sha256(text) AS sha, count(*) AS n_docs, count(DISTINCT source) AS n_sources, min(doc_id) AS first_doc
        FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1""",
    "source_pair_overlap": """
        WITH d AS (SELECT DISTINCT source, sha256(text) AS sha FROM documents)
        SELECT a.source AS source_a, b.source AS source_b, count(*) AS shared FROM d a JOIN d b USING (sha) WHERE a.source < b.source GROUP BY 1, 2""",
    "exact_matches": """
        SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, sha256(a.text) AS sha FROM documents a JOIN documents b ON a.text = b.text
        WHERE a.source = 'src0' AND b.source <> 'src0'""",
    "largest_groups": "SELECT sha256(text) AS sha, count(*) AS n_docs FROM documents GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "class_distribution": """
        SELECT l.lang, k.toxic, count(x.doc_id) AS n FROM (SELECT DISTINCT lang FROM documents) l CROSS JOIN (SELECT DISTINCT toxic FROM labels) k
        LEFT JOIN (SELECT doc_id, lang, toxic FROM documents JOIN labels USING (doc_id)) x ON x.lang = l.lang AND x.toxic = k.toxic GROUP BY 1, 2""",
    "name_normalise": r"""
        WITH x AS (SELECT p_partkey, replace(p_name, ' ', '_') || '_' || p_size || CASE WHEN p_partkey % 2 = 0 THEN '_JPG' ELSE '_png' END
                     || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '.rf.' || substr(md5(CAST(p_partkey AS VARCHAR)), 1, 6) END AS name FROM part),
        y AS (SELECT *, CASE WHEN regexp_matches(name, '^(.*)\.rf\.[0-9A-Za-z]+$')
                     THEN lower(regexp_replace(regexp_extract(name, '^(.*)\.rf\.[0-9A-Za-z]+$', 1), '_(jpe?g|png|bmp|webp|tiff?)$', '', 'i')) END AS source FROM x)
        SELECT p_partkey, source, CASE WHEN regexp_matches(source, '^(.*)_\d+$') THEN regexp_extract(source, '^(.*)_\d+$', 1) ELSE source END AS photo,
               lower(CASE WHEN instr(lower(name), '_jpg') > 0 THEN substr(name, 1, instr(lower(name), '_jpg') - 1) ELSE name END) AS original FROM y""",
    "dataset_of_path": r"""
        WITH x AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'images/' ELSE '' END || regexp_extract(url, '://(.*)$', 1) AS p FROM pages)
        SELECT page_id, CASE WHEN len(string_split(p, '/')) > 2 AND string_split(p, '/')[1] = 'images' THEN string_split(p, '/')[2] ELSE string_split(p, '/')[1] END AS dataset,
               regexp_replace(lower(regexp_replace(p, '[\\/]+', '/', 'g')), '^images/', '') AS key FROM x""",
    "class_captions": """
        WITH d AS (SELECT DISTINCT source, lang FROM documents),
        o AS (SELECT source, lang, coalesce(sum(length(lang) + 3) OVER (PARTITION BY source ORDER BY lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM d)
        SELECT source, string_agg(lang, ' . ' ORDER BY lang) || ' .' AS caption, string_agg(a || '-' || (a + length(lang)), ',' ORDER BY a) AS spans FROM o GROUP BY 1""",
    "content_fingerprint": "SELECT conv_id, substr(md5(string_agg(role || ':' || text, chr(10) ORDER BY turn)), 1, 12) AS fingerprint FROM conversations GROUP BY 1",
    "same_text_elsewhere": "SELECT doc_id, sha256(text) AS sha FROM documents WHERE source = 'src0' AND text IN (SELECT text FROM documents WHERE source <> 'src0')",
    "last_of_pairs": """
        SELECT least(l_partkey, l_suppkey) AS path_a, greatest(l_partkey, l_suppkey) AS path_b, CAST(arg_max(l_quantity, l_orderkey * 10 + l_linenumber) AS BIGINT) AS inliers
        FROM lineitem GROUP BY 1, 2""",
    "distinct_pairs": "SELECT DISTINCT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b FROM lineitem WHERE l_partkey <> l_suppkey",
    "known_pair_anti_join": """
        WITH p AS (SELECT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b, l_returnflag AS f FROM lineitem WHERE l_partkey <> l_suppkey)
        SELECT DISTINCT a, b FROM p WHERE f = 'R' AND NOT EXISTS (SELECT 1 FROM p k WHERE k.f <> 'R' AND k.a = p.a AND k.b = p.b)""",
}
