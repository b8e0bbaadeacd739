"""Queries on metrics, curves and reports [A11-A13, T10-T15, T17, G5, W3, S15] and relational extras that the reference lacks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foldsmith.functions import vectors
from foldsmith.functions.vectors import lr_factor
from foldsmith.operators import metrics
from foldsmith.session import table
from foldsmith.sources import readers
from foldsmith.streaming.events import upsert


def fold_summary(spark, sf_dir):
    """Order totals over segments as folds."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    r = o.groupBy("o_orderpriority", "c_mktsegment").agg(F.avg("o_totalprice").alias("v"), F.count("*").alias("support"))
    s = metrics.fold_summary(r, "v", ["o_orderpriority"])
    return s.select("o_orderpriority", *(F.round(c, 4).alias(c) for c in ("mean", "std", "half_range")), "folds", "support", "low_support")


def percentile_calibration(spark, sf_dir):
    p = metrics.percentiles(table(spark, sf_dir, "events"), "value", ["event_type"], 50.0)
    return p.select("event_type", *(F.round(c, 6).alias(c) for c in ("p10", "p50", "p90", "rate")))


def _epochs(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("epoch"), "value")


EPOCHS = "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch, value FROM events"


def early_stopping(spark, sf_dir):
    return metrics.early_stopping(_epochs(spark, sf_dir), ["user_id"], "epoch", "value", 3).select("user_id", "epoch", "is_best", "since_best", "stop")


def lr_schedule(spark, sf_dir):
    """Factor of every step of a run of 130; the orders tell which steps there are."""
    s = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 130).alias("step")).distinct()
    return s.select("step", F.round(lr_factor(F.col("step"), 10, 12, 1, 5e-5, 1e-6), 9).alias("factor"))


def ema(spark, sf_dir):
    """Moving average of each user's values in time order."""
    g = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "value"))).alias("v"))
    return g.select("user_id", F.round(vectors.ema(F.col("v.value"), 0.9, 1.0), 6).alias("ema"))


def status_latest(spark, sf_dir):
    """The last value of every user's keys; a purchase with an even id deletes its key."""
    e = table(spark, sf_dir, "events").withColumn("value", F.when(F.col("event_id") % 5 != 0, F.col("value")))
    return upsert(None, e.withColumn("at", F.struct("ts", "event_id")), ["user_id", "event_type"], "at")


def section_pairs(spark, sf_dir):
    """Pairs of path lines below the section headers of a generated report."""
    c = table(spark, sf_dir, "conversations")
    n = F.col("conv_id") * 100 + F.col("turn") * 2
    head = c.where("turn = 0").select((F.col("conv_id") * 100 - 1).alias("n"), F.when(F.col("conv_id") % 3 == 0, F.lit("=== other ===")).otherwise(F.concat(F.lit("=== Exact matches (Distance 0): c"), "conv_id", F.lit(" ==="))).alias("line"))
    body = c.select(n.alias("n"), F.concat(F.lit("  "), "role", F.lit("/"), "conv_id", F.lit("_"), "turn", F.lit(".jpg")).alias("line"))
    return readers.section_pairs(head.union(body), "n", "line")


def _detections(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    size = (20 + F.col("l_quantity")).alias("w")
    truth = l.where("l_linenumber <= 3").select(F.col("l_orderkey").alias("image_id"), (F.col("l_suppkey") % 3).cast("int").alias("class_id"), F.lit(False).alias("crowd"), (F.col("l_linenumber") * 100).cast("double").alias("x"), F.lit(0.0).alias("y"), size, F.lit(20.0).alias("h"))
    near = (F.col("l_linenumber") * 100 + F.col("l_partkey") % 9).cast("double").alias("x")
    det = l.select(F.col("l_orderkey").alias("image_id"), (F.col("l_suppkey") % 3).cast("int").alias("class_id"), (F.col("l_linenumber") * 100_000 + F.col("l_partkey")).cast("long").alias("det"), (F.col("l_extendedprice") % 100 / 100).alias("score"), near, F.lit(0.0).alias("y"), size, F.lit(20.0).alias("h"))
    return det, truth


def average_precision(spark, sf_dir):
    """Average precision of generated detections by class."""
    det, truth = _detections(spark, sf_dir)
    ap = metrics.average_precision(det, truth, spark.createDataFrame([(0,), (1,), (2,), (9,)], "class_id int"))
    return ap.select("class_id", *(F.round(c, 6).alias(c) for c in ("ap", "ap_50", "ap_75")), "support")


def throughput(spark, sf_dir):
    """Seconds between a user's events and the mean rate so far."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(w)
    return e.select("event_id", (gap / 1_000_000).alias("gap_s"), F.count("*").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("done"))


def topk_limit(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").orderBy("l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey").limit(30)


def cube_rollup(spark, sf_dir):
    """Extension: the reference has no grouping sets."""
    l = table(spark, sf_dir, "lineitem")
    return l.cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


def window_events(spark, sf_dir):
    """Extension: counts of six-hour windows; the reference has no time windows."""
    e = table(spark, sf_dir, "events")
    g = e.groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.unix_seconds(F.col("w.start").cast("timestamp")).alias("start_s"), "event_type", "n", "total")


QUERIES = {f.__name__: f for f in (fold_summary, percentile_calibration, early_stopping, lr_schedule, ema, status_latest, section_pairs, average_precision, throughput, topk_limit, cube_rollup, window_events)}
SQL = {
    "fold_summary": """
        WITH r AS (SELECT o_orderpriority, c_mktsegment, avg(o_totalprice) AS v, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
        SELECT o_orderpriority, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS std, round((max(v) - min(v)) / 2, 4) AS half_range, count(v) AS folds, CAST(sum(n) AS BIGINT) AS support, sum(n) < 50 AS low_support FROM r GROUP BY 1""",
    "percentile_calibration": "SELECT event_type, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(avg((value >= 50)::INT), 6) AS rate FROM events GROUP BY 1",
    "early_stopping": f"""
        WITH e AS ({EPOCHS}), b AS (SELECT *, coalesce(value > max(value) OVER (PARTITION BY user_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS is_best FROM e),
        s AS (SELECT *, CAST(epoch - max(CASE WHEN is_best THEN epoch END) OVER (PARTITION BY user_id ORDER BY epoch) AS INTEGER) AS since_best FROM b)
        SELECT user_id, CAST(epoch AS INTEGER) AS epoch, is_best, since_best, coalesce(epoch = min(CASE WHEN since_best >= 3 THEN epoch END) OVER (PARTITION BY user_id), false) AS stop FROM s""",
    "lr_schedule": "SELECT range AS step, round(CASE WHEN range < 10 THEN range / 10 ELSE greatest(1e-6 / 5e-5, 0.5 * (1 + cos(pi() * (range - 10) / 110))) END, 9) AS factor FROM range(130)",
    "ema": f"""
        WITH RECURSIVE e AS ({EPOCHS}), m AS (SELECT user_id, max(epoch) AS n FROM e GROUP BY 1), r AS (SELECT user_id, 0::BIGINT AS k, 1.0::DOUBLE AS s FROM m
          UNION ALL SELECT r.user_id, r.k + 1, 0.9::DOUBLE * s + 0.1::DOUBLE * e.value FROM r JOIN e ON e.user_id = r.user_id AND e.epoch = r.k + 1)
        SELECT r.user_id, round(s, 6) AS ema FROM r JOIN m ON m.user_id = r.user_id AND m.n = r.k""",
    "status_latest": """
        SELECT user_id, event_type, value FROM (SELECT user_id, event_type, CASE WHEN event_id % 5 <> 0 THEN value END AS value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events)
        WHERE k = 1 AND value IS NOT NULL""",
    "section_pairs": """
        WITH t AS (SELECT conv_id, '  ' || role || '/' || conv_id || '_' || turn || '.jpg' AS p, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM conversations
                   WHERE conv_id % 3 <> 0 AND conv_id IN (SELECT conv_id FROM conversations WHERE turn = 0))
        SELECT 'c' || conv_id AS section, CAST(k // 2 AS INTEGER) AS nth, trim(max(CASE WHEN k % 2 = 0 THEN p END)) AS first, trim(max(CASE WHEN k % 2 = 1 THEN p END)) AS second
        FROM t GROUP BY conv_id, k // 2 HAVING count(*) = 2""",
    # One row more of each image and class a step: the ten sets of taken boxes go along as bits.
    "average_precision": """
        WITH RECURSIVE d AS (SELECT l_orderkey AS i, CAST(l_suppkey % 3 AS INTEGER) AS c, l_linenumber * 100000 + l_partkey AS det, l_extendedprice % 100 / 100 AS score, (l_linenumber * 100 + l_partkey % 9)::DOUBLE AS x, 20 + l_quantity AS w FROM lineitem),
        t AS (SELECT l_orderkey AS i, CAST(l_suppkey % 3 AS INTEGER) AS c, (l_linenumber * 100)::DOUBLE AS x, 20 + l_quantity AS w, row_number() OVER (PARTITION BY l_orderkey, l_suppkey % 3 ORDER BY l_linenumber * 100, l_quantity) AS b FROM lineitem WHERE l_linenumber <= 3),
        r AS (SELECT *, row_number() OVER (PARTITION BY i, c ORDER BY score DESC, det) AS k FROM d),
        o AS (SELECT r.i, r.c, r.k, t.b, greatest(0, least(r.x + r.w, t.x + t.w) - greatest(r.x, t.x)) AS n, r.w AS rw, t.w AS tw FROM r JOIN t ON t.i = r.i AND t.c = r.c),
        v AS (SELECT i, c, k, list({'b': b, 'u': n / (rw + tw - n)} ORDER BY b) AS l FROM o GROUP BY ALL),
        h AS (SELECT unnest(range(10)) AS q),
        m AS (SELECT DISTINCT r.i, r.c, q, 0::BIGINT AS k, []::BIGINT[] AS taken, NULL::BIGINT AS hit FROM r, h
          UNION ALL
          SELECT i, c, q, k, CASE WHEN hit IS NULL THEN taken ELSE list_append(taken, hit) END, hit FROM (
            SELECT m.i, m.c, m.q, r.k, m.taken, list_reduce(list_prepend({'b': NULL::BIGINT, 'u': -1.0::DOUBLE}, list_filter(coalesce(v.l, []), lambda z: NOT list_contains(m.taken, z.b) AND z.u >= round(0.5 + 0.05 * m.q, 2))), lambda y, z: CASE WHEN z.u >= y.u THEN z ELSE y END).b AS hit
            FROM m JOIN r ON r.i = m.i AND r.c = m.c AND r.k = m.k + 1 LEFT JOIN v ON v.i = r.i AND v.c = r.c AND v.k = r.k)),
        s AS (SELECT c, count(*) AS n FROM t GROUP BY 1),
        e AS (SELECT m.c, q, n, count(hit) OVER w AS tp, count(*) OVER w AS pos FROM m JOIN r ON r.i = m.i AND r.c = m.c AND r.k = m.k JOIN s ON s.c = m.c WINDOW w AS (PARTITION BY m.c, q ORDER BY score DESC, m.i, r.det ROWS UNBOUNDED PRECEDING)),
        p AS (SELECT c, q, CAST(floor(tp / n * 100 + 1e-9) AS INTEGER) AS f, max(tp / pos) AS p FROM e GROUP BY ALL),
        a AS (SELECT c, q, sum(coalesce((SELECT max(p) FROM p WHERE p.c = g.c AND p.q = g.q AND p.f >= g.f), 0)) / 101 AS ap FROM (SELECT c, q, unnest(range(101)) AS f FROM (SELECT DISTINCT c, q FROM p)) g GROUP BY ALL),
        z AS (SELECT c, sum(ap) / 10 AS ap, max(ap) FILTER (q = 0) AS ap_50, max(ap) FILTER (q = 5) AS ap_75 FROM a GROUP BY 1)
        SELECT k.class_id, CASE WHEN s.n IS NULL THEN -1.0::DOUBLE ELSE round(z.ap, 6)::DOUBLE END AS ap, CASE WHEN s.n IS NULL THEN -1.0::DOUBLE ELSE round(ap_50, 6)::DOUBLE END AS ap_50,
          CASE WHEN s.n IS NULL THEN -1.0::DOUBLE ELSE round(ap_75, 6)::DOUBLE END AS ap_75, coalesce(s.n, 0) AS support
        FROM (SELECT unnest([0, 1, 2, 9])::INTEGER AS class_id) k LEFT JOIN s ON s.c = class_id LEFT JOIN z ON z.c = class_id""",
    "throughput": "SELECT event_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1000000 AS gap_s, count(*) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS done FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "topk_limit": "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem ORDER BY 4, 1, 2, 3 LIMIT 30",
    "cube_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "window_events": "SELECT CAST(epoch(time_bucket(INTERVAL 6 HOURS, ts)) AS BIGINT) AS start_s, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
}
