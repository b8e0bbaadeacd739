"""Repeat factors and sampling [A14, A15, T8-T10]."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldsmith.operators.scan import running


def repeat_factors(lines: DataFrame, cap: float = 3.0) -> DataFrame:
    """Lines (id, dataset, classes array) with factor = min(cap, max(1, root of t_ds / f_ds, that of the rarest class)).

    f: share of all lines that have the dataset or class; t: one over the number of datasets or of classes.
    """
    n = lines.agg(F.count("*").alias("n"))
    ds = lines.groupBy("dataset").agg(F.count("*").alias("c")).crossJoin(F.broadcast(n)).select("dataset", (F.col("c") / F.col("n")).alias("f"))
    each = lines.select("id", F.explode(F.array_distinct("classes")).alias("class"))
    cl = each.groupBy("class").agg(F.count("*").alias("c")).crossJoin(F.broadcast(n)).select("class", (F.col("c") / F.col("n")).alias("f"))
    root = lambda t, keys: t.crossJoin(F.broadcast(t.agg((1 / F.count("*")).alias("t")))).select(*keys, F.sqrt(F.col("t") / F.col("f")).alias("r"))
    rare = each.join(root(cl, ["class"]), "class").groupBy("id").agg(F.max("r").alias("rc"))
    x = lines.join(root(ds, ["dataset"]), "dataset").join(rare, "id", "left")
    factor = F.least(F.lit(float(cap)), F.greatest(F.lit(1.0), F.col("r"), F.coalesce("rc", F.lit(1.0))))
    return x.select("id", "dataset", "classes", factor.alias("factor"))


def balance_report(factors: DataFrame) -> DataFrame:
    """(kind, name, before, after): shares of the lines and of the factors by dataset and by class."""
    total = factors.agg(F.count("*").alias("n"), F.sum("factor").alias("s"))
    parts = factors.select(F.lit("dataset").alias("kind"), F.col("dataset").alias("name"), "factor").union(
        factors.select(F.lit("class").alias("kind"), F.explode(F.transform(F.array_distinct("classes"), lambda c: c.cast("string"))).alias("name"), "factor")
    )
    g = parts.groupBy("kind", "name").agg(F.count("*").alias("c"), F.sum("factor").alias("f")).crossJoin(F.broadcast(total))
    return g.select("kind", "name", (F.col("c") / F.col("n")).alias("before"), (F.col("f") / F.col("s")).alias("after"))


def hash_order(*parts: Column) -> Column:
    """A stable order that looks random: SHA-1 of the parts joined by colons."""
    return F.sha1(F.concat_ws(":", *parts))


def hash_sample(df: DataFrame, n: int, *parts: Column) -> DataFrame:
    """N rows without replacement, the first in hash order."""
    return df.orderBy(hash_order(*parts)).limit(n)


def weighted_sample(df: DataFrame, weight: str, key: str, n: int, seed: int) -> DataFrame:
    """N draws with replacement in proportion to the weight: (key, draws), rows never drawn left out.

    A row owns an interval of the running weight; every draw is a point, the first 13 hexadecimal digits of SHA-1 of the
    seed and its number as a share of the total. Points and intervals meet by buckets of the range, so the join is an
    equi-join with a bounded number of buckets for each interval.
    """
    rows = df.select(key, F.col(weight).cast("double").alias("_w")).where(F.col(weight) > 0)
    x = running(rows, [], [F.col(key)], {"_hi": ("sum", F.col("_w"))}).withColumn("_lo", F.col("_hi") - F.col("_w"))
    total = x.agg(F.max("_hi")).first()[0] or 0.0
    width = max(total / max(n, 1), 1e-300)
    buckets = x.withColumn("_k", F.explode(F.sequence(F.floor(F.col("_lo") / width), F.floor(F.col("_hi") / width))))
    u = F.conv(F.substring(hash_order(F.lit(seed), F.col("id")), 1, 13), 16, 10).cast("double") / float(1 << 52)
    points = df.sparkSession.range(n).select((u * total).alias("_p")).withColumn("_k", F.floor(F.col("_p") / width))
    hit = buckets.join(points, "_k").where("_p >= _lo AND _p < _hi")
    return hit.groupBy(key).agg(F.count("*").alias("draws"))
