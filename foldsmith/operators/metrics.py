"""Detections, average precision, fold summaries and training curves [P16, T5, T17, G5, A11-A13, T11]."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldsmith.operators.scan import running

THRESHOLDS = [round(0.5 + 0.05 * i, 2) for i in range(10)]


def top_detections(scores: DataFrame, annotated: DataFrame | None = None, most: int = 100, floor: float = 0.001) -> DataFrame:
    """(image_id, query, class_id, score) of each image's best scores, then those at or above the floor [T5].

    scores: image_id, query, class_id, score. With annotated (image_id, classes) the score of a class that the image's
    dataset does not label counts as 0 [P16].
    """
    if annotated is not None:
        scores = scores.join(annotated, "image_id", "left")
        ok = F.coalesce(F.array_contains("classes", F.col("class_id")), F.lit(True))
        scores = scores.withColumn("score", F.when(ok, F.col("score")).otherwise(0.0)).drop("classes")
    rank = F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("score"), "query", "class_id"))
    return scores.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank").where(F.col("score") >= floor)


def match(over: np.ndarray, crowd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hit, ignored) by threshold and detection; over: overlaps of detections, best score first, with true boxes.

    At every threshold each detection takes the free true box of greatest overlap at or above it, the later one
    on ties; one that finds none but overlaps a crowd box is ignored.
    """
    hit, ignored = match_many(over[None], crowd[None])
    return hit[:, 0], ignored[:, 0]


def match_many(over: np.ndarray, crowd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """match() of many groups side by side: over (group, detection, box), -1 where there is no such box; results (threshold, group, detection)."""
    groups, dets, boxes = over.shape
    hit, ignored = (np.zeros((len(THRESHOLDS), groups, dets), bool) for _ in range(2))
    if not boxes:
        return hit, ignored
    free = np.repeat(~crowd[None], len(THRESHOLDS), axis=0)
    least = np.array(THRESHOLDS)[:, None, None]
    for i in range(dets):
        row = over[None, :, i]
        ok = np.where(free & (row >= np.minimum(least, 1 - 1e-10)), row, -1.0)
        last = boxes - 1 - ok[:, :, ::-1].argmax(axis=2)
        hit[:, :, i] = np.take_along_axis(ok, last[:, :, None], 2)[:, :, 0] >= 0
        t, g = np.nonzero(hit[:, :, i])
        free[t, g, last[t, g]] = False
        ignored[:, :, i] = ~hit[:, :, i] & (crowd[None] & (row >= least)).any(axis=2)
    return hit, ignored


def _overlaps(d: np.ndarray, g: np.ndarray, crowd: np.ndarray) -> np.ndarray:
    """Overlaps (group, detection, box) of boxes (group, place, x y w h); with a crowd box by the detection's area."""
    d, g = d[:, :, None], g[:, None]
    side = lambda k: np.maximum(np.minimum(d[..., k] + d[..., k + 2], g[..., k] + g[..., k + 2]) - np.maximum(d[..., k], g[..., k]), 0)
    inter, area = side(0) * side(1), d[..., 2] * d[..., 3]
    union = np.where(crowd[:, None], area, area + g[..., 2] * g[..., 3] - inter)
    return np.divide(inter, union, out=np.zeros_like(inter), where=union > 0)


def _match_all(dets: pa.Table, truth: pa.Table, most: int = 100) -> pa.Table:
    """match() of every image and class of a bucket of images, a bit for each threshold; groups of like sizes go side by side."""
    cols = lambda t, names: [t[n].to_numpy() for n in names]
    image, cls, det, score = cols(dets, ("image_id", "class_id", "det", "score"))
    t_image, t_cls, t_crowd = cols(truth, ("image_id", "class_id", "crowd"))
    box, t_box = (np.stack(cols(t, "xywh"), axis=1).astype(float) if t.num_rows else np.empty((0, 4)) for t in (dets, truth))
    both = np.unique(np.stack([np.append(image, t_image), np.append(cls, t_cls)], axis=1).astype(np.int64), axis=0, return_inverse=True)[1].ravel()
    group, t_group = both[: len(image)], both[len(image) :]
    order = np.lexsort((det, -score, group))
    first = np.searchsorted(group[order], np.arange(both.max(initial=-1) + 2))
    t_order = np.argsort(t_group, kind="stable")
    t_first = np.searchsorted(t_group[t_order], np.arange(both.max(initial=-1) + 2))
    n, m = np.minimum(np.diff(first), most), np.diff(t_first)
    some = np.flatnonzero(n)
    some = some[np.lexsort((n[some], m[some]))]
    rows, hits, ignored, at = [], [], [], 0
    while at < len(some):
        width = max(1, 2 * int(n[some[at]])) * max(1, 2 * int(m[some[at]]))
        own = some[at : at + max(1, (1 << 18) // width)]
        own = own[(m[own] <= max(2 * m[own[0]], 1)) & (np.maximum.accumulate(n[own]) <= 2 * n[own[0]])] if len(own) > 1 else own
        own = some[at : at + len(own)]
        d, g = (np.arange(max(int(x[own].max()), 0)) for x in (n, m))
        has, t_has = d < n[own][:, None], g < m[own][:, None]
        pick = order[np.where(has, first[own][:, None] + d, 0)]
        t_pick = t_order[np.where(t_has, t_first[own][:, None] + g, 0)] if len(t_order) else np.zeros(t_has.shape, np.int64)
        crowd = (t_crowd[t_pick].astype(bool) & t_has) if len(t_order) else t_has
        over = np.where(t_has[:, None], _overlaps(box[pick], t_box[t_pick], crowd), -1.0) if len(t_order) else np.zeros((*has.shape, 0))
        h, i = match_many(over, crowd)
        rows.append(pick[has])
        hits.append(h[:, has])
        ignored.append(i[:, has])
        at += len(own)
    k = len(THRESHOLDS)
    at = np.concatenate([*rows, np.empty(0, np.int64)])
    bits = lambda x: (1 << np.arange(k)) @ np.concatenate([*x, np.empty((k, 0), bool)], axis=1)
    return pa.table({"image_id": image[at], "class_id": cls[at], "score": score[at], "det": det[at], "hit": bits(hits), "ignored": bits(ignored)})


def average_precision(detections: DataFrame, truth: DataFrame, classes: DataFrame) -> DataFrame:
    """(class_id, ap, ap_50, ap_75, support) of every class [T17]; -1 without a true box.

    detections: image_id, class_id, det (number), score, x, y, w, h. truth: image_id, class_id, crowd, x, y, w, h.
    Images are matched in parallel; precision and recall are running sums over each class by score, of all thresholds at once, taken
    over ranges, so a common class is spread over tasks and a detection is one row all the way. The precision is made monotone from the right and
    sampled at recalls 0, 0.01, ..., 1.
    """

    ddl = "image_id long, class_id int, score double, det long, hit long, ignored long"
    buckets = max(1, -(-detections.count() // 20_000))
    own = F.pmod(F.xxhash64("image_id"), F.lit(buckets)).alias("_b")
    truth = truth.select(*(F.col(c).alias(c) for c in truth.columns))  # columns of their own, as detections may come from the same table
    matched = detections.select("*", own).groupBy("_b").cogroup(truth.select("*", own).groupBy("_b")).applyInArrow(lambda d, g: _match_all(d, g), ddl)
    support = truth.where(~F.col("crowd")).groupBy("class_id").agg(F.count("*").alias("support"))
    places = range(len(THRESHOLDS))
    bit = lambda c, i: F.shiftright(c, i).bitwiseAND(F.lit(1).cast("long"))
    sums = {f"tp{i}": ("sum", bit("hit", i)) for i in places} | {f"n{i}": ("sum", 1 - bit("ignored", i)) for i in places}
    curve = running(matched, ["class_id"], [F.desc("score"), F.col("image_id"), F.col("det")], sums)
    each = F.array(*(F.struct(F.lit(t).alias("t"), F.col(f"tp{i}").alias("tp"), F.col(f"n{i}").alias("n"), bit("ignored", i).alias("ignored")) for i, t in enumerate(THRESHOLDS)))
    curve = curve.select("class_id", F.explode(each).alias("x")).select("class_id", "x.*").where("ignored = 0")
    curve = curve.join(F.broadcast(support), "class_id").select("class_id", "t", (F.col("tp") / F.col("support")).alias("recall"), (F.col("tp") / F.col("n")).alias("precision"))
    # The greatest precision at or beyond each recall sample: a point serves all samples up to its recall.
    best = curve.groupBy("class_id", "t", F.floor(F.col("recall") * 100 + 1e-9).cast("int").alias("r")).agg(F.max("precision").alias("p"))
    samples = best.groupBy("class_id", "t").agg(F.collect_list(F.struct("r", "p")).alias("c"))
    at = lambda s: F.coalesce(F.array_max(F.transform(F.filter("c", lambda x: x["r"] >= s), lambda x: x["p"])), F.lit(0.0))
    ap = F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(100)), at), F.lit(0.0), lambda s, x: s + x) / 101
    each = samples.select("class_id", "t", ap.alias("ap"))
    pick = lambda t: F.coalesce(F.max(F.when(F.col("t") == t, F.col("ap"))), F.lit(0.0))
    out = each.groupBy("class_id").agg((F.sum("ap") / len(THRESHOLDS)).alias("ap"), pick(0.5).alias("ap_50"), pick(0.75).alias("ap_75"))
    out = classes.select("class_id").join(support, "class_id", "left").join(out, "class_id", "left")
    value = lambda c: F.when(F.col("support").isNull(), -1.0).otherwise(F.coalesce(c, F.lit(0.0))).alias(c)
    return out.select("class_id", value("ap"), value("ap_50"), value("ap_75"), F.coalesce("support", F.lit(0).cast("long")).alias("support"))


def mean_ap(per_class: DataFrame) -> DataFrame:
    """(map, map_50, map_75): means over classes with a true box; 0 if there are none."""
    mean = lambda c, n: F.coalesce(F.avg(F.when(F.col(c) >= 0, F.col(c))), F.lit(0.0)).alias(n)
    return per_class.agg(mean("ap", "map"), mean("ap_50", "map_50"), mean("ap_75", "map_75"))


def fold_summary(results: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Mean, population standard deviation and half range over folds, folds present and whether support is low."""
    v = F.col(value)
    return results.groupBy(*by).agg(
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), ((F.max(v) - F.min(v)) / 2).alias("half_range"), F.count(v).alias("folds"),
        F.sum("support").alias("support"), (F.sum("support") < 50).alias("low_support"),
    )


def epoch_means(batches: DataFrame, by: list[str], losses: list[str]) -> DataFrame:
    """Mean of every loss over an epoch's batches; 0 where a batch has none."""
    return batches.groupBy(*by).agg(*(F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in losses))


def box_counts(annotations: DataFrame, image: str = "image_id") -> DataFrame:
    """A1: (image, n_boxes, histogram): boxes of each image, and (class_id, n) by class."""
    each = annotations.groupBy(image, "class_id").agg(F.count("*").alias("n"))
    return each.groupBy(image).agg(F.sum("n").alias("n_boxes"), F.sort_array(F.collect_list(F.struct("class_id", "n"))).alias("histogram"))


def early_stopping(curve: DataFrame, by: list[str], order: str, score: str, patience: int) -> DataFrame:
    """Curve with is_best, since_best (epochs without a better one) and stop (the first at `patience`)."""
    run = Window.partitionBy(*by).orderBy(order)
    before = F.max(score).over(run.rowsBetween(Window.unboundedPreceding, -1))
    x = curve.withColumn("is_best", F.col(score) > F.coalesce(before, F.lit(float("-inf"))))
    x = x.withColumn("_n", F.row_number().over(run))
    last = F.max(F.when(F.col("is_best"), F.col("_n"))).over(run.rowsBetween(Window.unboundedPreceding, 0))
    x = x.withColumn("since_best", (F.col("_n") - F.coalesce(last, F.lit(0))).cast("int"))
    first = F.min(F.when(F.col("since_best") >= patience, F.col("_n"))).over(Window.partitionBy(*by))
    return x.withColumn("stop", F.coalesce(F.col("_n") == first, F.lit(False))).drop("_n")


def percentiles(df: DataFrame, value: str, by: list[str], least: float) -> DataFrame:
    """10, 50 and 90 % by linear interpolation, and the share at or above `least`."""
    p = F.percentile(value, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    x = df.groupBy(*by).agg(p.alias("p"), F.avg((F.col(value) >= least).cast("int")).alias("rate"))
    return x.select(*by, F.col("p")[0].alias("p10"), F.col("p")[1].alias("p50"), F.col("p")[2].alias("p90"), "rate")
