"""Leakage audits of folds and their problems as one table [C3, C5, C6, C9, A10, A16, J22, P21, P24, T7]."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldsmith.functions.boxes import inside
from foldsmith.operators.audit import Unreadable, over_cap, refuse_unreadable
from foldsmith.operators.balance import hash_order
from foldsmith.operators.similarity import most_similar, nearest_hamming, top_similar


def fold_problems(folds: DataFrame, boxes: DataFrame, caps: dict[str, int], per_dataset: list[str], out_of_training: DataFrame, n_classes: int) -> DataFrame:
    """(held, split, rule, detail), a row for each fault of a fold.

    folds: held, split, id, dataset, group_id, subscene_id. boxes: id, class_id, box, width, height. out_of_training: (held, dataset)
    pairs that may be in neither train nor val. Rules: beyond_cap, wrong_dataset (others in test, barred ones in training),
    no_boxes (of train images) and bad_box.
    """
    row = lambda df, rule, detail: df.select("held", "split", F.lit(rule).alias("rule"), detail.cast("string").alias("detail"))
    capped = row(over_cap(folds, caps, per_dataset), "beyond_cap", F.col("subscene_id"))
    test = folds.where("split = 'test' AND dataset <> held")
    barred = folds.where("split <> 'test'").join(F.broadcast(out_of_training.select("held", "dataset").distinct()), ["held", "dataset"], "left_semi")
    bare = folds.where("split = 'train'").join(boxes.select("id"), "id", "left_anti")
    right = F.col("class_id").between(0, n_classes - 1) & inside(F.col("box"), F.col("width"), F.col("height"))
    bad = folds.select("held", "split", "id").join(boxes.where(~right), "id")
    wrong = row(test, "wrong_dataset", F.col("id")).union(row(barred, "wrong_dataset", F.col("id")))
    return capped.union(wrong).union(row(bare, "no_boxes", F.col("id"))).union(row(bad, "bad_box", F.col("id")))


def nearest_in_training(folds: DataFrame, held: str, split: str) -> DataFrame:
    """Images of a split with their nearest training image: (held, split, id, near, cosine, distance, same_name).

    folds: held, split, id, embedding, bits, source; bits is a hash or an array of the hashes of all orientations, of which an image's first is
    compared with all of the training images. distance: the least one, 64 where training is empty. Images of either
    side without a vector or hash raise Unreadable: left out, they would look clean. Without training images near and cosine are null.
    """
    fold = refuse_unreadable(folds.where((F.col("held") == held) & F.col("split").isin(split, "train")), "embedding", "bits")
    own, train = fold.where(F.col("split") == split), fold.where(F.col("split") == "train")
    cosine = most_similar(own, train, "id").select(F.col("q").alias("id"), F.col("t").alias("near"), "cosine")
    distance = nearest_hamming(own, train, "id").select(F.col("q").alias("id"), "distance")
    named = own.select("id", "source").join(train.select("source").where("source IS NOT NULL").distinct().withColumn("same_name", F.lit(True)), "source", "left").select("id", F.coalesce("same_name", F.lit(False)).alias("same_name"))
    out = own.select("id").join(cosine, "id", "left").join(distance, "id").join(named, "id")
    return out.select(F.lit(held).alias("held"), F.lit(split).alias("split"), "id", "near", "cosine", "distance", "same_name")


def leakage_counts(nearest: DataFrame, cosines: list[float], distance: int) -> DataFrame:
    """Counters of nearest_in_training rows by fold and split: n, near_bits, same_name, and one for each cosine."""
    at = [F.count_if(F.col("cosine") >= t).alias(f"cosine_{round(100 * t)}") for t in cosines]
    return nearest.groupBy("held", "split").agg(F.count("*").alias("n"), F.count_if(F.col("distance") <= distance).alias("near_bits"), F.count_if("same_name").alias("same_name"), *at)


def by_cosine(nearest: DataFrame, n: int | None = None) -> DataFrame:
    """The closest first, ties by id; with n only so many."""
    x = nearest.orderBy(F.desc("cosine"), "id")
    return x if n is None else x.limit(n)


def sampled_matches(folds: DataFrame, held: str, inliers: DataFrame, n: int, k: int, least_cosine: float, seed: int) -> DataFrame:
    """(held, id, near, cosine, inliers): n validation images in hash order with their k most similar training images.

    inliers: (a, b, inliers) of matched pairs in either order; pairs not matched have null. n is the size of the check, not a limit of the data.
    Images of train or val without a vector raise Unreadable.
    """
    own = refuse_unreadable(folds.where((F.col("held") == held) & F.col("split").isin("val", "train")), "embedding")
    val = own.where("split = 'val'").orderBy(hash_order(F.lit(seed), F.col("id")), "id").limit(n)
    found = top_similar(val, own.where("split = 'train'"), k, "id").where(F.col("cosine") >= least_cosine)
    pair = lambda a, b: (F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))
    known = inliers.select(*pair(F.col("a"), F.col("b")), "inliers").groupBy("lo", "hi").agg(F.max("inliers").alias("inliers"))
    x = found.select(F.lit(held).alias("held"), F.col("q").alias("id"), F.col("t").alias("near"), "cosine", *pair(F.col("q"), F.col("t")))
    return x.join(known, ["lo", "hi"], "left").drop("lo", "hi")


def same_photo(least: int = 40, similar: int | None = 15, similar_cosine: float = 0.6) -> Column:
    """P13 of sampled_matches rows: enough inliers, or fewer at a great cosine."""
    hit = F.col("inliers") >= least
    if similar is not None:
        hit = hit | ((F.col("inliers") >= similar) & (F.col("cosine") >= similar_cosine))
    return F.coalesce(hit, F.lit(False))


def refuse_matches(matches: DataFrame) -> DataFrame:
    """The matches; raises if any is a same photo, as a script would exit with 1."""
    n = matches.where(same_photo()).select("id").distinct().count()
    if n:
        raise Unreadable(f"{n} validation images have a copy in training")
    return matches


def clean_validation(folds: DataFrame) -> DataFrame:
    """Folds without the val images whose group is in train."""
    train = folds.where("split = 'train'").select("held", "group_id").distinct()
    val = folds.where("split = 'val'").join(train, ["held", "group_id"], "left_anti").select(folds.columns)
    return folds.where("split <> 'val'").union(val)


def known_pairs(test: list[str] | None, val_for: dict[str, str] | None, datasets: list[str]) -> tuple[list[str], dict[str, str]]:
    """Test datasets and validation partners limited to datasets that are known; all are tested where none is named."""
    held = [d for d in (datasets if test is None else test) if d in datasets]
    return held, {t: v for t, v in (val_for or {}).items() if t in held and v in datasets}


def file_problems(files: DataFrame, folds: list[str], needed: list[str], label_maps: DataFrame, n_classes: int) -> DataFrame:
    """(fold, problem): missing files of a fold, label maps of the wrong size. files: fold, name. label_maps: fold, classes (map)."""
    spark = files.sparkSession
    want = spark.createDataFrame([(f, n) for f in folds for n in needed], "fold string, name string")
    missing = want.join(files.select("fold", "name"), ["fold", "name"], "left_anti").select("fold", F.concat(F.lit("missing: "), "name").alias("problem"))
    wrong = label_maps.where(F.size("classes") != n_classes).select("fold", F.concat(F.lit("label map of "), F.size("classes").cast("string"), F.lit(" classes")).alias("problem"))
    return missing.union(wrong)


def common_names(images: DataFrame, left: str, right: str) -> DataFrame:
    """(source, a, b): the first file of every source name that both datasets have. images: dataset, source, file, ord."""
    first = images.where("source IS NOT NULL").groupBy("dataset", "source").agg(F.min_by("file", "ord").alias("file"))
    side = lambda d, name: first.where(F.col("dataset") == d).select("source", F.col("file").alias(name))
    return side(left, "a").join(side(right, "b"), "source")


def confirmed_overlaps(pairs: DataFrame, by: list[str]) -> DataFrame:
    """A10: pairs (distance, name_a, name_b): those of distance 0, and of them those with one original name."""
    zero = F.col("distance") == 0
    return pairs.groupBy(*by).agg(F.count_if(zero).alias("distance_zero"), F.count_if(zero & F.coalesce(F.col("name_a") == F.col("name_b"), F.lit(False))).alias("confirmed"))


def exclusions(before: DataFrame, after: DataFrame, by: list[str], key: str = "id") -> DataFrame:
    """Rows by group before and after a filter, and how many it dropped."""
    b, a = (df.select(*by, key).distinct().groupBy(*by).agg(F.count("*").alias(n)) for df, n in ((before, "before"), (after, "after")))
    return b.join(a, by, "left").select(*by, "before", F.coalesce("after", F.lit(0)).alias("after"), (F.col("before") - F.coalesce("after", F.lit(0))).alias("dropped"))
