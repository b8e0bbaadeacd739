"""Lists of pairs and photo-match decisions [S9, J16, J17, P13, P15, U5, K8, G7]."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldsmith.session import materialize


def unordered(df: DataFrame, a: str, b: str) -> DataFrame:
    """The pair's ends in order."""
    return df.withColumns({a: F.least(a, b), b: F.greatest(a, b)})


def last_of_pairs(pairs: DataFrame, a: str = "path_a", b: str = "path_b", order: str = "ord", value: str = "inliers") -> DataFrame:
    """The last row's value of every unordered pair."""
    return unordered(pairs, a, b).groupBy(a, b).agg(F.max_by(value, order).alias(value))


def distinct_pairs(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """U5."""
    return unordered(pairs, a, b).select(a, b).where(F.col(a) != F.col(b)).distinct()


def new_pairs(candidates: DataFrame, known: DataFrame, a: str, b: str) -> DataFrame:
    """Different candidate pairs that are not known in either order."""
    return distinct_pairs(candidates, a, b).join(distinct_pairs(known, a, b), [a, b], "left_anti")


@dataclass
class Spec:
    """Queries and targets, k, and the cosine band.

    Targets: `*` every dataset as a pool of its own, `=` the query's own dataset, `+` all as one pool; names are one pool together.
    """

    queries: list[str]
    targets: list[str]
    k: int
    low: float
    high: float

    @classmethod
    def parse(cls, text: str) -> Spec:
        """`q1,q2:t1,t2:K[:MIN[:MAX]]`."""
        q, t, k, *bounds = text.split(":")
        if len(bounds) > 2 or int(k) < 1:
            raise ValueError(f"no pair specification: {text}")
        return cls(q.split(","), t.split(","), int(k), float(bounds[0]) if bounds else 0.0, float(bounds[1]) if len(bounds) > 1 else float("inf"))


def candidates(images: DataFrame, spec: Spec, key: str = "vec_id", vec: str = "embedding", dataset: str = "dataset", digits: int | None = None) -> DataFrame:
    """(q, t, cosine, rank): the plan of a specification over one table of images [T2, T3, P12]; with `digits` the band takes the rounded cosine."""
    from foldsmith.operators.similarity import band, top_similar

    some = lambda names: images if "*" in names or "+" in names or "=" in names else images.where(F.col(dataset).isin(names))
    own_pools = "+" not in spec.targets and ("*" in spec.targets or "=" in spec.targets)
    found = top_similar(some(spec.queries), some(spec.targets), spec.k, key, vec, pool=dataset if own_pools else None)
    if "=" in spec.targets:
        own = images.select(F.col(key).cast("long").alias("q"), F.col(dataset).alias("own"))
        found = found.join(own, "q").where(F.col("pool") == F.col("own")).drop("own")
    cosine = F.col("cosine") if digits is None else F.round("cosine", digits).alias("cosine")
    return band(found.select("q", "t", cosine, "rank"), spec.low, spec.high)


def match_decisions(pairs: DataFrame, least: int = 25, val_least: int = 40, similar: int = 15, similar_cosine: float = 0.6) -> DataFrame:
    """(fold_id, side, file, decision) from matched pairs (fold_id, side, file, copy, inliers, cosine) [P13].

    side test: the copy's sub-scene is to be dropped (decision drop, file = the copy). side val: the val
    file goes to train (decision to_train).
    """
    drop = pairs.where((F.col("side") == "test") & (F.col("inliers") >= least)).select("fold_id", "side", F.col("copy").alias("file"), F.lit("drop").alias("decision"))
    is_copy = (F.col("inliers") >= val_least) | ((F.col("inliers") >= similar) & (F.col("cosine") >= similar_cosine))
    move = pairs.where((F.col("side") == "val") & is_copy).select("fold_id", "side", "file", F.lit("to_train").alias("decision"))
    return drop.union(move).distinct()


def whole_scenes(images: DataFrame, matched: DataFrame, file: str = "file", scene: str = "subscene_id") -> DataFrame:
    """All images of a sub-scene that holds a matched file."""
    hit = images.join(matched.select(file).distinct(), file, "left_semi").select(scene).distinct()
    return images.join(hit, scene, "left_semi")


def merge_drops(old: DataFrame, new: DataFrame) -> DataFrame:
    """Union of two (fold_id, file) lists."""
    return old.select("fold_id", "file").union(new.select("fold_id", "file")).distinct()


def fixed_point(build: Callable[[DataFrame], DataFrame], found: Callable[[DataFrame, DataFrame], DataFrame], drops: DataFrame, passes: int = 20) -> tuple[DataFrame, DataFrame, int]:
    """Build with the drops, look for new drops among the result, until none is new or `passes` are done.

    found(result, drops) gives (fold_id, file); only what is not yet in the drops counts. Returns the last
    result, all drops and the number of passes.
    """
    for n in range(1, passes + 1):
        result = materialize(build(drops), "fixed-point")
        new = materialize(found(result, drops).select("fold_id", "file").distinct().join(drops, ["fold_id", "file"], "left_anti"), "new-drops")
        if new.isEmpty():
            break
        drops = materialize(merge_drops(drops, new), "drops")
    return result, drops, n
