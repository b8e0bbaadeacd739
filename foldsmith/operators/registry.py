"""Linking of images into scene groups and their registry [J3, J8, J9, G3, A2, A3, I2-I5]."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldsmith.operators.graph import connected_components
from foldsmith.operators.ids import with_index
from foldsmith.session import materialize


def nodes_of(occurrences: DataFrame) -> DataFrame:
    """(sha, idx, dataset, path): different contents in the order of their first occurrence.

    occurrences: dataset, path, sha and the orders dataset_ord and image_ord. The dataset and path are
    those of the first occurrence.
    """
    order = F.struct("dataset_ord", "image_ord")
    first = occurrences.groupBy("sha").agg(F.min(F.struct(order.alias("o"), "dataset", "path")).alias("f"))
    return with_index(first.select("sha", F.col("f.o").alias("o"), "f.dataset", "f.path"), [F.col("o"), F.col("sha")], "idx").drop("o")


def name_edges(occurrences: DataFrame, nodes: DataFrame, key: str = "source", space: str = "space") -> DataFrame:
    """Star edges between contents that share a normalised name within a name space (or dataset); every occurrence counts."""
    named = occurrences.where(F.col(key).isNotNull()).select("sha", F.coalesce(space, "dataset").alias("s"), F.col(key).alias("n"))
    named = named.join(nodes.select("sha", "idx"), "sha").select("s", "n", "idx").distinct()
    hub = named.groupBy("s", "n").agg(F.min("idx").alias("hub"), F.count("*").alias("c")).where("c > 1")
    return named.join(hub, ["s", "n"]).where("idx <> hub").select(F.col("hub").alias("a"), F.col("idx").alias("b")).distinct()


def pair_edges(pairs: DataFrame, nodes: DataFrame, a: str = "path_a", b: str = "path_b") -> DataFrame:
    """Edges of an outside list of path pairs; unknown paths are ignored."""
    n = nodes.select("path", "idx")
    x = pairs.join(n.select(F.col("path").alias(a), F.col("idx").alias("a")), a).join(n.select(F.col("path").alias(b), F.col("idx").alias("b")), b)
    return x.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def roots(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """(idx, root) with root the least idx of the component; nodes without an edge are their own."""
    comp = connected_components(edges).select(F.col("node").alias("idx"), "component")
    return nodes.select("idx").join(comp, "idx", "left").select("idx", F.coalesce("component", "idx").alias(name))


def rule_merges(nodes: DataFrame, rules: list[tuple[str, DataFrame]]) -> list[tuple[str, int]]:
    """A3: unions that each rule adds after those before it: components before less components after.

    A rule goes on from the components of those before, a row for each node, not from their edges.
    """
    out, known, before = [], None, nodes.count()
    for name, own in rules:
        edges = own.select("a", "b")
        edges = edges if known is None else edges.union(known.select("idx", "r"))
        known = materialize(roots(nodes, edges, "r"), "rule-roots")
        after = known.select("r").distinct().count()
        out.append((name, before - after))
        before = after
    return out


def build_registry(occurrences: DataFrame, strong: DataFrame, weak: DataFrame) -> DataFrame:
    """The registry of images: occurrences with id, group_id and subscene_id [I4, I5].

    strong, weak: edges (a, b) of node numbers as nodes_of() gives them. Ids ascend by component root, content and
    occurrence; a path repeated within a content has null ids. Groups and sub-scenes are numbered by
    their roots' order and by first appearance.
    """
    nodes = materialize(nodes_of(occurrences), "nodes")
    both = strong.select("a", "b").union(weak.select("a", "b"))
    known = nodes.join(roots(nodes, strong, "strong_root"), "idx").join(roots(nodes, both, "root"), "idx")
    occ = occurrences.join(known.select("sha", "idx", "root", "strong_root"), "sha")
    nth = F.row_number().over(Window.partitionBy("sha", "path").orderBy("dataset_ord", "image_ord"))
    occ = materialize(occ.withColumn("_nth", nth), "occurrences")
    order = [F.col("root"), F.col("idx"), F.col("dataset_ord"), F.col("image_ord")]
    kept = materialize(with_index(occ.where("_nth = 1"), order, "id"), "registry")
    group = with_index(kept.select("root").distinct(), [F.col("root")], "group_id")
    scene = with_index(kept.groupBy("strong_root").agg(F.min("id").alias("first")), [F.col("first")], "subscene_id").drop("first")
    full = kept.join(group, "root").join(scene, "strong_root").drop("_nth")
    repeat = occ.where("_nth > 1").drop("_nth").withColumns({c: F.lit(None).cast("long") for c in ("id", "group_id", "subscene_id")})
    return full.unionByName(repeat)


def group_rollup(registry: DataFrame) -> DataFrame:
    """A2: (group_id, datasets, n_images, cross_dataset)."""
    g = registry.where("id IS NOT NULL").groupBy("group_id").agg(F.array_sort(F.collect_set("dataset")).alias("datasets"), F.count("*").alias("n_images"))
    return g.withColumn("cross_dataset", F.size("datasets") > 1)


def oversized(groups: DataFrame, n_images: int) -> DataFrame:
    """Groups beyond max(50, 1 % of the images): likely chained."""
    return groups.where(F.col("n_images") > max(50, 0.01 * n_images))
