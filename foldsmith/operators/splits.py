"""Leave-one-dataset-out folds [P5, P18-P20, G2, G4, G6, G8-G10, J14, J15, A19, C1, U4].

Images are a DataFrame: id, dataset, group_id, subscene_id, sha, file, n_boxes, n_classes, area and
embedding (unit vector, null allowed). What needs an order inside a scene group runs as one task for each group and
fold, or in rounds over all tasks where a group is large; group summaries, which are small, go to one task for each fold; all
else is joins and windows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldsmith.operators.graph import connected_components
from foldsmith.operators.ids import with_index
from foldsmith.operators.scan import running
from foldsmith.operators.similarity import cosine_pairs, near_any
from foldsmith.session import materialize


@dataclass
class FoldRules:
    """Parameters of a build; the defaults are the production values."""

    train_cap: int = 5
    eval_cap: int = 2
    thin: float | None = 0.95
    near: float = 0.80
    val_fraction: float = 0.10
    most_share: float = 1.2
    least_boxes: int = 50
    least_groups: int = 15
    seed: int = 42
    hold_out_together: list[list[str]] = field(default_factory=list)
    keep_together: list[list[str]] = field(default_factory=list)


def best_first() -> list[Column]:
    """Order of images, best first: with boxes, more labelled classes, more boxes, larger, lower id."""
    return [F.desc(F.col("n_boxes") > 0), F.desc("n_classes"), F.desc("n_boxes"), F.desc("area"), F.asc("id")]


def fold_side(datasets: Column, held: Column, sidelined: Column, val: Column | None = None) -> Column:
    """Test, val, sidelined or train of a group with these datasets; the first that fits."""
    side = F.when(F.array_contains(datasets, held), "test")
    if val is not None:
        side = side.when(val.isNotNull() & F.array_contains(datasets, val), "val")
    return side.when(F.arrays_overlap(datasets, sidelined), "sidelined").otherwise("train")


def sidelined(folds: DataFrame, together: DataFrame) -> DataFrame:
    """U4: folds (held, val) with sidelined: partners of both in any set (set_id, dataset), less both."""
    sets = together.groupBy("set_id").agg(F.collect_set("dataset").alias("s"))
    hit = folds.join(F.broadcast(sets), F.array_contains("s", F.col("held")) | F.coalesce(F.array_contains("s", F.col("val")), F.lit(False)), "left")
    own = F.array_except(F.flatten(F.collect_list("s")), F.array_compact(F.array("held", "val")))
    return hit.groupBy("held", "val").agg(F.array_sort(F.array_distinct(own)).alias("sidelined"))


def cap_key(keep_together: list[str]) -> Column:
    """P20: what a cap counts: the sub-scene, and the dataset too where copies are kept together."""
    return F.concat_ws("/", F.col("subscene_id").cast("string"), F.when(F.col("dataset").isin(keep_together or [""]), F.col("dataset")))


def pick(images: pd.DataFrame, cap: int, thin: float | None, before: list[int] | None = None) -> list[int]:
    """Positions of the images to keep, in the order given (best first).

    An image is passed over if its content is chosen already, its cap_key has `cap` chosen, or its cosine to a chosen
    one is at or above `thin`. What is passed over takes up no place. before: for each image those of its cap_key chosen elsewhere.
    """
    vectors = [None if v is None else np.asarray(v, float) for v in images["embedding"]]
    stack, n = np.empty((16, next((len(v) for v in vectors if v is not None), 0))), 0
    chosen, seen, used = [], set(), {}
    for i, (sha, key, v) in enumerate(zip(images["sha"], images["cap_key"], vectors)):
        if sha in seen or used.get(key, 0) + (before[i] if before else 0) >= cap:
            continue
        if thin is not None and v is not None and n and (stack[:n] @ v).max() >= thin:
            continue
        chosen.append(i)
        seen.add(sha)
        used[key] = used.get(key, 0) + 1
        if v is not None:
            if n == len(stack):
                stack = np.concatenate([stack, np.empty_like(stack)])
            stack[n] = v
            n += 1
    return chosen


#: Images of a group that one task picks from; larger groups are settled in rounds by all tasks.
GROUP_ROWS = 10_000


def picked(images: DataFrame, by: list[str], cap: int, thin: float | None, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Rows of images (with cap_key) that pick() keeps of each group of `by`.

    A group of up to group_rows images is one task; what is kept of larger ones is the same, see picked_in_rounds.
    """
    large = materialize(images.groupBy(*by).agg(F.count("*").alias("_size")).where(F.col("_size") > group_rows).drop("_size"), "large-groups")
    if large.isEmpty():
        return images.join(_picked_in_tasks(images, by, cap, thin), [*by, "id"], "left_semi")
    small = _picked_in_tasks(images.join(large, by, "left_anti"), by, cap, thin)
    kept = small.unionByName(picked_in_rounds(images.join(large, by, "left_semi"), by, cap, thin, group_rows))
    return images.join(kept, [*by, "id"], "left_semi")


def _picked_in_tasks(images: DataFrame, by: list[str], cap: int, thin: float | None) -> DataFrame:
    """(*by, id) that pick() keeps, one call for each group."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*best_first()))
    few = images.select(*by, "id", "sha", "cap_key", "embedding", rank.alias("_rank"))
    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in few.select(*by, "id").schema)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_rank", ignore_index=True)
        return group.loc[pick(group, cap, thin), [*by, "id"]]

    return few.groupBy(*by).applyInPandas(run, names)


def picked_in_rounds(images: DataFrame, by: list[str], cap: int, thin: float | None, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(*by, id) that pick() keeps of groups of any size: an ordered greedy independent set.

    An image is out once a better one of its content or near to it is kept, or `cap` better ones of its cap_key are; it is kept once no
    better one that could still be kept stands in its way. Each round settles all such images of all groups at once: what
    is kept and open before an image comes from running sums over ranges, near pairs from the cells' join. A group whose open images
    are down to group_rows is finished in one task, so a round is only spent where many images remain.
    """
    number = materialize(with_index(images.select(*by, "id", "sha", "cap_key", "embedding", "n_boxes", "n_classes", "area"), [*map(F.col, by), *best_first()], "_n"), "pick-order")
    edges = None
    if thin is not None:
        near = cosine_pairs(number.select("id", "embedding").dropDuplicates(["id"]), thin, "id").select("a", "b")
        rows = number.select(*by, "id", "_n")
        end = lambda side: rows.select(*by, F.col("id").cast("long").alias(side), F.col("_n").alias(f"_{side}"))
        edges = near.join(end("a"), "a").join(end("b"), [*by, "b"])
        edges = materialize(edges.select(F.least("_a", "_b").alias("_lo"), F.greatest("_a", "_b").alias("_n")), "pick-edges")
    state = number.select(*by, "id", "_n", "sha", "cap_key", F.lit(0).alias("_is"))  # 0 open, 1 kept, 2 out
    kept, open_ = ((F.col("_is") == v).cast("long") for v in (1, 0))
    while True:
        s = running(state, [*by, "sha"], [F.col("_n")], {"_kept_sha": ("sum", kept), "_open_sha": ("sum", open_)})
        s = running(s, [*by, "cap_key"], [F.col("_n")], {"_kept_cap": ("sum", kept), "_open_cap": ("sum", open_)})
        if edges is not None:
            at = edges.join(state.select(F.col("_n").alias("_lo"), "_is"), "_lo").groupBy("_n").agg(F.count_if(F.col("_is") == 1).alias("_kept_near"), F.count_if(F.col("_is") == 0).alias("_open_near"))
            s = s.join(at, "_n", "left").fillna(0, ["_kept_near", "_open_near"])
        else:
            s = s.withColumns({"_kept_near": F.lit(0), "_open_near": F.lit(0)})
        out = (F.col("_kept_sha") > 0) | (F.col("_kept_near") > 0) | (F.col("_kept_cap") >= cap)
        free = (F.col("_open_sha") == 1) & (F.col("_open_near") == 0) & (F.col("_kept_cap") + F.col("_open_cap") - 1 < cap)
        is_ = F.when(F.col("_is") != 0, F.col("_is")).when(out, 2).when(free, 1).otherwise(0)
        state = materialize(s.select(*by, "id", "_n", "sha", "cap_key", is_.alias("_is")), "pick-round")
        most = state.where("_is = 0").groupBy(*by).count().agg(F.max("count")).first()[0] or 0
        if most <= group_rows:
            break
    done = state.where("_is = 1").select(*by, "id")
    return done if not most else done.unionByName(_finish(state, number, edges, by, cap, thin))


def _finish(state: DataFrame, number: DataFrame, edges: DataFrame | None, by: list[str], cap: int, thin: float | None) -> DataFrame:
    """(*by, id) that pick() keeps of the open images of each group, after those that are settled."""
    before = running(state, [*by, "cap_key"], [F.col("_n")], {"_kept_cap": ("sum", (F.col("_is") == 1).cast("long"))})
    sha = running(state, [*by, "sha"], [F.col("_n")], {"_kept_sha": ("sum", (F.col("_is") == 1).cast("long"))})
    rest = before.where("_is = 0").join(sha.where("_kept_sha = 0").select("_n"), "_n", "left_semi").join(number.select("_n", "embedding"), "_n")
    if edges is not None:  # kept in the last round, so not yet held against their neighbours
        close = edges.join(state.where("_is = 1").select(F.col("_n").alias("_lo")), "_lo", "left_semi").select("_n")
        rest = rest.join(close, "_n", "left_anti")
    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rest.select(*by, "id").schema)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_n", ignore_index=True)
        return group.loc[pick(group, cap, thin, group["_kept_cap"].tolist()), [*by, "id"]]

    return rest.groupBy(*by).applyInPandas(run, names)


def one_dataset_per_scene(images: DataFrame, by: list[str], keep_together: list[list[str]]) -> DataFrame:
    """Of a sub-scene's images only those of its best image's dataset, and of the datasets kept together with it."""
    best = F.first("dataset").over(Window.partitionBy(*by, "subscene_id").orderBy(*best_first()))
    ok = F.col("dataset") == F.col("_best")
    for names in keep_together:
        ok = ok | (F.col("dataset").isin(names) & F.col("_best").isin(names))
    return images.withColumn("_best", best).where(ok).drop("_best")


def near_clusters(images: DataFrame, threshold: float) -> DataFrame:
    """(group_id, cluster): groups linked where any two of their images are at or above the threshold."""
    pairs = cosine_pairs(images, threshold, "id")
    g = images.select("id", "group_id").distinct()
    edges = pairs.join(g.select(F.col("id").alias("a"), F.col("group_id").alias("ga")), "a").join(g.select(F.col("id").alias("b"), F.col("group_id").alias("gb")), "b")
    comp = connected_components(edges.where("ga <> gb").select("ga", "gb").distinct(), "ga", "gb")
    return g.select("group_id").distinct().join(comp.select(F.col("node").alias("group_id"), "component"), "group_id", "left").select("group_id", F.coalesce("component", "group_id").alias("cluster"))


def pick_validation(train: np.ndarray, val: np.ndarray, boxes: np.ndarray, eligible: np.ndarray, order: np.ndarray, rules: FoldRules) -> tuple[np.ndarray, np.ndarray]:
    """(whether each group goes to validation, validation share of each dataset).

    train, val: images by group and dataset on either side; boxes: validation boxes by group and class; order: the
    groups in the order to try. First class floors, the shortest class first; then datasets up to the fraction. No group may
    bring its main dataset beyond most_share times the fraction.
    """
    chosen = np.zeros(len(train), bool)
    n_train, n_val = train.sum(axis=0), np.zeros(train.shape[1], np.int64)
    n_boxes, n_groups = np.zeros(boxes.shape[1]), np.zeros(boxes.shape[1])
    main = val.argmax(axis=1) if val.shape[1] else np.zeros(len(val), np.int64)
    queue = [g for g in order if eligible[g]]

    def share(d, g=None):
        v = n_val[d] + (0 if g is None else val[g, d])
        t = n_train[d] - (0 if g is None else train[g, d])
        return v / max(1, t + v)

    def try_one(ok) -> bool:
        for g in queue:
            if not chosen[g] and ok(g) and share(main[g], g) <= rules.most_share * rules.val_fraction:
                chosen[g] = True
                n_train[:], n_val[:] = n_train - train[g], n_val + val[g]
                n_boxes[:], n_groups[:] = n_boxes + boxes[g], n_groups + (boxes[g] > 0)
                return True
        return False

    open_classes = set(np.flatnonzero(boxes.sum(axis=0) > 0).tolist())
    while True:
        need = {c: min(n_boxes[c] / rules.least_boxes, n_groups[c] / rules.least_groups) for c in open_classes if n_boxes[c] < rules.least_boxes or n_groups[c] < rules.least_groups}
        if not need:
            break
        c = min(need, key=lambda c: (need[c], c))
        if not try_one(lambda g, c=c: boxes[g, c] > 0):
            open_classes.discard(c)
    for d in sorted({main[g] for g in queue}):
        for g in queue:
            if share(d) >= rules.val_fraction:
                break
            if main[g] == d and not chosen[g] and share(d, g) <= rules.most_share * rules.val_fraction:
                chosen[g] = True
                n_train[:], n_val[:] = n_train - train[g], n_val + val[g]
    return chosen, np.array([share(d) for d in range(train.shape[1])])


#: Rows of a fold's summary that one task picks the validation groups from; larger folds are picked from in rounds.
SUMMARY_ROWS = 200_000


def validation_groups(summary: DataFrame, rules: FoldRules, summary_rows: int = SUMMARY_ROWS) -> DataFrame:
    """(held, group_id, to_val) of a summary by fold, group and dataset.

    summary: held, group_id, dataset, n_train, n_val, class_boxes map<int,long> (on one row of the group), eligible. A fold whose
    summary has up to summary_rows rows is one task; what is picked in larger ones is the same, see validation.py.
    """
    from foldsmith.operators.validation import picked_in_rounds

    sizes = summary.groupBy("held").count().collect()  # a row for each fold
    large = [r.held for r in sizes if r["count"] > summary_rows]
    if not large:
        return _validation_in_tasks(summary, rules)
    out = _validation_in_tasks(summary.where(~F.col("held").isin(large)), rules)
    for held in sorted(large):
        out = out.unionByName(picked_in_rounds(summary.where(F.col("held") == held), held, rules))
    return out


def _validation_in_tasks(summary: DataFrame, rules: FoldRules) -> DataFrame:

    def run(s: pd.DataFrame) -> pd.DataFrame:
        held = s["held"].iloc[0]
        groups, datasets = sorted(s["group_id"].unique()), sorted(s["dataset"].unique())
        gi, di = {g: i for i, g in enumerate(groups)}, {d: i for i, d in enumerate(datasets)}
        maps = [dict(m) if m is not None else {} for m in s["class_boxes"]]
        classes = sorted({c for m in maps for c in m})
        train, val = (np.zeros((len(groups), len(datasets)), np.int64) for _ in range(2))
        boxes, eligible = np.zeros((len(groups), len(classes)), np.int64), np.ones(len(groups), bool)
        for g, d, a, b, m, ok in zip(s["group_id"], s["dataset"], s["n_train"], s["n_val"], maps, s["eligible"]):
            train[gi[g], di[d]] += a
            val[gi[g], di[d]] += b
            eligible[gi[g]] &= bool(ok)
            for c, n in m.items():
                boxes[gi[g], classes.index(c)] += n
        eligible &= val.sum(axis=1) > 0
        key = [hashlib.sha1(f"{rules.seed}:{held}:{g}".encode()).hexdigest() for g in groups]
        chosen, _ = pick_validation(train, val, boxes, eligible, np.argsort(key), rules)
        return pd.DataFrame({"held": held, "group_id": groups, "to_val": chosen})

    return summary.groupBy("held").applyInPandas(run, "held string, group_id long, to_val boolean")


def split_by_group(images: DataFrame, fraction: float, seed: int) -> DataFrame:
    """(id, to_val): whole groups in hash order go to validation while they fit; the smallest if none does.

    Groups are numbered in hash order over range partitions. A round takes all groups up to the first that does not fit, by
    running sums; the next goes on behind it with the groups that fit the room left, of which each round has fewer sizes.
    """
    sizes = images.groupBy("group_id").agg(F.count("*").alias("n"))
    key = F.sha1(F.concat_ws(":", F.lit(seed).cast("string"), F.col("group_id").cast("string")))
    ordered = materialize(with_index(sizes.withColumn("_k", key), [F.col("_k"), F.col("group_id")], "_i").drop("_k"), "groups")
    room = max(1, int((ordered.agg(F.sum("n")).first()[0] or 0) * fraction))
    taken, begin = F.lit(False), 0
    while True:
        rest = ordered.where((F.col("_i") >= begin) & (F.col("n") <= room)).select("_i", "n")
        run = running(rest, [], [F.col("_i")], {"_u": ("sum", F.col("n"))})
        fits = F.col("_u") <= room
        r = run.agg(F.sum(F.when(fits, F.col("n"))).alias("n"), F.min(F.when(~fits, F.col("_i"))).alias("stop")).first()
        end = (1 << 62) if r.stop is None else r.stop
        taken = taken | ((F.col("_i") >= begin) & (F.col("_i") < end) & (F.col("n") <= room))
        room -= r.n or 0
        if r.stop is None or room < 1:
            break
        begin = r.stop + 1
    chosen = ordered.withColumn("to_val", taken)
    if chosen.where("to_val").isEmpty():
        least = ordered.orderBy("n", "_i").limit(1).select("_i")
        chosen = ordered.join(F.broadcast(least.withColumn("to_val", F.lit(True))), "_i", "left").fillna(False, ["to_val"])
    return images.join(chosen.select("group_id", "to_val"), "group_id").select("id", "to_val")


def build_folds(images: DataFrame, held_out: list[str], rules: FoldRules, boxes: DataFrame | None = None, drops: DataFrame | None = None, barred: DataFrame | None = None) -> DataFrame:
    """(held, split, id, dataset, group_id, subscene_id, file): the train, val and test images of every fold.

    boxes: (id, class_id, n). drops: (held, file), taken out of train and val. barred: (held, file) whose near-copy cluster
    must stay in train.
    """
    spark = images.sparkSession
    together = [d for names in rules.keep_together for d in names]
    side_of = {h: sorted({d for names in rules.hold_out_together if h in names for d in names} - {h}) for h in held_out}
    folds = spark.createDataFrame([(h, side_of[h]) for h in held_out], "held string, out array<string>")
    images = materialize(images.withColumn("cap_key", cap_key(together)), "images")
    groups = images.groupBy("group_id").agg(F.collect_set("dataset").alias("ds"))
    sides = groups.crossJoin(F.broadcast(folds)).select("held", "group_id", fold_side(F.col("ds"), F.col("held"), F.col("out")).alias("side"))
    own = materialize(images.where("n_boxes > 0").join(sides.where("side IN ('test', 'train')"), "group_id"), "fold-images")
    test = materialize(picked(own.where("side = 'test' AND dataset = held"), ["held", "group_id"], rules.eval_cap, rules.thin), "test")
    pool = materialize(one_dataset_per_scene(own.where("side = 'train'"), ["held"], rules.keep_together), "pool")
    as_train = materialize(picked(pool, ["held", "group_id"], rules.train_cap, rules.thin), "as-train")
    as_val = materialize(picked(pool, ["held", "group_id"], rules.eval_cap, rules.thin), "as-val")
    drops = drops if drops is not None else spark.createDataFrame([], "held string, file string")
    clusters = []
    for h in held_out:
        both = as_train.where(F.col("held") == h).select("id", "group_id", "embedding").union(as_val.where(F.col("held") == h).select("id", "group_id", "embedding")).distinct()
        clusters.append(near_clusters(both, rules.near).withColumn("held", F.lit(h)))
    clusters = materialize(_union(clusters), "clusters")
    alone = clusters.groupBy("held", "cluster").agg((F.count("*") == 1).alias("alone"))
    if barred is not None:
        bad = as_train.union(as_val).join(barred, ["held", "file"], "left_semi").join(clusters, ["held", "group_id"]).select("held", "cluster").distinct().withColumn("bad", F.lit(True))
        alone = alone.join(bad, ["held", "cluster"], "left").select("held", "cluster", (F.col("alone") & F.col("bad").isNull()).alias("alone"))
    n = lambda df, c: df.join(drops, ["held", "file"], "left_anti").groupBy("held", "group_id", "dataset").agg(F.count("*").alias(c))
    summary = n(as_train, "n_train").join(n(as_val, "n_val"), ["held", "group_id", "dataset"], "full").fillna(0, ["n_train", "n_val"])
    if boxes is not None:
        c = as_val.join(drops, ["held", "file"], "left_anti").join(boxes, "id").groupBy("held", "group_id", "dataset", "class_id").agg(F.sum("n").alias("n"))
        c = c.groupBy("held", "group_id", "dataset").agg(F.map_from_entries(F.collect_list(F.struct("class_id", "n"))).alias("class_boxes"))
        summary = summary.join(c, ["held", "group_id", "dataset"], "left")
    else:
        summary = summary.withColumn("class_boxes", F.lit(None).cast("map<int,long>"))
    summary = summary.join(clusters, ["held", "group_id"], "left").join(alone, ["held", "cluster"], "left").withColumn("eligible", F.coalesce("alone", F.lit(True)))
    to_val = materialize(validation_groups(summary.select("held", "group_id", "dataset", "n_train", "n_val", "class_boxes", "eligible"), rules), "to-val")
    moved = to_val.where("to_val").select("held", "group_id")
    val = materialize(as_val.join(moved, ["held", "group_id"], "left_semi"), "val")
    train = materialize(as_train.join(moved, ["held", "group_id"], "left_anti"), "train")
    val, train = _settle(val, train, as_train, held_out, rules.near)
    train = _union([_far(train, test, h, rules.near) for h in held_out])
    cols = ["held", "split", "id", "dataset", "group_id", "subscene_id", "file"]
    kept = train.withColumn("split", F.lit("train")).select(cols).union(val.withColumn("split", F.lit("val")).select(cols)).join(drops, ["held", "file"], "left_anti").select(cols)
    return kept.union(test.withColumn("split", F.lit("test")).select(cols))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _near(left: DataFrame, right: DataFrame, held: str, threshold: float) -> DataFrame:
    """Rows of a fold's left side that are at or above the threshold to its right side."""
    a = left.where(F.col("held") == held)
    return near_any(a, right.where(F.col("held") == held), threshold, "id").select(F.lit(held).alias("held"), F.col("q").alias("id"))


def _far(left, right, held, threshold):
    return left.where(F.col("held") == held).join(_near(left, right, held, threshold), ["held", "id"], "left_anti")


def _settle(val, train, as_train, held_out, near):
    """Groups with a val image near to train go to train whole, until none is left.

    After the first round val has nothing near to what was in train before, so it only meets the groups that have just come.
    """
    fresh = train
    while True:
        close = materialize(_union([_near(val, fresh, h, near) for h in held_out]).join(val, ["held", "id"]).select("held", "group_id").distinct(), "close")
        if close.isEmpty():
            return val, train
        fresh = materialize(as_train.join(close, ["held", "group_id"], "left_semi"), "fresh")
        train = materialize(train.unionByName(fresh), "train")
        val = materialize(val.join(close, ["held", "group_id"], "left_anti"), "val")


def violations(folds: DataFrame, side_of: DataFrame | None = None) -> DataFrame:
    """(held, rule, detail): a group in two splits; the held-out or a sidelined dataset in train or val; others in test."""
    twice = folds.groupBy("held", "group_id").agg(F.countDistinct("split").alias("n")).where("n > 1").select("held", F.lit("group_in_two_splits").alias("rule"), F.col("group_id").cast("string").alias("detail"))
    held = folds.where("split <> 'test' AND dataset = held").select("held", F.lit("held_out_in_training").alias("rule"), F.col("id").cast("string").alias("detail"))
    other = folds.where("split = 'test' AND dataset <> held").select("held", F.lit("other_dataset_in_test").alias("rule"), F.col("id").cast("string").alias("detail"))
    out = twice.union(held).union(other)
    if side_of is not None:
        bad = folds.where("split <> 'test'").join(side_of.select("held", F.explode("sidelined").alias("dataset")), ["held", "dataset"], "left_semi")
        out = out.union(bad.select("held", F.lit("sidelined_in_training").alias("rule"), F.col("id").cast("string").alias("detail")))
    return out
