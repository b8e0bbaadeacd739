"""The choice of validation groups of one fold by all tasks, whatever the number of groups [G4, A19]."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldsmith.operators.balance import hash_order
from foldsmith.operators.ids import with_index
from foldsmith.operators.scan import running
from foldsmith.session import materialize

#: Candidates of a class that the driver looks at at a time.
PAGE = 1000


@dataclass
class Shares:
    """Images of every dataset on either side so far. A group that does not fit now never will: shares only grow."""

    datasets: list[str]
    n_train: np.ndarray
    n_val: np.ndarray
    bound: float

    def of(self, d: int, train: int = 0, val: int = 0) -> float:
        v = self.n_val[d] + val
        return float(v / max(1, self.n_train[d] - train + v))

    def fits(self) -> Column:
        """Whether a group (columns main, train, val) may still go to validation."""
        at = lambda x: F.element_at(F.array(*(F.lit(int(n)) for n in x)), F.col("main") + 1)
        own = lambda c: F.element_at(F.col(c), F.col("main") + 1)
        v = at(self.n_val) + own("val")
        return v / F.greatest(F.lit(1), at(self.n_train) - own("train") + v) <= self.bound

    def take(self, train: np.ndarray, val: np.ndarray) -> None:
        self.n_train, self.n_val = self.n_train - train, self.n_val + val


def groups_of(summary: DataFrame, held: str, datasets: list[str], seed: int) -> DataFrame:
    """(pos, group_id, ok, main, train, val, boxes) in hash order: counts as arrays by dataset, boxes by class."""
    number = F.array_position(F.array(*map(F.lit, datasets)), F.col("dataset")).cast("int") - 1
    cells = summary.groupBy("group_id", number.alias("d")).agg(F.sum("n_train").alias("t"), F.sum("n_val").alias("v"), F.min(F.coalesce("eligible", F.lit(False))).alias("ok"))
    g = cells.groupBy("group_id").agg(F.map_from_entries(F.collect_list(F.struct("d", "t"))).alias("t"), F.map_from_entries(F.collect_list(F.struct("d", "v"))).alias("v"), F.min("ok").alias("ok"))
    array = lambda c: F.transform(F.sequence(F.lit(0), F.lit(len(datasets) - 1)), lambda d: F.coalesce(F.try_element_at(F.col(c), d), F.lit(0).cast("long")))
    g = g.select("group_id", "ok", array("t").alias("train"), array("v").alias("val"))
    main = (F.array_position("val", F.array_max("val")) - 1).cast("int")
    some = F.exists("val", lambda x: x > 0)
    boxes = summary.where("class_boxes IS NOT NULL").select("group_id", F.explode("class_boxes").alias("c", "n")).groupBy("group_id", "c").agg(F.sum("n").alias("n"))
    boxes = boxes.groupBy("group_id").agg(F.map_from_entries(F.collect_list(F.struct("c", "n"))).alias("boxes"))
    g = g.join(boxes, "group_id", "left").select("group_id", (F.col("ok") & some).alias("ok"), main.alias("main"), "train", "val", F.coalesce("boxes", F.create_map().cast("map<int,bigint>")).alias("boxes"))
    key = hash_order(F.lit(seed).cast("string"), F.lit(held), F.col("group_id").cast("string"))
    return materialize(with_index(g.withColumn("_k", key), [F.col("_k"), F.col("group_id")], "pos").drop("_k"), "validation-groups")


@dataclass
class _Queue:
    """A class's candidates in hash order, fetched page by page; the cursor never goes back."""

    groups: DataFrame
    cls: int
    cursor: int = -1
    page: list = field(default_factory=list)

    def next(self, shares: Shares, chosen: dict):
        while True:
            while self.page:
                r = self.page.pop(0)
                self.cursor = r.pos
                if r.pos not in chosen and shares.of(r.main, r.train[r.main], r.val[r.main]) <= shares.bound:
                    return r
            ok = F.col("ok") & (F.col("pos") > self.cursor) & (F.coalesce(F.try_element_at("boxes", F.lit(self.cls)), F.lit(0)) > 0) & shares.fits()
            self.page = self.groups.where(ok).orderBy("pos").limit(PAGE).collect()
            if not self.page:
                return None


def class_floors(groups: DataFrame, shares: Shares, rules) -> dict:
    """Groups (pos: row) that bring every class to its floors, the shortest class first.

    A class is picked for at most max(least_boxes, least_groups) times, so the picks are as many as the classes allow, not as the groups;
    the driver holds a page of candidates for each class.
    """
    classes = [r.c for r in groups.select(F.explode("boxes").alias("c", "n")).where("n > 0").select("c").distinct().collect()]
    n_boxes, n_groups, chosen = dict.fromkeys(classes, 0), dict.fromkeys(classes, 0), {}
    queues = {c: _Queue(groups, c) for c in classes}
    while True:
        need = {c: min(n_boxes[c] / rules.least_boxes, n_groups[c] / rules.least_groups) for c in queues if n_boxes[c] < rules.least_boxes or n_groups[c] < rules.least_groups}
        if not need:
            return chosen
        c = min(need, key=lambda c: (need[c], c))
        r = queues[c].next(shares, chosen)
        if r is None:
            del queues[c]
            continue
        chosen[r.pos] = r
        shares.take(np.array(r.train), np.array(r.val))
        for k, n in r.boxes.items():
            if k in n_boxes and n > 0:
                n_boxes[k] += n
                n_groups[k] += 1


def fill_dataset(groups: DataFrame, taken: DataFrame, d: int, shares: Shares, fraction: float) -> DataFrame:
    """(pos) of the groups of main dataset d that go to validation until its share reaches the fraction.

    The share along running sums only grows, so a round takes all groups up to the first that would go beyond the bound, passes that
    one over, and goes on behind it with the groups that still fit.
    """
    out, cursor = [], -1
    rest = groups.where(F.col("ok") & (F.col("main") == d)).join(taken, "pos", "left_anti")
    while shares.of(d) < fraction:
        own = lambda c: F.element_at(F.col(c), d + 1)
        fit = rest.where((F.col("pos") > cursor) & shares.fits()).select("pos", "train", "val", own("train").alias("t"), own("val").alias("v"))
        run = materialize(running(fit, [], [F.col("pos")], {"st": ("sum", F.col("t")), "sv": ("sum", F.col("v"))}), "validation-run")
        v = F.col("sv") + int(shares.n_val[d])
        share = v / F.greatest(F.lit(1), F.lit(int(shares.n_train[d])) - F.col("st") + v)
        ends = run.agg(F.min(F.when(share >= fraction, F.col("pos"))).alias("stop"), F.min(F.when(share > shares.bound, F.col("pos"))).alias("no")).first()
        last = ends.no is not None and (ends.stop is None or ends.no <= ends.stop)
        mine = run.where(F.col("pos") < ends.no) if last else run if ends.stop is None else run.where(F.col("pos") <= ends.stop)
        out.append(mine.select("pos"))
        sums = {r.d: r for r in mine.select(F.posexplode(F.arrays_zip("train", "val")).alias("d", "x")).groupBy("d").agg(F.sum("x.train").alias("t"), F.sum("x.val").alias("v")).collect()}  # a row for each dataset
        get = lambda c: np.array([sums[i][c] if i in sums else 0 for i in range(len(shares.datasets))])
        shares.take(get("t"), get("v"))
        if not last:
            break
        cursor = ends.no
    empty = groups.limit(0).select("pos")
    for x in out:
        empty = empty.union(x)
    return empty


def picked_in_rounds(summary: DataFrame, held: str, rules) -> DataFrame:
    """(held, group_id, to_val) of one fold, as pick_validation() gives it: class floors first, then datasets up to the fraction."""
    spark = summary.sparkSession
    datasets = sorted(r.dataset for r in summary.select("dataset").distinct().collect())  # a row for each dataset
    totals = {r.dataset: r.n for r in summary.groupBy("dataset").agg(F.sum("n_train").alias("n")).collect()}
    groups = groups_of(summary, held, datasets, rules.seed)
    shares = Shares(datasets, np.array([totals[d] for d in datasets]), np.zeros(len(datasets), np.int64), rules.most_share * rules.val_fraction)
    chosen = class_floors(groups, shares, rules)
    taken = spark.createDataFrame([(p,) for p in chosen], "pos long")
    mains = sorted(r.main for r in groups.where("ok").select("main").distinct().collect())
    for d in mains:
        taken = materialize(taken.union(fill_dataset(groups, taken, d, shares, rules.val_fraction)), "validation-taken")
    to_val = taken.withColumn("to_val", F.lit(True))
    return groups.join(to_val, "pos", "left").select(F.lit(held).alias("held"), "group_id", F.coalesce("to_val", F.lit(False)).alias("to_val"))
