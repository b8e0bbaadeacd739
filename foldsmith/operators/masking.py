"""Annotation masks over caption tokens and the masked focal loss [P17, F11, S18]."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldsmith.functions.vectors import sigmoid


def token_mask(classes: Column, spans: Column, length: int) -> Column:
    """Array of `length` booleans, true at the tokens of annotated classes.

    spans: map of class id to struct(start, end); a span that ends beyond `length` counts for nothing.
    """
    known = F.filter(F.transform(classes, lambda c: F.try_element_at(spans, c)), lambda s: s.isNotNull() & (s["end"] <= length))
    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda t: F.exists(known, lambda s: (t >= s["start"]) & (t < s["end"])))


def focal_terms(logits: Column, targets: Column, mask: Column, alpha: float = 0.25, gamma: float = 2.0) -> Column:
    """sum of the focal loss over the masked-in tokens of one query; alpha below 0 means no class weight."""

    def term(z: Column) -> Column:
        x, y = z["logits"].cast("double"), z["targets"].cast("double")
        cross = F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))
        p = sigmoid(x)
        loss = cross * F.pow(1 - (p * y + (1 - p) * (1 - y)), F.lit(gamma))
        return F.when(z["mask"], loss * (alpha * y + (1 - alpha) * (1 - y)) if alpha >= 0 else loss).otherwise(0.0)

    rows = F.arrays_zip(logits.alias("logits"), targets.alias("targets"), mask.alias("mask"))
    return F.aggregate(rows, F.lit(0.0), lambda s, z: s + term(z))


def focal_loss(queries: DataFrame, by: list[str], positives: str, alpha: float = 0.25, gamma: float = 2.0) -> DataFrame:
    """(by, loss) of queries (logits, targets, mask arrays): the sum over a batch by its matched queries, 1 at least."""
    total = F.sum(focal_terms(F.col("logits"), F.col("targets"), F.col("mask"), alpha, gamma))
    return queries.groupBy(*by).agg((total / F.greatest(F.sum(positives), F.lit(1))).alias("loss"))


def prompts(spark: SparkSession, strategies: dict[str, dict[str, str]], name: str, classes: list[str]) -> DataFrame:
    """(class, prompt) of a strategy; raises if it is unknown or lacks a class."""
    if name not in strategies:
        raise ValueError(f"unknown strategy {name}, known: {sorted(strategies)}")
    lost = sorted(set(classes) - set(strategies[name]))
    if lost:
        raise ValueError(f"strategy {name} lacks {', '.join(lost)}")
    return spark.createDataFrame([(c, strategies[name][c]) for c in classes], "class string, prompt string")
