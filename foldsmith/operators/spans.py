"""Token spans of class names in captions [F10], for the masks of P17."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def class_token_spans(captions: DataFrame, offsets: DataFrame) -> DataFrame:
    """(caption_id, class_id, class, start, end, problem): the tokens [start, end) that the first place of each class in its caption touches.

    captions: caption_id, caption, classes (array; class_id is the place in it). offsets: caption_id, token, start, end in characters,
    in order; (0, 0) marks special tokens, which no class has. Tokens meet the places of their caption's classes and are counted
    into their least and greatest as they come, so a caption may have any number of them; they are shuffled once, by caption, or not
    at all if they come so. problem, else null: not_in_caption, no_token, or overlap (with a class that begins earlier, or at the same
    token with a smaller id); the first two have no span. Null captions and classes are not_in_caption.
    """
    each = captions.select("caption_id", "caption", F.posexplode("classes").alias("class_id", "class"))
    found = F.coalesce(F.position(F.col("class"), F.col("caption")) - 1, F.lit(-1))
    each = each.select("caption_id", "class_id", "class", found.alias("at")).withColumn("stop", F.col("at") + F.length("class"))
    real = offsets.where("NOT (start = 0 AND end = 0)").select(F.col("caption_id").alias("_id"), "token", F.col("start").alias("_start"), F.col("end").alias("_end"))
    touched = (F.col("caption_id") == F.col("_id")) & (F.col("at") >= 0) & (F.col("_start") < F.col("stop")) & (F.col("_end") > F.col("at"))
    # A merge join, as the tokens are many and come in the order of their captions from a window.
    spans = each.join(real.hint("merge"), touched, "left").groupBy("caption_id", "class_id", "class", "at").agg(F.min("token").alias("start"), (F.max("token") + 1).alias("end"))
    # A caption's classes come from one row.
    before = Window.partitionBy("caption_id").orderBy("start", "class_id").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("clash", F.coalesce(F.max("end").over(before), F.lit(0)) > F.col("start"))
    problem = F.when(F.col("at") < 0, "not_in_caption").when(F.col("start").isNull(), "no_token").when(F.col("clash"), "overlap")
    return spans.select("caption_id", "class_id", "class", "start", "end", problem.alias("problem"))


def refuse_span_problems(spans: DataFrame) -> DataFrame:
    """The spans as one map (caption_id, spans: class id to start and end); raises if any class has a problem."""
    bad = spans.where("problem IS NOT NULL").orderBy("caption_id", "class_id").first()
    if bad is not None:
        raise ValueError(f"caption {bad.caption_id}, class {bad.class_id} {bad['class']!r}: {bad.problem}")
    return spans.groupBy("caption_id").agg(F.map_from_entries(F.collect_list(F.struct("class_id", F.struct("start", "end")))).alias("spans"))
