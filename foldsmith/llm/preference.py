"""Preference formatting of chosen and rejected conversations. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def render(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"), turn["text"], F.lit("\n"))


def loss_spans(turns: Column) -> Column:
    """[start, end) offsets in characters of the assistant's texts within the rendered turns."""
    span = "array<struct<start:int,end:int>>"

    def step(acc, t):
        start = acc["at"] + F.length(t["role"]) + 5  # <|role|> and a line end
        end = start + F.length(t["text"])
        own = F.when(t["role"] == "assistant", F.array(F.struct(start.alias("start"), end.alias("end")))).otherwise(F.array().cast(span))
        return F.struct((end + 1).alias("at"), F.concat(acc["spans"], own).alias("spans"))

    return F.aggregate(turns, F.struct(F.lit(0).alias("at"), F.array().cast(span).alias("spans")), step, lambda acc: acc["spans"])


def conversations(turns: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """(conv_id, turns): each conversation's turns in order; a null role is `unknown`, a null text empty, ties by role and text."""
    t = F.struct(F.col("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.where(F.col(conv_id).isNotNull()).groupBy(conv_id).agg(F.sort_array(F.collect_list(t)).alias("turns"))


def format_pairs(pairs: DataFrame, turns: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """One row for each pair (chosen_id, rejected_id) of which both conversations have turns.

    prompt: the longest common prefix of turns (same role and text at the same place), rendered once;
    chosen and rejected: the turns after it; chosen_loss and rejected_loss: the spans of them that a loss counts,
    the assistant's texts. n_common may be 0 (empty prompt) or all turns (empty completions). Turn numbers order
    the turns and need not be equal. Repeated pairs give a row each, repeated turns count as turns. A turn or pair with a null
    id belongs to no conversation and is left out, as are other columns; empty tables give an empty result.
    """
    c = conversations(turns, conv_id)
    both = pairs.join(c.select(F.col(conv_id).alias("chosen_id"), F.col("turns").alias("_c")), "chosen_id")
    both = both.join(c.select(F.col(conv_id).alias("rejected_id"), F.col("turns").alias("_r")), "rejected_id")
    same = F.zip_with("_c", "_r", lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    n = F.when(F.array_contains(same, False), F.array_position(same, False) - 1).otherwise(F.size(same)).cast("int")
    both = both.withColumn("n_common", n)
    rest = {k: F.slice(F.col(col), F.col("n_common") + 1, F.greatest(F.size(col), F.lit(1))) for k, col in (("chosen", "_c"), ("rejected", "_r"))}
    text = lambda turns: F.array_join(F.transform(turns, render), "")
    return both.select(
        "chosen_id", "rejected_id", "n_common", text(F.slice("_c", F.lit(1), F.col("n_common"))).alias("prompt"),
        *(text(t).alias(k) for k, t in rest.items()), *(loss_spans(t).alias(f"{k}_loss") for k, t in rest.items()),
    )


def neighbour_pairs(turns: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """Pairs of the conversations 2k (chosen) and 2k + 1 (rejected) that both have turns; turns with a null id are left out."""
    ids = turns.select(F.col(conv_id).cast("long").alias(conv_id)).where(F.col(conv_id).isNotNull()).distinct()
    even = ids.where(F.pmod(F.col(conv_id), F.lit(2)) == 0).select(F.col(conv_id).alias("chosen_id"), (F.col(conv_id) + 1).alias("rejected_id"))
    return even.join(ids.select(F.col(conv_id).alias("rejected_id")), "rejected_id").select("chosen_id", "rejected_id")
