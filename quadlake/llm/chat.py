"""Chat formatting: every participant's view of a dialogue, with the masks of what that participant says."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined, range_prefix

START, END = "<|im_start|>", "<|im_end|>\n"


def perspectives(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", system: str = "system") -> DataFrame:
    """One row for each turn and perspective: conv_id, perspective, turn, speaker, role, segment, start, length, mask, mask_start, mask_end.

    For each participant of a conversation (each role but `system`) the dialogue is told with that participant as
    `assistant`, all others as `user` with their name; system turns stay. The segments of a (conv_id, perspective), in the
    order of `start` (code points, from 0, without gaps), make up the rendered text; mask is true of the assistant's turns,
    whose text and end mark lie in [mask_start, mask_end) of the rendered text; else both are `start`.
    A dialogue of any length stays spread over tasks: it is rendered turn by turn, never gathered in one row.
    Places come from lengths alone: texts are shuffled once, to meet their places at the end. Only turns that share
    conversation, turn and role are shuffled with their texts before, to order them.
    Turns are ordered by turn (null first), then role, then text; repeated rows are separate turns. Null role is the
    participant `unknown`; null text is empty; null conv_id is one conversation; conversations of system turns alone
    have no perspective and give no rows. Marks inside texts and roles stay as they are: a turn is what lies in its
    offsets. Other columns are ignored. An empty table gives an empty result.
    """
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("unknown")).alias("speaker"), F.coalesce(text, F.lit("")).alias("_text"))
    place = ["conv_id", "turn", "speaker"]
    ties = rows.groupBy(*place).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    if ties.isEmpty():
        rows = rows.withColumn("_tie", F.lit(0).cast("long"))
    else:
        tied = joined(rows, ties, place, "left_semi").withColumn("_one", F.lit(1).cast("long"))
        tied = range_prefix(tied, place, ["_text"], "_one", "_tie").drop("_one")
        rows = joined(rows, ties, place, "left_anti").withColumn("_tie", F.lit(0).cast("long")).unionByName(tied)
    people = rows.where(F.col("speaker") != system).select("conv_id", F.col("speaker").alias("perspective")).distinct()
    light = rows.select(*place, "_tie", F.length("_text").cast("long").alias("length"))
    own = F.col("speaker") == F.col("perspective")
    told_role = F.when(own, "assistant").when(F.col("speaker") == system, "system").otherwise("user")
    head = F.concat(F.lit(START), told_role, F.when(told_role == "user", F.concat(F.lit(" name="), "speaker")).otherwise(""), F.lit("\n"))
    told = joined(light, people, ["conv_id"]).withColumn("length", F.col("length") + F.length(head) + len(END))
    placed = range_prefix(told, ["conv_id", "perspective"], ["turn", "speaker", "_tie"], "length", "start")
    # a struct is never null, and its null fields equal each other
    key = F.struct(*place, "_tie").alias("_key")
    placed = placed.select(key, "perspective", "length", F.col("start").cast("long").alias("start")).hint("merge")
    full = rows.select(key, "_text").join(placed, "_key").select("_key.*", "_text", "perspective", "length", "start")
    mask = F.col("role") == "assistant"
    return full.withColumn("role", told_role).withColumn("_head", head).select(
        "conv_id", "perspective", "turn", "speaker", "role", F.concat("_head", "_text", F.lit(END)).alias("segment"), "start", "length", mask.alias("mask"),
        (F.col("start") + F.when(mask, F.length("_head")).otherwise(0)).cast("long").alias("mask_start"),
        (F.col("start") + F.when(mask, F.col("length") - 1).otherwise(0)).cast("long").alias("mask_end"),
    )
