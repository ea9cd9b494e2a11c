"""Multi-party perspective rotation of dialogues, in DataFrame expressions only.

For every participant of a dialogue the whole dialogue is rendered once more with that
speaker as ``assistant`` and all others as ``user`` with their name; ``system`` messages
stay. The result has one row for each message and perspective, with the message's
segment, its place in the rendered dialogue and the part of it that a loss may see, so
no dialogue is ever gathered into one value.

Places are prefix sums. Turns are dealt in blocks of ``BLOCK`` turn numbers: sums of
whole blocks are found on lean, pre-aggregated rows, and the texts are shuffled once, by
dialogue and block. A dialogue with a third of all rows thus spreads over many tasks.

Nulls: a null text is empty; a null or empty speaker is named ``unknown``; a null turn
stands after all others; rows with a null dialogue id form one dialogue. Equal turns are
ordered by speaker, then text; repeated rows all stay. A dialogue of system messages
alone has no perspective and gives no row. Other columns are not read. An empty table
gives an empty result. Control markers inside a text are defused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 256
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
SYSTEM = "system"
UNKNOWN = "unknown"


def defused(text: Column) -> Column:
    return F.replace(text, F.lit("<|im_"), F.lit("<|_im_"))


def head(role: Column, name: Column) -> Column:
    """The opening of a segment; only users carry a name."""
    return F.concat(F.lit(OPEN), role, F.when(role == "user", F.concat(F.lit(" name="), name)).otherwise(""), F.lit("\n"))


def role_in(speaker: Column, perspective: Column) -> Column:
    return F.when(speaker == SYSTEM, SYSTEM).when(speaker == perspective, "assistant").otherwise("user")


def rotated(
    messages: DataFrame, dialogue: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text"
) -> DataFrame:
    """``conv_id, perspective, turn, chat_role, name, segment, seg_start, seg_end, mask_start, mask_end``.

    Places are in code points of the rendered dialogue, ends exclusive; the mask covers an
    assistant's words and their closing marker and is null elsewhere.
    """
    rows = messages.select(
        F.col(dialogue).alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.nullif(F.col(speaker), F.lit("")), F.lit(UNKNOWN)).alias("speaker"),
        defused(F.coalesce(F.col(text), F.lit(""))).alias("content"),
    ).withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(2**62)).cast("long"))

    lean = rows.groupBy("conv_id", "block", "speaker").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("chars")
    )
    people = (
        lean.where(F.col("speaker") != SYSTEM)
        .select(F.col("conv_id").alias("of"), F.col("speaker").alias("perspective"))
        .distinct()
    )
    role = role_in(F.col("speaker"), F.col("perspective"))
    around = F.length(head(role, F.col("speaker"))) + F.lit(len(CLOSE) + 1)
    sums = (
        lean.join(people, F.col("conv_id").eqNullSafe(F.col("of")))
        .groupBy("conv_id", "perspective", "block")
        .agg(F.sum(F.col("chars") + F.col("n") * around).alias("size"))
    )
    before = Window.partitionBy("conv_id", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        F.col("conv_id").alias("of"), F.col("block").alias("of_block"), "perspective",
        F.coalesce(F.sum("size").over(before), F.lit(0)).alias("block_start"),
    )
    each = rows.join(starts, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("block") == F.col("of_block")))
    opening = head(role, F.col("speaker"))
    shown = each.select(
        "conv_id", "block", "perspective", "turn", "speaker", "content", "block_start",
        role.alias("chat_role"), opening.alias("opening"),
        (F.length(opening) + F.length("content") + F.lit(len(CLOSE) + 1)).cast("long").alias("size"),
    )
    inside = (
        Window.partitionBy("conv_id", "block", "perspective")
        .orderBy(F.col("turn").asc_nulls_last(), "speaker", "content")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    start = F.col("block_start") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    placed = shown.withColumn("seg_start", start)
    is_own = F.col("chat_role") == "assistant"
    return placed.select(
        "conv_id", "perspective", "turn", "chat_role",
        F.when(F.col("chat_role") == "user", F.col("speaker")).alias("name"),
        F.concat("opening", "content", F.lit(CLOSE + "\n")).alias("segment"),
        "seg_start", (F.col("seg_start") + F.col("size")).alias("seg_end"),
        F.when(is_own, F.col("seg_start") + F.length("opening")).alias("mask_start"),
        F.when(is_own, F.col("seg_start") + F.col("size") - 1).alias("mask_end"),
    )
