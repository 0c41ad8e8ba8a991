"""Chat formatting by multi-party perspective rotation (operator 6).

A dialogue is rendered once for every participant: that speaker as the assistant, the others as named
users, system turns as they are.  Each rendered turn is a row with its offset in the rendering and the
stretch that training looks at, so a dialogue of any length stays spread over many tasks; joining a
rendering's segments in order of ``start`` gives its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offermatch.llm.common import KEY, row_key, stored

SYSTEM = "system"
BUCKET_TURNS = 256  # consecutive turns whose offsets one task sums
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def content(text: Column) -> Column:
    """The turn's text; markers inside it are broken up, so that no turn can end itself."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<\|(?=im_(start|end)\|>)", "<\u200b|")


def head(role: Column, own: Column) -> Column:
    """A turn's opening: assistant for the perspective's own turns, a named user for other speakers."""
    name = F.trim(F.regexp_replace(F.coalesce(role, F.lit("")), r"[\s<>|]+", " "))
    user = F.when(name == "", F.lit("user")).otherwise(F.concat(F.lit("user name="), name))
    label = F.when(role == SYSTEM, F.lit(SYSTEM)).when(own, F.lit("assistant")).otherwise(user)
    return F.concat(F.lit(OPEN), label, F.lit("\n"))


def rotated(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
            text: str = "text") -> DataFrame:
    """conv_id, perspective, turn, role, target, start, length, mask_start, mask_end, segment.

    One row for each turn and each participant of its conversation.  ``target`` is true for turns that the
    perspective speaks; their mask covers text and end marker, offsets are code points in the rendering.
    Turns stand in order of ``turn`` (null first), then of a hash of the row.  A null text is empty.  A
    null role is an unnamed user without a perspective; a conversation of system turns and unnamed users
    only has none and gives no rows.  A null conv_id is a conversation of its own.  Repeated rows are
    turns of their own; other columns are ignored; an empty table gives no rows.

    Offsets come from lengths alone, summed in two levels (stretches of turns, turns in a stretch), so a
    conversation with a third of all rows is split.  Texts move once, to their offsets.
    """
    rows = turns.select(F.col(f"`{conv_id}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"),
                        F.col(f"`{role}`").alias("role"), F.col(f"`{text}`").alias("text"))
    numbered = Window.partitionBy(*KEY).orderBy(KEY[0])
    size = F.length(content(F.col("text"))) + len(CLOSE) + 1
    narrow = stored(rows.select(
        "conv_id", "turn", "role", *row_key(rows),
        (F.length(head(F.col("role"), F.lit(False))) + size).cast("long").alias("other"),
        (F.length(head(F.col("role"), F.lit(True))) + size).cast("long").alias("own"),
    ).withColumn("copy", F.row_number().over(numbered)), "turns")
    speakers = stored(narrow.where(F.col("role").isNotNull() & (F.col("role") != SYSTEM)).select(
        F.col("conv_id").alias("c"), F.col("role").alias("perspective")).distinct(), "speakers")
    target = F.coalesce(F.col("role") == F.col("perspective"), F.lit(False))
    seen = narrow.join(speakers, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c").withColumns({
        "target": target, "length": F.when(target, F.col("own")).otherwise(F.col("other")),
        "stretch": F.floor(F.col("turn") / BUCKET_TURNS)})
    keys = ["conv_id", "perspective", "stretch"]
    sums = seen.groupBy(*keys).agg(F.sum("length").alias("stretch_length"))
    earlier = Window.partitionBy("conv_id", "perspective").orderBy(F.col("stretch").asc_nulls_first()).rowsBetween(
        Window.unboundedPreceding, -1)
    bases = sums.select(*[F.col(k).alias(f"{k}_") for k in keys],
                        F.coalesce(F.sum("stretch_length").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy(*keys).orderBy(F.col("turn").asc_nulls_first(), *KEY, "copy").rowsBetween(
        Window.unboundedPreceding, -1)
    placed = seen.withColumn("before", F.coalesce(F.sum("length").over(within), F.lit(0)))
    same = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys]
    offsets = placed.join(bases, same[0] & same[1] & same[2]).select(
        *KEY, "copy", "perspective", "target", (F.col("base") + F.col("before")).alias("start"), "length")
    spoken = rows.select("*", *row_key(rows)).withColumn("copy", F.row_number().over(numbered))
    opening = head(F.col("role"), F.col("target"))
    end = F.col("start") + F.col("length") - 1  # the line break after the end marker is not looked at
    return spoken.join(offsets, [*KEY, "copy"]).select(
        "conv_id", "perspective", "turn", "role", "target", "start", "length",
        F.when(F.col("target"), F.col("start") + F.length(opening)).alias("mask_start"),
        F.when(F.col("target"), end).alias("mask_end"),
        F.concat(opening, content(F.col("text")), F.lit(CLOSE + "\n")).alias("segment"))
