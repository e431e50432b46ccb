"""Chat formatting by multi-party perspective rotation.

For every participant of a conversation the dialogue is rendered with that
speaker as the assistant and all others as named users. Turns of ``system``
belong to every perspective and are nobody's own. The result is in segments,
one row per conversation, perspective and turn: the segment's text, its place
in the rendered dialogue, and the part of it that the loss mask covers (own
turns behind their header, closing mark included). A rendered dialogue is the
concatenation of a perspective's segments by ``position``.

Segments keep a long conversation's work apart. A segment's place is a running
sum of lengths, taken in two levels: inside blocks of ``BLOCK`` turn numbers, and
over the blocks' totals. Turns meet the participants of their conversation in
an equi-join whose turn side Spark can split; no dialogue meets in one row. The
result has participants x turns rows for each conversation, as asked for.

Null text is empty, a null role is the speaker ``unknown``, null conversation ids
are one conversation, null turns come first. Equal turn numbers stand in the
order of speaker and text; repeated rows are turns of their own. A conversation
of system turns only has no participant and no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillpoint.llm.scratch import stored

SYSTEM = "system"
BLOCK = 256
# The marks around a turn.
OPEN, HEADER_END, CLOSE = "<|", "|>\n", "\n<|end|>\n"


def header(speaker: Column) -> Column:
    return F.concat(F.lit(OPEN), speaker, F.lit(HEADER_END))


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text", system: str = SYSTEM) -> DataFrame:
    """``conv_id, perspective, position, turn, speaker, segment, start, length, mask_start, mask_length``;
    ``speaker`` is ``assistant``, ``system`` or ``user:<name>``, places are code points."""
    plain = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("unknown")).alias("name"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    parties = plain.where(F.col("name") != system).groupBy(F.col("conv_id").alias("_conv"), F.col("name").alias("perspective")).agg(
        F.count(F.lit(1)).alias("own_turns"))
    speaker = (F.when(F.col("name") == system, F.lit(system)).when(F.col("name") == F.col("perspective"), F.lit("assistant"))
                .otherwise(F.concat(F.lit("user:"), F.col("name"))))
    rendered = (plain.join(parties, F.col("conv_id").eqNullSafe(F.col("_conv"))).withColumn("speaker", speaker)
                     .withColumn("segment", F.concat(header(F.col("speaker")), F.col("text"), F.lit(CLOSE)))
                     .withColumn("length", F.length("segment").cast("long"))
                     .withColumn("_block", F.floor(F.col("turn") / BLOCK))
                     .withColumn("_head", F.length(header(F.col("speaker"))).cast("long")))
    key = ["conv_id", "perspective", "_block"]
    inside = Window.partitionBy(*key).orderBy("turn", "name", "text")
    placed = stored(rendered.withColumn("_n", F.row_number().over(inside) - 1)
                            .withColumn("_at", F.coalesce(F.sum("length").over(
                                inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
                            .drop("_conv", "text", "own_turns"), "chat-segments")
    blocks = placed.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("chars"))
    before = Window.partitionBy("conv_id", "perspective").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select(
        *(F.col(k).alias(f"b{k}") for k in key), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("b_n"),
        F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("b_at"))
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"b{k}"))
    start = F.col("b_at") + F.col("_at")
    own = F.col("speaker") == "assistant"
    return placed.join(starts, same).select(
        "conv_id", "perspective", (F.col("b_n") + F.col("_n")).cast("long").alias("position"), "turn", "speaker", "segment",
        start.alias("start"), "length", F.when(own, start + F.col("_head")).alias("mask_start"),
        F.when(own, F.col("length") - F.col("_head")).otherwise(0).alias("mask_length"))
