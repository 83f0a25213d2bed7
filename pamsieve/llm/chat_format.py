"""Operator 10, chat formatting: multi-party perspective rotation, DataFrame and SQL functions only.

For every participant of a conversation the dialogue is rendered with that speaker as the assistant, the others as
named users, and system turns as they are; the mask covers what the assistant says and its end marker.

Turns are gathered by conversation, the only shuffle of texts, and a dialogue is then rendered inside its row, once for
each of its participants: a task holds one dialogue and one rendering.  ``block_turns`` bounds that where dialogues
outgrow a task: then they are gathered and rendered by stretches of so many turn numbers.

Marks inside texts and names can't forge turns: ``<|`` becomes ``<\\|``, and each backslash before a ``|`` one more, so
that taking one away again gives the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
SYSTEM, NOBODY = "system", "unknown"


def escaped(text: Column) -> Column:
    """A text in which nothing reads as a control mark."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def _header(speaker: Column, assistant: Column) -> Column:
    name = escaped(F.translate(speaker, "\n\r", "  "))
    role = F.when(speaker == SYSTEM, F.lit(SYSTEM)).when(speaker == assistant, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), name))
    return F.concat(F.lit(START), role, F.lit("\n"))


def _spans(segments: Column) -> Column:
    """[start, end) in code points of each trained body, over the concatenated segments."""
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, s: Column) -> Column:
        body = acc["at"] + F.char_length(s["head"])
        end = body + F.char_length(s["body"])
        span = F.struct(body.alias("start"), end.alias("end"))
        return F.struct((end + 1).alias("at"), F.when(s["train"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(segments, begin, step, lambda acc: acc["spans"])


def rotate_perspectives(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text", block_turns: int | None = None
) -> DataFrame:
    """(``conv_col``, perspective, block, n_turns, rendered, mask) for every participant of each conversation.

    ``mask`` lists the [start, end) code points of ``rendered`` to train on.  Dialogues are whole, in block 0; with
    ``block_turns`` blocks are numbered by turn number divided by it, and one without turns of the participant has an
    empty mask.

    Defined cases: turns are ordered by number, then speaker, then text, nulls first and in block -1 of blocks; equal
    rows are turns of their own; a null speaker is named "unknown"; a null text is empty; a row without a conversation id
    is a conversation of its own; a conversation of system turns only has no participants and no result; an empty table
    gives an empty result; other columns are ignored.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv"),
        F.when(F.col(conv_col).isNull(), F.monotonically_increasing_id()).alias("own"),
        F.coalesce(F.col(turn_col).cast("long"), F.lit(-(1 << 63))).alias("turn"),
        F.coalesce(F.col(speaker_col).cast("string"), F.lit(NOBODY)).alias("speaker"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    first = F.when(F.col("turn") == -(1 << 63), -1).otherwise(F.floor(F.col("turn") / (block_turns or 1)))
    block = (first if block_turns else F.lit(0)).cast("long").alias("block")
    blocks = rows.groupBy("conv", "own", block).agg(F.array_sort(F.collect_list(F.struct("turn", "speaker", "text"))).alias("said"))
    names = lambda x: F.array_sort(F.filter(F.array_distinct(x), lambda s: s != SYSTEM))
    if block_turns:
        people = rows.groupBy(F.col("conv").alias("c"), F.col("own").alias("o")).agg(names(F.collect_set("speaker")).alias("people"))
        blocks = blocks.join(people, F.col("conv").eqNullSafe(F.col("c")) & F.col("own").eqNullSafe(F.col("o")))
    else:
        blocks = blocks.withColumn("people", names(F.transform("said", lambda t: t["speaker"])))
    each = blocks.select("conv", "block", "said", F.explode("people").alias("perspective"))
    me = F.col("perspective")
    segments = F.transform(
        "said",
        lambda t: F.struct(_header(t["speaker"], me).alias("head"), F.concat(escaped(t["text"]), F.lit(END)).alias("body"), ((t["speaker"] == me) & (t["speaker"] != SYSTEM)).alias("train")),
    )
    each = each.select("conv", "perspective", "block", segments.alias("segments"))
    rendered = F.array_join(F.transform("segments", lambda s: F.concat(s["head"], s["body"], F.lit("\n"))), "")
    return each.select(
        F.col("conv").alias(conv_col), "perspective", "block", F.size("segments").cast("long").alias("n_turns"), rendered.alias("rendered"), _spans(F.col("segments")).alias("mask")
    )
