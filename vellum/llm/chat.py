"""Preference pairs: the longest common turn prefix is rendered once, and both completions carry loss masks.

A turn is rendered as <|role|>, a line end, its text, <|end|> and a line end. In a completion only the texts of
assistant turns, with their <|end|>, bear loss; `mask` lists those spans as [start, end) in code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "<|end|>"
REPLY = "assistant"


def head(role: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"))


def pairs(turns: DataFrame) -> DataFrame:
    """One row (pair_id, prompt, chosen, rejected, chosen_mask, rejected_mask, prompt_turns, has_preference) for each pair of turns.

    A pair whose sides are equal is all prompt, with empty completions; has_preference is false for it, and training leaves it out.

    turns(pair_id, side 'chosen' or 'rejected', turn, role, text) may come in any order; a null role or text is empty.
    Turns are numbered anew by (turn, role, text), so gaps don't matter, and a repeated row is a repeated turn. A turn is
    common if both sides have the same role and text there and in all turns before. A side without further turns has an
    empty completion; a side that is missing has an empty prefix. Null pair ids form one pair. Turns with another side
    are ignored, an empty table gives no rows and other columns aren't read. A very long text is rendered whole; a pair's turns
    make one row, as the pair that is returned does.
    """
    clean = turns.filter(F.col("side").isin("chosen", "rejected")).select("pair_id", "side", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    side = lambda s: F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct("turn", "role", "text"))))
    both = clean.groupBy("pair_id").agg(side("chosen").alias("a"), side("rejected").alias("b"))
    differ = F.expr("filter(sequence(0, greatest(size(a), size(b))), i -> i >= least(size(a), size(b)) or not (get(a, i).role <=> get(b, i).role and get(a, i).text <=> get(b, i).text))")
    cut = both.withColumn("prompt_turns", F.array_min(differ))
    full = lambda t: F.concat(head(t["role"]), t["text"], F.lit(END + "\n"))
    rest = lambda c: F.expr(f"slice({c}, prompt_turns + 1, size({c}))")
    text = lambda c: F.array_join(F.transform(c, full), "")
    return cut.select(
        "pair_id",
        text(F.expr("slice(a, 1, prompt_turns)")).alias("prompt"),
        text(rest("a")).alias("chosen"),
        text(rest("b")).alias("rejected"),
        mask(rest("a")).alias("chosen_mask"),
        mask(rest("b")).alias("rejected_mask"),
        F.col("prompt_turns").cast("long").alias("prompt_turns"),
        (F.col("prompt_turns") < F.greatest(F.size("a"), F.size("b"))).alias("has_preference"),
    )


def mask(turns: Column) -> Column:
    """Spans that bear loss, as an array of (start, end), by one fold over the turns."""
    span = "array<struct<start:long,end:long>>"
    step = lambda acc, t: F.struct(
        (acc["at"] + F.length(head(t["role"])) + F.length(t["text"]) + len(END) + 1).cast("long").alias("at"),
        F.when(
            t["role"] == REPLY,
            F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.length(head(t["role"]))).cast("long").alias("start"), (acc["at"] + F.length(head(t["role"])) + F.length(t["text"]) + len(END)).cast("long").alias("end")))),
        ).otherwise(acc["spans"]).cast(span).alias("spans"),
    )
    return F.aggregate(turns, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(span).alias("spans")), step, lambda acc: acc["spans"])


def own_replies(conversations: DataFrame) -> DataFrame:
    """Turns of preference pairs that a plain table conversations(conv_id, turn, role, text) yields.

    Chosen is each conversation as it is; rejected is the same with its last assistant turn answered off the point, by
    the assistant turn before it or, where there is none, by an echo of the turn before it (else by nothing). Of turns with
    one number the one whose text comes last counts. Without an assistant turn, or where the echo equals the reply, both sides
    are equal. A null text is empty, a null role no assistant's; repeated rows are repeated turns; null ids are one conversation;
    an empty table gives no rows, and other columns aren't read.
    """
    base = conversations.select("conv_id", "turn", "role", "text")
    last = base.filter(F.col("role") == REPLY).groupBy("conv_id").agg(F.max("turn").alias("last"))
    known = base.alias("c").join(last.alias("l"), F.col("c.conv_id").eqNullSafe(F.col("l.conv_id")), "left").select("c.*", "l.last")
    before = F.col("turn") < F.col("last")
    latest = known.groupBy("conv_id").agg(
        F.max(F.when(before & (F.col("role") == REPLY), F.struct("turn", "text"))).alias("reply"), F.max(F.when(before, F.struct("turn", "text"))).alias("echo")
    )
    other = latest.select("conv_id", F.coalesce("reply.text", "echo.text", F.lit("")).alias("other"))
    poorer = known.alias("c").join(other.alias("o"), F.col("c.conv_id").eqNullSafe(F.col("o.conv_id"))).select(
        F.col("c.conv_id").alias("pair_id"), F.lit("rejected").alias("side"), "c.turn", "c.role",
        F.when((F.col("c.turn") == F.col("c.last")) & (F.col("c.role") == REPLY), F.col("o.other")).otherwise(F.col("c.text")).alias("text"),
    )
    return base.select(F.col("conv_id").alias("pair_id"), F.lit("chosen").alias("side"), "turn", "role", "text").unionByName(poorer)


def digest(formatted: DataFrame) -> DataFrame:
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",")
    return formatted.select(F.col("pair_id").alias("conv_id"), "prompt", "chosen", "rejected", spans("chosen_mask").alias("chosen_mask"), spans("rejected_mask").alias("rejected_mask"), "prompt_turns", "has_preference")
