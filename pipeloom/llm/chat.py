"""Preference formatting of chat conversations (operator 9).

A preference pair is a chosen and a rejected conversation.  Their longest common
prefix of turns (same role and text) is rendered once, as the prompt; what follows
in each is its completion, with a mask of the spans that training learns from: the
text and closing mark of the assistant's turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How a turn is rendered.
OPEN, AFTER_ROLE, CLOSE = "<|", "|>\n", "<|end|>\n"
LEARNED_ROLE = "assistant"


def rendered(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(AFTER_ROLE), turn["text"], F.lit(CLOSE))


def text_of(turns: Column) -> Column:
    return F.array_join(F.transform(turns, rendered), "")


def mask_of(turns: Column) -> Column:
    """Array of (start, stop) in characters of the rendered turns."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,stop:bigint>>").alias("spans"))

    def step(state: Column, turn: Column) -> Column:
        start = state["at"] + F.length(turn["role"]) + len(OPEN) + len(AFTER_ROLE)
        stop = start + F.length(turn["text"]) + len(CLOSE)
        span = F.array(F.struct(start.cast("long").alias("start"), stop.cast("long").alias("stop")))
        spans = F.when(turn["role"] == LEARNED_ROLE, F.concat(state["spans"], span)).otherwise(state["spans"])
        return F.struct(stop.cast("long").alias("at"), spans.alias("spans"))

    return F.aggregate(turns, zero, step, lambda s: s["spans"])


def preference_pairs(turns: DataFrame, pairs: DataFrame | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per pair: pair_id, chosen_id, rejected_id, prompt_turns, prompt, chosen, chosen_mask, rejected, rejected_mask.

    ``pairs`` has (pair_id, chosen_id, rejected_id); without it conversations 2k and
    2k + 1 are a pair, k its id and the even one chosen.  Turns are ordered by turn
    number (null first), then role and text; repeated rows are repeated turns.  A
    null role is ``unknown``, null text empty.  Rows without a conversation id
    belong to no pair.  Of a conversation without turns the completion and mask
    are null and the prompt is empty.  Other columns are not read; an empty table
    gives no rows (with ``pairs``, rows without text).
    """
    own = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("unknown")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text")
    )
    if pairs is None:
        sided = own.withColumns({"pair_id": F.floor(F.col("conv") / 2).cast("long"), "side": F.pmod("conv", F.lit(2)).cast("int")})
    else:
        sides = F.explode(F.array(*(F.struct(F.col(c).cast("long").alias("conv"), F.lit(k).alias("side")) for k, c in enumerate(("chosen_id", "rejected_id")))))
        wanted = pairs.select("pair_id", sides.alias("x")).select("pair_id", "x.*")
        sided = wanted.join(own, "conv", "left")
    each = F.struct("side", "turn", "role", "text", "conv")
    grouped = sided.groupBy("pair_id").agg(F.sort_array(F.collect_list(each)).alias("all"))  # one pair's turns

    def side(k: int) -> Column:
        return F.transform(F.filter("all", lambda t: (t["side"] == k) & t["role"].isNotNull()), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))

    def conv(k: int) -> Column:
        return F.get(F.filter("all", lambda t: t["side"] == k), F.lit(0))["conv"]

    both = grouped.select("pair_id", conv(0).alias("chosen_id"), conv(1).alias("rejected_id"), side(0).alias("a"), side(1).alias("b"))
    equal = F.zip_with("a", "b", lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    shared = F.coalesce(F.array_position(equal, F.lit(False)), F.lit(0))
    counted = both.withColumn("prompt_turns", F.when(shared == 0, F.size("a")).otherwise(shared - 1).cast("int"))

    def rest(name: str) -> Column:
        return F.slice(name, F.col("prompt_turns") + 1, F.greatest(F.size(name) - F.col("prompt_turns"), F.lit(0)))

    def present(name: str, value: Column) -> Column:
        return F.when(F.size(name) > 0, value)

    split = counted.withColumns({"p": F.slice("a", F.lit(1), F.col("prompt_turns")), "x": rest("a"), "y": rest("b")})
    return split.select(
        "pair_id", "chosen_id", "rejected_id", "prompt_turns", text_of(F.col("p")).alias("prompt"),
        present("a", text_of(F.col("x"))).alias("chosen"), present("a", mask_of(F.col("x"))).alias("chosen_mask"),
        present("b", text_of(F.col("y"))).alias("rejected"), present("b", mask_of(F.col("y"))).alias("rejected_mask"),
    )


def shown(mask: Column) -> Column:
    """A mask as text: start-stop,start-stop."""
    return F.array_join(F.transform(mask, lambda s: F.concat_ws("-", s["start"].cast("string"), s["stop"].cast("string"))), ",")
