"""Preference pairs: what two conversations share at their start is the prompt, the rest of each is a completion with a loss mask.

Only Column expressions run here.  A conversation is one value of the result, so its turns are brought together; its size is that of
one conversation, never that of a group of conversations.

Turns stand by turn number, then role and text.  Two turns are equal if role and text are (null equals null).  A turn is rendered as
``<|im_start|>role``, a line break, its text, ``<|im_end|>`` and a line break.  The mask lists the characters of a completion to be learned as
start:end spans: text and end mark of the assistant's turns.

Edge cases: null roles and texts are rendered empty; a conversation without its partner shares nothing, its whole text is the completion and the other
side is null; equal conversations have two empty completions; rows that repeat are turns that repeat; rows without a conversation
id are left out; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import let, placed_parts, upto


def conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id and its turns in order."""
    one = F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    return turns.filter(F.col(conv).isNotNull()).groupBy(F.col(conv).alias("conv_id")).agg(F.sort_array(F.collect_list(one)).alias("turns"))


def common_turns(a: Column, b: Column) -> Column:
    """Number of turns that two conversations share from their start on."""
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]))
    return let(same, lambda s: F.when(F.array_position(s, F.lit(False)) > 0, F.array_position(s, F.lit(False)) - 1).otherwise(F.size(s))).cast("int")


def _head(turn: Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), F.coalesce(turn["role"], F.lit("")), F.lit("\n"))


def _body(turn: Column) -> Column:
    return F.concat(F.coalesce(turn["text"], F.lit("")), F.lit("<|im_end|>"))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t), F.lit("\n"))), "")


def mask(turns: Column) -> Column:
    """start:end of the assistant's parts of the rendered turns."""
    def spans(held: Column) -> Column:
        starts = placed_parts(F.transform(held, lambda t: F.concat(_head(t), _body(t), F.lit("\n"))))
        return let(starts, lambda at: F.array_join(F.transform(
            F.filter(upto(F.size(held)), lambda i: F.coalesce(held[i]["role"] == "assistant", F.lit(False))),
            lambda i: F.concat_ws(":", (at[i] + F.length(_head(held[i]))).cast("string"), (at[i] + F.length(_head(held[i])) + F.length(_body(held[i]))).cast("string"))), ","))
    return let(turns, spans)


def preference_pairs(turns: DataFrame, pairs: DataFrame | None = None, **names: str) -> DataFrame:
    """pair_id, chosen_id, rejected_id, n_common, prompt, chosen, chosen_mask, rejected, rejected_mask.

    ``pairs`` has pair_id, chosen_id and rejected_id; without it an even conversation id is chosen over the next one.
    """
    talks = conversations(turns, **names)
    if pairs is None:
        side = talks.select(F.shiftright(F.col("conv_id").cast("long"), 1).alias("pair_id"), (F.col("conv_id").cast("long").bitwiseAND(1) == 0).alias("first"), "conv_id", "turns")
    else:
        sides = pairs.select("pair_id", F.explode(F.array(F.struct(F.lit(True).alias("first"), F.col("chosen_id").alias("conv_id")),
                                                          F.struct(F.lit(False).alias("first"), F.col("rejected_id").alias("conv_id")))).alias("s"))
        side = sides.select("pair_id", "s.first", "s.conv_id").join(talks, "conv_id")
    pick = lambda first, c: F.max(F.when(F.col("first") == first, F.col(c)))
    both = side.groupBy("pair_id").agg(pick(True, "conv_id").alias("chosen_id"), pick(False, "conv_id").alias("rejected_id"),
                                       pick(True, "turns").alias("a"), pick(False, "turns").alias("b"))
    n = F.coalesce(common_turns(F.col("a"), F.col("b")), F.lit(0))
    rest = lambda c: F.slice(c, F.col("n_common") + 1, F.size(c))
    prompt = F.when(F.col("n_common") > 0, rendered(F.slice("a", F.lit(1), F.col("n_common")))).otherwise(F.lit(""))
    return both.withColumn("n_common", n).select(
        "pair_id", "chosen_id", "rejected_id", "n_common", prompt.alias("prompt"), *(
            F.when(F.col(c).isNotNull(), value).alias(name) for c, side_name in (("a", "chosen"), ("b", "rejected"))
            for name, value in ((side_name, rendered(rest(F.col(c)))), (f"{side_name}_mask", mask(rest(F.col(c)))))))
