"""Preference formatting of conversations (operator 3), DataFrame functions only.

A pair names a chosen and a rejected conversation.  The longest common prefix of their turns (equal
role and text, turn by turn) is rendered once as the prompt; what follows in either is its
completion, a list of segments of which only the assistant's are trained on.

Defined results: turns are ordered by number, then role, then text; a turn without number comes first; equal
rows of one conversation count once; NULL role or text counts as empty; turns without conversation are left
out; a pair whose conversation is missing is left out; if one conversation is a prefix of the other, or
both are equal, a completion is empty; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAINED_ROLE = "assistant"


def turn_lists(turns: DataFrame) -> DataFrame:
    """conv_id and its turns in order, as one array of (turn, role, text)."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.filter("conv_id IS NOT NULL").groupBy("conv_id").agg(F.array_distinct(F.sort_array(F.collect_list(turn))).alias("turns"))


def render(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"), turn["text"], F.lit("\n"))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, render), "")


def segments(turns: Column) -> Column:
    return F.transform(turns, lambda t: F.struct(render(t).alias("text"), (t["role"] == TRAINED_ROLE).alias("trained")))


def common_turns(a: Column, b: Column) -> Column:
    """How many turns two lists share from the start."""
    shorter = F.least(F.size(a), F.size(b))
    differs = F.filter(F.sequence(F.lit(0), shorter - 1), lambda i: (a[i]["role"] != b[i]["role"]) | (a[i]["text"] != b[i]["text"]))
    return F.when(shorter == 0, F.lit(0)).otherwise(F.coalesce(F.array_min(differs), shorter))


def formatted(lists: DataFrame) -> DataFrame:
    """pair_id, n_common, prompt, and for both sides the completion and its segments (text, trained), of turn lists a and b."""
    met = lists.select("pair_id", "a", "b", common_turns(F.col("a"), F.col("b")).alias("n_common"))
    after = {side: F.expr(f"slice({side}, n_common + 1, size({side}))") for side in "ab"}
    return met.select(
        "pair_id", F.col("n_common").cast("long").alias("n_common"), rendered(F.expr("slice(a, 1, n_common)")).alias("prompt"),
        rendered(after["a"]).alias("chosen"), rendered(after["b"]).alias("rejected"),
        segments(after["a"]).alias("chosen_segments"), segments(after["b"]).alias("rejected_segments"))


def preference_rows(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """:func:`formatted` rows of pairs of conversations: ``pairs`` has pair_id, chosen_id, rejected_id."""
    lists = turn_lists(turns)
    chosen = lists.select(F.col("conv_id").alias("chosen_id"), F.col("turns").alias("a"))
    rejected = lists.select(F.col("conv_id").alias("rejected_id"), F.col("turns").alias("b"))
    return formatted(pairs.select("pair_id", "chosen_id", "rejected_id").join(chosen, "chosen_id").join(rejected, "rejected_id"))


def swapped_reply_rows(turns: DataFrame) -> DataFrame:
    """:func:`formatted` rows of every conversation (pair_id: its id) against itself with another last reply.

    The rejected side has the turns before the last and then the last turn of the conversation with the next id; if there is
    none, nothing follows.  So the common prefix is all but the last turn, or all of them where both replies are equal.
    """
    lists = turn_lists(turns)
    other = lists.select((F.col("conv_id") - 1).alias("_before"), F.slice("turns", -1, 1).alias("_reply"))
    met = lists.join(other, F.col("conv_id") == F.col("_before"), "left")
    none = F.slice("turns", 1, F.lit(0))
    return formatted(met.select(F.col("conv_id").alias("pair_id"), F.col("turns").alias("a"), F.concat(F.expr("slice(turns, 1, size(turns) - 1)"), F.coalesce("_reply", none)).alias("b")))


def neighbour_pairs(turns: DataFrame) -> DataFrame:
    """Conversations 2i (chosen) and 2i + 1 (rejected) as pair i."""
    ids = turns.select("conv_id").filter("conv_id % 2 = 0").distinct()
    return ids.select((F.col("conv_id") / 2).cast("long").alias("pair_id"), F.col("conv_id").alias("chosen_id"), (F.col("conv_id") + 1).alias("rejected_id"))


def mask(segments: Column) -> Column:
    """One character a segment: 1 where it is trained on."""
    return F.array_join(F.transform(segments, lambda s: F.when(s["trained"], F.lit("1")).otherwise(F.lit("0"))), "")
