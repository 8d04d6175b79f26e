"""Preference formatting: the shared beginning of a chosen and a rejected conversation once, then both completions with masks.

The prompt is the longest run of leading turns, equal in role and text, that both conversations have. The turns after it
are rendered as completions. A mask is a list of (start, end) character ranges of the completion that a model learns from:
the texts of assistant turns with their closing marker.

Turns are ordered by turn, then role, then text; null texts and roles are empty strings; null turns come first. Each turn
with a null conv_id is a conversation of its own. Repeated turns stay. An empty table gives an empty result; conversations that
are wholly equal get two empty completions; other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, BREAK, CLOSE, LEARNED = "<|start|>", "\n", "<|end|>\n", "assistant"


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id and its ordered turns, an array of (role, text)."""
    one = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = F.sort_array(F.collect_list(one))
    said = lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))
    whole = turns.where("conv_id is not null").groupBy("conv_id").agg(F.transform(ordered, said).alias("turns"))
    return whole.union(turns.where("conv_id is null").select("conv_id", F.array(said(one)).alias("turns")))


def _shown(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(BREAK), turn["text"], F.lit(CLOSE))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _shown), "")


def learned(turns: Column) -> Column:
    """(start, end) of every learned range of the rendered turns, counted in characters."""
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(so_far: Column, turn: Column) -> Column:
        end = so_far["at"] + F.char_length(_shown(turn))
        start = so_far["at"] + len(OPEN) + F.char_length(turn["role"]) + len(BREAK)
        span = F.array(F.struct(start.alias("start"), (end - 1).alias("end")))
        return F.struct(end.alias("at"), F.when(turn["role"] == LEARNED, F.concat(so_far["spans"], span)).otherwise(so_far["spans"]).alias("spans"))

    return F.aggregate(turns, empty, step, lambda s: s["spans"])


def shared_turns(a: Column, b: Column) -> Column:
    """Number of leading turns that are equal."""
    n = F.least(F.size(a), F.size(b))
    differ = F.array_position(F.transform(F.sequence(F.lit(0), n), lambda i: (i < n) & (F.get(a, i) == F.get(b, i))), F.lit(False))
    return (differ - 1).cast("int")


def formatted(pairs: DataFrame) -> DataFrame:
    """``pairs`` holds pair_id, chosen and rejected (arrays of role and text).

    Gives pair_id, n_shared, prompt, chosen, rejected, chosen_mask and rejected_mask.
    """
    cut = pairs.withColumn("n_shared", shared_turns(F.col("chosen"), F.col("rejected")))
    rest = lambda c: F.slice(c, F.col("n_shared") + 1, F.size(c))
    return cut.select(
        "pair_id", F.col("n_shared").cast("long").alias("n_shared"), rendered(F.slice("chosen", F.lit(1), F.col("n_shared"))).alias("prompt"),
        rendered(rest("chosen")).alias("chosen"), rendered(rest("rejected")).alias("rejected"),
        learned(rest("chosen")).alias("chosen_mask"), learned(rest("rejected")).alias("rejected_mask"),
    )


def swapped_replies(talks: DataFrame) -> DataFrame:
    """Pairs from conversations alone: each one against itself with its last learned turn's text taken from the next conv_id.

    Where the next conversation is missing or has no such turn the text is empty. Conversations without such a turn have
    equal sides. A null conv_id has no next one.
    """
    last = F.size("turns") - F.array_position(F.transform(F.reverse("turns"), lambda x: x["role"]), F.lit(LEARNED)).cast("int")
    placed = talks.withColumn("last", F.when(F.exists("turns", lambda x: x["role"] == LEARNED), last))
    following = placed.select((F.col("conv_id") - 1).alias("conv_id"), F.get("turns", F.col("last"))["text"].alias("other"))
    both = placed.join(following, "conv_id", "left")
    swap = F.transform("turns", lambda x, i: F.struct(x["role"].alias("role"), F.when(i == F.col("last"), F.coalesce("other", F.lit(""))).otherwise(x["text"]).alias("text")))
    return both.select(F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"), swap.alias("rejected"))
