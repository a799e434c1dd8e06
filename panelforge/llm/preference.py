"""Preference pairs in chat format.

A pair is a chosen and a rejected conversation, each a list of turns (role, text). The longest common
prefix of turns is rendered once as the prompt; what follows on either side is a completion. The mask
of a completion lists the character ranges to train on: the texts of the assistant's turns with their
end marks.

Only built-in functions on arrays are used; a row holds one pair, and nothing is shuffled but the
turns, to bring a conversation together.

Nulls, ties and repeats: a null role or text is empty text. Turns are ordered by number, null numbers
first, and by role and text among equal numbers; repeated rows are repeated turns. Turns with a null
conversation take no part. Equal conversations are all prompt: both completions are empty and `tied`
is true. A side that is the beginning of the other has an empty completion. A null or empty list of
turns has none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.operators.ordered import next_in_order

ASSISTANT = "assistant"
OPEN, AFTER_ROLE, CLOSE = "<|", "|>\n", "<|end|>\n"
_TURNS = "array<struct<role: string, text: string>>"


def conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn") -> DataFrame:
    """`conv_id` and its ordered `turns` (role, text)."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    one = F.struct(F.col(turn).alias("turn"), blank("role").alias("role"), blank("text").alias("text"))
    rows = turns.filter(F.col(conv_id).isNotNull()).groupBy(F.col(conv_id).alias("conv_id"))
    ordered = F.array_sort(F.collect_list(one))
    return rows.agg(
        F.transform(ordered, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns")
    )


def _clean(turns: Column) -> Column:
    each = F.transform(
        turns,
        lambda t: F.struct(
            F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")
        ),
    )
    return F.coalesce(each, F.array().cast(_TURNS))


def common_prefix(a: Column, b: Column) -> Column:
    """How many first turns are equal."""
    shared = F.least(F.size(a), F.size(b))
    at = F.sequence(F.lit(0), shared - 1)
    differs = F.array_position(F.transform(at, lambda i: F.get(a, i) != F.get(b, i)), F.lit(True))
    return F.when(shared == 0, F.lit(0)).when(differs > 0, differs - 1).otherwise(shared).cast("int")


def _head(t: Column) -> Column:
    return F.concat(F.lit(OPEN), t["role"], F.lit(AFTER_ROLE))


def rendered(turns: Column) -> Column:
    return F.array_join(
        F.transform(turns, lambda t: F.concat(_head(t), t["text"], F.lit(CLOSE))), ""
    )


def mask(turns: Column, role: str = ASSISTANT) -> Column:
    """Character ranges [low, high) of the rendered turns that are trained on."""
    start = F.struct(
        F.lit(0).alias("at"), F.array().cast("array<struct<low: int, high: int>>").alias("spans")
    )

    def step(done, t):
        low = done["at"] + F.length(_head(t))
        high = low + F.length(t["text"]) + len(CLOSE)
        span = F.array(F.struct(low.alias("low"), high.alias("high")))
        spans = F.when(t["role"] == role, F.concat(done["spans"], span)).otherwise(done["spans"])
        return F.struct(high.alias("at"), spans.alias("spans"))

    return F.aggregate(turns, start, step, lambda done: done["spans"])


def format_pairs(pairs: DataFrame, pair_id: str = "pair_id") -> DataFrame:
    """Prompt, completions and masks of pairs with `chosen` and `rejected` turns."""
    both = pairs.select(
        F.col(pair_id).alias("pair_id"),
        _clean(F.col("chosen")).alias("a"),
        _clean(F.col("rejected")).alias("b"),
    ).withColumn("n", common_prefix(F.col("a"), F.col("b")))
    rest = lambda c: F.slice(c, F.col("n") + 1, F.size(c))
    split = both.select(
        "pair_id", "n", F.slice("a", F.lit(1), F.col("n")).alias("p"), rest("a").alias("a"), rest("b").alias("b")
    )
    return split.select(
        "pair_id",
        F.col("n").alias("n_prompt_turns"),
        rendered(F.col("p")).alias("prompt"),
        rendered(F.col("a")).alias("chosen"),
        rendered(F.col("b")).alias("rejected"),
        mask(F.col("a")).alias("chosen_mask"),
        mask(F.col("b")).alias("rejected_mask"),
        ((F.size("a") == 0) & (F.size("b") == 0)).alias("tied"),
    )


def sampled_pairs(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Pairs from plain conversations: up to the last reply of the assistant the conversation is
    chosen; with that reply replaced by the one of the next conversation (the first one after the
    last) it is rejected. What follows the last reply is in neither. A conversation without a reply is
    chosen and rejected as it is, so it is all prompt."""
    talks = conversations(turns, conv_id, turn).withColumn(
        "back", F.array_position(F.reverse(F.transform("turns", lambda t: t["role"] == ASSISTANT)), F.lit(True))
    )
    upto = F.slice("turns", F.lit(1), (F.size("turns") - F.col("back") + 1).cast("int"))
    chosen = talks.filter("back > 0").select("conv_id", upto.alias("chosen"))
    chosen = chosen.withColumn("reply", F.element_at("chosen", -1))
    paired = next_in_order(chosen, [], "conv_id", ["reply"], closed=True)
    other = F.coalesce("next_reply", "first_reply")
    rejected = F.concat(F.slice("chosen", F.lit(1), F.size("chosen") - 1), F.array(other))
    pairs = paired.select(F.col("conv_id").alias("pair_id"), "chosen", rejected.alias("rejected"))
    same = F.col("turns")
    alone = talks.filter("back = 0").select(
        F.col("conv_id").alias("pair_id"), same.alias("chosen"), same.alias("rejected")
    )
    return pairs.unionByName(alone)
