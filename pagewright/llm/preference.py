"""Preference pairs as one prompt and two masked completions, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The role whose text is trained on.
TRAINED_ROLE = "assistant"


def _head(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"))


def _body(turn: Column) -> Column:
    return F.concat(turn["text"], F.lit("\n"))


def render(turns: Column) -> Column:
    """The text of some turns, each as <|role|>, a line break, its text and a line break."""
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t))), "")


def mask(turns: Column) -> Column:
    """Runs (n_chars, train) over the rendered turns: a head is never trained on, a text only of the trained role."""
    runs = F.transform(
        turns,
        lambda t: F.array(
            F.struct(F.length(_head(t)).alias("n_chars"), F.lit(False).alias("train")),
            F.struct(F.length(_body(t)).alias("n_chars"), (t["role"] == TRAINED_ROLE).alias("train")),
        ),
    )
    return F.flatten(runs)


def format_preferences(
    turns: DataFrame, pair: Column, chosen: Column, turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """pair_id, n_prompt_turns, prompt, and chosen and rejected completions with their masks, one row for each pair.

    turns has a row (turn, role, text) for each turn; `pair` names the pair that it belongs to and `chosen` on which side
    it stands. Turns are ordered by turn, role and text. The prompt is the longest run of first turns that are equal in
    role and text on both sides, rendered once. Turns of one pair meet in one row, as any format of it needs them.
    Nulls: a null pair or side takes no part, a null role is "none", a null text is empty, a null turn comes first. Turns
    that repeat are rendered as often as they come. A side without turns has an empty completion; a pair of equal sides
    has two. usable tells whether the completions differ and each holds a turn to train on. An empty table gives no rows.
    Only the three named columns, `pair` and `chosen` are read, whatever others are called. Texts of any length are kept
    whole; a conversation must fit into a row, as its rendering does.
    """
    held = turns.select(
        pair.alias("pair_id"),
        chosen.alias("chosen"),
        F.struct(
            F.col(f"`{turn}`").alias("turn"),
            F.coalesce(F.col(f"`{role}`"), F.lit("none")).alias("role"),
            F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
        ).alias("t"),
    ).filter("pair_id is not null and chosen is not null")
    side = lambda which: F.array_sort(F.collect_list(F.when(which, F.col("t"))))
    sides = held.groupBy("pair_id").agg(side(F.col("chosen")).alias("a"), side(~F.col("chosen")).alias("b"))
    same = F.zip_with("a", "b", lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    first = F.array_position(same, F.lit(False))
    cut = sides.withColumn("n", F.when(first > 0, first - 1).otherwise(F.size("a")).cast("int"))
    rest = lambda x: F.slice(x, F.col("n") + 1, F.greatest(F.size(x) - F.col("n"), F.lit(0)))
    trained = lambda x: F.exists(x, lambda t: t["role"] == TRAINED_ROLE)
    cut = cut.withColumns({"a_rest": rest("a"), "b_rest": rest("b")})
    return cut.select(
        "pair_id",
        F.col("n").alias("n_prompt_turns"),
        render(F.slice("a", F.lit(1), F.col("n"))).alias("prompt"),
        render(F.col("a_rest")).alias("chosen"),
        mask(F.col("a_rest")).alias("chosen_mask"),
        render(F.col("b_rest")).alias("rejected"),
        mask(F.col("b_rest")).alias("rejected_mask"),
        (trained("a_rest") & trained("b_rest") & (render(F.col("a_rest")) != render(F.col("b_rest")))).alias("usable"),
    )
