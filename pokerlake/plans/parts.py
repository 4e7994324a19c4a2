"""Pieces shared by the analyses of advice and spots.

Join keys are hand ids and file names, never a player name or a position. Captures
without a hand are dropped (or kept apart by an outer join on the file name) before
any join on the hand id, so that their NULLs do not meet in one partition. What a
hero did is counted per hand, street and action first: a decision then meets at most
one row per kind of action, and each carries the number of equal actions as weight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pokerlake.functions.labels import NOT_DECISIONS, PLAY


def linked(mapping: DataFrame) -> DataFrame:
    """Captures that have a hand."""
    return mapping.filter("hand_id IS NOT NULL")


def hero_rows(hand_players: DataFrame, *columns: str) -> DataFrame:
    """The hero's row of each hand."""
    return hand_players.filter("is_hero").select("hand_id", *columns)


def hero_decisions(hand_actions: DataFrame) -> DataFrame:
    """The hero's action rows without posts and shown cards."""
    return hand_actions.filter(F.col("is_hero") & ~F.col("action_type").isin(*NOT_DECISIONS))


def hero_action_counts(hand_actions: DataFrame, *more: str) -> DataFrame:
    """hand_id, street, hero_action and ``n``, the number of such actions."""
    keyed = hero_decisions(hand_actions).select("hand_id", "street", F.col("action_type").alias("hero_action"), *more)
    return keyed.groupBy("hand_id", "street", "hero_action", *more).agg(F.count(F.lit(1)).alias("n"))


def hands_with_hero(hands: DataFrame, hand_players: DataFrame, hand_columns: list[str], hero_columns: list[str]) -> DataFrame:
    return hands.select("hand_id", *hand_columns).join(hero_rows(hand_players, *hero_columns), "hand_id")


def decision_base(
    screenshots: DataFrame,
    mapping: DataFrame,
    hands: DataFrame,
    hand_players: DataFrame,
    screenshot_players: DataFrame,
) -> DataFrame:
    """One row per advised and linked capture with its hand, hero and table size.

    ``players`` counts the listed opponents and the hero; captures that list none count
    as one player.
    """
    shots = screenshots.filter("gpt_action IS NOT NULL").select(
        "file_name", "screenshot_at", "stage", "street", "hero_stack", "gpt_action"
    )
    listed = screenshot_players.groupBy("file_name").agg((F.count(F.lit(1)) + 1).alias("players"))
    dealt = hands_with_hero(
        hands, hand_players, ["tournament_id", "hero_result", "big_blind", "total_pot"], ["amount_won", "chips_start", "net_profit"]
    )
    return (
        shots.join(linked(mapping).select("file_name", "hand_id"), "file_name")
        .join(listed, "file_name", "left")
        .join(dealt, "hand_id")
        .withColumn("players", F.coalesce("players", F.lit(1)))
    )


def won(condition: Column | None = None) -> Column:
    result = F.col("hero_result") == "won"
    return result if condition is None else condition & result


def not_won(condition: Column) -> Column:
    return condition & F.col("hero_result").isin("lost", "folded")


def plays(action: Column) -> Column:
    return action.isin(*PLAY)
