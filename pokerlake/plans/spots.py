"""All-in calls in the rush stage and small raises at the final table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pokerlake.functions.cards import acts_after, hand_class
from pokerlake.functions.labels import small_raise, spot_stack
from pokerlake.functions.numbers import count_where, pct, ratio, rounded, weighted_mean
from pokerlake.operators.ordered import first_per_key
from pokerlake.plans.parts import hands_with_hero, hero_action_counts, hero_decisions, linked, not_won, won


def _with_hand(shots: DataFrame, mapping: DataFrame, dealt: DataFrame) -> DataFrame:
    """Captures with their hand where there is one; the outer join is on the file name."""
    found = linked(mapping).select("file_name", "hand_id").join(dealt, "hand_id")
    return shots.join(found, "file_name", "left")


def _allin_shots(screenshots: DataFrame) -> DataFrame:
    half = F.col("hero_stack").cast("double") * 0.5
    return screenshots.filter(
        (F.col("stage") == "rush") & (F.col("to_call") > half) & F.col("gpt_action").isin("call", "raise")
    ).withColumns(
        {
            "hand_type": hand_class(F.col("hero_cards")),
            "pct_of_stack": pct(F.col("to_call"), F.col("hero_stack")),
        }
    )


def rush_allin_call_analysis(
    screenshots: DataFrame,
    mapping: DataFrame,
    hands: DataFrame,
    hand_players: DataFrame,
    hand_actions: DataFrame,
    min_rows: int = 2,
) -> DataFrame:
    """Advised calls and raises for over half of the stack, by starting hand."""
    shots = _allin_shots(screenshots).select("file_name", "street", "hand_type", "pct_of_stack")
    dealt = hands_with_hero(hands, hand_players, ["hero_result", "big_blind"], ["net_profit"])
    acts = hero_action_counts(hand_actions)
    linked_shots = shots.join(linked(mapping).select("file_name", "hand_id"), "file_name").join(dealt, "hand_id")
    acted = linked_shots.join(acts, ["hand_id", "street"], "left").select(
        "file_name", "hero_action", "n", "hero_result", ratio(F.col("net_profit"), F.col("big_blind")).alias("net_bb")
    )
    rows = shots.join(acted, "file_name", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    n, total = F.col("n"), F.sum("n")
    played = F.coalesce(F.col("hero_action").isin("call", "raise"), F.lit(False))
    net = F.col("net_bb")
    grouped = rows.groupBy("hand_type").agg(
        total.alias("total_situations"),
        count_where(played, n).alias("hero_played"),
        count_where(F.col("hero_action") == "fold", n).alias("hero_folded"),
        count_where(won(played), n).alias("wins"),
        count_where(not_won(played), n).alias("losses"),
        pct(count_where(won(played), n), count_where(played, n)).alias("win_rate_pct"),
        rounded(F.sum(F.when(played, net * n).otherwise(0.0)), 1).alias("total_net_bb"),
        rounded(weighted_mean(net, n, played), 1).alias("avg_net_bb_per_hand"),
        rounded(weighted_mean(F.col("pct_of_stack"), n), 1).alias("avg_pct_of_stack"),
    )
    return grouped.filter(F.col("total_situations") >= min_rows)


def rush_allin_call_details(
    screenshots: DataFrame, mapping: DataFrame, hands: DataFrame, hand_players: DataFrame, hand_actions: DataFrame
) -> DataFrame:
    """The same captures one by one with the hero's first action on the street."""
    deeds = hand_actions.filter(
        F.col("is_hero") & F.col("action_type").isin("fold", "call", "raise", "check", "bet")
    ).select("hand_id", "street", "action_order", F.col("action_type").alias("hero_action"))
    first = first_per_key(deeds, ["hand_id", "street"], ["action_order"]).drop("action_order")
    dealt = hands_with_hero(hands, hand_players, ["hero_result", "big_blind"], ["net_profit"])
    shots = _allin_shots(screenshots)
    found = (
        shots.select("file_name", "street")
        .join(linked(mapping).select("file_name", "hand_id"), "file_name")
        .join(dealt, "hand_id")
        .join(first, ["hand_id", "street"], "left")
        .select(
            "file_name",
            "hero_result",
            "hero_action",
            rounded(ratio(F.col("net_profit"), F.col("big_blind")), 1).alias("net_profit_bb"),
        )
    )
    return shots.join(found, "file_name", "left").select(
        "hand_type", "hero_cards", "hero_pos", "hero_stack", "to_call", "pct_of_stack", "pot", "gpt_action",
        "gpt_recommendation", "hero_result", "hero_action", "net_profit_bb", "file_name", "screenshot_at",
    )


def small_raise_outcomes(
    screenshots: DataFrame, mapping: DataFrame, hands: DataFrame, hand_players: DataFrame, hand_actions: DataFrame
) -> DataFrame:
    """One row per advised small raise before the flop at the final table.

    Adds the deepest stack (in big blinds) still to act, whether the hero raised before
    the flop, folded at any time, and the number of the hero's actions.
    """
    shots = screenshots.filter(
        (F.col("stage") == "final") & (F.col("street") == "preflop") & (F.col("gpt_action") == "raise")
        & small_raise(F.col("gpt_recommendation"))
    ).select("file_name", "screenshot_at", "hero_cards", "hero_pos", "hero_stack", "gpt_recommendation")
    dealt = hands_with_hero(hands, hand_players, ["hero_result", "big_blind"], ["net_profit"])
    action = F.col("action_type")
    deeds = hero_decisions(hand_actions).groupBy("hand_id").agg(
        F.max(F.when((F.col("street") == "preflop") & (action == "raise"), 1).otherwise(0)).alias("raised"),
        F.max(F.when(action == "fold", 1).otherwise(0)).alias("folded"),
        F.count_distinct("action_order").alias("hero_action_count"),
    )
    # A row per hand with its few seats, so that a capture meets its table in the join that brings the hand.
    seats = hand_players.filter("NOT is_hero").groupBy("hand_id").agg(F.collect_list(F.struct("position", "chips_start")).alias("seats"))
    rows = _with_hand(shots, mapping, dealt.join(deeds, "hand_id", "left").join(seats, "hand_id", "left"))
    later = F.filter("seats", lambda s: acts_after(F.col("hero_pos"), s["position"]))
    deepest = F.array_max(F.transform(later, lambda s: ratio(s["chips_start"], F.col("big_blind"))))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("raised", "folded", "hero_action_count")}
    return (
        rows.withColumn("max_stack_behind", deepest)
        .drop("seats")
        .withColumns(zero)
        .withColumns(
            {
                "net_bb": ratio(F.col("net_profit"), F.col("big_blind")),
                "covered": F.coalesce("max_stack_behind", F.lit(0.0)) > F.col("hero_stack").cast("double") * 1.5,
            }
        )
    )


def final_small_raise_analysis(outcomes: DataFrame) -> DataFrame:
    """Outcome of advised small raises by big stacks behind and own stack."""
    raised, folded, result = F.col("raised") == 1, F.col("folded") == 1, F.col("hero_result")
    outcome = (
        F.when(raised & folded, "raised_then_folded")
        .when(raised & (result == "won"), "raised_and_won")
        .when(raised & result.isin("lost", "folded"), "raised_and_lost")
        .when(~raised, "did_not_raise")
        .otherwise("other")
    )
    labelled = outcomes.withColumns(
        {
            "outcome_type": outcome,
            "stack_situation": F.when(F.col("covered"), "big_stack_behind").otherwise("no_big_stack_behind"),
            "hero_stack_category": spot_stack(F.col("hero_stack")),
        }
    )
    return labelled.groupBy("outcome_type", "stack_situation", "hero_stack_category").agg(
        F.count(F.lit(1)).alias("total"),
        rounded(F.sum("net_bb"), 1).alias("total_net_bb"),
        rounded(F.avg("net_bb"), 1).alias("avg_net_bb"),
        rounded(F.avg(F.col("hero_stack").cast("double")), 1).alias("avg_hero_stack"),
        rounded(F.avg("max_stack_behind"), 1).alias("avg_max_stack_behind"),
    )


def final_raise_then_fold_details(
    outcomes: DataFrame, hand_players: DataFrame, hand_actions: DataFrame
) -> DataFrame:
    """The small raises given up later, with the first player who shoved before the flop."""
    given_up = outcomes.filter("raised = 1 AND folded = 1")
    shoves = hand_actions.filter(
        "NOT is_hero AND street = 'preflop' AND action_type = 'raise' AND is_allin"
    ).select("hand_id", "player_name", "action_order")
    players = hand_players.select("hand_id", "player_name", "position", "chips_start", "vpip")
    first = F.min_by(F.struct("position", "chips_start", "vpip"), F.struct("action_order", "position"))
    shover = shoves.join(players, ["hand_id", "player_name"]).groupBy("hand_id").agg(first.alias("shover"))

    def one_decimal(name: str) -> Column:
        return rounded(F.col(name), 1).alias(name)

    return given_up.join(shover, "hand_id", "left").select(
        "file_name",
        "hero_cards",
        "hero_pos",
        one_decimal("hero_stack"),
        one_decimal("max_stack_behind"),
        F.col("shover.position").alias("shover_pos"),
        rounded(ratio(F.col("shover.chips_start"), F.col("big_blind")), 1).alias("shover_stack"),
        F.col("shover.vpip").alias("shover_vpip"),
        one_decimal("net_bb"),
        spot_stack(F.col("hero_stack")).alias("hero_stack_cat"),
        F.when(F.col("covered"), "big_behind").otherwise("no_big_behind").alias("stack_sit"),
    )
