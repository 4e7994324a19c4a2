"""Feature tables of players and hands, and the lookup of expected values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pokerlake.functions.cards import (
    high_rank,
    is_pair,
    is_suited,
    low_rank,
    position_code,
    rank_letter,
    strength_score,
)
from pokerlake.functions.labels import binned
from pokerlake.functions.numbers import pct, ratio, rounded
from pokerlake.operators.linking import named_seats
from pokerlake.plans.parts import linked

PLAYER_FEATURES = ["vpip_pct", "pfr_pct", "three_bet_pct", "aggression_factor", "wtsd_pct", "wsd_pct", "allin_pct"]
HAND_FEATURES = [
    "high_card_rank", "low_card_rank", "is_suited", "is_pocket_pair", "hand_strength_score", "is_final_stage",
    "position_encoded", "is_late_position", "stack_bb", "opponent_count", "avg_opponent_cluster",
    "had_preflop_raise", "hero_raised_preflop", "preflop_raise_count",
]


def player_features(statistics: DataFrame) -> DataFrame:
    """The measures of a player as doubles."""
    return statistics.select(
        "player_name",
        "total_hands",
        *[F.col(c).cast("double").alias(c) for c in [*PLAYER_FEATURES, "avg_preflop_raise_bb"]],
        F.current_timestamp().alias("feature_timestamp"),
    )


def hand_features(
    hands: DataFrame,
    hand_players: DataFrame,
    hand_actions: DataFrame,
    mapping: DataFrame,
    screenshots: DataFrame,
    player_clusters: DataFrame,
    names: DataFrame | None = None,
) -> DataFrame:
    """One row per hand dealt to the hero: cards, seat, stack, table, raises and result.

    Clusters go by real names, seats by anonymous ids, so that opponents mostly have the default
    cluster; with ``names`` (``linking.resolved_names``) their seats carry the real names first.

    The hero sits in every hand and is left out before opponents meet their clusters.
    A hand seen in several captures has the stage of the earliest.
    """
    cards = F.col("hero_cards")
    dealt = hands.filter(cards.isNotNull() & (F.length(cards) >= 4)).select(
        "hand_id", "hero_cards", "big_blind", "hand_timestamp"
    )
    hero = hand_players.filter("is_hero").select("hand_id", "chips_start", "net_profit", "won_hand", "position")
    seats = hand_players.groupBy("hand_id").agg((F.count(F.lit(1)) - 1).alias("opponents"))
    opponents = hand_players.filter("NOT is_hero").select("hand_id", "player_name")
    clustered = (
        (opponents if names is None else named_seats(opponents, hands, names))
        .join(player_clusters.select("player_name", "cluster_id"), "player_name")
        .groupBy("hand_id")
        .agg(F.avg("cluster_id").alias("mean_cluster"))
    )
    raises = (
        hand_actions.filter("street = 'preflop' AND action_type = 'raise'")
        .groupBy("hand_id")
        .agg(F.max(F.col("is_hero").cast("int")).alias("hero_raised"), F.count(F.lit(1)).alias("raises"))
    )
    stage = (
        linked(mapping)
        .select("file_name", "hand_id")
        .join(screenshots.select("file_name", "screenshot_at", "stage"), "file_name")
        .groupBy("hand_id")
        .agg(F.min_by("stage", F.struct("screenshot_at", "file_name")).alias("stage"))
    )
    df = dealt.join(hero, "hand_id").withColumn("stack", ratio(F.col("chips_start"), F.col("big_blind")))
    df = df.filter("stack > 0")
    for part in (seats, clustered, raises, stage):
        df = df.join(part, "hand_id", "left")

    def number(value: Column, default: float = 0.0) -> Column:
        return F.coalesce(value.cast("double"), F.lit(float(default)))

    position = F.col("position")
    return df.select(
        "hand_id",
        high_rank(cards).cast("double").alias("high_card_rank"),
        low_rank(cards).cast("double").alias("low_card_rank"),
        is_suited(cards).cast("double").alias("is_suited"),
        is_pair(cards).cast("double").alias("is_pocket_pair"),
        strength_score(cards).alias("hand_strength_score"),
        number(F.col("stage") == "final").alias("is_final_stage"),
        position_code(position).cast("double").alias("position_encoded"),
        number(position.isin("CO", "BTN")).alias("is_late_position"),
        number(F.col("stack"), 20).alias("stack_bb"),
        number(F.col("opponents"), 5).alias("opponent_count"),
        number(F.col("mean_cluster"), 1).alias("avg_opponent_cluster"),
        number(F.col("raises") > 0).alias("had_preflop_raise"),
        number(F.col("hero_raised")).alias("hero_raised_preflop"),
        number(F.col("raises")).alias("preflop_raise_count"),
        F.when(F.col("won_hand"), 1).otherwise(0).alias("won_hand"),
        ratio(number(F.col("net_profit")), F.col("big_blind")).alias("profit_bb"),
        F.col("hand_timestamp").alias("feature_timestamp"),
    )


def hand_ev_lookup(features: DataFrame) -> DataFrame:
    """Profit by starting hand, position, stage and number of opponents."""
    high, low = rank_letter(F.col("high_card_rank")), rank_letter(F.col("low_card_rank"))
    suffix = F.when(F.col("is_suited") == 1, "s").otherwise("o")
    hand = F.when(F.col("is_pocket_pair") == 1, F.concat(high, high)).otherwise(F.concat(high, low, suffix))
    places = F.array(*map(F.lit, ["Early", "Middle", "Late", "Blinds"]))
    profit = F.col("profit_bb")
    return features.groupBy(
        hand.alias("hand_type"),
        F.get(places, F.col("position_encoded").cast("int")).alias("position"),
        F.when(F.col("is_final_stage") == 1, "Final").otherwise("Rush").alias("stage"),
        binned(F.col("opponent_count"), [(2, "1-2"), (4, "3-4")], "5+").alias("opponent_bucket"),
    ).agg(
        rounded(F.avg(profit), 2).alias("avg_profit_bb"),
        pct(F.sum("won_hand"), F.count(F.lit(1))).alias("win_rate_pct"),
        F.count(F.lit(1)).alias("sample_size"),
        rounded(F.min(profit), 2).alias("min_profit_bb"),
        rounded(F.max(profit), 2).alias("max_profit_bb"),
        rounded(F.stddev_samp(profit), 2).alias("stddev_profit_bb"),
    )
