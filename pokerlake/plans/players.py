"""Profiles of identified players."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pokerlake.functions.cards import hand_category, hand_class, is_pair, is_suited, position_group
from pokerlake.functions.labels import binned
from pokerlake.functions.numbers import count_where, pct, rate, ratio, rounded
from pokerlake.operators.lists import PART_ROWS, repeated_text
from pokerlake.sinks.tables import write_batch


def player_hand_stats(
    identity: DataFrame, hand_players: DataFrame, hands: DataFrame, hand_actions: DataFrame, screenshots: DataFrame
) -> DataFrame:
    """One row per identified player and hand: position, stack, flags, sizes, result."""
    action, preflop = F.col("action_type"), F.col("street") == "preflop"
    raise_ = preflop & (action == "raise")
    sizes = (
        hand_actions.groupBy("hand_id", F.col("player_name").alias("anonymous_id"))
        .agg(
            F.max(F.col("is_allin").cast("int")).alias("allin"),
            F.max(F.when(raise_, F.col("amount"))).alias("raise_amount"),
            F.max(F.when(raise_ & F.col("is_allin"), 1).otherwise(0)).alias("shove"),
            F.avg(F.when(action.isin("bet", "raise"), F.col("amount"))).alias("mean_amount"),
        )
    )
    seats = hand_players.withColumnRenamed("player_name", "anonymous_id").select(
        "hand_id", "anonymous_id", "position", "chips_start", "hole_cards", "vpip", "pfr", "three_bet", "total_bets",
        "total_raises", "total_calls", "went_to_showdown", "won_hand", "amount_won", "net_profit", "result_description",
    )
    df = (
        identity.select("player_name", "hand_id", "anonymous_id", "file_name")
        .join(seats, ["hand_id", "anonymous_id"])
        .join(hands.select("hand_id", "hand_timestamp", "tournament_id", "big_blind"), "hand_id")
        .join(sizes, ["hand_id", "anonymous_id"], "left")
        .join(screenshots.select("file_name", "stage"), "file_name", "left")
    )

    def in_bb(value: str) -> Column:
        return rounded(ratio(F.col(value), F.col("big_blind")), 1)

    return df.select(
        "player_name", "hand_id", "hand_timestamp", "tournament_id", "stage", "position",
        position_group(F.col("position")).alias("position_group"),
        "chips_start", "big_blind", in_bb("chips_start").alias("stack_bb"), "hole_cards",
        "vpip", "pfr", "three_bet", "total_bets", "total_raises", "total_calls",
        F.coalesce(F.col("allin") == 1, F.lit(False)).alias("went_allin"),
        in_bb("raise_amount").alias("preflop_raise_bb"),
        F.coalesce(F.col("shove") == 1, F.lit(False)).alias("preflop_shove"),
        in_bb("mean_amount").alias("avg_action_size_bb"),
        "went_to_showdown", "won_hand", "amount_won", "net_profit", "result_description",
    )


def _shares() -> dict[str, tuple[Column, Column]]:
    """Measures that are a share: the rows that count among the rows asked."""
    c = F.col
    rush, final = c("stage") == "rush", c("stage") == "final"
    group, stack, shown, every = c("position_group"), c("stack_bb"), c("went_to_showdown"), F.lit(True)
    of = {
        "vpip_pct": (c("vpip"), every),
        "pfr_pct": (c("pfr"), every),
        "three_bet_pct": (c("three_bet"), every),
        "wtsd_pct": (shown, every),
        "wsd_pct": (c("won_hand"), shown),
        "allin_pct": (c("went_allin"), every),
        "open_raise_early_pct": (c("pfr"), group == "early"),
        "open_raise_middle_pct": (c("pfr"), group == "middle"),
        "open_raise_late_pct": (c("pfr"), group == "late"),
        "sb_open_pct": (c("pfr"), c("position") == "SB"),
        "bb_defend_pct": (c("vpip"), c("position") == "BB"),
        "rush_vpip_pct": (c("vpip"), rush),
        "rush_pfr_pct": (c("pfr"), rush),
        "rush_3bet_pct": (c("three_bet"), rush),
        "rush_allin_pct": (c("went_allin"), rush),
        "rush_wtsd_pct": (shown, rush),
        "rush_wsd_pct": (c("won_hand"), rush & shown),
        "ft_vpip_pct": (c("vpip"), final),
        "ft_pfr_pct": (c("pfr"), final),
        "ft_allin_pct": (c("went_allin"), final),
        "ft_shove_short_pct": (c("went_allin"), final & (stack <= 10)),
        "ft_shove_medium_pct": (c("went_allin"), final & (stack > 10) & (stack <= 20)),
        "ft_shove_deep_pct": (c("went_allin"), final & (stack > 20)),
        "ft_shove_late_pct": (c("went_allin"), final & (group == "late")),
        "ft_shove_blinds_pct": (c("went_allin"), final & (group == "blinds")),
    }
    shares = {name: (yes & base, base) for name, (yes, base) in of.items()}
    # Shoves among opened hands; a shove does not have to be among them.
    return shares | {"ft_open_shove_pct": (final & c("preflop_shove"), final & c("pfr"))}


def player_sums(stats: DataFrame) -> DataFrame:
    """Sums and counts per player from which all measures follow.

    They add up: the sums of two sets of hands, added, are those of both together. Means are kept
    as a sum of exact decimals and a count.
    """
    c = F.col
    rush, final = c("stage") == "rush", c("stage") == "final"
    exact = lambda name: F.sum(c(name).cast("decimal(18,4)"))
    sums = {
        "total_hands": F.count(F.lit(1)),
        "rush_hands": count_where(rush),
        "ft_hands": count_where(final),
        "raising": F.sum((c("total_bets") + c("total_raises")).cast("bigint")),
        "calling": F.sum(c("total_calls").cast("bigint")),
        "raise_bb_sum": exact("preflop_raise_bb"),
        "raise_bb_rows": F.count("preflop_raise_bb"),
        "size_bb_sum": exact("avg_action_size_bb"),
        "size_bb_rows": F.count("avg_action_size_bb"),
        "total_net_profit": F.sum("net_profit"),
        "rush_net_profit": F.sum(F.when(rush, c("net_profit")).otherwise(0.0)),
    }
    for name, (yes, base) in _shares().items():
        sums |= {f"{name}_yes": count_where(yes), f"{name}_of": count_where(base)}
    return stats.groupBy("player_name").agg(*[value.alias(name) for name, value in sums.items()])


def added_sums(sums: DataFrame) -> DataFrame:
    """One row per player for several rows of ``player_sums``, such as one per batch of hands."""
    names = [c for c in sums.columns if c not in ("player_name", "batch")]
    return sums.groupBy("player_name").agg(*[F.sum(c).alias(c) for c in names])


def statistics_of(sums: DataFrame) -> DataFrame:
    """All measures of a player and the two labels, from one row of sums per player."""
    c = F.col
    shares = {name: pct(c(f"{name}_yes"), c(f"{name}_of")) for name in _shares()}
    measures = {
        "total_hands": c("total_hands"),
        **{n: shares[n] for n in ("vpip_pct", "pfr_pct", "three_bet_pct")},
        "aggression_factor": rounded(ratio(c("raising"), c("calling")), 2),
        **{n: shares[n] for n in ("wtsd_pct", "wsd_pct", "allin_pct")},
        "avg_preflop_raise_bb": rounded(ratio(c("raise_bb_sum"), c("raise_bb_rows")), 1),
        "avg_bet_size_bb": rounded(ratio(c("size_bb_sum"), c("size_bb_rows")), 1),
        "total_net_profit": c("total_net_profit"),
        **{n: shares[n] for n in shares if n.startswith(("open_", "sb_", "bb_"))},
        "rush_hands": c("rush_hands"),
        **{n: shares[n] for n in shares if n.startswith("rush_")},
        "rush_net_profit": c("rush_net_profit"),
        "ft_hands": c("ft_hands"),
        **{n: shares[n] for n in shares if n.startswith("ft_")},
    }
    vpip, pfr, factor = c("vpip_pct"), c("pfr_pct"), c("aggression_factor")
    loose, tight = vpip >= 40, vpip < 25
    return sums.select("player_name", *[value.alias(name) for name, value in measures.items()]).withColumns(
        {
            "player_type": F.when(loose & (pfr >= 25), "LAG")
            .when(loose & (pfr < 25), "LP")
            .when(tight & (pfr >= 18), "TAG")
            .when(tight & (pfr < 18), "NIT")
            .otherwise("REG"),
            "aggression_style": F.when(factor >= 3, "very_aggressive")
            .when(factor >= 2, "aggressive")
            .when(factor >= 1, "neutral")
            .otherwise("passive"),
        }
    )


def player_statistics(stats: DataFrame) -> DataFrame:
    """All measures of a player in one aggregation, then the two labels."""
    return statistics_of(player_sums(stats))


def merge_hands(spark: SparkSession, name: str, stats: DataFrame, batch: str, folder: str | None = None) -> DataFrame:
    """Statistics after a batch of hands: only its hands are summed, the others come from the table of sums.

    The table ``name`` holds ``player_sums`` per batch. Running a batch again replaces its own sums,
    so a repeat changes nothing and a corrected batch takes the place of the old one. A hand must
    be in one batch only, as the insert-only merge of the hands table sees to.
    """
    return statistics_of(added_sums(write_batch(spark, name, player_sums(stats), batch, folder)))


def player_shove_profile(stats: DataFrame) -> DataFrame:
    """All-ins before the flop whose cards are known."""
    cards = F.col("hole_cards")
    shown = stats.filter((F.col("went_allin")) & F.col("preflop_shove") & cards.isNotNull() & (cards != ""))
    return shown.select(
        "player_name", "hand_id", "stage", "position", "position_group", "stack_bb",
        binned(F.col("stack_bb"), [(10, "short"), (20, "medium")], "deep").alias("stack_category"),
        "hole_cards",
        hand_class(cards).alias("hand_notation"),
        hand_category(cards).alias("hand_category"),
        is_suited(cards).alias("is_suited"),
        is_pair(cards).alias("is_pocket_pair"),
        "won_hand", "net_profit",
    )


SHOVE_GROUP = ["player_name", "stage", "stack_category", "position_group"]


def player_shove_summary(profile: DataFrame) -> DataFrame:
    """Shoves of a player by stage, stack and position group; ``hands`` counts each hand shown.

    A group has at most 169 hands; ``shoves_spelled`` writes them out with repeats.
    """
    category = F.col("hand_category")
    # The value counts come first, so a group gathers one item per hand, not per shove.
    per_hand = profile.groupBy(*SHOVE_GROUP, "hand_notation").agg(F.count(F.lit(1)).alias("n"))
    listed = per_hand.groupBy(F.struct(*SHOVE_GROUP).alias("_key")).agg(F.array_sort(F.collect_list(F.struct(F.col("hand_notation").alias("hand"), "n"))).alias("hands"))
    # NULL stages form groups of their own; the join below needs a value to meet on.
    measures = profile.groupBy(F.struct(*SHOVE_GROUP).alias("_key")).agg(
        F.count(F.lit(1)).alias("total_shoves"),
        rate(F.col("won_hand")).alias("win_rate"),
        rate(category.isin("premium_pair", "premium_broadway")).alias("premium_pct"),
        rate(category.isin("medium_pair", "strong_ace", "strong_broadway")).alias("strong_pct"),
        rate(category.isin("small_pair", "micro_pair")).alias("small_pair_pct"),
        rate(category.isin("Axs", "Axo")).alias("ax_pct"),
        rate(category == "trash").alias("trash_pct"),
    )
    joined = measures.join(listed, "_key")
    return joined.select("_key.*", *[c for c in joined.columns if c != "_key"])


def shoves_spelled(profile: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """``hands_shown``: all hands of a group, sorted, with repeats, in parts of ``part_rows`` shoves."""
    return repeated_text(profile, SHOVE_GROUP, "hand_notation", ", ", part_rows).withColumnRenamed("text", "hands_shown")
