"""What was advised, what was done and what came of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pokerlake.functions.labels import (
    PLAY,
    STREETS,
    binned,
    decision_type,
    followed,
    street_followed,
    table_type,
)
from pokerlake.functions.numbers import count_where, pct, ratio, rounded, weighted_mean
from pokerlake.operators.lists import PART_ROWS, list_parts
from pokerlake.operators.ordered import SLICE_ROWS, lookback, running
from pokerlake.plans.parts import (
    hands_with_hero,
    hero_action_counts,
    hero_decisions,
    linked,
    not_won,
    plays,
    won,
)


def _street_actions(hand_actions: DataFrame) -> DataFrame:
    """What the hero did over each street, one row per hand and street."""
    action = F.col("action_type")
    flag = lambda c: F.max(F.when(c, 1).otherwise(0))
    return hero_decisions(hand_actions).groupBy("hand_id", "street").agg(
        F.min_by("action_type", "action_order").alias("hero_first_action"),
        flag(action.isin("call", "bet", "raise")).alias("hero_put_money_in"),
        flag(action == "fold").alias("hero_folded_on_street"),
    )


def screenshot_hand_analysis(
    screenshots: DataFrame, mapping: DataFrame, hands: DataFrame, hand_players: DataFrame, hand_actions: DataFrame
) -> DataFrame:
    """Each linked capture: advice, the hero's deed on that street, verdict and outcome."""
    won_row = lambda column: F.max(F.when(F.col("won_hand"), F.col(column)))
    hero_row = lambda column: F.max(F.when(F.col("is_hero"), F.col(column)))
    # One pass over the seats gives the winner and the hero of each hand.
    seats = hand_players.groupBy("hand_id").agg(
        F.max(F.col("went_to_showdown").cast("int")).alias("had_showdown"),
        won_row("result_description").alias("winner_hand_description"),
        won_row("hole_cards").alias("winner_hole_cards"),
        won_row("amount_won").alias("showdown_pot_won"),
        hero_row("amount_won").alias("hero_amount_won"),
        hero_row("chips_start").alias("chips_start"),
        hero_row("vpip").alias("hero_vpip"),
        hero_row("pfr").alias("hero_pfr"),
        F.max("is_hero").alias("_with_hero"),
    )
    dealt = hands.select(
        "hand_id", "hand_timestamp", "tournament_id", "big_blind", "board", "total_pot", "hero_result"
    ).join(seats.filter("_with_hero").drop("_with_hero"), "hand_id")
    shots = screenshots.select(
        "file_name", "screenshot_at", "stage", "street", "hero_cards", "hero_pos", "hero_stack", "pot", "to_call",
        "gpt_recommendation", "gpt_action", "gpt_amount",
    )
    df = (
        shots.join(linked(mapping).select("file_name", "hand_id", "match_confidence"), "file_name")
        .join(dealt, "hand_id")
        .join(_street_actions(hand_actions), ["hand_id", "street"], "left")
    )
    advice, result = F.col("gpt_action"), F.col("hero_result")
    money, folded = F.col("hero_put_money_in"), F.col("hero_folded_on_street")
    play = advice.isin(*PLAY)
    lost = result.isin("lost", "folded")
    big_blind = F.col("big_blind")
    category = (
        F.when((advice == "fold") & (money == 1) & (result == "won"), "ignored_fold_won")
        .when((advice == "fold") & (money == 1) & lost, "ignored_fold_lost")
        .when(play & (money == 1) & (result == "won"), "followed_play_won")
        .when(play & (money == 1) & lost, "followed_play_lost")
        .when(play & (folded == 1), "ignored_play_folded")
        .when((advice == "fold") & (folded == 1), "followed_fold")
        .otherwise("unknown")
    )
    stake = F.col("chips_start") - F.coalesce("hero_amount_won", F.lit(0.0))
    profit = (
        F.when(result == "won", ratio(F.col("hero_amount_won"), big_blind))
        .when(result == "lost", -ratio(stake, big_blind))
        .otherwise(F.lit(0.0))
    )
    showdown = F.col("had_showdown") == 1
    return df.select(
        "file_name", "screenshot_at", "stage", F.col("street").alias("screenshot_street"), "hero_cards", "hero_pos",
        "hero_stack", "pot", "to_call", "match_confidence", "gpt_recommendation", "gpt_action", "gpt_amount",
        "hand_id", "hand_timestamp", "tournament_id", "board", F.col("total_pot").alias("final_pot"), "hero_result",
        "hero_amount_won", "hero_vpip", "hero_pfr", "hero_first_action", "hero_put_money_in", "hero_folded_on_street",
        street_followed(advice, money, folded, F.col("hero_first_action") == "check").alias("followed_gpt_advice"),
        category.alias("outcome_category"),
        profit.alias("profit_bb"),
        "had_showdown", "winner_hole_cards", "winner_hand_description", "showdown_pot_won",
        F.when((result == "folded") & showdown, ratio(F.col("showdown_pot_won"), big_blind)).alias("missed_pot_bb"),
        F.coalesce(play & (folded == 1) & showdown, F.lit(False)).alias("folded_with_showdown_data"),
    )


def hand_line_steps(screenshots: DataFrame, mapping: DataFrame, hand_actions: DataFrame) -> DataFrame:
    """One row per linked capture: advice and verdict on its street. Long form of the lines."""
    steps = (
        linked(mapping)
        .select("file_name", "hand_id")
        .join(screenshots.select("file_name", "screenshot_at", "street", "gpt_action"), "file_name")
        .join(_street_actions(hand_actions), ["hand_id", "street"], "left")
    )
    money, folded = F.col("hero_put_money_in"), F.col("hero_folded_on_street")
    verdict = street_followed(F.col("gpt_action"), money, folded, (money == 0) & (folded == 0))
    label = F.when(verdict, "followed").when(~verdict, "deviated").otherwise("unknown")
    return steps.select("hand_id", "file_name", "screenshot_at", "street", "gpt_action", label.alias("gpt_compliance"))


def hand_line_analysis(
    screenshots: DataFrame,
    mapping: DataFrame,
    hands: DataFrame,
    hand_players: DataFrame,
    hand_actions: DataFrame,
) -> DataFrame:
    """Each hand: advice and verdict per street and deviations; ``hand_lines`` has the lines.

    The first deviating street is the alphabetical minimum.
    """
    steps = hand_line_steps(screenshots, mapping, hand_actions)
    deviated = F.col("gpt_compliance") == "deviated"
    pivot = [
        F.max(F.when(F.col("street") == street, F.col(column))).alias(f"{street}_{name}")
        for street in STREETS
        for column, name in (("gpt_action", "gpt"), ("gpt_compliance", "compliance"))
    ]
    per_hand = steps.groupBy("hand_id").agg(
        *pivot,
        count_where(deviated).alias("deviation_count"),
        F.max(deviated.cast("int")).alias("had_deviation"),
        F.min(F.when(deviated, F.col("street"))).alias("first_deviation_street"),
    )
    dealt = hands_with_hero(
        hands, hand_players, ["hero_cards", "hero_position", "board", "hero_result", "total_pot"], ["amount_won"]
    )
    return dealt.join(per_hand, "hand_id")


def hand_lines(steps: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """Advice and verdicts of each hand in the order of its captures, in parts of ``part_rows`` captures.

    ``steps`` is ``hand_line_steps``. Nearly every hand has one part, number 0.
    """
    values = {"gpt_line": F.col("gpt_action"), "compliance_line": F.col("gpt_compliance")}
    parts = list_parts(steps, ["hand_id"], ["screenshot_at", "file_name"], values, part_rows)
    return parts.withColumns({c: F.array_join(c, "->") for c in values})


def gpt_compliance_stats(base: DataFrame, hand_actions: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Obedience and results by stage, table type, street, stack and phase of the tournament.

    ``base`` is ``decision_base``. Each action of the hero on the street counts.
    """
    numbered = running(
        base, ["tournament_id"], ["screenshot_at", "file_name"], number="nr", total="decisions", slice_rows=slice_rows
    )
    advice, action, n = F.col("gpt_action"), F.col("hero_action"), F.col("n")
    stack_bb = rounded(ratio(F.col("hero_stack"), F.col("big_blind") / 100), 1)
    lost_share = F.lit(0.1).cast("double")
    profit = (
        F.when(won(), ratio(F.col("amount_won"), F.col("big_blind")))
        .when(
            F.col("hero_result").isin("lost", "folded"),
            -ratio(F.col("total_pot") - F.col("amount_won"), F.col("big_blind")) * lost_share,
        )
        .otherwise(F.lit(0.0))
    )
    # Thirds are compared in integers: a number up to 33 % of the total.
    phase = (
        F.when(F.col("nr") * 100 <= F.col("decisions") * 33, "early")
        .when(F.col("nr") * 100 <= F.col("decisions") * 66, "middle")
        .otherwise("late")
    )
    judged = (
        numbered.join(hero_action_counts(hand_actions), ["hand_id", "street"])
        .withColumns(
            {
                "followed": followed(advice, action, checks=True),
                "profit_bb": profit,
                "table_type": table_type(F.col("players")),
                "stack_category": binned(stack_bb, [(10, "short_<10bb"), (20, "medium_10-20bb")], "deep_>20bb", strict=True),
                "tournament_phase": phase,
            }
        )
        .filter("followed IS NOT NULL")
    )
    yes, no = F.col("followed"), ~F.col("followed")
    total = F.sum("n")
    return judged.groupBy("stage", "table_type", "street", "stack_category", "tournament_phase").agg(
        total.alias("total_decisions"),
        count_where(yes, n).alias("followed_count"),
        count_where(no, n).alias("deviated_count"),
        pct(count_where(yes, n), total).alias("compliance_pct"),
        rounded(weighted_mean(F.col("profit_bb"), n, yes), 2).alias("avg_profit_bb_followed"),
        count_where(won(yes), n).alias("wins_when_followed"),
        rounded(weighted_mean(F.col("profit_bb"), n, no), 2).alias("avg_profit_bb_deviated"),
        count_where(won(no), n).alias("wins_when_deviated"),
        count_where(no & (advice == "fold"), n).alias("ignored_fold_count"),
        count_where(no & plays(advice), n).alias("ignored_play_count"),
    )


def deviation_outcome_analysis(base: DataFrame, hand_actions: DataFrame, min_rows: int = 3) -> DataFrame:
    """Results by decision type, stage, table type, action and all-in; small groups left out."""
    acts = hero_action_counts(hand_actions.filter("action_type <> 'check'"), "amount")
    near_all = F.col("amount") >= F.col("chips_start") * F.lit(0.95).cast("double")
    judged = (
        base.join(acts, ["hand_id", "street"])
        .withColumns(
            {
                "decision_type": decision_type(F.col("gpt_action"), F.col("hero_action")),
                "table_type": table_type(F.col("players")),
                "hero_went_allin": F.coalesce(near_all, F.lit(False)),
                "won_bb": ratio(F.col("amount_won"), F.col("big_blind")),
            }
        )
        .filter("decision_type <> 'unknown'")
    )
    n, total = F.col("n"), F.sum("n")
    result = F.col("hero_result")
    grouped = judged.groupBy("decision_type", "stage", "table_type", "hero_action", "hero_went_allin").agg(
        total.alias("total"),
        count_where(won(), n).alias("wins"),
        count_where(result == "lost", n).alias("losses"),
        count_where(result == "folded", n).alias("folded_later"),
        pct(count_where(won(), n), total).alias("win_rate_pct"),
        rounded(F.sum(F.when(won(), F.col("won_bb") * n).otherwise(0.0)), 1).alias("total_won_bb"),
        rounded(weighted_mean(F.col("won_bb"), n, won()), 1).alias("avg_won_bb"),
    )
    return grouped.filter(F.col("total") >= min_rows)


def _judged_hands(
    sessions: DataFrame, mapping: DataFrame, screenshots: DataFrame, hand_actions: DataFrame
) -> DataFrame:
    """Session hands with each advised capture and each action of the hero on its street."""
    shots = screenshots.filter("gpt_action IS NOT NULL").select("file_name", "street", "gpt_action")
    advised = linked(mapping).select("file_name", "hand_id").join(shots, "file_name")
    # Equal advice on one street of a hand is counted before it meets the actions.
    advised = advised.groupBy("hand_id", "street", "gpt_action").agg(F.count(F.lit(1)).alias("shots"))
    verdict = followed(F.col("gpt_action"), F.col("hero_action"), checks=False)
    return (
        advised.join(hero_action_counts(hand_actions), ["hand_id", "street"])
        .withColumn("followed", verdict)
        .filter("followed IS NOT NULL")
        .withColumn("n", F.col("n") * F.col("shots"))
        .join(sessions, "hand_id")
    )


def tilt_detection(
    screenshots: DataFrame,
    mapping: DataFrame,
    hands: DataFrame,
    hand_players: DataFrame,
    hand_actions: DataFrame,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Obedience by the running profit of the tournament and after a big loss."""
    dealt = hands_with_hero(
        hands, hand_players, ["tournament_id", "hand_timestamp", "hero_result", "big_blind"], ["net_profit"]
    )
    keys, order = ["tournament_id"], ["hand_timestamp", "hand_id"]
    sums, lags = {"running_profit": F.col("net_profit")}, {"previous_profit": "net_profit"}
    sessions = running(dealt, keys, order, sums, lags=lags, slice_rows=slice_rows)
    profit, big = F.col("running_profit"), F.col("big_blind")
    sessions = sessions.select(
        "hand_id",
        "hero_result",
        F.when(profit > big * 20, "winning_big")
        .when(profit > 0, "winning")
        .when(profit > big * -20, "losing")
        .otherwise("losing_big")
        .alias("session_status"),
        F.coalesce(F.col("previous_profit") < big * -10, F.lit(False)).alias("after_big_loss"),
    )
    yes, no, n = F.col("followed"), ~F.col("followed"), F.col("n")
    advice = F.col("gpt_action")
    judged = _judged_hands(sessions, mapping, screenshots, hand_actions)
    return judged.groupBy("session_status", "after_big_loss").agg(
        F.sum("n").alias("decisions"),
        count_where(yes, n).alias("followed_count"),
        pct(count_where(yes, n), F.sum("n")).alias("compliance_pct"),
        count_where(no & (advice == "fold"), n).alias("ignored_fold_count"),
        count_where(no & plays(advice), n).alias("ignored_play_count"),
        count_where(won(no), n).alias("wins_when_deviated"),
        count_where(not_won(no), n).alias("losses_when_deviated"),
    )


def tilt_consecutive_losses(
    hands: DataFrame,
    mapping: DataFrame,
    screenshots: DataFrame,
    hand_actions: DataFrame,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Obedience by the number of hands not won among the five before."""
    dealt = hands.select("tournament_id", "hand_id", "hand_timestamp", "hero_result")
    losses = F.when(F.col("hero_result") != "won", 1).otherwise(0)
    streaks = lookback(
        dealt, ["tournament_id"], ["hand_timestamp", "hand_id"], sums={"losses": (losses, 5)}, slice_rows=slice_rows
    )
    label = F.when(F.col("losses") >= 4, "4+ losses").when(F.col("losses") >= 2, "2-3 losses").otherwise("0-1 losses")
    sessions = streaks.select("hand_id", "hero_result", label.alias("recent_loss_streak"))
    yes, no, n = F.col("followed"), ~F.col("followed"), F.col("n")
    judged = _judged_hands(sessions, mapping, screenshots, hand_actions)
    return judged.groupBy("recent_loss_streak").agg(
        F.sum("n").alias("decisions"),
        pct(count_where(yes, n), F.sum("n")).alias("compliance_pct"),
        count_where(no & (F.col("gpt_action") == "fold"), n).alias("ignored_fold_count"),
        count_where(won(no), n).alias("wins_when_deviated"),
    )


def headsup_analysis(base: DataFrame, hand_actions: DataFrame) -> DataFrame:
    """Heads-up against larger tables: advice given, obedience and wins."""
    judged = (
        base.join(hero_action_counts(hand_actions), ["hand_id", "street"])
        .withColumn("decision_type", decision_type(F.col("gpt_action"), F.col("hero_action")))
        .filter("decision_type <> 'unknown'")
        .withColumns({"is_headsup": F.col("players") == 2, "gpt_recommended": F.col("gpt_action")})
    )
    n, total = F.col("n"), F.sum("n")
    kind = F.col("decision_type")
    yes, no = kind.startswith("followed"), kind.startswith("ignored")
    grouped = judged.groupBy("is_headsup", "stage", "gpt_recommended").agg(
        total.alias("total_decisions"),
        count_where(yes, n).alias("followed_count"),
        pct(count_where(yes, n), total).alias("compliance_pct"),
        count_where(won(yes), n).alias("wins_when_followed"),
        pct(count_where(won(yes), n), count_where(yes, n)).alias("win_rate_when_followed"),
        count_where(won(no), n).alias("wins_when_deviated"),
        pct(count_where(won(no), n), count_where(no, n)).alias("win_rate_when_deviated"),
    )
    # The window sees a handful of rows per stage.
    of_stage = F.sum("total_decisions").over(Window.partitionBy("is_headsup", "stage"))
    return grouped.withColumn("pct_of_recommendations", pct(F.col("total_decisions"), of_stage))


def headsup_fold_analysis(
    screenshots: DataFrame,
    mapping: DataFrame,
    hands: DataFrame,
    hand_players: DataFrame,
    hand_actions: DataFrame,
    screenshot_players: DataFrame,
) -> DataFrame:
    """Heads-up advice to fold: obeyed or not, and what ignoring it brought."""
    single = screenshot_players.groupBy("file_name").count().filter("count = 1").select("file_name")
    shots = screenshots.filter("gpt_action = 'fold'").select("file_name", "stage", "street")
    dealt = hands_with_hero(hands, hand_players, ["hero_result", "big_blind"], ["net_profit"])
    rows = (
        shots.join(single, "file_name", "left_semi")
        .join(linked(mapping).select("file_name", "hand_id"), "file_name")
        .join(dealt, "hand_id")
        .join(hero_action_counts(hand_actions), ["hand_id", "street"], "left")
        .withColumns(
            {"n": F.coalesce("n", F.lit(1)), "net_bb": ratio(F.col("net_profit"), F.col("big_blind"))}
        )
    )
    n, net = F.col("n"), F.col("net_bb")
    played = F.coalesce(plays(F.col("hero_action")), F.lit(False))

    def mean(condition: Column) -> Column:
        return rounded(weighted_mean(net, n, condition), 1)

    return rows.groupBy("stage", "street").agg(
        F.sum("n").alias("gpt_fold_recommendations"),
        count_where(F.col("hero_action") == "fold", n).alias("hero_folded"),
        count_where(played, n).alias("hero_played"),
        count_where(won(played), n).alias("won_when_ignored_fold"),
        count_where(not_won(played), n).alias("lost_when_ignored_fold"),
        pct(count_where(won(played), n), count_where(played, n)).alias("win_rate_when_ignored_fold_pct"),
        mean(won(played)).alias("avg_won_bb"),
        mean(not_won(played)).alias("avg_lost_bb"),
        rounded(F.sum(F.when(played, net * n).otherwise(0.0)), 1).alias("total_net_bb_ignoring_fold"),
        mean(played).alias("avg_net_bb_per_hand"),
    )
