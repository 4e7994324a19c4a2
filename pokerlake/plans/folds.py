"""What a folded hand would have made at showdown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pokerlake.functions.numbers import pct, ratio, rounded
from pokerlake.operators.showdown import with_showdown
from pokerlake.plans.parts import linked


def fold_showdown_analysis(
    screenshots: DataFrame, mapping: DataFrame, hands: DataFrame, hand_players: DataFrame, hand_actions: DataFrame
) -> DataFrame:
    """Each folded hand with each winner, the advice on the street of the fold and the simulated showdown.

    The street is the alphabetical minimum of those with a fold. The showdown is run
    once per hand and winner, before the advice rows are attached.
    """
    fold = (
        hand_actions.filter("is_hero AND action_type = 'fold'")
        .groupBy("hand_id")
        .agg(F.min("street").alias("fold_street"))
    )
    folded = hands.filter("hero_result = 'folded'").select(
        "hand_id", "hand_timestamp", "tournament_id", "hero_cards", "hero_position", "board", "total_pot", "big_blind"
    )
    winners = hand_players.filter("won_hand").select(
        "hand_id",
        F.col("player_name").alias("winner_name"),
        F.col("hole_cards").alias("winner_cards"),
        F.col("result_description").alias("winner_hand"),
        F.col("amount_won").alias("pot_won"),
        F.col("went_to_showdown").alias("winner_showed_cards"),
    )
    full = F.coalesce(F.size("board") == 5, F.lit(False))
    met = folded.join(fold, "hand_id").join(winners, "hand_id")
    # Without a full board nothing is ranked: NULL cards keep the ranking from running.
    met = met.withColumns(
        {
            "_hero": F.when(full, F.col("hero_cards")),
            "_rivals": F.array("winner_cards"),
            "_board": F.when(full, F.array_join("board", "")),
        }
    )
    met = with_showdown(met, "_hero", "_rivals", "_board", "_sim").drop("_rivals", "_board")
    both = F.col("_hero").isNotNull() & F.col("winner_cards").isNotNull()
    met = met.withColumns(
        {
            "showdown_simulation": F.when(both, F.col("_sim")),
            "hero_would_have_won": F.when(both, F.col("_sim.hero_would_win")),
            "hero_hand_at_showdown": F.when(F.col("_hero").isNotNull(), F.col("_sim.hero_hand")),
            "pot_won_bb": rounded(ratio(F.col("pot_won"), F.col("big_blind")), 1),
        }
    ).drop("_hero", "_sim")
    advice = (
        linked(mapping)
        .select("file_name", "hand_id")
        .join(
            screenshots.select(
                "file_name",
                F.col("street").alias("fold_street"),
                F.col("gpt_action").alias("gpt_advised"),
                "gpt_recommendation",
                F.col("pot").alias("pot_at_decision"),
                "to_call",
                "hero_stack",
            ),
            "file_name",
        )
        .drop("file_name")
    )
    df = met.join(advice, ["hand_id", "fold_street"], "left")
    call, pot, stack = F.col("to_call"), F.col("pot_at_decision"), F.col("hero_stack")
    view = (
        F.when(F.col("gpt_advised") == "fold", "GPT_agreed_fold")
        .when(F.col("gpt_advised").isin("call", "raise", "bet"), "GPT_said_play")
        .otherwise("no_gpt_advice")
    )
    lost = rounded(ratio(-F.coalesce(call.cast("double"), F.lit(0.0)), F.col("big_blind")), 1)
    would_win = F.col("hero_would_have_won")
    return df.withColumns(
        {
            "gpt_vs_hero": view,
            "pot_odds_pct": F.when((call > 0) & (pot > 0), pct(call, pot + call)),
            "stack_commit_pct": F.when((stack > 0) & (call > 0), pct(call, stack)),
            "potential_profit_bb": F.when(would_win, F.col("pot_won_bb")).when(~would_win, lost),
        }
    )
