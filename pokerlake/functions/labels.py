"""Bins and labels used by the analyses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

PLAY = ("call", "raise", "bet")
# Posts and shown cards are not decisions.
NOT_DECISIONS = ("post_ante", "post_sb", "post_bb", "show")
STREETS = ["preflop", "flop", "turn", "river"]


def binned(value: Column, steps: list[tuple[float, str]], above: str, strict: bool = False) -> Column:
    """Label of the first upper limit that holds ``value``; NULL lands in ``above``."""
    holds = (lambda limit: value < limit) if strict else (lambda limit: value <= limit)
    first, *rest = steps
    chain = reduce(lambda c, s: c.when(holds(s[0]), s[1]), rest, F.when(holds(first[0]), first[1]))
    return chain.otherwise(above)


def finish_stage(place: Column) -> Column:
    return (
        F.when(place == 1, "1_champion")
        .when(place == 2, "2_runner_up")
        .when(place == 3, "3_third")
        .when(place == 4, "4_fourth")
        .when(place.between(5, 6), "5_mid_final")
        .when(place.between(7, 9), "6_early_final")
        .when(place >= 10, "7_rush_bust")
    )


def street_order(street: Column) -> Column:
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, STREETS)), street), F.lit(0)), F.lit(5))


def decision_type(advice: Column, action: Column) -> Column:
    """followed/ignored × fold/play for one advice and one action, else ``unknown``."""
    return (
        F.when((advice == "fold") & (action == "fold"), "followed_fold")
        .when((advice == "fold") & action.isin(*PLAY), "ignored_fold")
        .when(advice.isin(*PLAY) & action.isin(*PLAY), "followed_play")
        .when(advice.isin(*PLAY) & (action == "fold"), "ignored_play")
        .otherwise("unknown")
    )


def followed(advice: Column, action: Column, checks: bool) -> Column:
    """Whether the action obeys the advice; NULL when that cannot be told.

    ``checks`` also counts an advised check that was checked.
    """
    kind = decision_type(advice, action)
    verdict = F.when(kind.startswith("followed"), True).when(kind.startswith("ignored"), False)
    return verdict.when((advice == "check") & (action == "check"), True) if checks else verdict


def street_followed(advice: Column, money: Column, folded: Column, checked: Column) -> Column:
    """Verdict from what the player did over a whole street (flags 1/0, NULL without actions)."""
    play = advice.isin(*PLAY)
    return (
        F.when((advice == "fold") & (folded == 1), True)
        .when((advice == "fold") & (money == 1), False)
        .when((advice == "check") & checked, True)
        .when(play & (money == 1), True)
        .when(play & (folded == 1), False)
    )


def table_type(players: Column) -> Column:
    return F.when(players == 2, "heads_up").otherwise("multiway")


def small_raise(recommendation: Column) -> Column:
    """Advice texts that name a raise of two or three blinds (the patterns are substring tests)."""
    return recommendation.like("%2.%BB%") | recommendation.like("%2 BB%") | recommendation.like("%3%BB%")


def spot_stack(stack: Column) -> Column:
    return binned(stack, [(12, "short_10-12bb"), (15, "short_13-15bb"), (20, "medium_16-20bb")], "deep_20+bb")


def sample_confidence(hands: Column) -> Column:
    return F.when(hands >= 30, "high").when(hands >= 10, "medium").otherwise("low")
