"""Card text, two-card hand classes and positions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ranks from low to high, worth 2 to 14.
RANKS = "23456789TJQKA"

# Seat names by player count, clockwise from the button.
SEAT_NAMES = {
    1: ["BTN"],
    2: ["BTN", "SB"],
    3: ["BTN", "SB", "BB"],
    4: ["BTN", "SB", "BB", "UTG"],
    5: ["BTN", "SB", "BB", "UTG", "MP"],
    6: ["BTN", "SB", "BB", "UTG", "MP", "CO"],
    7: ["BTN", "SB", "BB", "UTG", "UTG+1", "MP", "CO"],
    8: ["BTN", "SB", "BB", "UTG", "UTG+1", "MP", "HJ", "CO"],
    9: ["BTN", "SB", "BB", "UTG", "UTG+1", "MP", "MP+1", "HJ", "CO"],
}

# Positions that act after the given one before the flop.
ACTS_LATER = {
    "UTG": ["UTG+1", "HJ", "MP", "CO", "BTN", "SB", "BB"],
    "UTG+1": ["HJ", "MP", "CO", "BTN", "SB", "BB"],
    "HJ": ["CO", "BTN", "SB", "BB"],
    "MP": ["CO", "BTN", "SB", "BB"],
    "CO": ["BTN", "SB", "BB"],
    "BTN": ["SB", "BB"],
    "SB": ["BB"],
}


def card_rank(rank: Column) -> Column:
    """2..14 for a rank character, NULL for anything else."""
    at = F.instr(F.lit(RANKS), F.nullif(rank, F.lit("")))
    return F.when(at > 0, at + 1)


def _ranks(cards: Column) -> tuple[Column, Column]:
    return card_rank(F.substring(cards, 1, 1)), card_rank(F.substring(cards, 3, 1))


def is_suited(cards: Column) -> Column:
    return F.coalesce(F.substring(cards, 2, 1) == F.substring(cards, 4, 1), F.lit(False))


def is_pair(cards: Column) -> Column:
    return F.coalesce(F.substring(cards, 1, 1) == F.substring(cards, 3, 1), F.lit(False))


def high_rank(cards: Column) -> Column:
    return F.greatest(*_ranks(cards))


def low_rank(cards: Column) -> Column:
    return F.least(*_ranks(cards))


def hand_class(cards: Column) -> Column:
    """One of the 169 starting hands: ``77``, ``AKs`` or ``T9o``."""
    first, second = F.substring(cards, 1, 1), F.substring(cards, 3, 1)
    a, b = _ranks(cards)
    suffix = F.when(is_suited(cards), "s").otherwise("o")
    return (
        F.when(is_pair(cards), F.concat(first, first))
        .when(a >= b, F.concat(first, second, suffix))
        .otherwise(F.concat(second, first, suffix))
    )


def rank_letter(rank: Column) -> Column:
    """Inverse of ``card_rank``; tens print as ``T``."""
    return F.substring(F.lit(RANKS), (rank - 1).cast("int"), F.lit(1))


def hand_category(cards: Column) -> Column:
    """Coarse class of a shoving hand.

    The ace-king, strong-ace and king-queen classes ask for the higher card first,
    as the card text is written; the same cards in the other order fall through to
    the wider classes below them.
    """
    a, b = _ranks(cards)
    pair, suited = is_pair(cards), is_suited(cards)
    gap = F.abs(a - b)

    def by_suit(yes: str, no: str) -> Column:
        return F.when(suited, yes).otherwise(no)

    return (
        F.when(pair & (a >= 11), "premium_pair")
        .when((a == 14) & (b == 13), "premium_broadway")
        .when(pair & (a >= 9), "medium_pair")
        .when((a == 14) & (b >= 11), "strong_ace")
        .when((a == 13) & (b == 12), "strong_broadway")
        .when(pair & (a >= 6), "small_pair")
        .when(pair, "micro_pair")
        .when((a == 14) | (b == 14), by_suit("Axs", "Axo"))
        .when((a >= 10) & (b >= 10), by_suit("broadway_suited", "broadway_offsuit"))
        .when(suited & (gap == 1), "suited_connector")
        .when(suited & (gap <= 3), "suited_gapper")
        .when(suited & ((a == 13) | (b == 13)), "Kxs")
        .otherwise("trash")
    )


def strength_score(cards: Column) -> Column:
    """Higher rank + half the lower one, +2 when suited, +5 for a pair."""
    return (
        high_rank(cards)
        + low_rank(cards) * F.lit(0.5).cast("double")
        + is_suited(cards).cast("int") * 2
        + is_pair(cards).cast("int") * 5
    ).cast("double")


def position_group(position: Column) -> Column:
    return (
        F.when(position.isin("UTG", "UTG+1", "EP"), "early")
        .when(position.isin("MP", "MP+1", "HJ"), "middle")
        .when(position.isin("CO", "BTN"), "late")
        .when(position.isin("SB", "BB"), "blinds")
        .otherwise("unknown")
    )


def position_code(position: Column) -> Column:
    """0 early, 1 middle (and unknown), 2 late, 3 blinds."""
    return (
        F.when(position.isin("UTG", "UTG+1", "UTG+2"), 0)
        .when(position.isin("CO", "BTN"), 2)
        .when(position.isin("SB", "BB"), 3)
        .otherwise(1)
    )


def norm_position(position: Column) -> Column:
    """Synonyms of the button and of the first seat to act become one name."""
    return F.when(position.isin("BTN", "BU", "D"), "BTN").when(position.isin("UTG", "EP"), "UTG").otherwise(position)


def norm_cards(cards: Column) -> Column:
    """The same two cards in the same order, whichever way they were written."""
    first, second = F.substring(cards, 1, 2), F.substring(cards, 3, 2)
    return F.when(first <= second, cards).otherwise(F.concat(second, first))


def acts_after(position: Column, other: Column) -> Column:
    """True when ``other`` has yet to act before the flop once ``position`` has acted."""
    later = F.create_map(*[c for k, v in ACTS_LATER.items() for c in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.coalesce(F.array_contains(F.try_element_at(later, position), other), F.lit(False))


def cards_to_array(text: Column) -> Column:
    """Cards of a text such as ``AhKd``, ``ah kd`` or ``["Ah", "Kd"]`` as ``[Ah, Kd]``.

    Tokens whose first two characters are not a rank and a suit are left out; ``1``
    stands for ten.
    """
    plain = F.trim(F.translate(F.coalesce(text, F.lit("")), ",[]\"'", " "))
    words = F.split(plain, r"\s+")
    pairs = F.regexp_extract_all(plain, F.lit(r"(?s)(..?)"), F.lit(1))
    tokens = F.when((F.size(words) == 1) & (F.length(plain) >= 4), pairs).otherwise(words)
    valid = F.filter(tokens, lambda t: t.rlike("^[2-9TJQKAtjqka1][hdcsHDCS]"))
    return F.transform(
        valid,
        lambda t: F.concat(
            F.translate(F.upper(F.substring(t, 1, 1)), "1", "T"), F.lower(F.substring(t, 2, 1))
        ),
    )
