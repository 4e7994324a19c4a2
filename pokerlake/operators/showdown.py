"""Ranking poker hands over whole tables: sets of ranks as bits, looked up in constant tables."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pokerlake.functions.cards import RANKS, cards_to_array
from pokerlake.functions.numbers import let

# Names of the ten ranks, best first; both straight flushes are class 1.
RANK_NAMES = [
    "Royal Flush",
    "Straight Flush",
    "Four of a Kind",
    "Full House",
    "Flush",
    "Straight",
    "Three of a Kind",
    "Two Pair",
    "One Pair",
    "High Card",
]
# Marks of hands that cannot be ranked.
NO_RANK, NO_WINNER = 9999, -99


# A rank is a bit of 13 (the deuce is bit 0) and a digit of four bits (2 to 14).
DIGIT = 4
TOP = 16  # place of the first of five digits


def _ranks_of(mask: int) -> list[int]:
    """Ranks of the bits of a mask, the highest first."""
    return [bit + 2 for bit in range(12, -1, -1) if mask >> bit & 1]


def _top_five(mask: int) -> int:
    """The five highest ranks as digits, the first at the top."""
    return sum(rank << (TOP - DIGIT * i) for i, rank in enumerate(_ranks_of(mask)[:5]))


def _straight_top(mask: int) -> int:
    """The top rank of the best straight, 0 without one; the ace also counts as one."""
    held = {*_ranks_of(mask), *([1] if mask >> 12 & 1 else [])}
    return max((top for top in range(5, 15) if held.issuperset(range(top - 4, top + 1))), default=0)


@lru_cache(maxsize=None)
def _spelled(rule) -> str:
    return ",".join(str(rule(mask)) for mask in range(1 << 13))


def _table(rule) -> Column:
    """The rule for all sets of ranks, as an array that the optimizer folds into one constant."""
    return F.split(F.lit(_spelled(rule)), ",").cast("array<int>")


def _masks(cards: Column) -> Column:
    """Sets of ranks held at least once to four times, ranks by suit (16 bits each) and cards by suit (a digit each)."""

    def add(state: Column, card: Column) -> Column:
        rank = F.instr(F.lit(RANKS), F.substring(card, 1, 1)) - 1
        suit = F.instr(F.lit("cdhs"), F.substring(card, 2, 1)) - 1
        bit = F.call_function("shiftleft", F.lit(1), rank)
        held = [state[f"m{n}"] for n in range(1, 5)]
        more = [below.bitwiseAND(bit).bitwiseOR(own).alias(f"m{n}") for n, (below, own) in enumerate(zip(held, held[1:], strict=False), 2)]
        return F.struct(
            held[0].bitwiseOR(bit).alias("m1"),
            *more,
            state["suited"].bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), suit * 16 + rank)).alias("suited"),
            (state["count"] + F.call_function("shiftleft", F.lit(1), suit * DIGIT)).alias("count"),
        )

    none = F.struct(*[F.lit(0).alias(f"m{n}") for n in range(1, 5)], F.lit(0).cast("bigint").alias("suited"), F.lit(0).alias("count"))
    return F.aggregate(cards, none, add)


def hand_strength(cards: Column) -> Column:
    """Comparable strength of the best five of the given cards, as one number.

    ``10 - rank`` (rank 1 is best) stands above five digits with the ranks that break ties, so
    that the larger number is the better hand. Four of a kind compares by its rank alone: the
    fifth card does not count. Two tables over all sets of ranks, the five highest and the top
    of the best straight, take the place of searches.
    """
    top_five, straight = _table(_top_five), _table(_straight_top)

    def at(table: Column, mask: Column) -> Column:
        return F.get(table, mask.cast("int"))

    def digit(rank: Column, place: int) -> Column:
        return F.shiftleft(rank, TOP - DIGIT * place)

    def made(m: Column) -> Column:
        lanes = [F.shiftright(m["suited"], 16 * s).bitwiseAND(F.lit(8191)) for s in range(4)]
        flushes = [F.when(F.shiftright(m["count"], DIGIT * s).bitwiseAND(F.lit(15)) >= 5, lane).otherwise(0) for s, lane in enumerate(lanes)]
        return F.struct(
            m["m1"].alias("all"),
            m["m2"].alias("pairs"),
            F.greatest(*[at(straight, f) for f in flushes]).alias("straight_flush"),
            F.greatest(*[at(top_five, f) for f in flushes]).alias("flush"),
            at(straight, m["m1"]).alias("straight"),
            *[F.shiftright(at(top_five, m[f"m{n}"]), TOP).alias(name) for n, name in ((4, "four"), (3, "three"), (2, "two"))],
        )

    def without(mask: Column, *ranks: Column) -> Column:
        for rank in ranks:
            mask = mask.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1), rank - 2)))
        return mask

    def highest(mask: Column, count: int) -> Column:
        """The highest ranks of a set as digits, the last at place 0."""
        return F.shiftright(at(top_five, mask), TOP - DIGIT * (count - 1))

    def strength(rank: Column | int, ties: Column) -> Column:
        return F.shiftleft(10 - (F.lit(rank) if isinstance(rank, int) else rank), TOP + DIGIT).bitwiseOR(ties)

    def scored(m: Column) -> Column:
        three, two = m["three"], m["two"]
        # Further ranks held twice, below the triple and below the higher pair.
        under, second = without(m["pairs"], three), without(m["pairs"], two)
        low = highest(second, 1)
        return (
            F.when(m["straight_flush"] > 0, strength(F.when(m["straight_flush"] == 14, 1).otherwise(2), digit(m["straight_flush"], 0)))
            .when(m["four"] > 0, strength(3, digit(m["four"], 0)))
            .when((three > 0) & (under > 0), strength(4, digit(three, 0).bitwiseOR(digit(highest(under, 1), 1))))
            .when(m["flush"] > 0, strength(5, m["flush"]))
            .when(m["straight"] > 0, strength(6, digit(m["straight"], 0)))
            .when(three > 0, strength(7, digit(three, 0).bitwiseOR(digit(highest(without(m["all"], three), 2), 2))))
            .when((two > 0) & (second > 0), strength(8, digit(two, 0).bitwiseOR(digit(low, 1)).bitwiseOR(digit(highest(without(m["all"], two, low), 1), 2))))
            .when(two > 0, strength(9, digit(two, 0).bitwiseOR(digit(highest(without(m["all"], two), 3), 3))))
            .otherwise(strength(10, at(top_five, m["all"])))
        )

    return let(let(_masks(cards), made), scored)


def rank_of(strength: Column) -> Column:
    """Rank 1 (best) to 10 of a strength."""
    return 10 - F.shiftright(strength, TOP + DIGIT)


def _name(rank: Column, names: list[str] = RANK_NAMES) -> Column:
    return F.get(F.array(*map(F.lit, names)), rank - 1)


def with_hand_rank(df: DataFrame, hole: str, board: str, out: str = "evaluation") -> DataFrame:
    """Add ``out``: rank 1..10 (best first), hand_class 1..9 and the name of the hand.

    Needs two hole and three board cards; otherwise rank 9999, class 0, ``invalid``.
    """
    invalid = F.struct(
        F.lit(NO_RANK).alias("rank"), F.lit(0).alias("hand_class"), F.lit("invalid").alias("hand_name")
    )

    def evaluate(held: Column) -> Column:
        enough = (F.size(held["hole"]) >= 2) & (F.size(held["board"]) >= 3)
        rank = rank_of(hand_strength(F.concat(held["hole"], held["board"])))
        valid = let(
            rank,
            lambda r: F.struct(
                r.alias("rank"), F.greatest(r - 1, F.lit(1)).alias("hand_class"), _name(r).alias("hand_name")
            ),
        )
        return F.when(enough, valid).otherwise(invalid)

    parsed = F.struct(cards_to_array(F.col(hole)).alias("hole"), cards_to_array(F.col(board)).alias("board"))
    return df.withColumn(out, let(parsed, evaluate))


def with_showdown(df: DataFrame, hero: str, opponents: str, board: str, out: str = "showdown") -> DataFrame:
    """Add ``out``: who wins of the hero and an array of opponents on a full board.

    winner_index is 0 for the hero, i for the i-th opponent (the first of equals) and
    -1 when an opponent ties with a winning hero; a tie counts as a win of the hero.
    Opponents without two cards do not take part. Without two hero and five board
    cards the index is -99.
    """
    names = ["Straight Flush", *RANK_NAMES[1:]]
    invalid = F.struct(
        F.lit(NO_WINNER).alias("winner_index"),
        F.lit(NO_RANK).alias("hero_rank"),
        F.lit("invalid").alias("hero_hand"),
        F.lit(NO_RANK).alias("winning_rank"),
        F.lit("invalid").alias("winning_hand"),
        F.lit(None).cast("boolean").alias("hero_would_win"),
    )

    def compare(held: Column) -> Column:
        def strength(cards: Column) -> Column:
            return F.when(F.size(cards) >= 2, hand_strength(F.concat(cards, held["board"])))

        # The hero is item 0 of the hands, so that the ranking is built once.
        everyone = F.transform(F.concat(F.array(held["hero"]), held["opponents"]), strength)
        split = lambda hands: F.struct(hands[0].alias("hero"), F.slice(hands, 2, F.size(hands) - 1).alias("opponents"))
        enough = (F.size(held["hero"]) >= 2) & (F.size(held["board"]) >= 5)
        return F.when(enough, let(let(everyone, split), verdict)).otherwise(invalid)

    def verdict(scored: Column) -> Column:
        rival = F.array_max(scored["opponents"])
        hero = scored["hero"]
        best = F.greatest(hero, rival)
        index = (
            F.when(rival > hero, F.array_position(scored["opponents"], rival))
            .when(rival == hero, F.lit(-1))
            .otherwise(F.lit(0))
        )
        return F.struct(
            index.cast("int").alias("winner_index"),
            rank_of(hero).alias("hero_rank"),
            _name(rank_of(hero), names).alias("hero_hand"),
            rank_of(best).alias("winning_rank"),
            _name(rank_of(best), names).alias("winning_hand"),
            (hero >= best).alias("hero_would_win"),
        )

    parsed = F.struct(
        cards_to_array(F.col(hero)).alias("hero"),
        F.transform(
            F.coalesce(F.col(opponents), F.array().cast("array<string>")), cards_to_array
        ).alias("opponents"),
        cards_to_array(F.col(board)).alias("board"),
    )
    return df.withColumn(out, let(parsed, compare))
