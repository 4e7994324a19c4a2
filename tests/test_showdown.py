"""Hand ranking against brute force over all five-card choices."""

import random
from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F

from pokerlake.operators.showdown import with_hand_rank, with_showdown

RANKS = "23456789TJQKA"
DECK = [r + s for r in RANKS for s in "cdhs"]


def score(five):
    """Larger is better: (-rank, ties)."""
    values = sorted((RANKS.index(c[0]) + 2 for c in five), reverse=True)
    groups = sorted(Counter(values).items(), key=lambda g: (-g[1], -g[0]))
    shape, order = [n for _, n in groups], [v for v, _ in groups]
    flush = len({c[1] for c in five}) == 1
    top = values[0] if values[0] - values[4] == 4 and len(order) == 5 else 5 if values == [14, 5, 4, 3, 2] else 0
    if top and flush:
        return (-1 if top == 14 else -2, [top])
    if shape[0] == 4:
        return (-3, order[:1])
    if shape == [3, 2]:
        return (-4, order)
    if flush:
        return (-5, values)
    if top:
        return (-6, [top])
    return ({3: -7, 2: -8 if shape[:2] == [2, 2] else -9, 1: -10}[shape[0]], order)


def best(cards):
    return max(score(five) for five in combinations(cards, 5))


def test_showdown_agrees_with_brute_force(spark):
    rng = random.Random(7)
    # Small decks of few ranks or suits make rare hands frequent.
    decks = [DECK, [c for c in DECK if c[0] in "A2345K"], [c for c in DECK if c[1] in "ch"]]
    deals = [rng.sample(decks[i % 3], 11) for i in range(600)]
    rows = [("".join(d[:2]), ["".join(d[2:4]), "".join(d[4:6])], "".join(d[6:])) for d in deals]
    df = spark.createDataFrame(rows, "hero string, rivals array<string>, board string").repartition(8)
    found = with_showdown(df, "hero", "rivals", "board").collect()
    for r in found:
        cut = lambda t: [t[i : i + 2] for i in range(0, len(t), 2)]
        board = cut(r.board)
        hero, rivals = best(cut(r.hero) + board), [best(cut(x) + board) for x in r.rivals]
        rival = max(rivals)
        index = rivals.index(rival) + 1 if rival > hero else -1 if rival == hero else 0
        assert (r.showdown.winner_index, r.showdown.hero_would_win) == (index, hero >= rival), r
        assert (r.showdown.hero_rank, r.showdown.winning_rank) == (-hero[0], -max(hero, rival)[0]), r


def test_known_hands(spark):
    cases = [
        ("AhKh", "2h5h7hJsQc", 5, 4, "Flush"),
        ("AhKh", "QhJhTh", 1, 1, "Royal Flush"),
        ("Ah2h", "3h4h5hKdKc", 2, 1, "Straight Flush"),
        ("Ac2h", "3h4d5hKdKc", 6, 5, "Straight"),
        ("AcAh", "AdKs2c3d", 7, 6, "Three of a Kind"),
        ('["ah", "1d"]', "Th Tc 2s", 7, 6, "Three of a Kind"),
        ("Ah", "2h5h7hJsQc", 9999, 0, "invalid"),
        (None, "2h5h7h", 9999, 0, "invalid"),
        ("AhKh", "2h5h", 9999, 0, "invalid"),
    ]
    df = spark.createDataFrame([c[:2] for c in cases], "hole string, board string").withColumn("i", F.monotonically_increasing_id())
    got = [tuple(r.evaluation) for r in with_hand_rank(df, "hole", "board").orderBy("i").collect()]
    assert got == [c[2:] for c in cases]


def test_quads_on_the_board_always_tie(spark):
    df = spark.createDataFrame([("AhKd", ["QcJd", "", None], "2c2d2h2s5c"), ("AhKd", None, "2c2d2h2s")], "h string, o array<string>, b string")
    tie, short = with_showdown(df, "h", "o", "b").collect()
    assert (tie.showdown.winner_index, tie.showdown.hero_would_win) == (-1, True)
    assert (short.showdown.winner_index, short.showdown.hero_would_win) == (-99, None)
