"""Chips followed through a hand: ledgers, pots, shares."""

import random

import pytest

from pokerlake.operators import chips, hand_text
from tests.samples import QUIET_HAND, SHOWDOWN_HAND

HEAD = """Poker Hand #{hand}: Tournament #1, Night $10 Hold'em No Limit - Level3(50/100) - 2026/03/04 21:07:09
Table '31' 6-max Seat #1 is the button"""


def text(hand, stacks, lines, summary=()):
    seats = [f"Seat {i}: p{i} ({n:,} in chips)" for i, n in stacks.items()]
    return "\n".join([HEAD.format(hand=hand), *seats, *lines, "*** SUMMARY ***", "Total pot 1 | Rake 0", *summary])


# p1 and p2 are all in for 300 and 700, p3 and p4 for 1,500; p2 wins what it can, p3 and p4 split the rest; the side pots are printed backwards.
THREE_ALL_INS = text(
    "A", {1: 300, 2: 700, 3: 1500, 4: 9000, 5: 5000},
    [
        *[f"p{i}: posts the ante 10" for i in range(1, 6)], "p2: posts small blind 50", "p3: posts big blind 100", "*** HOLE CARDS ***",
        "p4: raises 100 to 200", "p5: calls 200", "p1: raises 90 to 290 and is all-in", "p2: raises 400 to 690 and is all-in", "p3: raises 800 to 1,490 and is all-in",
        "p4: raises 2,000 to 3,490", "p5: folds", "Uncalled bet (2,000) returned to p4", "*** FLOP *** [2c 3c 4c]", "*** SHOWDOWN ***",
        "p4 collected 800 from side pot", "p3 collected 800 from side pot", "p2 collected 1,200 from side pot", "p1 collected 1,410 from main pot",
    ],
)
# Nobody collects in the body; the summary says who took how much of a raked pot.
RAKED = text(
    "B", {1: 1000, 2: 1000},
    ["p2: posts small blind 50", "p1: posts big blind 100", "*** HOLE CARDS ***", "p2: calls 50", "p1: checks"],
    ["Seat 1: p1 (button) collected (190)", "Seat 2: p2 folded on the Flop"],
)
# The small blind is all in with less than the blind; a walk afterwards returns the rest.
SHORT_BLIND = text(
    "C", {1: 500, 2: 30, 3: 500},
    ["p2: posts small blind 30 and is all-in", "p3: posts big blind 100", "*** HOLE CARDS ***", "p1: folds", "Uncalled bet (70) returned to p3", "p2 collected 60 from pot"],
)
NOTHING = text("D", {1: 500, 2: 30}, [])


@pytest.fixture(scope="module")
def parsed(spark):
    files = [(x, f"{i}.txt") for i, x in enumerate([SHOWDOWN_HAND, QUIET_HAND, THREE_ALL_INS, RAKED, SHORT_BLIND, NOTHING, None, "x"])]
    return hand_text.parse_hands(spark.createDataFrame(files, "raw_content string, file_name string"), strict=True).persist()


def money(parsed, hand):
    rows = hand_text.build_players(parsed, strict=True).filter(f"hand_id = '{hand}'").collect()
    return {r.player_name: (r.total_invested, r.amount_won, r.net_profit, r.won_hand, r.went_to_showdown) for r in rows}


def test_raises_blinds_and_returned_bets(parsed):
    rows = money(parsed, "TX500600")
    assert rows["Hero"] == (9250.0, 0.0, -9250.0, False, True)
    assert rows["olof"] == (9250.0, 20200.0, 10950.0, True, True)
    assert rows["mara"][:2] == (1100.0, 0.0) and rows["quill"] == (600.0, 0.0, -600.0, False, False)
    check = {r.hand_id: r for r in chips.money_check(parsed).collect()}
    assert check["TX500600"].balanced and check["TX500600"].invested == 20200


def test_side_pots_and_split(parsed):
    pots = {r.pot_no: r for r in chips.build_pots(parsed).filter("hand_id = 'A'").collect()}
    # Antes 50, then 4 x 290 and 200 of p5; 3 x 400; 2 x 800.
    assert {n: (r.amount, r.seats) for n, r in pots.items()} == {1: (50 + 4 * 290 + 200, [1, 2, 3, 4]), 2: (1200, [2, 3, 4]), 3: (1600, [3, 4])}
    rows = money(parsed, "A")
    assert {n: r[0] for n, r in rows.items()} == {"p1": 300, "p2": 700, "p3": 1500, "p4": 1500, "p5": 210}
    assert {n: r[1] for n, r in rows.items()} == {"p1": 1410, "p2": 1200, "p3": 800, "p4": 800, "p5": 0}
    assert rows["p5"][3:] == (False, False) and rows["p4"][4]


def test_shares_cover_lines_and_pots(parsed):
    shares = chips.build_pot_shares(parsed).filter("hand_id = 'A'").collect()
    pots = {r.pot_no: r.paid for r in chips.build_pots(parsed).filter("hand_id = 'A'").collect()}
    assert sum(pots.values()) == 1410 + 1200 + 800 + 800
    for no, paid in pots.items():
        assert sum(r.amount for r in shares if r.pot_no == no) == paid
    assert {(r.pot_no, r.seat): r.amount for r in shares} == {(1, 1): 1410, (2, 2): 1200, (3, 3): 800, (3, 4): 800}


def test_summary_stands_in_for_missing_lines(parsed):
    assert money(parsed, "B") == {"p1": (100.0, 190.0, 90.0, True, True), "p2": (100.0, 0.0, -100.0, False, True)}
    (pot,) = chips.build_pots(parsed).filter("hand_id = 'B'").collect()
    assert (pot.amount, pot.paid, pot.seats) == (200, 190, [1, 2])


def test_short_blind_and_empty_hand(parsed):
    rows = money(parsed, "C")
    assert rows == {"p1": (0.0, 0.0, 0.0, False, False), "p2": (30.0, 60.0, 30.0, True, True), "p3": (30.0, 0.0, -30.0, False, True)}
    assert money(parsed, "D") == {"p1": (0.0, 0.0, 0.0, False, False), "p2": (0.0, 0.0, 0.0, False, False)}
    assert chips.build_pots(parsed).filter("hand_id = 'D'").count() == 0


def test_hero_result_follows_the_chips(parsed):
    rows = {r.hand_id: r.hero_result for r in hand_text.build_hands(parsed, strict=True).collect()}
    assert (rows["TX500600"], rows["TX500601"]) == ("lost", "folded")


def play(draw):
    """A random hand of antes, blinds, raises and folds on one street, with its chips by plain bookkeeping."""
    n = draw.randint(2, 6)
    stack = {i: draw.randint(5, 400) for i in range(1, n + 1)}
    left, total, lines = dict(stack), dict.fromkeys(stack, 0), []
    antes, held = dict.fromkeys(stack, 0), dict.fromkeys(stack, 0)

    def put(i, amount):
        amount = min(amount, left[i])
        left[i] -= amount
        total[i] += amount
        return amount

    for i in stack:
        antes[i] = put(i, 10)
        lines.append(f"p{i}: posts the ante {antes[i]}")
    for i, name, blind in ((1, "small", 20), (2, "big", 40)):
        if left[i]:
            held[i] = put(i, blind)
            lines.append(f"p{i}: posts {name} blind {held[i]}")
    lines.append("*** HOLE CARDS ***")
    folded, to = set(), 40
    for _ in range(2):
        for i in stack:
            if i in folded or not left[i]:
                continue
            if draw.random() < 0.25 and len(folded) < n - 2:
                folded.add(i)
                lines.append(f"p{i}: folds")
            elif left[i] + held[i] > to and draw.random() < 0.5:
                amount = put(i, to + draw.randint(1, 80) - held[i])
                held[i] += amount
                to = max(to, held[i])
                lines.append(f"p{i}: raises 1 to {held[i]}")
            elif held[i] < to:
                amount = put(i, to - held[i])
                held[i] += amount
                lines.append(f"p{i}: calls {amount}")
    return stack, lines, total, antes, held, folded


def layers(total, antes, held, folded):
    """Pots chip by chip: a chip lies in the pot of the seats that can match it."""
    live = [i for i in total if i not in folded and total[i]]
    top = {i: (1, held[i]) if held[i] else (0, antes[i]) for i in live}
    pots = {}
    for i in total:
        for chip in [(0, c) for c in range(1, antes[i] + 1)] + [(1, c) for c in range(1, held[i] + 1)]:
            able = tuple(j for j in live if top[j] >= chip) or tuple(j for j in live if top[j] == max(top.values()))
            pots[able] = pots.get(able, 0) + 1
    return sorted((list(k), v) for k, v in pots.items())


def test_random_hands_against_chip_by_chip_pots(spark):
    draw = random.Random(11)
    hands = [play(draw) for _ in range(120)]
    files = [(text(f"H{i}", stack, lines), f"{i}") for i, (stack, lines, *_) in enumerate(hands)]
    parsed = hand_text.parse_hands(spark.createDataFrame(files, "raw_content string, file_name string"), strict=True).persist()
    spent = {(r.hand_id, r.player_name): r.total_invested for r in hand_text.build_players(parsed, strict=True).collect()}
    pots = {}
    for r in chips.build_pots(parsed).collect():
        pots.setdefault(r.hand_id, []).append((r.seats, r.amount))
    for i, (_, _, total, antes, held, folded) in enumerate(hands):
        assert {p: spent[f"H{i}", f"p{p}"] for p in total} == total
        assert sorted(pots[f"H{i}"]) == layers(total, antes, held, folded)
