"""Hands are read in one pass of Python per batch; odd lines keep the meaning their patterns give them."""

from pokerlake.operators import hand_lines, hand_text
from tests.samples import SHOWDOWN_HAND


def test_one_pass_and_no_lambdas(spark):
    bronze = spark.createDataFrame([(SHOWDOWN_HAND, "one.txt")], "raw_content string, file_name string")
    for strict in (False, True):
        players = hand_text.build_players(hand_text.parse_hands(bronze, strict), strict)
        plan = players._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == 1
        assert "lambda" not in plan
    assert players.count() == 4


def test_odd_lines():
    lines = [
        "Poker Hand #x", "Table", "Seat 1: mara (1,0 in chips)", "Seat 99999999999: olof (, in chips)", " Dealt to mara [] ", "Dealt to mara [Qs\rQd]",
        "\tmara: folds and calls 50", "x *** FLOP *** [Qh 8c 3d]", "mara: calls 9223372036854775808 and is all-in", "mara: bets", "two words: folds",
        "Uncalled bet (7) returned to mara now", "mara collected 3 from side pot", "mara: shows [Qs Qd]", "*** SUMMARY ***", "mara: folds",
    ]
    said = hand_lines.events("\n".join(lines))
    assert [(e[0], e[1], e[2], e[3], e[4]) for e in said] == [
        ("seat", "mara", 10, None, 1), ("seat", "olof", None, None, None), ("dealt", "mara", None, None, None), ("dealt", "mara", None, "Qs\rQd", None),
        ("fold", "mara", 50, None, None), ("marker", "flop", None, "x *** FLOP *** [Qh 8c 3d]", None), ("call", "mara", None, None, None),
        ("return", "mara", 7, None, None), ("win", "mara", 3, "side", None), ("show", "mara", None, None, None),
    ]
    assert [e[6] for e in said] == [0, 1, 2, 3, 4, 5, 6, 9, 10, 11]
    assert [e[7] for e in said] == ["preflop"] * 6 + ["flop"] * 4
    assert [e[5] for e in said].index(True) == 6
