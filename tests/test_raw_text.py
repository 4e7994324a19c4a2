"""Golden values of the parse jobs."""

import pytest
from pyspark.sql import functions as F

from pokerlake.operators import captures, hand_text, tournament_text
from tests.samples import LATE_BUST, QUIET_HAND, SECOND_PLACE, SHOWDOWN_HAND

FILES = [
    (SHOWDOWN_HAND + "\n\n\n" + QUIET_HAND, "two.txt"),
    ("\r\n".join(QUIET_HAND.replace("TX500601", "TX500602").split("\n")), "windows.txt"),
    ("Poker Hand #broken\nTable", "broken.txt"),
    ("", "empty.txt"),
    (None, "null.txt"),
]


@pytest.fixture(scope="module")
def parsed(spark):
    bronze = spark.createDataFrame(FILES, "raw_content string, file_name string")
    return hand_text.parse_hands(bronze).persist()


def by_hand(df, hand="TX500600"):
    return df.filter(F.col("hand_id") == hand).collect()


def test_hand_fields(parsed):
    hands = {r["hand_id"]: r for r in hand_text.build_hands(parsed).collect()}
    assert set(hands) == {"TX500600", "TX500601", "TX500602"}
    first = hands["TX500600"]
    assert (first.tournament_id, first.tournament_name, first.game_type) == (4711, "Harbour Night Special", "Hold'em No Limit")
    assert (first.level, first.small_blind, first.big_blind, first.ante) == (12, 500.0, 1000.0, 100.0)
    assert (first.table_name, first.max_seats, first.button_seat) == ("31", 6, 5)
    assert str(first.hand_timestamp) == "2026-03-04 21:07:09"
    assert first.board == ["Qh", "8c", "3d", "9s", "As"]
    assert (first.hero_seat, first.hero_cards, first.hero_chips_start, first.hero_result) == (3, "QsQd", 9250.0, "lost")
    # A single blind number doubles into the big blind.
    assert (hands["TX500601"].small_blind, hands["TX500601"].big_blind) == (40.0, 80.0)
    assert hands["TX500601"].hero_result == "folded"


def test_positions_and_money(parsed):
    rows = {r.player_name: r for r in by_hand(hand_text.build_players(parsed))}
    assert {n: r.position for n, r in rows.items()} == {"olof": "BTN", "quill": "SB", "mara": "BB", "Hero": "UTG"}
    assert rows["Hero"].total_invested == 2200 + 4400 + 2550
    assert (rows["olof"].amount_won, rows["olof"].won_hand, rows["olof"].hole_cards) == (20200.0, True, "AcAh")
    assert (rows["olof"].three_bet, rows["Hero"].three_bet) == (True, False)
    assert rows["Hero"].preflop_actions == ["raise 2200", "call 4400"]
    assert (rows["Hero"].vpip, rows["quill"].vpip, rows["mara"].went_to_showdown) == (True, False, False)
    assert (rows["olof"].total_bets, rows["olof"].total_raises, rows["Hero"].total_calls) == (1, 1, 2)


def test_two_players_have_no_big_blind(parsed):
    rows = {r.player_name: r for r in by_hand(hand_text.build_players(parsed), "TX500601")}
    assert {n: r.position for n, r in rows.items()} == {"Hero": "BTN", "mara": "SB"}
    # A pot taken without showdown is no recorded win, and its winner counts as shown down.
    assert (rows["mara"].won_hand, rows["mara"].went_to_showdown) == (False, True)


def test_actions_keep_order_and_streets(parsed):
    rows = sorted(by_hand(hand_text.build_actions(parsed)), key=lambda r: r.action_order)
    assert [r.action_type for r in rows] == ["raise", "raise", "fold", "fold", "call", "check", "bet", "call", "return", "show", "show"]
    assert [r.street for r in rows] == ["preflop"] * 5 + ["flop"] * 6
    assert (rows[7].amount, rows[7].is_allin, rows[7].seat, rows[7].is_hero) == (2550.0, True, 3, True)


def test_nested_and_flat_records(parsed):
    flat = by_hand(hand_text.hands_flat(parsed))[0]
    assert (flat.hero_card_1, flat.flop_3, flat.turn_card, flat.river_card, flat.hero_stack_bb) == ("Qs", "3d", "9s", "As", 9.2)
    assert (flat.winners, flat.hero_won, flat.went_to_showdown, flat.num_players) == ("olof", False, True, 4)
    nested = by_hand(hand_text.hands_nested(parsed))[0]
    assert [p.name for p in nested.players] == ["mara", "Hero", "olof", "quill"]
    assert nested.results[0].folded_street == "before Flop" and nested.turn == ["9s"]


def test_unreadable_hands_are_kept_apart(spark):
    bronze = spark.createDataFrame(FILES, "raw_content string, file_name string")
    assert [r.file_name for r in hand_text.rejected_hands(bronze).collect()] == ["broken.txt"]


def test_tournaments(spark):
    bronze = spark.createDataFrame(
        [(SECOND_PLACE, "a"), (LATE_BUST, "b"), ("nothing here", "c"), (None, "d")], "raw_content string, file_name string"
    )
    rows = {r.file_name: r for r in tournament_text.build_tournaments(tournament_text.parse_tournaments(bronze)).collect()}
    assert set(rows) == {"a", "b"}
    a = rows["a"]
    assert (a.tournament_id, a.total_players, a.hero_position) == (880011, 24, 2)
    assert [float(x) for x in (a.buyin_prize, a.buyin_rake, a.buyin_bounty, a.buyin_total, a.prize_pool, a.hero_prize)] == [9, 1.6, 9.4, 20, 441.6, 65]
    # Without a pool the pool is 0; without a start the start is the time of the run.
    assert float(rows["b"].prize_pool) == 0 and rows["b"].started_at.year >= 2026
    roi = tournament_text.parse_tournaments(bronze).select(tournament_text.roi(F.col("hero_prize"), F.col("buyin_total")))
    assert sorted(r[0] for r in roi.collect()) == [-100.0, 225.0]


def test_captures_of_large_spots_keep_their_rows(spark):
    document = '{"hero": {"cards": "AsKd", "pos": "BTN"}, "street": "flop", "pot": 4.5, "gpt_advice": {"raw": {"action": "%s"}}}'
    shots = [(document % f"a{i}", f"screenshot_20260304_2000{i:02d}_x") for i in range(6)]
    shots += [("{broken", "screenshot_20260304_200100_x"), ('{"pot": 1}', "no_time.json")]
    bronze = spark.createDataFrame(shots, "raw_content string, file_name string")
    keyed = captures.with_spot_key(captures.parse_screenshots(bronze))
    first = captures.build_screenshots(captures.first_of_spots(keyed)).collect()
    assert len(first) == 1 and first[0].recommendation_count == 6 and first[0].gpt_action == "a0"
    parts = sorted(captures.spot_lists(keyed, part_rows=4).collect(), key=lambda r: r.part)
    assert [r.all_recommendations for r in parts] == [["a0", "a1", "a2", "a3"], ["a4", "a5"]]
    assert captures.spot_recommendations(keyed).count() == 6
    built = captures.build_screenshots(captures.first_of_spots(keyed))
    for size, listed, complete in ((4, 4, False), (6, 6, True)):
        (row,) = captures.with_spot_lists(built, captures.spot_lists(keyed, part_rows=size)).collect()
        assert (row.gpt_action, len(row.all_recommendations), row.lists_complete) == ("a0", listed, complete)
    assert captures.rejected_screenshots(bronze).count() == 2
