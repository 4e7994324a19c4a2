"""Matching captures to hands, showdown ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from pokerlake.functions.cards import cards_to_array, norm_cards, norm_position
from pokerlake.operators.linking import interval_join, match_confidence, match_method, named_seats, resolved_names
from pokerlake.operators.showdown import with_hand_rank, with_showdown
from workload import derived as d
from workload.gold import rank_ctes
from workload.registry import cte, query

CARDS = "least(substr(hero_cards, 1, 2), substr(hero_cards, 3, 2)) || greatest(substr(hero_cards, 1, 2), substr(hero_cards, 3, 2))"


@query("lnk8_norm_position", """
    SELECT file_name, CASE hero_pos WHEN 'BU' THEN 'BTN' WHEN 'D' THEN 'BTN' WHEN 'EP' THEN 'UTG' ELSE hero_pos END AS pos FROM fx_screenshots""")
def _(t):
    return t.screenshots.select("file_name", norm_position(F.col("hero_pos")).alias("pos"))


@query("lnk9_norm_cards", f"SELECT file_name, {CARDS} AS cards FROM fx_screenshots")
def _(t):
    return t.screenshots.select("file_name", norm_cards(F.col("hero_cards")).alias("cards"))


def pairs(t):
    shots = t.screenshots.select(
        "file_name", norm_cards(F.col("hero_cards")).alias("cards"), norm_position(F.col("hero_pos")).alias("shot_pos"),
        F.unix_timestamp("screenshot_at").alias("shot_ts"),
    )
    hands = t.hands.select(
        "hand_id", norm_cards(F.col("hero_cards")).alias("cards"), norm_position(F.col("hero_position")).alias("hand_pos"),
        F.unix_timestamp("hand_timestamp").alias("hand_ts"),
    )
    return interval_join(shots, hands, ["cards"], "shot_ts", "hand_ts", 300)


@query("lnk10_interval_join", "SELECT file_name, hand_id, CAST(time_diff_seconds AS BIGINT) AS gap FROM fx_pairs")
def _(t):
    return pairs(t).select("file_name", "hand_id", (F.col("shot_ts") - F.col("hand_ts")).alias("gap"))


@query("lnk11_match_grade", "SELECT file_name, hand_id, match_confidence, match_method FROM fx_pairs")
def _(t):
    same = F.col("shot_pos") == F.col("hand_pos")
    hand = F.col("hand_id")
    return pairs(t).select(
        "file_name", "hand_id", match_confidence(hand, same).alias("match_confidence"), match_method(hand, same).alias("match_method")
    )


@query("lnk12_best_match", "SELECT file_name, hand_id, CAST(time_diff_seconds AS BIGINT) AS time_diff_seconds FROM fx_map")
def _(t):
    return d.mapping(t).select("file_name", "hand_id", "time_diff_seconds")


@query("lnk13_map_screenshots", """
    SELECT file_name, hand_id, match_confidence, match_method, CAST(time_diff_seconds AS BIGINT) AS time_diff_seconds, screenshot_hero_cards,
           hand_hero_cards, screenshot_hero_pos, hand_hero_pos FROM fx_map""")
def _(t):
    return d.mapping(t).drop("matched_at")


@query("lnk14_player_identity", "SELECT player_name, hand_id, anonymous_id, seat::BIGINT AS seat, file_name FROM fx_identity")
def _(t):
    return d.identity(t)


cte("fx_votes", """
    SELECT h.tournament_id, i.anonymous_id, i.player_name, COUNT(DISTINCT i.hand_id) AS hands FROM fx_identity i JOIN fx_hands h USING (hand_id) GROUP BY 1, 2, 3""")
cte("fx_names", """
    SELECT tournament_id, anonymous_id, player_name, hands
    FROM (SELECT *, RANK() OVER (PARTITION BY tournament_id, player_name ORDER BY hands DESC) AS place, COUNT(*) OVER (PARTITION BY tournament_id, player_name, hands) AS drawn
          FROM (SELECT *, SUM(hands) OVER (PARTITION BY tournament_id, anonymous_id) AS all_hands FROM fx_votes) v WHERE 2 * hands > all_hands) w
    WHERE place = 1 AND drawn = 1""")


@query("lnk14_resolved_names", "SELECT * FROM fx_names")
def _(t):
    return resolved_names(d.identity(t), t.hands)


@query("lnk14_named_seats", """
    SELECT p.hand_id, p.seat::BIGINT AS seat, COALESCE(n.player_name, p.player_name) AS player_name
    FROM fx_hand_players p JOIN fx_hands h USING (hand_id) LEFT JOIN fx_names n ON n.tournament_id = h.tournament_id AND n.anonymous_id = p.player_name""")
def _(t):
    return named_seats(t.hand_players.select("hand_id", "seat", "player_name"), t.hands, resolved_names(d.identity(t), t.hands))


@query("udf1_cards_to_array", "SELECT hand_id, array_to_string([hero_cards[1:2], hero_cards[3:4], board_str[1:2], board_str[9:10]], ' ') AS cards FROM fx_hands")
def _(t):
    # The same cards as upper case, spaced and JSON-list text.
    spaced = F.concat_ws(" ", F.substring("hero_cards", 1, 2), F.substring("hero_cards", 3, 2))
    listed = F.to_json(F.array(F.lower(F.substring("board_str", 1, 2)), F.upper(F.substring("board_str", 9, 2))))
    return t.hands.select(
        "hand_id", F.concat_ws(" ", F.concat(cards_to_array(spaced), cards_to_array(listed))).alias("cards")
    )


rank_ctes("fx_all", """SELECT hand_id, 0 AS side, hero_cards || board_str AS cards FROM fx_hands
    UNION ALL SELECT p.hand_id, p.seat - 1, p.hole_cards || h.board_str FROM fx_hand_players p JOIN fx_hands h USING (hand_id)
    WHERE NOT p.is_hero AND p.hole_cards IS NOT NULL""")
NAMES = "['Straight Flush', 'Straight Flush', 'Four of a Kind', 'Full House', 'Flush', 'Straight', 'Three of a Kind', 'Two Pair', 'One Pair', 'High Card']"


@query("udf2_hand_rank", f"""
    SELECT hand_id, CAST(rank AS BIGINT) AS rank, CAST(greatest(rank - 1, 1) AS BIGINT) AS hand_class,
           CASE rank WHEN 1 THEN 'Royal Flush' ELSE {NAMES}[rank] END AS hand_name
    FROM fx_all_rank WHERE side = 0""")
def _(t):
    return with_hand_rank(t.hands, "hero_cards", "board_str").select("hand_id", "evaluation.*")


@query("udf3_showdown", f"""
    SELECT h.hand_id, CASE WHEN r.strength > h.strength THEN r.side WHEN r.strength = h.strength THEN -1 ELSE 0 END::BIGINT AS winner_index,
           h.rank::BIGINT AS hero_rank, {NAMES}[h.rank] AS hero_hand, least(h.rank, r.rank)::BIGINT AS winning_rank,
           {NAMES}[least(h.rank, r.rank)] AS winning_hand, h.strength >= r.strength AS hero_would_win
    FROM (SELECT * FROM fx_all_rank WHERE side = 0) h
    JOIN (SELECT * FROM fx_all_rank WHERE side > 0 QUALIFY row_number() OVER (PARTITION BY hand_id ORDER BY strength DESC, side) = 1) r USING (hand_id)""")
def _(t):
    seats = t.hand_players.groupBy("hand_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.when(~F.col("is_hero"), F.struct("seat", "hole_cards")))), lambda p: p["hole_cards"]
        ).alias("rivals")
    )
    return with_showdown(t.hands.join(seats, "hand_id"), "hero_cards", "rivals", "board_str").select("hand_id", "showdown.*")
