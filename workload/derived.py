"""Inputs of the analyses: fixture tables completed to the columns the operators read.

Each has a Spark form and a SQL form. The mapping and the decision base in SQL are
brute-force joins that share nothing with the library.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pokerlake.operators.linking import map_screenshots, player_identity
from pokerlake.plans import parts, players
from pokerlake.session import shared_dir
from pokerlake.sinks.tables import overwrite_table
from workload.fixture_tables import Tables
from workload.registry import cte, rnd


def fresh_dir(t: Tables) -> str:
    return f"{shared_dir(t.spark)}/run-{uuid4().hex[:12]}"


def stored(t: Tables, df: DataFrame, name: str = "rows") -> DataFrame:
    """The rows as a new table in the shared folder."""
    return overwrite_table(df, f"{name}_{uuid4().hex[:12]}", fresh_dir(t))


def hands(t: Tables) -> DataFrame:
    """Hands with a board array: three cards on some, none on others."""
    cards = F.regexp_extract_all("board_str", F.lit("(..)"), F.lit(1))
    board = F.when(F.col("k") % 9 == 4, F.slice(cards, 1, 3)).when(F.col("k") % 9 == 5, F.lit(None)).otherwise(cards)
    return t.hands.withColumn("board", board)


cte("fx_h", """SELECT *, CASE k % 9 WHEN 4 THEN substr(board_str, 1, 6) WHEN 5 THEN NULL ELSE board_str END AS board
    FROM fx_hands""")


def hand_players(t: Tables) -> DataFrame:
    said = F.concat(F.lit("pair of "), F.substring("hole_cards", 1, 1))
    return t.hand_players.withColumn("result_description", said)


cte("fx_p", "SELECT *, 'pair of ' || substr(hole_cards, 1, 1) AS result_description FROM fx_hand_players")


def screenshots(t: Tables) -> DataFrame:
    return t.screenshots.withColumn("gpt_amount", F.when(F.col("gpt_action") == "raise", F.col("pot") / 2))


cte("fx_s", "SELECT *, CASE WHEN gpt_action = 'raise' THEN pot / 2 END AS gpt_amount FROM fx_screenshots")


def mapping(t: Tables) -> DataFrame:
    return map_screenshots(t.screenshots, t.hands)


def _norm_cards(column: str) -> str:
    a, b = f"substr({column}, 1, 2)", f"substr({column}, 3, 2)"
    return f"least({a}, {b}) || greatest({a}, {b})"


def _norm_pos(column: str) -> str:
    return f"CASE WHEN {column} IN ('BTN', 'BU', 'D') THEN 'BTN' WHEN {column} IN ('UTG', 'EP') THEN 'UTG' ELSE {column} END"


cte("fx_pairs", f"""
    SELECT s.file_name, s.hero_cards AS screenshot_hero_cards, s.pos AS screenshot_hero_pos,
           h.hand_id, h.hero_cards AS hand_hero_cards, h.pos AS hand_hero_pos,
           CAST(s.ts - h.ts AS INT) AS time_diff_seconds,
           CASE WHEN h.hand_id IS NULL THEN 'unmatched' WHEN s.pos = h.pos THEN 'high'
                WHEN s.pos <> h.pos THEN 'medium' ELSE 'unmatched' END AS match_confidence,
           CASE WHEN s.pos = h.pos THEN 'cards+position+time' WHEN h.hand_id IS NOT NULL THEN 'cards+time' END AS match_method
    FROM (SELECT *, {_norm_cards('hero_cards')} AS cards, {_norm_pos('hero_pos')} AS pos,
                 CAST(epoch(screenshot_at) AS BIGINT) AS ts FROM fx_screenshots) s
    LEFT JOIN (SELECT *, {_norm_cards('hero_cards')} AS cards, {_norm_pos('hero_position')} AS pos,
                      CAST(epoch(hand_timestamp) AS BIGINT) AS ts FROM fx_hands) h
      ON s.cards = h.cards AND s.ts BETWEEN h.ts - 300 AND h.ts + 300""")
cte("fx_map", """
    SELECT * FROM fx_pairs
    QUALIFY row_number() OVER (PARTITION BY file_name ORDER BY
        CASE match_confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END,
        abs(time_diff_seconds), hand_id) = 1""")


def decision_base(t: Tables) -> DataFrame:
    return parts.decision_base(t.screenshots, mapping(t), t.hands, t.hand_players, t.screenshot_players)


cte("fx_base", """
    SELECT s.file_name, s.screenshot_at, s.stage, s.street, s.hero_stack, s.gpt_action, m.hand_id,
           h.tournament_id, h.hero_result, h.big_blind, h.total_pot,
           p.amount_won, p.chips_start, p.net_profit,
           1 + COALESCE((SELECT COUNT(*) FROM fx_screenshot_players o WHERE o.file_name = s.file_name), 0) AS players
    FROM fx_s s JOIN fx_map m USING (file_name) JOIN fx_h h USING (hand_id)
    JOIN fx_p p ON p.hand_id = h.hand_id AND p.is_hero
    WHERE s.gpt_action IS NOT NULL""")
cte("fx_acts", """
    SELECT hand_id, street, action_order, action_type, amount FROM fx_hand_actions
    WHERE is_hero AND action_type NOT IN ('post_ante', 'post_sb', 'post_bb', 'show')""")


def verdict(advice: str, action: str, checks: bool) -> str:
    """true / false / NULL for advice obeyed or not."""
    play = "('call', 'raise', 'bet')"
    check = f" WHEN {advice} = 'check' AND {action} = 'check' THEN true" if checks else ""
    return (
        f"CASE WHEN {advice} = 'fold' AND {action} IN ('fold', 'call', 'raise', 'bet') THEN {action} = 'fold'"
        f" WHEN {advice} IN {play} AND {action} IN ('fold', 'call', 'raise', 'bet') THEN {action} <> 'fold'{check} END"
    )


def identity(t: Tables) -> DataFrame:
    return player_identity(t.screenshot_players, mapping(t), t.hand_players)


cte("fx_identity", """
    SELECT o.name AS player_name, m.hand_id, p.player_name AS anonymous_id, o.seat, o.file_name
    FROM fx_screenshot_players o JOIN fx_map m USING (file_name)
    JOIN fx_p p ON p.hand_id = m.hand_id AND p.seat = o.seat
    WHERE o.name NOT IN ('', 'Hero') AND NOT p.is_hero
    QUALIFY row_number() OVER (PARTITION BY o.name, m.hand_id ORDER BY o.file_name, o.seat, p.player_name) = 1""")


def player_hand_stats(t: Tables) -> DataFrame:
    return players.player_hand_stats(identity(t), hand_players(t), hands(t), t.hand_actions, t.screenshots)


cte("fx_stats", f"""
    SELECT i.player_name, p.hand_id, h.hand_timestamp, h.tournament_id, s.stage, p.position,
           CASE WHEN p.position IN ('UTG', 'UTG+1', 'EP') THEN 'early' WHEN p.position IN ('MP', 'MP+1', 'HJ') THEN 'middle'
                WHEN p.position IN ('CO', 'BTN') THEN 'late' WHEN p.position IN ('SB', 'BB') THEN 'blinds'
                ELSE 'unknown' END AS position_group,
           p.chips_start, h.big_blind, {rnd('p.chips_start / NULLIF(h.big_blind, 0)', 1)} AS stack_bb, p.hole_cards,
           p.vpip, p.pfr, p.three_bet, CAST(p.total_bets AS BIGINT) AS total_bets,
           CAST(p.total_raises AS BIGINT) AS total_raises, CAST(p.total_calls AS BIGINT) AS total_calls,
           COALESCE(a.allin, false) AS went_allin,
           {rnd('a.raise_to / NULLIF(h.big_blind, 0)', 1)} AS preflop_raise_bb,
           COALESCE(a.shove, false) AS preflop_shove,
           {rnd('a.mean_size / NULLIF(h.big_blind, 0)', 1)} AS avg_action_size_bb,
           p.went_to_showdown, p.won_hand, p.amount_won, p.net_profit, p.result_description
    FROM fx_identity i
    JOIN fx_p p ON p.hand_id = i.hand_id AND p.player_name = i.anonymous_id
    JOIN fx_h h ON h.hand_id = i.hand_id
    LEFT JOIN (SELECT hand_id, player_name, bool_or(is_allin) AS allin,
                      MAX(amount) FILTER (WHERE street = 'preflop' AND action_type = 'raise') AS raise_to,
                      bool_or(street = 'preflop' AND action_type = 'raise' AND is_allin) AS shove,
                      AVG(amount) FILTER (WHERE action_type IN ('bet', 'raise')) AS mean_size
               FROM fx_hand_actions GROUP BY ALL) a ON a.hand_id = i.hand_id AND a.player_name = i.anonymous_id
    LEFT JOIN fx_s s ON s.file_name = i.file_name""")
