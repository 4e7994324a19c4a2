"""The analyses."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from pokerlake.plans import advice, folds, players, spots, tournaments
from workload import derived as d
from workload.registry import cte, dbl, n, pct, query, rnd

cte("fx_results", f"""
    SELECT *, CASE WHEN hero_position <= 4 THEN ['1_champion', '2_runner_up', '3_third', '4_fourth'][hero_position]
                   WHEN hero_position <= 6 THEN '5_mid_final' WHEN hero_position <= 9 THEN '6_early_final'
                   ELSE '7_rush_bust' END AS stage,
           COALESCE([8, 6, 4][hero_position], 0) * buyin_prize AS place_prize,
           hero_prize - buyin_total AS profit
    FROM fx_tournaments""")
MONEY = {"buyin_total": "buyin_total", "buyin_prize": "buyin_prize", "hero_prize": "hero_prize", "profit": "profit"}


@query("gld1_tournament_analysis", f"""
    SELECT tournament_id, {', '.join(f'{dbl(c)} AS {c}' for c in MONEY)}, CAST(hero_position AS BIGINT) AS hero_position,
           started_at, stage, {dbl('place_prize')} AS estimated_position_prize,
           {dbl('hero_prize - place_prize')} AS estimated_bounty_prize,
           {dbl('SUM(profit) OVER w')} AS cumulative_profit, {dbl('SUM(buyin_total) OVER w')} AS cumulative_buyin,
           {pct('profit', 'buyin_total')} AS roi_pct
    FROM fx_results WINDOW w AS (ORDER BY started_at, tournament_id ROWS UNBOUNDED PRECEDING)""")
def _(t):
    return tournaments.tournament_analysis(t.tournaments)


@query("gld2_tournament_summary_by_stage", f"""
    SELECT stage, COUNT(*) AS tournaments, {pct('COUNT(*)', '(SELECT COUNT(*) FROM fx_results)')} AS pct_of_total,
           {dbl('SUM(buyin_total)')} AS total_buyin, {dbl('SUM(hero_prize)')} AS total_prize, {dbl('SUM(profit)')} AS total_profit,
           {rnd('AVG(profit)', 2)} AS avg_profit, {dbl('SUM(place_prize)')} AS total_position_prize,
           {dbl('SUM(hero_prize - place_prize)')} AS total_bounty_prize, {pct('SUM(profit)', 'SUM(buyin_total)')} AS roi_pct
    FROM fx_results GROUP BY stage""")
def _(t):
    return tournaments.tournament_summary_by_stage(tournaments.tournament_results(t.tournaments))


@query("gld3_tournament_summary_by_buyin", f"""
    SELECT {dbl('buyin_total')} AS buyin_total, COUNT(*) AS tournaments, {n("stage = '7_rush_bust'")} AS rush_busts,
           {n("stage SIMILAR TO '[56]_.*'")} AS final_no_cash, {n('hero_position <= 3')} AS itm,
           {pct(n('hero_prize > 0'), 'COUNT(*)')} AS itm_rate, {dbl('SUM(buyin_total)')} AS total_buyin,
           {dbl('SUM(hero_prize)')} AS total_prize, {dbl('SUM(profit)')} AS total_profit,
           {pct('SUM(profit)', 'SUM(buyin_total)')} AS roi_pct, {dbl('SUM(hero_prize - place_prize)')} AS total_bounty_earned,
           {rnd('AVG(hero_prize - place_prize) FILTER (WHERE hero_prize > place_prize)', 2)} AS avg_bounty_when_won
    FROM fx_results GROUP BY fx_results.buyin_total""")
def _(t):
    return tournaments.tournament_summary_by_buyin(tournaments.tournament_results(t.tournaments))


@query("gld4_tournament_summary_daily", f"""
    SELECT CAST(started_at AS DATE) AS play_date, COUNT(*) AS tournaments, {dbl('SUM(buyin_total)')} AS total_buyin,
           {dbl('SUM(hero_prize)')} AS total_prize, {dbl('SUM(profit)')} AS daily_profit,
           {pct('SUM(profit)', 'SUM(buyin_total)')} AS roi_pct, {dbl('MAX(profit)')} AS best_result,
           {dbl('MIN(profit)')} AS worst_result, {n('hero_position >= 10')} AS rush_busts, {n('hero_prize > 0')} AS itm_count
    FROM fx_results GROUP BY 1""")
def _(t):
    return tournaments.tournament_summary_daily(tournaments.tournament_results(t.tournaments))


cte("fx_street", """
    SELECT hand_id, street, arg_min(action_type, action_order) AS first_deed,
           CAST(bool_or(action_type IN ('call', 'bet', 'raise')) AS INT) AS money,
           CAST(bool_or(action_type = 'fold') AS INT) AS gone
    FROM fx_acts GROUP BY hand_id, street""")
PLAY = "('call', 'raise', 'bet')"


@query("gld5_screenshot_hand_analysis", f"""
    SELECT s.file_name, s.screenshot_at, s.stage, s.street AS screenshot_street, s.hero_cards, s.hero_pos, s.hero_stack,
           s.pot, s.to_call, m.match_confidence, s.gpt_recommendation, s.gpt_action, s.gpt_amount, m.hand_id,
           h.hand_timestamp, h.tournament_id, h.board, h.total_pot AS final_pot, h.hero_result,
           p.amount_won AS hero_amount_won, p.vpip AS hero_vpip, p.pfr AS hero_pfr,
           a.first_deed AS hero_first_action, CAST(a.money AS BIGINT) AS hero_put_money_in,
           CAST(a.gone AS BIGINT) AS hero_folded_on_street,
           CASE WHEN s.gpt_action = 'fold' AND (a.gone + a.money) > 0 THEN a.gone = 1
                WHEN s.gpt_action = 'check' AND a.first_deed = 'check' THEN true
                WHEN s.gpt_action IN {PLAY} AND (a.gone + a.money) > 0 THEN a.money = 1 END AS followed_gpt_advice,
           CASE WHEN s.gpt_action = 'fold' AND a.money = 1 THEN CASE h.hero_result WHEN 'won' THEN 'ignored_fold_won' ELSE 'ignored_fold_lost' END
                WHEN s.gpt_action IN {PLAY} AND a.money = 1 THEN CASE h.hero_result WHEN 'won' THEN 'followed_play_won' ELSE 'followed_play_lost' END
                WHEN s.gpt_action IN {PLAY} AND a.gone = 1 THEN 'ignored_play_folded'
                WHEN s.gpt_action = 'fold' AND a.gone = 1 THEN 'followed_fold' ELSE 'unknown' END AS outcome_category,
           CASE h.hero_result WHEN 'won' THEN p.amount_won / h.big_blind
                WHEN 'lost' THEN -(p.chips_start - p.amount_won) / h.big_blind ELSE 0 END AS profit_bb,
           w.had_showdown, w.winner_hole_cards, w.winner_hand_description, w.showdown_pot_won,
           CASE WHEN h.hero_result = 'folded' AND w.had_showdown = 1 THEN w.showdown_pot_won / h.big_blind END AS missed_pot_bb,
           COALESCE(s.gpt_action IN {PLAY} AND a.gone = 1 AND w.had_showdown = 1, false) AS folded_with_showdown_data
    FROM fx_s s JOIN fx_map m USING (file_name) JOIN fx_h h USING (hand_id)
    JOIN fx_p p ON p.hand_id = h.hand_id AND p.is_hero
    JOIN (SELECT hand_id, CAST(bool_or(went_to_showdown) AS BIGINT) AS had_showdown,
                 MAX(hole_cards) FILTER (WHERE won_hand) AS winner_hole_cards,
                 MAX(result_description) FILTER (WHERE won_hand) AS winner_hand_description,
                 MAX(amount_won) FILTER (WHERE won_hand) AS showdown_pot_won
          FROM fx_p GROUP BY hand_id) w ON w.hand_id = h.hand_id
    LEFT JOIN fx_street a ON a.hand_id = h.hand_id AND a.street = s.street""")
def _(t):
    df = advice.screenshot_hand_analysis(d.screenshots(t), d.mapping(t), d.hands(t), d.hand_players(t), t.hand_actions)
    return df.withColumn("board", F.array_join("board", ""))


cte("fx_steps", f"""
    SELECT m.hand_id, s.file_name, s.screenshot_at, s.street, s.gpt_action,
           COALESCE(CASE WHEN s.gpt_action = 'fold' AND a.gone + a.money > 0 THEN CASE a.gone WHEN 1 THEN 'followed' ELSE 'deviated' END
                WHEN s.gpt_action IN {PLAY} AND a.gone + a.money > 0 THEN CASE a.money WHEN 1 THEN 'followed' ELSE 'deviated' END
                WHEN s.gpt_action = 'check' AND a.gone + a.money = 0 THEN 'followed' END, 'unknown') AS gpt_compliance
    FROM fx_map m JOIN fx_s s USING (file_name) LEFT JOIN fx_street a ON a.hand_id = m.hand_id AND a.street = s.street
    WHERE m.hand_id IS NOT NULL""")
PIVOT = ", ".join(
    f"MAX({c}) FILTER (WHERE l.street = '{s}') AS {s}_{a}"
    for s in ("preflop", "flop", "turn", "river")
    for c, a in (("gpt_action", "gpt"), ("gpt_compliance", "compliance"))
)


@query("gld6_hand_line_analysis", f"""
    SELECT l.hand_id, any_value(h.hero_cards) AS hero_cards, any_value(h.hero_position) AS hero_position,
           any_value(h.board) AS board, any_value(h.hero_result) AS hero_result, any_value(p.amount_won) AS amount_won,
           any_value(h.total_pot) AS total_pot, {PIVOT},
           {n("gpt_compliance = 'deviated'")} AS deviation_count,
           COALESCE(string_agg(gpt_action, '->' ORDER BY screenshot_at, file_name), '') AS gpt_line,
           string_agg(gpt_compliance, '->' ORDER BY screenshot_at, file_name) AS compliance_line,
           CAST(bool_or(gpt_compliance = 'deviated') AS BIGINT) AS had_deviation,
           MIN(l.street) FILTER (WHERE gpt_compliance = 'deviated') AS first_deviation_street
    FROM fx_steps l JOIN fx_h h ON h.hand_id = l.hand_id JOIN fx_p p ON p.hand_id = l.hand_id AND p.is_hero
    GROUP BY l.hand_id""")
def _(t):
    mapping = d.stored(t, d.mapping(t))
    df = advice.hand_line_analysis(t.screenshots, mapping, d.hands(t), d.hand_players(t), t.hand_actions)
    lines = advice.hand_lines(advice.hand_line_steps(t.screenshots, mapping, t.hand_actions)).drop("part")
    return df.withColumn("board", F.array_join("board", "")).join(lines, "hand_id")


@query("gld6_hand_line_steps", "SELECT * FROM fx_steps")
def _(t):
    return advice.hand_line_steps(t.screenshots, d.mapping(t), t.hand_actions)


# Cards of a text as numbers, ranked by histogram in SQL: an independent second opinion.
cte("fx_fold_rows", """
    SELECT h.hand_id, h.hero_cards, p.player_name AS winner_name, p.hole_cards AS winner_cards, h.board
    FROM fx_h h JOIN fx_p p ON p.hand_id = h.hand_id AND p.won_hand
    WHERE h.hero_result = 'folded' AND length(h.board) = 10
      AND EXISTS (SELECT 1 FROM fx_hand_actions a WHERE a.hand_id = h.hand_id AND a.is_hero AND a.action_type = 'fold')""")
def rank_ctes(prefix: str, hands: str) -> None:
    """``<prefix>_rank`` (hand_id, side, rank, strength) of the texts in ``hands`` (hand_id, side, cards of seven).

    Lists within the row, no join. The strength packs the rank and the ranks that break ties in one number, the larger the better.
    """
    top = "list_max([t FOR t IN range(5, 15) IF len([1 FOR k IN range(t - 4, t + 1) IF list_contains({ranks}, CASE k WHEN 1 THEN 14 ELSE k END)]) = 5])"
    cte(f"{prefix}_seven", f"""
        SELECT hand_id, side, [strpos('23456789TJQKA', substr(cards, 2 * i - 1, 1)) + 1 FOR i IN range(1, 8)] AS rs, [substr(cards, 2 * i, 1) FOR i IN range(1, 8)] AS us
        FROM ({hands}) x""")
    cte(f"{prefix}_groups", f"""
        SELECT hand_id, side, rs, list_reverse_sort([{{'c': len([1 FOR x IN rs IF x = r]), 'r': r}} FOR r IN list_distinct(rs)]) AS g,
               list_reverse_sort([rs[i] FOR i IN range(1, 8) IF len([1 FOR u IN us IF u = us[i]]) >= 5]) AS f
        FROM {prefix}_seven""")
    cte(f"{prefix}_made", f"""
        SELECT hand_id, side, g, f, {top.format(ranks='rs')} AS st, {top.format(ranks='f')} AS sf FROM {prefix}_groups""")
    cte(f"{prefix}_ties", f"""
        SELECT hand_id, side,
               CASE WHEN sf = 14 THEN 1 WHEN sf IS NOT NULL THEN 2 WHEN g[1].c = 4 THEN 3 WHEN g[1].c = 3 AND g[2].c >= 2 THEN 4 WHEN len(f) > 0 THEN 5
                    WHEN st IS NOT NULL THEN 6 WHEN g[1].c = 3 THEN 7 WHEN g[2].c = 2 THEN 8 WHEN g[1].c = 2 THEN 9 ELSE 10 END AS rank,
               CASE WHEN sf IS NOT NULL THEN [sf] WHEN g[1].c = 4 THEN [g[1].r]
                    WHEN g[1].c = 3 AND g[2].c >= 2 THEN [g[1].r, list_max([x.r FOR x IN g[2:] IF x.c >= 2])]
                    WHEN len(f) > 0 THEN f[1:5] WHEN st IS NOT NULL THEN [st]
                    WHEN g[1].c = 3 THEN [g[1].r, g[2].r, g[3].r]
                    WHEN g[2].c = 2 THEN [g[1].r, g[2].r, list_max([x.r FOR x IN g[3:]])]
                    ELSE [x.r FOR x IN g][1:CASE WHEN g[1].c = 2 THEN 4 ELSE 5 END] END AS ties
        FROM {prefix}_made""")
    cte(f"{prefix}_rank", f"""
        SELECT hand_id, side, rank, list_reduce(list_concat([(10 - rank)::BIGINT], [COALESCE(ties[i], 0)::BIGINT FOR i IN range(1, 6)]), lambda x, y: 15 * x + y) AS strength
        FROM {prefix}_ties""")


rank_ctes("fx", """SELECT hand_id, 'hero' AS side, hero_cards || board AS cards FROM fx_fold_rows
    UNION ALL SELECT hand_id, 'rival', winner_cards || board FROM fx_fold_rows WHERE winner_cards IS NOT NULL""")
cte("fx_sim", """
    SELECT w.hand_id, h.rank AS hero_rank, r.rank AS rival_rank,
           [NULL, 'Straight Flush', 'Straight Flush', 'Four of a Kind', 'Full House', 'Flush', 'Straight', 'Three of a Kind',
            'Two Pair', 'One Pair', 'High Card'][h.rank + 1] AS hero_hand,
           CASE WHEN r.rank IS NULL THEN NULL ELSE h.strength >= r.strength END AS hero_wins,
           CASE WHEN h.strength > r.strength THEN 0 WHEN h.strength = r.strength THEN -1 WHEN r.rank IS NOT NULL THEN 1 END AS winner_index
    FROM fx_fold_rows w JOIN fx_rank h ON h.hand_id = w.hand_id AND h.side = 'hero'
    LEFT JOIN fx_rank r ON r.hand_id = w.hand_id AND r.side = 'rival'""")


@query("gld7_fold_showdown_analysis", f"""
    SELECT h.hand_id, h.hand_timestamp, h.tournament_id, h.hero_cards, h.hero_position, f.fold_street, h.board, h.total_pot,
           h.big_blind, p.player_name AS winner_name, p.hole_cards AS winner_cards, p.result_description AS winner_hand,
           p.amount_won AS pot_won, p.went_to_showdown AS winner_showed_cards, a.gpt_action AS gpt_advised,
           a.gpt_recommendation, a.pot AS pot_at_decision, a.to_call, a.hero_stack,
           {rnd('p.amount_won / h.big_blind', 1)} AS pot_won_bb,
           CASE WHEN a.gpt_action = 'fold' THEN 'GPT_agreed_fold' WHEN a.gpt_action IN {PLAY} THEN 'GPT_said_play'
                ELSE 'no_gpt_advice' END AS gpt_vs_hero,
           CASE WHEN a.to_call > 0 AND a.pot > 0 THEN {pct('a.to_call', 'a.pot + a.to_call')} END AS pot_odds_pct,
           CASE WHEN a.hero_stack > 0 AND a.to_call > 0 THEN {pct('a.to_call', 'a.hero_stack')} END AS stack_commit_pct,
           CAST(x.winner_index AS BIGINT) AS winner_index, x.hero_wins AS hero_would_have_won, x.hero_hand AS hero_hand_at_showdown,
           CASE WHEN x.hero_wins THEN {rnd('p.amount_won / h.big_blind', 1)}
                WHEN NOT x.hero_wins THEN {rnd('-COALESCE(a.to_call, 0) / h.big_blind', 1)} END AS potential_profit_bb
    FROM fx_h h JOIN fx_p p ON p.hand_id = h.hand_id AND p.won_hand
    JOIN (SELECT hand_id, MIN(street) AS fold_street FROM fx_hand_actions WHERE is_hero AND action_type = 'fold' GROUP BY 1) f
      ON f.hand_id = h.hand_id
    LEFT JOIN (SELECT m.hand_id, s.* FROM fx_s s JOIN fx_map m USING (file_name)) a ON a.hand_id = h.hand_id AND a.street = f.fold_street
    LEFT JOIN fx_sim x ON x.hand_id = h.hand_id
    WHERE h.hero_result = 'folded'""")
def _(t):
    df = folds.fold_showdown_analysis(t.screenshots, d.mapping(t), d.hands(t), d.hand_players(t), t.hand_actions)
    return df.withColumns(
        {"board": F.array_join("board", ""), "winner_index": F.col("showdown_simulation.winner_index")}
    ).drop("showdown_simulation")


cte("fx_judged", f"""
    SELECT b.*, a.action_type AS hero_action, a.amount, {d.verdict('b.gpt_action', 'a.action_type', False)} AS ok,
           {d.verdict('b.gpt_action', 'a.action_type', True)} AS ok_checks
    FROM fx_base b JOIN fx_acts a ON a.hand_id = b.hand_id AND a.street = b.street""")
COMPLIANCE = f"""
    SELECT stage, CASE players WHEN 2 THEN 'heads_up' ELSE 'multiway' END AS table_type, street,
           CASE WHEN stack_bb < 10 THEN 'short_<10bb' WHEN stack_bb < 20 THEN 'medium_10-20bb' ELSE 'deep_>20bb' END AS stack_category,
           CASE WHEN seq * 100 <= all_rows * 33 THEN 'early' WHEN seq * 100 <= all_rows * 66 THEN 'middle' ELSE 'late' END AS tournament_phase,
           COUNT(*) AS total_decisions, {n('ok_checks')} AS followed_count, {n('NOT ok_checks')} AS deviated_count,
           {pct(n('ok_checks'), 'COUNT(*)')} AS compliance_pct,
           {rnd('AVG(profit_bb) FILTER (WHERE ok_checks)', 2)} AS avg_profit_bb_followed,
           {n("ok_checks AND hero_result = 'won'")} AS wins_when_followed,
           {rnd('AVG(profit_bb) FILTER (WHERE NOT ok_checks)', 2)} AS avg_profit_bb_deviated,
           {n("NOT ok_checks AND hero_result = 'won'")} AS wins_when_deviated,
           {n("NOT ok_checks AND gpt_action = 'fold'")} AS ignored_fold_count,
           {n(f"NOT ok_checks AND gpt_action IN {PLAY}")} AS ignored_play_count
    FROM (SELECT j.*, q.seq, q.all_rows, {rnd('j.hero_stack / (j.big_blind / 100)', 1)} AS stack_bb,
                 CASE j.hero_result WHEN 'won' THEN amount_won / big_blind
                      ELSE -(j.total_pot - j.amount_won) / j.big_blind * CAST(0.1 AS DOUBLE) END AS profit_bb
          FROM fx_judged j JOIN (SELECT file_name, row_number() OVER (PARTITION BY tournament_id ORDER BY screenshot_at, file_name) AS seq,
                                        COUNT(*) OVER (PARTITION BY tournament_id) AS all_rows FROM fx_base) q USING (file_name)
          WHERE ok_checks IS NOT NULL) x
    GROUP BY 1, 2, 3, 4, 5"""


@query("gld8_gpt_compliance_stats", COMPLIANCE)
def _(t):
    # Written first: slices are found, summed and sorted on the same rows.
    return advice.gpt_compliance_stats(d.decision_base(t), t.hand_actions)


@query("gld8_gpt_compliance_stats_split", COMPLIANCE)
def _(t):
    return advice.gpt_compliance_stats(d.decision_base(t), t.hand_actions, slice_rows=2_000)


@query("gld9_deviation_outcome_analysis", f"""
    SELECT CASE WHEN ok THEN 'followed_' ELSE 'ignored_' END || CASE gpt_action WHEN 'fold' THEN 'fold' ELSE 'play' END AS decision_type,
           stage, CASE players WHEN 2 THEN 'heads_up' ELSE 'multiway' END AS table_type, hero_action,
           COALESCE(amount >= chips_start * CAST(0.95 AS DOUBLE), false) AS hero_went_allin, COUNT(*) AS total,
           {n("hero_result = 'won'")} AS wins, {n("hero_result = 'lost'")} AS losses, {n("hero_result = 'folded'")} AS folded_later,
           {pct(n("hero_result = 'won'"), 'COUNT(*)')} AS win_rate_pct,
           {rnd("SUM(CASE hero_result WHEN 'won' THEN amount_won / big_blind ELSE 0 END)", 1)} AS total_won_bb,
           {rnd("AVG(amount_won / big_blind) FILTER (WHERE hero_result = 'won')", 1)} AS avg_won_bb
    FROM fx_judged WHERE ok IS NOT NULL GROUP BY 1, 2, 3, 4, 5 HAVING COUNT(*) >= 3""")
def _(t):
    return advice.deviation_outcome_analysis(d.decision_base(t), t.hand_actions)


TILT = f"""
    SELECT session_status, after_big_loss, COUNT(*) AS decisions, {n('ok')} AS followed_count,
           {pct(n('ok'), 'COUNT(*)')} AS compliance_pct, {n("NOT ok AND gpt_action = 'fold'")} AS ignored_fold_count,
           {n("NOT ok AND gpt_action <> 'fold'")} AS ignored_play_count, {n("NOT ok AND hero_result = 'won'")} AS wins_when_deviated,
           {n("NOT ok AND hero_result <> 'won'")} AS losses_when_deviated
    FROM fx_judged JOIN (
        SELECT hand_id, COALESCE(lag(net_profit) OVER w < -10 * big_blind, false) AS after_big_loss,
               CASE WHEN SUM(net_profit) OVER w > 20 * big_blind THEN 'winning_big' WHEN SUM(net_profit) OVER w > 0 THEN 'winning'
                    WHEN SUM(net_profit) OVER w > -20 * big_blind THEN 'losing' ELSE 'losing_big' END AS session_status
        FROM fx_h JOIN (SELECT hand_id, net_profit FROM fx_p WHERE is_hero) USING (hand_id)
        WINDOW w AS (PARTITION BY tournament_id ORDER BY hand_timestamp, hand_id)) USING (hand_id)
    WHERE ok IS NOT NULL GROUP BY 1, 2"""


@query("gld10_tilt_detection", TILT)
def _(t):
    return advice.tilt_detection(t.screenshots, d.mapping(t), t.hands, t.hand_players, t.hand_actions)


@query("gld10_tilt_detection_split", TILT)
def _(t):
    return advice.tilt_detection(t.screenshots, d.mapping(t), t.hands, t.hand_players, t.hand_actions, slice_rows=2_000)


STREAKS = f"""
    SELECT CASE WHEN losses >= 4 THEN '4+ losses' WHEN losses >= 2 THEN '2-3 losses' ELSE '0-1 losses' END AS recent_loss_streak,
           COUNT(*) AS decisions, {pct(n('ok'), 'COUNT(*)')} AS compliance_pct,
           {n("NOT ok AND gpt_action = 'fold'")} AS ignored_fold_count, {n("NOT ok AND hero_result = 'won'")} AS wins_when_deviated
    FROM fx_judged JOIN (
        SELECT hand_id, COUNT(*) FILTER (WHERE hero_result <> 'won') OVER (
            PARTITION BY tournament_id ORDER BY hand_timestamp, hand_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS losses
        FROM fx_h) USING (hand_id)
    WHERE ok IS NOT NULL GROUP BY 1"""


@query("gld11_tilt_consecutive_losses", STREAKS)
def _(t):
    return advice.tilt_consecutive_losses(t.hands, d.mapping(t), t.screenshots, t.hand_actions)


@query("gld11_tilt_consecutive_losses_split", STREAKS)
def _(t):
    return advice.tilt_consecutive_losses(t.hands, d.mapping(t), t.screenshots, t.hand_actions, slice_rows=2_000)


@query("gld12_headsup_analysis", f"""
    SELECT players = 2 AS is_headsup, stage, gpt_action AS gpt_recommended, COUNT(*) AS total_decisions,
           {pct('COUNT(*)', 'SUM(COUNT(*)) OVER (PARTITION BY players = 2, stage)')} AS pct_of_recommendations,
           {n('ok')} AS followed_count, {pct(n('ok'), 'COUNT(*)')} AS compliance_pct,
           {n("ok AND hero_result = 'won'")} AS wins_when_followed, {pct(n("ok AND hero_result = 'won'"), n('ok'))} AS win_rate_when_followed,
           {n("NOT ok AND hero_result = 'won'")} AS wins_when_deviated,
           {pct(n("NOT ok AND hero_result = 'won'"), n('NOT ok'))} AS win_rate_when_deviated
    FROM fx_judged WHERE ok IS NOT NULL GROUP BY 1, 2, 3""")
def _(t):
    return advice.headsup_analysis(d.decision_base(t), t.hand_actions)


MONEY_IN = "a.action_type IN ('call', 'raise', 'bet')"


@query("gld13_headsup_fold_analysis", f"""
    SELECT b.stage, b.street, COUNT(*) AS gpt_fold_recommendations, {n("a.action_type = 'fold'")} AS hero_folded,
           {n(MONEY_IN)} AS hero_played, {n(f"{MONEY_IN} AND hero_result = 'won'")} AS won_when_ignored_fold,
           {n(f"{MONEY_IN} AND hero_result <> 'won'")} AS lost_when_ignored_fold,
           {pct(n(f"{MONEY_IN} AND hero_result = 'won'"), n(MONEY_IN))} AS win_rate_when_ignored_fold_pct,
           {rnd(f"AVG(net_profit / big_blind) FILTER (WHERE {MONEY_IN} AND hero_result = 'won')", 1)} AS avg_won_bb,
           {rnd(f"AVG(net_profit / big_blind) FILTER (WHERE {MONEY_IN} AND hero_result <> 'won')", 1)} AS avg_lost_bb,
           {rnd(f"COALESCE(SUM(net_profit / big_blind) FILTER (WHERE {MONEY_IN}), 0)", 1)} AS total_net_bb_ignoring_fold,
           {rnd(f"AVG(net_profit / big_blind) FILTER (WHERE {MONEY_IN})", 1)} AS avg_net_bb_per_hand
    FROM fx_base b LEFT JOIN fx_acts a ON a.hand_id = b.hand_id AND a.street = b.street
    WHERE b.players = 2 AND b.gpt_action = 'fold' GROUP BY 1, 2""")
def _(t):
    return advice.headsup_fold_analysis(
        t.screenshots, d.mapping(t), t.hands, t.hand_players, t.hand_actions, t.screenshot_players
    )


def hand_class_sql(cards: str) -> str:
    a, b = f"substr({cards}, 1, 1)", f"substr({cards}, 3, 1)"
    order = "strpos('23456789TJQKA', {})"
    return (
        f"CASE WHEN {a} = {b} THEN {a} || {b} ELSE "
        f"CASE WHEN {order.format(a)} > {order.format(b)} THEN {a} || {b} ELSE {b} || {a} END || "
        f"CASE WHEN substr({cards}, 2, 1) = substr({cards}, 4, 1) THEN 's' ELSE 'o' END END"
    )


cte("fx_allin", f"""
    SELECT s.*, {hand_class_sql('s.hero_cards')} AS hand_type, {pct('s.to_call', 's.hero_stack')} AS pct_of_stack,
           m.hand_id, h.hero_result, p.net_profit / h.big_blind AS net_bb
    FROM fx_s s LEFT JOIN fx_map m USING (file_name) LEFT JOIN fx_h h ON h.hand_id = m.hand_id
    LEFT JOIN fx_p p ON p.hand_id = m.hand_id AND p.is_hero
    WHERE s.stage = 'rush' AND s.to_call * 2 > s.hero_stack AND s.gpt_action IN ('call', 'raise')""")
IN = "a.action_type IN ('call', 'raise')"


@query("gld14_rush_allin_call_analysis", f"""
    SELECT hand_type, COUNT(*) AS total_situations, {n(IN)} AS hero_played, {n("a.action_type = 'fold'")} AS hero_folded,
           {n(f"{IN} AND hero_result = 'won'")} AS wins, {n(f"{IN} AND hero_result <> 'won'")} AS losses,
           {pct(n(f"{IN} AND hero_result = 'won'"), n(IN))} AS win_rate_pct,
           {rnd(f'COALESCE(SUM(net_bb) FILTER (WHERE {IN}), 0)', 1)} AS total_net_bb,
           {rnd(f'AVG(net_bb) FILTER (WHERE {IN})', 1)} AS avg_net_bb_per_hand, {rnd('AVG(pct_of_stack)', 1)} AS avg_pct_of_stack
    FROM fx_allin x LEFT JOIN fx_acts a ON a.hand_id = x.hand_id AND a.street = x.street
    GROUP BY 1 HAVING COUNT(*) >= 2""")
def _(t):
    return spots.rush_allin_call_analysis(t.screenshots, d.mapping(t), t.hands, t.hand_players, t.hand_actions)


@query("gld15_rush_allin_call_details", f"""
    SELECT hand_type, hero_cards, hero_pos, hero_stack, to_call, pct_of_stack, pot, gpt_action, gpt_recommendation, hero_result,
           a.hero_action, {rnd('net_bb', 1)} AS net_profit_bb, file_name, screenshot_at
    FROM fx_allin x LEFT JOIN (SELECT hand_id, street, arg_min(action_type, action_order) AS hero_action FROM fx_hand_actions
         WHERE is_hero AND action_type IN ('fold', 'call', 'raise', 'check', 'bet') GROUP BY ALL) a
      ON a.hand_id = x.hand_id AND a.street = x.street""")
def _(t):
    return spots.rush_allin_call_details(t.screenshots, d.mapping(t), t.hands, t.hand_players, t.hand_actions)


cte("fx_behind", """
    SELECT * FROM (VALUES ('UTG', ['UTG+1', 'HJ', 'MP', 'CO', 'BTN', 'SB', 'BB']), ('UTG+1', ['HJ', 'MP', 'CO', 'BTN', 'SB', 'BB']),
        ('HJ', ['CO', 'BTN', 'SB', 'BB']), ('MP', ['CO', 'BTN', 'SB', 'BB']), ('CO', ['BTN', 'SB', 'BB']), ('BTN', ['SB', 'BB']),
        ('SB', ['BB'])) t(pos, later)""")
cte("fx_raises", """
    SELECT s.file_name, s.screenshot_at, s.hero_cards, s.hero_pos, s.hero_stack, s.gpt_recommendation, h.hand_id, h.hero_result,
           h.big_blind, p.net_profit, p.net_profit / h.big_blind AS net_bb,
           (SELECT MAX(o.chips_start / h.big_blind) FROM fx_p o JOIN fx_behind b ON b.pos = s.hero_pos
            WHERE o.hand_id = h.hand_id AND NOT o.is_hero AND list_contains(b.later, o.position)) AS max_stack_behind,
           COALESCE(x.raised, 0) AS raised, COALESCE(x.gone, 0) AS folded, COALESCE(x.deeds, 0) AS hero_action_count
    FROM fx_s s LEFT JOIN fx_map m USING (file_name) LEFT JOIN fx_h h ON h.hand_id = m.hand_id
    LEFT JOIN fx_p p ON p.hand_id = m.hand_id AND p.is_hero
    LEFT JOIN (SELECT hand_id, CAST(bool_or(street = 'preflop' AND action_type = 'raise') AS BIGINT) AS raised,
                      CAST(bool_or(action_type = 'fold') AS BIGINT) AS gone, COUNT(DISTINCT action_order) AS deeds
               FROM fx_acts GROUP BY 1) x ON x.hand_id = m.hand_id
    WHERE s.stage = 'final' AND s.street = 'preflop' AND s.gpt_action = 'raise'
      AND regexp_matches(s.gpt_recommendation, '2\\..*BB|2 BB|3.*BB')""")
STACK_BIN = "CASE WHEN hero_stack <= 12 THEN 'short_10-12bb' WHEN hero_stack <= 15 THEN 'short_13-15bb' WHEN hero_stack <= 20 THEN 'medium_16-20bb' ELSE 'deep_20+bb' END"
COVERED = "COALESCE(max_stack_behind, 0) > hero_stack * 1.5"


def outcomes(t):
    return spots.small_raise_outcomes(t.screenshots, d.mapping(t), t.hands, t.hand_players, t.hand_actions)


@query("agg10_count_distinct_small_raise_outcomes", f"SELECT *, {COVERED} AS covered FROM fx_raises")
def _(t):
    return outcomes(t)


@query("gld16_final_small_raise_analysis", f"""
    SELECT CASE WHEN raised = 0 THEN 'did_not_raise' WHEN folded = 1 THEN 'raised_then_folded' WHEN hero_result = 'won' THEN 'raised_and_won'
                WHEN hero_result IN ('lost', 'folded') THEN 'raised_and_lost' ELSE 'other' END AS outcome_type,
           CASE WHEN {COVERED} THEN 'big_stack_behind' ELSE 'no_big_stack_behind' END AS stack_situation,
           {STACK_BIN} AS hero_stack_category, COUNT(*) AS total, {rnd('SUM(net_bb)', 1)} AS total_net_bb,
           {rnd('AVG(net_bb)', 1)} AS avg_net_bb, {rnd('AVG(hero_stack)', 1)} AS avg_hero_stack,
           {rnd('AVG(max_stack_behind)', 1)} AS avg_max_stack_behind
    FROM fx_raises GROUP BY 1, 2, 3""")
def _(t):
    return spots.final_small_raise_analysis(outcomes(t))


@query("gld17_final_raise_then_fold_details", f"""
    SELECT r.file_name, hero_cards, hero_pos, {rnd('hero_stack', 1)} AS hero_stack, {rnd('max_stack_behind', 1)} AS max_stack_behind,
           z.position AS shover_pos, {rnd('z.chips_start / r.big_blind', 1)} AS shover_stack, z.vpip AS shover_vpip,
           {rnd('net_bb', 1)} AS net_bb, {STACK_BIN} AS hero_stack_cat,
           CASE WHEN {COVERED} THEN 'big_behind' ELSE 'no_big_behind' END AS stack_sit
    FROM fx_raises r LEFT JOIN (
        SELECT a.hand_id, p.position, p.chips_start, p.vpip FROM fx_hand_actions a JOIN fx_p p USING (hand_id, player_name)
        WHERE NOT a.is_hero AND a.street = 'preflop' AND a.action_type = 'raise' AND a.is_allin
        QUALIFY row_number() OVER (PARTITION BY a.hand_id ORDER BY a.action_order) = 1) z ON z.hand_id = r.hand_id
    WHERE raised = 1 AND folded = 1""")
def _(t):
    return spots.final_raise_then_fold_details(outcomes(t), t.hand_players, t.hand_actions)


@query("gld18_player_hand_stats", "SELECT * FROM fx_stats")
def _(t):
    return d.player_hand_stats(t)


def share(condition: str, base: str | None = None) -> str:
    return pct(n(f"{condition} AND {base}") if base else n(condition), n(base))


STATISTICS = {
    "total_hands": "COUNT(*)", "vpip_pct": share("vpip"), "pfr_pct": share("pfr"), "three_bet_pct": share("three_bet"),
    "aggression_factor": rnd("CAST(SUM(total_bets + total_raises) AS DOUBLE) / NULLIF(SUM(total_calls), 0)", 2),
    "wtsd_pct": share("went_to_showdown"), "wsd_pct": share("won_hand", "went_to_showdown"), "allin_pct": share("went_allin"),
    "avg_preflop_raise_bb": rnd("AVG(preflop_raise_bb)", 1), "avg_bet_size_bb": rnd("AVG(avg_action_size_bb)", 1),
    "total_net_profit": "SUM(net_profit)",
    "open_raise_early_pct": share("pfr", "position_group = 'early'"), "open_raise_middle_pct": share("pfr", "position_group = 'middle'"),
    "open_raise_late_pct": share("pfr", "position_group = 'late'"), "sb_open_pct": share("pfr", "position = 'SB'"),
    "bb_defend_pct": share("vpip", "position = 'BB'"),
    "rush_hands": n("stage = 'rush'"), "rush_vpip_pct": share("vpip", "stage = 'rush'"), "rush_pfr_pct": share("pfr", "stage = 'rush'"),
    "rush_3bet_pct": share("three_bet", "stage = 'rush'"), "rush_allin_pct": share("went_allin", "stage = 'rush'"),
    "rush_wtsd_pct": share("went_to_showdown", "stage = 'rush'"),
    "rush_wsd_pct": share("won_hand", "stage = 'rush' AND went_to_showdown"),
    "rush_net_profit": "COALESCE(SUM(net_profit) FILTER (WHERE stage = 'rush'), 0)",
    "ft_hands": n("stage = 'final'"), "ft_vpip_pct": share("vpip", "stage = 'final'"), "ft_pfr_pct": share("pfr", "stage = 'final'"),
    "ft_allin_pct": share("went_allin", "stage = 'final'"), "ft_shove_short_pct": share("went_allin", "stage = 'final' AND stack_bb <= 10"),
    "ft_shove_medium_pct": share("went_allin", "stage = 'final' AND stack_bb > 10 AND stack_bb <= 20"),
    "ft_shove_deep_pct": share("went_allin", "stage = 'final' AND stack_bb > 20"),
    "ft_shove_late_pct": share("went_allin", "stage = 'final' AND position_group = 'late'"),
    "ft_shove_blinds_pct": share("went_allin", "stage = 'final' AND position_group = 'blinds'"),
    "ft_open_shove_pct": pct(n("stage = 'final' AND preflop_shove"), n("stage = 'final' AND pfr")),
}
cte("fx_statistics", f"""
    SELECT *, CASE WHEN vpip_pct >= 40 THEN CASE WHEN pfr_pct >= 25 THEN 'LAG' ELSE 'LP' END
                   WHEN vpip_pct < 25 THEN CASE WHEN pfr_pct >= 18 THEN 'TAG' ELSE 'NIT' END ELSE 'REG' END AS player_type,
           CASE WHEN aggression_factor >= 3 THEN 'very_aggressive' WHEN aggression_factor >= 2 THEN 'aggressive'
                WHEN aggression_factor >= 1 THEN 'neutral' ELSE 'passive' END AS aggression_style
    FROM (SELECT player_name, {', '.join(f'{v} AS {k}' for k, v in STATISTICS.items())} FROM fx_stats GROUP BY 1) x""")


@query("gld19_player_statistics", "SELECT * FROM fx_statistics")
def _(t):
    return players.player_statistics(d.player_hand_stats(t))


@query("gld19_player_statistics_in_batches", "SELECT * FROM fx_statistics")
def _(t):
    stats, name, folder = d.stored(t, d.player_hand_stats(t)), f"player_sums_{uuid4().hex[:12]}", d.fresh_dir(t)
    number = F.pmod(F.xxhash64("hand_id"), F.lit(3))
    for batch in (0, 1, 2, 1):  # the second one twice
        merged = players.merge_hands(t.spark, name, stats.filter(number == batch), f"day{batch}", folder)
    return merged


A, B = "strpos('23456789TJQKA', substr(hole_cards, 1, 1)) + 1", "strpos('23456789TJQKA', substr(hole_cards, 3, 1)) + 1"
cte("fx_shoves", f"""
    SELECT player_name, hand_id, stage, position, position_group, stack_bb,
           CASE WHEN stack_bb <= 10 THEN 'short' WHEN stack_bb <= 20 THEN 'medium' ELSE 'deep' END AS stack_category, hole_cards,
           {hand_class_sql('hole_cards')} AS hand_notation,
           CASE WHEN a = b THEN CASE WHEN a >= 11 THEN 'premium_pair' WHEN a >= 9 THEN 'medium_pair' WHEN a >= 6 THEN 'small_pair' ELSE 'micro_pair' END
                WHEN (a, b) = (14, 13) THEN 'premium_broadway' WHEN a = 14 AND b >= 11 THEN 'strong_ace'
                WHEN (a, b) = (13, 12) THEN 'strong_broadway' WHEN 14 IN (a, b) THEN CASE WHEN same THEN 'Axs' ELSE 'Axo' END
                WHEN least(a, b) >= 10 THEN CASE WHEN same THEN 'broadway_suited' ELSE 'broadway_offsuit' END
                WHEN same AND abs(a - b) = 1 THEN 'suited_connector' WHEN same AND abs(a - b) <= 3 THEN 'suited_gapper'
                WHEN same AND 13 IN (a, b) THEN 'Kxs' ELSE 'trash' END AS hand_category,
           same AS is_suited, a = b AS is_pocket_pair, won_hand, net_profit
    FROM (SELECT *, {A} AS a, {B} AS b, substr(hole_cards, 2, 1) = substr(hole_cards, 4, 1) AS same FROM fx_stats
          WHERE went_allin AND preflop_shove AND hole_cards <> '') x""")


@query("gld20_player_shove_profile", "SELECT * FROM fx_shoves")
def _(t):
    return players.player_shove_profile(d.player_hand_stats(t))


def kinds(*names: str) -> str:
    return pct(n(f"hand_category IN ({', '.join(repr(x) for x in names)})"), n())


@query("gld21_player_shove_summary", f"""
    SELECT player_name, stage, stack_category, position_group, COUNT(*) AS total_shoves, {pct(n('won_hand'), n())} AS win_rate,
           {kinds('premium_pair', 'premium_broadway')} AS premium_pct, {kinds('medium_pair', 'strong_ace', 'strong_broadway')} AS strong_pct,
           {kinds('small_pair', 'micro_pair')} AS small_pair_pct, {kinds('Axs', 'Axo')} AS ax_pct, {kinds('trash')} AS trash_pct,
           string_agg(hand_notation, ', ' ORDER BY hand_notation) AS hands_shown
    FROM fx_shoves GROUP BY ALL""")
def _(t):
    profile = d.stored(t, players.player_shove_profile(d.player_hand_stats(t)))
    spelled = players.shoves_spelled(profile).drop("part")
    on = [F.col(f"s.{c}").eqNullSafe(F.col(f"p.{c}")) for c in players.SHOVE_GROUP]
    summary = players.player_shove_summary(profile).drop("hands")
    return summary.alias("s").join(spelled.alias("p"), on, "left").select("s.*", F.coalesce("hands_shown", F.lit("")).alias("hands_shown"))
