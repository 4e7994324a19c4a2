"""Round trips: raw files are rendered from the tables, parsed, and compared with the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pokerlake.functions.times import capture_time
from pokerlake.operators import captures, hand_text, tournament_text
from pokerlake.streaming import spots as spots_stream
from workload import derived as d
from workload import render
from workload.registry import cte, dbl, pct, query, rnd

FILE = f"'history_' || CAST(CAST(floor(k / {render.HANDS_PER_FILE}) AS BIGINT) AS VARCHAR) || '.txt'"


def blocks(t) -> DataFrame:
    return hand_text.hand_blocks(render.hand_files(t))


def parsed(t) -> DataFrame:
    return hand_text.parse_hands(render.hand_files(t))


@query("par1_hand_blocks", f"""
    SELECT {FILE} AS file_name, row_number() OVER (PARTITION BY floor(k / {render.HANDS_PER_FILE}) ORDER BY k) - 1 AS block_no,
           'Poker Hand #' || hand_id AS opening FROM fx_hands""")
def _(t):
    return blocks(t).select("file_name", "block_no", F.substring_index("block", ":", 1).alias("opening"))


cte("fx_header", f"""
    SELECT {FILE} AS file_name, k, hand_id, tournament_id, 'Evening Series' AS tournament_name,
           CASE WHEN k % 2 = 0 THEN 10.0::DOUBLE ELSE 2.5::DOUBLE END AS buy_in, 'Hold''em No Limit' AS game_type,
           CAST(level AS BIGINT) AS level, CAST(small_blind AS BIGINT) AS small_blind, CAST(big_blind AS BIGINT) AS big_blind,
           hand_timestamp, CAST(k % 40 + 1 AS VARCHAR) AS table_name, CAST(6 AS BIGINT) AS max_seats,
           CAST(button_seat AS BIGINT) AS button_seat FROM fx_hands""")


@query("par2_hand_headers", "SELECT hand_id, tournament_id, tournament_name, buy_in, game_type, level, hand_timestamp FROM fx_header")
def _(t):
    return hand_text.hand_headers(blocks(t)).select(
        "hand_id", "tournament_id", "tournament_name", "buy_in", "game_type", "level", "hand_timestamp"
    )


@query("par3_blinds", "SELECT hand_id, small_blind, big_blind FROM fx_header")
def _(t):
    return hand_text.hand_headers(blocks(t)).select("hand_id", "small_blind", "big_blind")


@query("par4_table_line", "SELECT hand_id, table_name, max_seats, button_seat FROM fx_header")
def _(t):
    return hand_text.hand_headers(blocks(t)).select("hand_id", "table_name", "max_seats", "button_seat")


def seats(t) -> DataFrame:
    return parsed(t).select("hand_id", F.explode("seats").alias("s")).select("hand_id", "s.*")


@query("par5_hand_seats", """
    SELECT hand_id, CAST(seat AS BIGINT) AS seat, player_name AS name, CAST(chips_start AS BIGINT) AS stack, is_hero FROM fx_hand_players""")
def _(t):
    return seats(t).select("hand_id", "seat", "name", "stack", "is_hero")


@query("par6_dealt_cards", """
    SELECT hand_id, 'Hero' AS name, substr(hero_cards, 1, 2) || ' ' || substr(hero_cards, 3, 2) AS cards FROM fx_hands""")
def _(t):
    return seats(t).filter("cards IS NOT NULL").select("hand_id", "name", "cards")


cte("fx_played", """
    SELECT a.*, h.k, a.is_allin AND a.action_type IN ('call', 'bet', 'raise') AS allin
    FROM fx_hand_actions a JOIN fx_hands h USING (hand_id)
    WHERE NOT (h.k % 9 = 4 AND a.street IN ('turn', 'river'))""")


@query("par7_line_streets", "SELECT hand_id, street, COUNT(*) AS lines FROM fx_played GROUP BY ALL")
def _(t):
    events = hand_text.line_streets(hand_text.hand_headers(blocks(t))).select("hand_id", F.explode("events").alias("e"))
    acts = events.filter(F.col("e.kind").isin("fold", "check", "call", "bet", "raise"))
    return acts.groupBy("hand_id", F.col("e.street").alias("street")).agg(F.count(F.lit(1)).alias("lines"))


SHOWN = "CASE WHEN k % 9 = 4 THEN substr(board_str, 1, 6) ELSE board_str END"


@query("par8_boards", f"""
    SELECT hand_id, substr(board_str, 1, 2) || ' ' || substr(board_str, 3, 2) || ' ' || substr(board_str, 5, 2) AS flop,
           CASE WHEN k % 9 <> 4 THEN substr(board_str, 7, 2) END AS turn, CASE WHEN k % 9 <> 4 THEN substr(board_str, 9, 2) END AS river,
           {SHOWN} AS board FROM fx_hands""")
def _(t):
    return parsed(t).select("hand_id", "flop", "turn", "river", F.array_join("board", "").alias("board"))


def action_rows(t) -> DataFrame:
    return hand_text.build_actions(parsed(t))


@query("par9_action_types", "SELECT hand_id, CAST(action_order AS BIGINT) AS action_order, player_name, action_type FROM fx_played")
def _(t):
    return action_rows(t).select("hand_id", "action_order", "player_name", "action_type")


@query("par10_amounts", "SELECT hand_id, CAST(action_order AS BIGINT) AS action_order, amount FROM fx_played WHERE amount IS NOT NULL")
def _(t):
    return action_rows(t).filter("amount IS NOT NULL").select("hand_id", "action_order", "amount")


@query("par11_all_in", "SELECT street, action_type, COUNT(*) FILTER (WHERE allin) AS all_ins, COUNT(*) AS lines FROM fx_played GROUP BY ALL")
def _(t):
    return action_rows(t).groupBy("street", "action_type").agg(
        F.count_if("is_allin").alias("all_ins"), F.count(F.lit(1)).alias("lines")
    )


@query("par12_ante_and_winners", """
    SELECT hand_id, CAST(big_blind / 10 AS BIGINT) AS ante, p.player_name AS winners
    FROM fx_hands JOIN (SELECT hand_id, player_name FROM fx_hand_players WHERE won_hand) p USING (hand_id)""")
def _(t):
    return parsed(t).select("hand_id", "ante", F.array_join("winners", ",").alias("winners"))


@query("par13_pot_and_rake", "SELECT hand_id, CAST(total_pot AS BIGINT) AS total_pot, k % 3 AS rake FROM fx_hands")
def _(t):
    return parsed(t).select("hand_id", "total_pot", "rake")


@query("par14_results", """
    SELECT hand_id, player_name, CASE position WHEN 'BTN' THEN CASE WHEN seat = 0 THEN NULL ELSE 'button' END WHEN 'SB' THEN 'small blind' END AS position_text,
           NOT (won_hand OR went_to_showdown) AS folded, CASE WHEN NOT (won_hand OR went_to_showdown) THEN 'before Flop' END AS folded_street,
           CASE WHEN went_to_showdown THEN substr(hole_cards, 1, 2) || ' ' || substr(hole_cards, 3, 2) END AS cards,
           CAST(amount_won AS BIGINT) AS won_amount,
           CASE WHEN won_hand AND went_to_showdown THEN 'two pair, Tens and Fours' WHEN went_to_showdown THEN 'a pair of Twos' END AS hand_description
    FROM fx_hand_players""")
def _(t):
    return parsed(t).select("hand_id", F.explode("results").alias("r")).select("hand_id", "r.*")


@query("par15_positions", "SELECT hand_id, CAST(seat AS BIGINT) AS seat, position FROM fx_hand_players")
def _(t):
    return seats(t).select("hand_id", "seat", "position")


cte("fx_hero_seat", "SELECT * FROM fx_hand_players WHERE is_hero")


@query("par16_derived_fields", """
    SELECT hand_id, h.hero_cards, p.position AS hero_position, CAST(p.chips_start AS BIGINT) AS hero_stack, p.won_hand AS hero_won, true AS went_to_showdown
    FROM fx_hands h JOIN fx_hero_seat p USING (hand_id)""")
def _(t):
    return hand_text.hands_flat(parsed(t)).select(
        "hand_id", F.concat("hero_card_1", "hero_card_2").alias("hero_cards"), "hero_position", "hero_stack", "hero_won", "went_to_showdown"
    )


@query("par17_hands_nested", """
    SELECT hand_id, 6 AS players, 6 AS results, COUNT(*) FILTER (WHERE street = 'preflop') AS preflop,
           COUNT(*) FILTER (WHERE street = 'flop') AS flop, COUNT(*) FILTER (WHERE street IN ('turn', 'river')) AS later
    FROM fx_hands LEFT JOIN fx_played USING (hand_id) GROUP BY hand_id""".replace("6 AS", "CAST(6 AS BIGINT) AS"))
def _(t):
    nested = hand_text.hands_nested(parsed(t))
    return nested.select(
        "hand_id", F.size("players").alias("players"), F.size("results").alias("results"),
        F.size("preflop_actions").alias("preflop"), F.size("flop_actions").alias("flop"),
        (F.size("turn_actions") + F.size("river_actions")).alias("later"),
    )


@query("par18_hands_flat", f"""
    SELECT h.hand_id, any_value(substr(hero_cards, 1, 2)) AS hero_card_1, any_value(substr(hero_cards, 3, 2)) AS hero_card_2,
           any_value(substr(board_str, 5, 2)) AS flop_3, any_value(substr({SHOWN}, 7, 2)) AS turn_card, any_value(NULLIF(substr({SHOWN}, 9, 2), '')) AS river_card,
           CAST(6 AS BIGINT) AS num_players, COUNT(*) FILTER (WHERE street = 'preflop') AS preflop_action_count,
           COUNT(*) FILTER (WHERE street = 'turn') AS turn_action_count
    FROM fx_hands h LEFT JOIN (SELECT hand_id, street FROM fx_played) a ON a.hand_id = h.hand_id GROUP BY h.hand_id""".replace(
    f"any_value(substr({SHOWN}, 7, 2))", f"any_value(NULLIF(substr({SHOWN}, 7, 2), ''))"))
def _(t):
    return hand_text.hands_flat(parsed(t)).select(
        "hand_id", "hero_card_1", "hero_card_2", "flop_3", "turn_card", "river_card", "num_players", "preflop_action_count", "turn_action_count"
    )


@query("par19_hero_result", """
    SELECT CASE WHEN won_hand THEN 'won' WHEN went_to_showdown THEN 'lost' ELSE 'folded' END AS hero_result, COUNT(*) AS hands FROM fx_hero_seat GROUP BY 1""")
def _(t):
    return hand_text.build_hands(parsed(t)).groupBy("hero_result").agg(F.count(F.lit(1)).alias("hands"))


@query("par20_build_hands", f"""
    SELECT h.hand_id, h.tournament_id, e.tournament_name, e.game_type, e.level, h.small_blind, h.big_blind, h.big_blind / 10 AS ante, e.table_name,
           e.max_seats, e.button_seat, h.hand_timestamp, {SHOWN.replace('k %', 'h.k %')} AS board, h.total_pot, {dbl('h.k % 3')} AS rake,
           CAST(1 AS BIGINT) AS hero_seat, p.position AS hero_position, h.hero_cards, p.chips_start AS hero_chips_start,
           CASE WHEN p.won_hand THEN 'won' WHEN p.went_to_showdown THEN 'lost' ELSE 'folded' END AS hero_result, e.file_name
    FROM fx_hands h JOIN fx_header e USING (hand_id) JOIN fx_hero_seat p USING (hand_id)""")
def _(t):
    return hand_text.build_hands(parsed(t)).withColumn("board", F.array_join("board", "")).drop("ingested_at")


MONEY_IN = "action_type IN ('call', 'raise', 'bet')"
cte("fx_player_deeds", f"""
    SELECT hand_id, player_name, bool_or(street = 'preflop' AND {MONEY_IN}) AS vpip,
           bool_or(street = 'preflop' AND action_type IN ('raise', 'bet')) AS pfr, bool_or(COALESCE(raise_no >= 2, false)) AS three_bet,
           SUM(amount) FILTER (WHERE {MONEY_IN}) AS invested,
           string_agg(action_type || COALESCE(' ' || CAST(CAST(amount AS BIGINT) AS VARCHAR), ''), ';' ORDER BY action_order)
               FILTER (WHERE street = 'preflop') AS preflop_actions,
           COUNT(*) FILTER (WHERE street <> 'preflop' AND action_type = 'bet') AS total_bets,
           COUNT(*) FILTER (WHERE action_type = 'raise') AS total_raises, COUNT(*) FILTER (WHERE action_type = 'call') AS total_calls
    FROM (SELECT *, CASE WHEN street = 'preflop' AND action_type = 'raise' THEN
                 COUNT(*) FILTER (WHERE street = 'preflop' AND action_type = 'raise') OVER (PARTITION BY hand_id ORDER BY action_order) END AS raise_no
          FROM fx_played) x GROUP BY hand_id, player_name""")
cte("fx_parsed_players", """
    SELECT p.hand_id, CAST(p.seat AS BIGINT) AS seat, p.player_name, p.is_hero, p.position, p.position = 'BTN' AS is_button,
           p.position = 'SB' AS is_sb, p.position = 'BB' AS is_bb, p.chips_start, p.hole_cards,
           p.won_hand OR p.went_to_showdown AS went_to_showdown, p.won_hand, p.amount_won, COALESCE(d.invested, 0) AS total_invested,
           p.amount_won - COALESCE(d.invested, 0) AS net_profit,
           CASE WHEN p.won_hand AND p.went_to_showdown THEN 'two pair, Tens and Fours' WHEN p.went_to_showdown THEN 'a pair of Twos' END AS result_description,
           COALESCE(d.vpip, false) AS vpip, COALESCE(d.pfr, false) AS pfr, COALESCE(d.three_bet, false) AS three_bet,
           COALESCE(d.preflop_actions, '') AS preflop_actions, COALESCE(d.total_bets, 0) AS total_bets,
           COALESCE(d.total_raises, 0) AS total_raises, COALESCE(d.total_calls, 0) AS total_calls
    FROM fx_hand_players p LEFT JOIN fx_player_deeds d USING (hand_id, player_name)""")


def player_rows(t) -> DataFrame:
    return hand_text.build_players(parsed(t)).withColumn("preflop_actions", F.array_join("preflop_actions", ";"))


for _name, _columns in {
    "par21_preflop_flags": "hand_id, seat, vpip, pfr",
    "par22_three_bet": "hand_id, seat, three_bet",
    "par23_player_money": "hand_id, seat, total_invested, amount_won, net_profit",
    "par24_showdown_flags": "hand_id, seat, went_to_showdown, won_hand, hole_cards, result_description",
    "par25_action_counts": "hand_id, seat, preflop_actions, total_bets, total_raises, total_calls",
}.items():
    query(_name, f"SELECT {_columns} FROM fx_parsed_players")(
        lambda t, columns=_columns: player_rows(t).select(*columns.split(", "))
    )


@query("par23_build_players", "SELECT * FROM fx_parsed_players")
def _(t):
    return player_rows(t)


@query("par26_build_actions", """
    SELECT hand_id, CAST(action_order AS BIGINT) AS action_order, street, CAST(seat AS BIGINT) AS seat, player_name, is_hero, action_type, amount,
           allin AS is_allin, CAST(NULL AS DOUBLE) AS raise_to, CAST(NULL AS VARCHAR) AS raw_line FROM fx_played""")
def _(t):
    return action_rows(t)


cte("fx_summaries", f"""
    SELECT tournament_id, 'Evening Series' AS tournament_name, 'Hold''em No Limit' AS game_type, {dbl('buyin_prize')} AS buyin_prize,
           CAST(0.8 AS DOUBLE) AS buyin_rake, CAST(4.2 AS DOUBLE) AS buyin_bounty, {dbl('buyin_total')} AS buyin_total, CAST(18 AS BIGINT) AS total_players,
           {dbl('buyin_prize')} AS prize_pool, started_at, CAST(hero_position AS BIGINT) AS hero_position, {dbl('hero_prize')} AS hero_prize,
           'summary_' || CAST(tournament_id AS VARCHAR) || '.txt' AS file_name
    FROM fx_tournaments WHERE tournament_id % 50 <> 7""")


def summaries(t) -> DataFrame:
    return tournament_text.parse_tournaments(render.summary_files(t).drop("tournament_id"))


@query("par27_parse_tournaments", "SELECT * FROM fx_summaries")
def _(t):
    return summaries(t)


@query("par28_roi_and_itm", f"""
    SELECT tournament_id, {rnd('(hero_prize - buyin_total) / buyin_total * 100', 4)} AS roi, hero_prize > 0 AS is_itm FROM fx_summaries""")
def _(t):
    roi = F.round(tournament_text.roi(F.col("hero_prize"), F.col("buyin_total")).cast("decimal(38,10)"), 4).cast("double")
    return summaries(t).select("tournament_id", roi.alias("roi"), tournament_text.is_itm(F.col("hero_prize")).alias("is_itm"))


@query("par29_build_tournaments", "SELECT * FROM fx_summaries")
def _(t):
    return tournament_text.build_tournaments(summaries(t)).drop("ingested_at")


cte("fx_captures", """
    SELECT s.*, c.copy, s.screenshot_at + c.copy * INTERVAL 3 SECOND AS taken_at,
           'screenshot_' || strftime(s.screenshot_at + c.copy * INTERVAL 3 SECOND, '%Y%m%d_%H%M%S') || '_' || CAST(k AS VARCHAR) || '_' || CAST(shot AS VARCHAR)
               || '_' || CAST(c.copy AS VARCHAR) AS capture, CASE c.copy WHEN 1 THEN 'allin' ELSE gpt_action END AS advised,
           CASE WHEN shot = 1 THEN '2c,7d,Jh' END AS board,
           s.file_name AS shot_file
    FROM fx_screenshots s CROSS JOIN (VALUES (0), (1)) c(copy) WHERE (c.copy = 0 OR k % 5 = 0)""")
cte("fx_spots", """
    SELECT *, concat_ws('|', strftime(time_bucket(INTERVAL 600 SECOND, taken_at, TIMESTAMP '1970-01-01'), '%Y%m%d_%H%M'), hero_cards, hero_pos, street,
              COALESCE(board, ''), CAST(pot AS VARCHAR)) AS spot_key
    FROM fx_captures WHERE gpt_action IS NOT NULL""")
cte("fx_first", "SELECT * FROM fx_spots QUALIFY row_number() OVER (PARTITION BY spot_key ORDER BY taken_at, capture) = 1")


#: Files of a part come in any order of time, so all of them belong to one micro-batch.
ALL_FILES = 2**31 - 1


def keyed(t) -> DataFrame:
    """Parsed captures, written once; the tables are derived from them."""
    return d.stored(t, captures.with_spot_key(captures.parse_screenshots(render.capture_files(t))))


def spots(t) -> DataFrame:
    return captures.first_of_spots(keyed(t))


@query("par30_parse_screenshots", """
    SELECT capture AS file_name, hero_cards, hero_pos, hero_stack, street, pot, to_call, advised AS action,
           (SELECT COUNT(*) FROM fx_screenshot_players p WHERE p.file_name = shot_file) AS players
    FROM fx_captures WHERE gpt_action IS NOT NULL""")
def _(t):
    return captures.parse_screenshots(render.capture_files(t)).select(
        "file_name", F.col("data.hero.cards").alias("hero_cards"), F.col("data.hero.pos").alias("hero_pos"), F.col("data.hero.stack").alias("hero_stack"),
        "data.street", "data.pot", "data.to_call", F.col("data.gpt_advice.raw.action").alias("action"),
        F.coalesce(F.size("data.players"), F.lit(0)).cast("bigint").alias("players"),
    )


@query("par31_with_advice", "SELECT stage, COUNT(*) AS captures FROM fx_captures WHERE gpt_action IS NOT NULL GROUP BY 1")
def _(t):
    parsed_ = captures.parse_screenshots(render.capture_files(t))
    return parsed_.groupBy(F.col("data.stage").alias("stage")).agg(F.count(F.lit(1)).alias("captures"))


@query("par32_capture_time", "SELECT capture AS file_name, taken_at AS screenshot_at FROM fx_captures")
def _(t):
    return render.capture_files(t).select("file_name", capture_time(F.col("file_name")).alias("screenshot_at"))


@query("par33_rejects", f"""
    SELECT 'hand' AS kind, COUNT(*) FILTER (WHERE k % 97 = 3) AS rejected, COUNT(*) FILTER (WHERE k % 97 <> 3) AS kept FROM fx_hands
    UNION ALL SELECT 'tournament', COUNT(*) FILTER (WHERE tournament_id % 50 = 7), COUNT(*) FILTER (WHERE tournament_id % 50 <> 7) FROM fx_tournaments
    UNION ALL SELECT 'capture', COUNT(*) FILTER (WHERE gpt_action IS NULL), COUNT(gpt_action) FROM fx_captures""")
def _(t):
    # Hands whose big blind is not a number.
    broken = render.hand_texts(t).withColumn(
        "block", F.when(F.col("k") % 97 == 3, F.regexp_replace("block", r"Level(\d+)\(([^)]+)\)", "Level$1(x/y)")).otherwise(F.col("block"))
    )
    read = hand_text.read_blocks(broken.select(F.lit("f").alias("file_name"), F.lit(0).alias("block_no"), "block"))
    summary = tournament_text.read_summaries(render.summary_files(t))
    capture = captures.read_captures(render.capture_files(t))
    return (
        read.select(F.lit("hand").alias("kind"), "is_valid")
        .unionByName(summary.select(F.lit("tournament").alias("kind"), "is_valid"))
        .unionByName(capture.select(F.lit("capture").alias("kind"), "is_valid"))
        .groupBy("kind")
        .agg(F.count_if(~F.col("is_valid")).alias("rejected"), F.count_if("is_valid").alias("kept"))
    )


@query("lnk1_time_bucket", """
    SELECT event_id, time_bucket(INTERVAL 600 SECOND, ts, TIMESTAMP '1970-01-01') AS bucket FROM events""")
def _(t):
    from pokerlake.functions.times import time_bucket

    return t.events.select("event_id", time_bucket(F.col("ts"), 600).alias("bucket"))


@query("lnk2_spot_key", "SELECT capture AS file_name, spot_key FROM fx_spots")
def _(t):
    return keyed(t).select("file_name", "spot_key")


@query("lnk3_first_of_spot", "SELECT spot_key, capture AS file_name, taken_at AS screenshot_at FROM fx_first")
def _(t):
    from pokerlake.operators.ordered import first_per_key

    return first_per_key(keyed(t), ["spot_key"], ["screenshot_at", "file_name"]).select("spot_key", "file_name", "screenshot_at")


@query("lnk3_first_of_spot_stream", "SELECT spot_key, capture AS file_name, taken_at AS screenshot_at FROM fx_first")
def _(t):
    folder = d.fresh_dir(t)
    # Written once; the stream's three parts are cut from it.
    files = d.stored(t, render.capture_files(t).withColumn("seconds", F.unix_timestamp(capture_time(F.col("file_name")))))
    low, high = files.agg(F.percentile_approx("seconds", [0.33, 0.66])).first()[0]
    part = F.when(F.col("seconds") < low, 0).when(F.col("seconds") < high, 1).otherwise(2)
    # Three runs of one micro-batch each, every capture twice in it; a capture of a later day closes the last spots.
    for i in (0, 1, 2):
        rows = files.filter(part == i).select("raw_content", "file_name")
        if i == 2:
            rows = rows.unionByName(rows.limit(1).withColumn("file_name", F.lit("screenshot_29990101_000000_0_0_0")))
        rows.unionByName(rows).write.mode("append").parquet(f"{folder}/in")
        stream = spots_stream.capture_stream(t.spark, f"{folder}/in", ALL_FILES)
        spots_stream.start_first_of_spots(stream, f"{folder}/out", f"{folder}/checkpoint", "1 day").awaitTermination()
    return t.spark.read.parquet(f"{folder}/out").select("spot_key", "file_name", "screenshot_at")


cte("fx_lists", """
    SELECT spot_key, COUNT(*) AS n, string_agg(advised, ',' ORDER BY taken_at, capture) AS actions,
           string_agg(gpt_recommendation, ',' ORDER BY taken_at, capture) AS texts FROM fx_spots GROUP BY 1""")


@query("lnk4_recommendations_of_spot", "SELECT spot_key, n AS recommendation_count, actions AS all_recommendations, texts AS all_recommendations_full FROM fx_lists")
def _(t):
    rows = keyed(t)
    counted = captures.build_screenshots(captures.first_of_spots(rows)).select("spot_key", "recommendation_count")
    return counted.join(captures.spot_lists(rows), "spot_key").select(
        "spot_key", "recommendation_count", F.array_join("all_recommendations", ",").alias("all_recommendations"),
        F.array_join("all_recommendations_full", ",").alias("all_recommendations_full"),
    )


@query("lnk4_spot_recommendations", """
    SELECT spot_key, taken_at AS screenshot_at, capture AS file_name, advised AS action, gpt_recommendation AS recommendation, CAST(k % 100 AS DOUBLE) / 8 AS seconds
    FROM fx_spots""")
def _(t):
    return captures.spot_recommendations(keyed(t))


@query("lnk5_build_screenshots", f"""
    SELECT capture AS file_name, taken_at AS screenshot_at, 'decision' AS action_type, stage, street, board, pot, to_call, 'fold,call' AS actions,
           hero_cards, hero_pos, hero_stack, CAST(0.5 AS DOUBLE) AS hero_bet, false AS hero_is_allin, CAST(1 AS BIGINT) AS hero_seat,
           gpt_recommendation, advised AS gpt_action, CAST(2.5 AS DOUBLE) AS gpt_amount, {rnd('CAST(k % 100 AS DOUBLE) / 8', 3)} AS gpt_time,
           CAST(NULL AS VARCHAR) AS gpt_prompt_system, spot_key, n AS recommendation_count
    FROM fx_first JOIN fx_lists USING (spot_key)""")
def _(t):
    df = captures.build_screenshots(spots(t)).drop("ingested_at")
    return df.withColumns({"board": F.array_join("board", ","), "actions": F.array_join("actions", ",")})


@query("lnk5_screenshots_with_lists", """
    SELECT capture AS file_name, spot_key, n AS recommendation_count, actions AS all_recommendations, texts AS all_recommendations_full, n AS times, true AS lists_complete
    FROM fx_first JOIN fx_lists USING (spot_key)""")
def _(t):
    rows = keyed(t)
    df = captures.with_spot_lists(captures.build_screenshots(captures.first_of_spots(rows)), captures.spot_lists(rows))
    return df.select(
        "file_name", "spot_key", "recommendation_count", F.array_join("all_recommendations", ",").alias("all_recommendations"),
        F.array_join("all_recommendations_full", ",").alias("all_recommendations_full"), F.size("all_gpt_times").alias("times"), "lists_complete",
    )


@query("lnk6_build_screenshot_players", """
    SELECT capture AS file_name, CAST(p.seat AS BIGINT) AS seat, 'CO' AS pos, p.name, p.stack, CAST(p.vpip AS BIGINT) AS vpip, CAST(1.5 AS DOUBLE) AS bet,
           true AS active, false AS is_allin
    FROM fx_first f JOIN fx_screenshot_players p ON p.file_name = f.shot_file""")
def _(t):
    return captures.build_screenshot_players(spots(t))


@query("lnk7_build_screenshot_history", """
    SELECT capture AS file_name, 'preflop' AS street, CAST(NULL AS VARCHAR) AS board, 'raise' AS actions, pot / 2 AS hero_bet, pot, 'call' AS hero_prev_action
    FROM fx_first WHERE shot = 1""")
def _(t):
    df = captures.build_screenshot_history(spots(t))
    return df.withColumns(
        {"board": F.array_join("board", ","), "actions": F.array_join("actions", ","), "hero_bet": F.element_at("bets", "Hero")}
    ).drop("bets")
