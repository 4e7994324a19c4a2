"""Projections, joins, aggregates, windows and sorts in the forms the analyses use them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pokerlake.functions import cards, labels
from pokerlake.functions.numbers import count_where, pct as share, rate, ratio, rounded
from pokerlake.operators.lists import list_parts, repeated_text
from pokerlake.operators.ordered import first_per_key, lookback, running, top
from pokerlake.sinks.tables import new_rows, upserted
from workload import derived as d
from workload.gold import hand_class_sql
from workload.registry import n, pct, query, rnd


def short(name: str, sql: str):
    return query(name, sql)


@short("prj1_struct_flatten", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(t):
    return t.events.select("event_id", F.from_json("props", "k BIGINT").alias("p")).select("event_id", F.col("p.k").alias("k"))


@short("prj2_extend_rows", "SELECT *, o_totalprice / 2 AS half FROM orders")
def _(t):
    return t.orders.select("*", (F.col("o_totalprice") / 2).alias("half"))


@short("prj3_simple_case", """
    SELECT hand_id, action_order::BIGINT AS action_order, CASE street WHEN 'preflop' THEN 1 WHEN 'flop' THEN 2 WHEN 'turn' THEN 3 ELSE 4 END::BIGINT AS street_order
    FROM fx_hand_actions""")
def _(t):
    return t.hand_actions.select("hand_id", "action_order", labels.street_order(F.col("street")).alias("street_order"))


@short("prj4_searched_case", """
    SELECT tournament_id, CASE WHEN hero_position < 5 THEN hero_position || ['_champion', '_runner_up', '_third', '_fourth'][hero_position]
                               WHEN hero_position < 7 THEN '5_mid_final' WHEN hero_position < 10 THEN '6_early_final' ELSE '7_rush_bust' END AS stage FROM fx_tournaments""")
def _(t):
    return t.tournaments.select("tournament_id", labels.finish_stage(F.col("hero_position")).alias("stage"))


@short("prj5_bins", """
    SELECT file_name, CASE WHEN hero_stack <= 12 THEN 'short_10-12bb' WHEN hero_stack <= 15 THEN 'short_13-15bb' WHEN hero_stack <= 20 THEN 'medium_16-20bb'
                           ELSE 'deep_20+bb' END AS stack, CASE WHEN pot >= 15 THEN 'high' WHEN pot >= 8 THEN 'medium' ELSE 'low' END AS pot_bin FROM fx_screenshots""")
def _(t):
    pot = labels.binned(-F.col("pot"), [(-15, "high"), (-8, "medium")], "low")
    return t.screenshots.select("file_name", labels.spot_stack(F.col("hero_stack")).alias("stack"), pot.alias("pot_bin"))


@short("prj6_predicates", """
    SELECT hand_id, action_order::BIGINT AS action_order FROM fx_hand_actions WHERE action_type NOT IN ('fold', 'check') AND action_order BETWEEN 2 AND 5
       AND (amount IS NOT NULL OR street <> 'preflop')""")
def _(t):
    c = F.col
    kept = ~c("action_type").isin("fold", "check") & c("action_order").between(2, 5) & (c("amount").isNotNull() | (c("street") != "preflop"))
    return t.hand_actions.filter(kept).select("hand_id", "action_order")


@short("prj7_small_raises", "SELECT file_name FROM fx_screenshots WHERE regexp_matches(gpt_recommendation, '2\\..*BB|2 BB|3.*BB')")
def _(t):
    return t.screenshots.filter(labels.small_raise(F.col("gpt_recommendation"))).select("file_name")


@short("prj8_jn7_yet_to_act", """
    SELECT a.hand_id, b.seat::BIGINT AS seat FROM fx_hands a JOIN fx_hand_players b ON a.hand_id = b.hand_id AND NOT b.is_hero AND list_contains(
        CASE a.hero_position WHEN 'UTG' THEN ['MP', 'CO', 'BTN', 'SB', 'BB'] WHEN 'MP' THEN ['CO', 'BTN', 'SB', 'BB'] WHEN 'CO' THEN ['BTN', 'SB', 'BB']
             WHEN 'BTN' THEN ['SB', 'BB'] WHEN 'SB' THEN ['BB'] ELSE [] END, b.position)""")
def _(t):
    rivals = t.hand_players.filter("NOT is_hero").select("hand_id", "seat", "position")
    met = t.hands.select("hand_id", "hero_position").join(rivals, "hand_id")
    return met.filter(cards.acts_after(F.col("hero_position"), F.col("position"))).select("hand_id", "seat")


@short("prj9_ratio_filter", "SELECT file_name FROM fx_screenshots WHERE 2 * to_call > hero_stack")
def _(t):
    return t.screenshots.filter(F.col("to_call") > F.col("hero_stack") * 0.5).select("file_name")


@short("prj10_null_safe_division", f"SELECT file_name, {rnd('hero_stack / NULLIF(to_call, 0)', 6)} AS r, COALESCE(hero_pos, 'none') AS pos FROM fx_screenshots")
def _(t):
    r = ratio(F.col("hero_stack"), F.col("to_call"))
    return t.screenshots.select("file_name", rounded(r, 6).alias("r"), F.coalesce("hero_pos", F.lit("none")).alias("pos"))


@short("prj11_casts", """
    SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS DOUBLE) AS price, TRY_CAST(substr(o_orderpriority, 1, 2) AS INT)::BIGINT AS priority,
           CAST(o_orderdate AS DATE) AS day FROM orders""")
def _(t):
    return t.orders.select(
        "o_orderkey", F.col("o_totalprice").cast("decimal(12,2)").cast("double").alias("price"),
        F.substring("o_orderpriority", 1, 2).try_cast("int").alias("priority"), F.to_date("o_orderdate").alias("day"),
    )


@short("prj12_length_filter", "SELECT doc_id, length(text) AS n FROM documents WHERE length(text) >= 400")
def _(t):
    return t.documents.filter(F.length("text") >= 400).select("doc_id", F.length("text").cast("bigint").alias("n"))


@short("prj13_struct_field", "SELECT hand_id, CAST(rank AS BIGINT) AS rank FROM fx_all_rank WHERE side = 0")
def _(t):
    from pokerlake.operators.showdown import with_hand_rank

    return with_hand_rank(t.hands, "hero_cards", "board_str").select("hand_id", F.col("evaluation").getField("rank").alias("rank"))


HERO = "SELECT h.hand_id, h.total_pot, p.chips_start FROM fx_hands h"


@short("jn1_inner", "SELECT l_orderkey, l_quantity, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def _(t):
    joined = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select("l_orderkey", "l_quantity", "o_custkey")


@short("jn2_inner_with_constant", f"{HERO} JOIN fx_hand_players p ON p.hand_id = h.hand_id AND p.is_hero")
def _(t):
    from pokerlake.plans.parts import hands_with_hero

    return hands_with_hero(t.hands, t.hand_players, ["total_pot"], ["chips_start"])


@short("jn3_left_on_two_columns", """
    SELECT p.hand_id, p.seat::BIGINT AS seat, a.n FROM fx_hand_players p
    LEFT JOIN (SELECT hand_id, player_name, COUNT(*) AS n FROM fx_hand_actions GROUP BY ALL) a USING (hand_id, player_name)""")
def _(t):
    acts = t.hand_actions.groupBy("hand_id", "player_name").agg(F.count(F.lit(1)).alias("n"))
    return t.hand_players.join(acts, ["hand_id", "player_name"], "left").select("hand_id", "seat", "n")


@short("jn4_left_with_conditions", """
    SELECT h.hand_id, a.n FROM fx_hands h LEFT JOIN (SELECT hand_id, COUNT(*) AS n FROM fx_hand_actions WHERE is_hero AND street = 'flop' GROUP BY 1) a
    ON a.hand_id = h.hand_id""")
def _(t):
    flop = t.hand_actions.filter("is_hero AND street = 'flop'").groupBy("hand_id").agg(F.count(F.lit(1)).alias("n"))
    return t.hands.select("hand_id").join(flop, "hand_id", "left")


@short("jn5_inner_in_effect", """
    SELECT h.hand_id, s.gpt_action FROM fx_hands h LEFT JOIN fx_map m ON m.hand_id = h.hand_id LEFT JOIN fx_screenshots s ON s.file_name = m.file_name
    WHERE s.gpt_action IS NOT NULL""")
def _(t):
    advised = t.screenshots.filter("gpt_action IS NOT NULL").select("file_name", "gpt_action")
    linked = d.mapping(t).filter("hand_id IS NOT NULL").select("file_name", "hand_id").join(advised, "file_name")
    return t.hands.select("hand_id").join(linked, "hand_id").select("hand_id", "gpt_action")


@short("jn6_nearest", "SELECT file_name, hand_id FROM fx_map WHERE hand_id IS NOT NULL")
def _(t):
    return d.mapping(t).filter("hand_id IS NOT NULL").select("file_name", "hand_id")


@short("jn8_own_aggregate", "SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_custkey) AS orders_of_customer FROM orders")
def _(t):
    counts = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders_of_customer"))
    return t.orders.join(counts, "o_custkey").select("o_orderkey", "orders_of_customer")


@short("jn9_agg_blocks_in_one_pass", f"""
    SELECT a.o_custkey, a.n, b.f, c.top FROM (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY 1) a
    LEFT JOIN (SELECT o_custkey, {pct(n("o_orderstatus = 'F'"), n())} AS f FROM orders GROUP BY 1) b USING (o_custkey)
    LEFT JOIN (SELECT o_custkey, MAX(o_totalprice) AS top FROM orders GROUP BY 1) c USING (o_custkey)""")
def _(t):
    return t.orders.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"), rate(F.col("o_orderstatus") == "F").alias("f"), F.max("o_totalprice").alias("top")
    )


@short("jn10_filtered_counts", """
    SELECT file_name FROM fx_screenshots JOIN (SELECT file_name FROM fx_screenshot_players GROUP BY 1 HAVING COUNT(*) = 1) x USING (file_name)""")
def _(t):
    single = t.screenshot_players.groupBy("file_name").count().filter("count = 1")
    return t.screenshots.join(single, "file_name", "left_semi").select("file_name")


@short("jn11_snk3_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def _(t):
    large = t.orders.filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return new_rows(large, t.customer.select("c_custkey"), ["c_custkey"])


@short("agg1_plain", f"""
    SELECT o_orderstatus, COUNT(*) AS n, {rnd('SUM(o_totalprice)', 2)} AS total, {rnd('AVG(o_totalprice)', 2)} AS mean, MIN(o_totalprice) AS low, MAX(o_totalprice) AS high
    FROM orders GROUP BY 1""")
def _(t):
    price = F.col("o_totalprice")
    return t.orders.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), rounded(F.sum(price), 2).alias("total"), rounded(F.avg(price), 2).alias("mean"),
        F.min(price).alias("low"), F.max(price).alias("high"),
    )


@short("agg2_conditional_count", "SELECT l_returnflag, COUNT(*) FILTER (WHERE l_quantity > 25) AS large FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.groupBy("l_returnflag").agg(count_where(F.col("l_quantity") > 25).alias("large"))


@short("agg3_conditional_mean", f"SELECT l_returnflag, {rnd('AVG(l_discount) FILTER (WHERE l_quantity > 25)', 6)} AS mean FROM lineitem GROUP BY 1")
def _(t):
    mean = F.avg(F.when(F.col("l_quantity") > 25, F.col("l_discount")))
    return t.lineitem.groupBy("l_returnflag").agg(rounded(mean, 6).alias("mean"))


@short("agg4_rates", f"""
    SELECT position, {pct(n('vpip'), n())} AS vpip_pct, {pct(n('won_hand AND went_to_showdown'), n('went_to_showdown'))} AS wsd_pct FROM fx_hand_players GROUP BY 1""")
def _(t):
    return t.hand_players.groupBy("position").agg(
        rate(F.col("vpip")).alias("vpip_pct"), rate(F.col("won_hand"), F.col("went_to_showdown")).alias("wsd_pct")
    )


@short("agg5_agg6_flag_and_attribute", """
    SELECT hand_id, bool_or(went_to_showdown) AS shown, MAX(player_name) FILTER (WHERE won_hand) AS winner FROM fx_hand_players GROUP BY 1""")
def _(t):
    winner = F.max(F.when(F.col("won_hand"), F.col("player_name")))
    return t.hand_players.groupBy("hand_id").agg(F.bool_or("went_to_showdown").alias("shown"), winner.alias("winner"))


@short("agg7_pivot_by_street", """
    SELECT hand_id, MAX(action_type) FILTER (WHERE street = 'preflop') AS preflop, MAX(action_type) FILTER (WHERE street = 'flop') AS flop,
           MAX(action_type) FILTER (WHERE street = 'turn') AS turn, MAX(action_type) FILTER (WHERE street = 'river') AS river FROM fx_hand_actions GROUP BY 1""")
def _(t):
    return t.hand_actions.groupBy("hand_id").pivot("street", labels.STREETS).agg(F.max("action_type"))


@short("agg8_first_in_order", "SELECT hand_id, arg_min(action_type, action_order) AS first_action FROM fx_hand_actions GROUP BY 1")
def _(t):
    return t.hand_actions.groupBy("hand_id").agg(F.min_by("action_type", "action_order").alias("first_action"))


@short("agg9_ordered_line", "SELECT hand_id, string_agg(action_type, '->' ORDER BY action_order) AS line FROM fx_hand_actions GROUP BY 1")
def _(t):
    lines = list_parts(t.hand_actions, ["hand_id"], ["action_order"], {"line": F.col("action_type")})
    return lines.withColumn("line", F.array_join("line", "->")).drop("part")


@short("agg9_repeated_text", "SELECT player_name, string_agg(position, ', ' ORDER BY position) AS text FROM fx_hand_players WHERE NOT is_hero GROUP BY 1")
def _(t):
    return repeated_text(t.hand_players.filter("NOT is_hero"), ["player_name"], "position", ", ").drop("part")


@short("agg11_stddev", f"SELECT l_returnflag, {rnd('stddev_samp(l_quantity)', 6)} AS spread FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.groupBy("l_returnflag").agg(rounded(F.stddev_samp("l_quantity"), 6).alias("spread"))


@short("agg12_having", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY 1 HAVING COUNT(*) >= 12")
def _(t):
    return t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).filter("n >= 12")


@short("agg13_group_by_expression", "SELECT CAST(ts AS DATE) AS day, CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS size, COUNT(*) AS n FROM events GROUP BY 1, 2")
def _(t):
    size = F.when(F.col("value") > 50, "high").otherwise("low")
    return t.events.groupBy(F.to_date("ts").alias("day"), size.alias("size")).agg(F.count(F.lit(1)).alias("n"))


@short("agg14_carried_columns", "SELECT o_orderkey, o_custkey, o_orderstatus, COUNT(*) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL")
def _(t):
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("lines"))
    return lines.join(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus"), "o_orderkey")


@short("agg15_ratio_of_sums", f"SELECT player_name, {rnd('SUM(total_bets + total_raises)::DOUBLE / NULLIF(SUM(total_calls), 0)', 2)} AS factor FROM fx_hand_players GROUP BY 1")
def _(t):
    factor = ratio(F.sum(F.col("total_bets") + F.col("total_raises")), F.sum("total_calls"))
    return t.hand_players.groupBy("player_name").agg(rounded(factor, 2).alias("factor"))


@short("agg16_min_of_text", "SELECT hand_id, MIN(street) AS street FROM fx_hand_actions GROUP BY 1")
def _(t):
    return t.hand_actions.groupBy("hand_id").agg(F.min("street").alias("street"))


@short("agg17_max_of_ratio", "SELECT h.hand_id, MAX(p.chips_start / h.big_blind) AS deepest FROM fx_hands h JOIN fx_hand_players p USING (hand_id) GROUP BY 1")
def _(t):
    joined = t.hand_players.join(t.hands.select("hand_id", "big_blind"), "hand_id")
    return joined.groupBy("hand_id").agg(F.max(ratio(F.col("chips_start"), F.col("big_blind"))).alias("deepest"))


@short("agg21_value_counts", "SELECT event_type, COUNT(*) AS n FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@short("win1_first_per_key", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1")
def _(t):
    return first_per_key(t.events.select("user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id")


SEQUENCE = """
    SELECT event_id, row_number() OVER w AS nr, COUNT(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"""


@short("win2_win3_sequence_and_total", SEQUENCE)
def _(t):
    return running(t.events, ["user_id"], ["ts", "event_id"], number="nr", total="n").select("event_id", "nr", "n")


@short("win2_win3_sequence_and_total_split", SEQUENCE)
def _(t):
    return running(t.events, ["user_id"], ["ts", "event_id"], number="nr", total="n", slice_rows=700).select("event_id", "nr", "n")


RUNNING = "SELECT event_id, SUM(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS cents FROM events"


def cents():
    return F.round(F.col("value") * 100).cast("bigint")


@short("win4_running_sum", RUNNING)
def _(t):
    return running(t.events, ["user_id"], ["ts", "event_id"], {"cents": cents()}).select("event_id", "cents")


@short("win4_running_sum_split", RUNNING)
def _(t):
    return running(t.events, ["user_id"], ["ts", "event_id"], {"cents": cents()}, slice_rows=700).select("event_id", "cents")


@short("win5_global_running_sum", RUNNING.replace("PARTITION BY user_id ", ""))
def _(t):
    return running(t.events, [], ["ts", "event_id"], {"cents": cents()}).select("event_id", "cents")


BEFORE = """
    SELECT event_id, lag(event_type) OVER w AS previous, SUM(CAST(round(value * 100) AS BIGINT)) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)::BIGINT AS last_five
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"""


def before(t, **options):
    df = lookback(t.events, ["user_id"], ["ts", "event_id"], {"previous": "event_type"}, {"last_five": (cents(), 5)}, **options)
    return df.select("event_id", "previous", "last_five")


@short("win6_win7_lag_and_trailing_frame", BEFORE)
def _(t):
    return before(t)


@short("win6_win7_lag_and_trailing_frame_split", BEFORE)
def _(t):
    return before(t, block_rows=7, slice_rows=700)


@short("win8_share_of_total", f"SELECT event_type, {pct('COUNT(*)', 'SUM(COUNT(*)) OVER ()')} AS pct FROM events GROUP BY 1")
def _(t):
    counts = t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("event_type", share(F.col("n"), F.sum("n").over(Window.partitionBy())).alias("pct"))


@short("win9_share_within_group", f"SELECT l_returnflag, l_linestatus, {pct('COUNT(*)', 'SUM(COUNT(*)) OVER (PARTITION BY l_returnflag)')} AS pct FROM lineitem GROUP BY 1, 2")
def _(t):
    counts = t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))
    whole = F.sum("n").over(Window.partitionBy("l_returnflag"))
    return counts.select("l_returnflag", "l_linestatus", share(F.col("n"), whole).alias("pct"))


@short("win10_first_value", "SELECT hand_id, street, arg_min(action_type, action_order) AS hero_action FROM fx_hand_actions WHERE is_hero GROUP BY ALL")
def _(t):
    mine = t.hand_actions.filter("is_hero").select("hand_id", "street", "action_order", F.col("action_type").alias("hero_action"))
    return first_per_key(mine, ["hand_id", "street"], ["action_order"]).drop("action_order")


@short("srt1_order_by_several", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey")
def _(t):
    return t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice").orderBy("o_orderstatus", F.desc("o_totalprice"), "o_orderkey")


@short("srt2_srt3_top", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def _(t):
    return top(t.orders.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 20)


@short("srt4_head", "SELECT least(COUNT(*), 20) AS n FROM events")
def _(t):
    return t.events.limit(20).agg(F.count(F.lit(1)).alias("n"))


@short("set_snk4_union_by_name", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN -c_acctbal ELSE c_acctbal END AS c_acctbal FROM customer")
def _(t):
    balances = t.customer.select("c_custkey", "c_acctbal")
    return upserted(balances, balances.filter("c_custkey % 4 = 0").withColumn("c_acctbal", -F.col("c_acctbal")), ["c_custkey"])


@short("fn_cards_rank_and_class", f"""
    SELECT hand_id, strpos('23456789TJQKA', substr(hero_cards, 1, 1)) + 1 AS first_rank, {hand_class_sql('hero_cards')} AS hand_class,
           substr(hero_cards, 2, 1) = substr(hero_cards, 4, 1) AS suited, substr(hero_cards, 1, 1) = substr(hero_cards, 3, 1) AS pair FROM fx_hands""")
def _(t):
    text = F.col("hero_cards")
    return t.hands.select(
        "hand_id", cards.card_rank(F.substring(text, 1, 1)).cast("bigint").alias("first_rank"), cards.hand_class(text).alias("hand_class"),
        cards.is_suited(text).alias("suited"), cards.is_pair(text).alias("pair"),
    )


@short("fn_position_group", """
    SELECT hand_id, seat::BIGINT AS seat, CASE WHEN position IN ('BTN', 'CO') THEN 'late' WHEN position IN ('SB', 'BB') THEN 'blinds' WHEN position = 'UTG' THEN 'early'
           ELSE 'middle' END AS position_group, CASE WHEN position IN ('BTN', 'CO') THEN 2 WHEN position IN ('SB', 'BB') THEN 3 WHEN position = 'UTG' THEN 0 ELSE 1 END::BIGINT AS code
    FROM fx_hand_players""")
def _(t):
    position = F.col("position")
    return t.hand_players.select("hand_id", "seat", cards.position_group(position).alias("position_group"), cards.position_code(position).alias("code"))


@short("fn_array_map_json", """
    SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type || '|' || CAST(user_id AS VARCHAR) AS joined, 2::BIGINT AS size, strftime(ts, '%Y%m%d') AS day FROM events""")
def _(t):
    parts = F.array("event_type", F.col("user_id").cast("string"))
    return t.events.select(
        "event_id", F.element_at(F.from_json("props", "MAP<STRING, BIGINT>"), "k").alias("k"), F.concat_ws("|", parts).alias("joined"),
        F.size(parts).alias("size"), F.date_format("ts", "yyyyMMdd").alias("day"),
    )


@short("fn_math", f"SELECT l_orderkey, l_partkey, l_suppkey, {rnd('l_extendedprice * (1 - l_discount)', 2)} AS net, greatest(l_discount, l_tax) AS high, least(l_discount, l_tax) AS low, abs(l_discount - l_tax) AS gap, floor(l_quantity / 7)::BIGINT AS sevens FROM lineitem")
def _(t):
    c = F.col
    return t.lineitem.select(
        "l_orderkey", "l_partkey", "l_suppkey", rounded(c("l_extendedprice") * (1 - c("l_discount")), 2).alias("net"), F.greatest("l_discount", "l_tax").alias("high"),
        F.least("l_discount", "l_tax").alias("low"), F.abs(c("l_discount") - c("l_tax")).alias("gap"), F.floor(c("l_quantity") / 7).alias("sevens"),
    )
