"""Features and models."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from pokerlake.functions.numbers import rounded
from pokerlake.operators.linking import resolved_names
from pokerlake.plans import features, models
from pokerlake.plans.players import player_statistics
from workload import derived as d
from workload.registry import cte, pct, query, rnd

FEATURES = features.PLAYER_FEATURES


def player_features(t):
    return features.player_features(player_statistics(d.player_hand_stats(t)))


def clusters(t):
    """Opponents carry a group number here, so that the mean over a table is not constant."""
    return t.hand_players.filter("NOT is_hero").select("player_name").distinct().select(
        "player_name", F.length("player_name").cast("int").alias("cluster_id")
    )


def hand_features(t):
    return features.hand_features(t.hands, t.hand_players, t.hand_actions, d.mapping(t), t.screenshots, clusters(t))


@query("ml1_player_features", f"SELECT player_name, total_hands, {', '.join(FEATURES)}, avg_preflop_raise_bb FROM fx_statistics")
def _(t):
    return player_features(t).drop("feature_timestamp")


A, B = "strpos('23456789TJQKA', substr(hero_cards, 1, 1)) + 1", "strpos('23456789TJQKA', substr(hero_cards, 3, 1)) + 1"
cte("fx_features", f"""
    SELECT h.hand_id, greatest({A}, {B})::DOUBLE AS high_card_rank, least({A}, {B})::DOUBLE AS low_card_rank,
           (substr(hero_cards, 2, 1) = substr(hero_cards, 4, 1))::INT::DOUBLE AS is_suited,
           (substr(hero_cards, 1, 1) = substr(hero_cards, 3, 1))::INT::DOUBLE AS is_pocket_pair,
           greatest({A}, {B})::DOUBLE + least({A}, {B})::DOUBLE / 2 + 2 * (substr(hero_cards, 2, 1) = substr(hero_cards, 4, 1))::INT
               + 5 * (substr(hero_cards, 1, 1) = substr(hero_cards, 3, 1))::INT AS hand_strength_score,
           COALESCE((g.stage = 'final')::INT, 0)::DOUBLE AS is_final_stage,
           CASE WHEN p.position = 'UTG' THEN 0 WHEN p.position IN ('CO', 'BTN') THEN 2 WHEN p.position IN ('SB', 'BB') THEN 3 ELSE 1 END::DOUBLE AS position_encoded,
           (p.position IN ('CO', 'BTN'))::INT::DOUBLE AS is_late_position, p.chips_start / h.big_blind AS stack_bb,
           CAST(5 AS DOUBLE) AS opponent_count, o.mean_cluster AS avg_opponent_cluster,
           (COALESCE(a.raises, 0) > 0)::INT::DOUBLE AS had_preflop_raise, (COALESCE(a.mine, 0) > 0)::INT::DOUBLE AS hero_raised_preflop,
           COALESCE(a.raises, 0)::DOUBLE AS preflop_raise_count, p.won_hand::BIGINT AS won_hand, p.net_profit / h.big_blind AS profit_bb,
           h.hand_timestamp AS feature_timestamp
    FROM fx_hands h JOIN fx_hand_players p ON p.hand_id = h.hand_id AND p.is_hero
    JOIN (SELECT hand_id, AVG(length(player_name)) AS mean_cluster FROM fx_hand_players WHERE NOT is_hero GROUP BY 1) o ON o.hand_id = h.hand_id
    LEFT JOIN (SELECT hand_id, COUNT(*) AS raises, COUNT(*) FILTER (WHERE is_hero) AS mine FROM fx_hand_actions
               WHERE street = 'preflop' AND action_type = 'raise' GROUP BY 1) a ON a.hand_id = h.hand_id
    LEFT JOIN (SELECT m.hand_id, arg_min(s.stage, (s.screenshot_at, s.file_name)) AS stage FROM fx_map m JOIN fx_screenshots s USING (file_name)
               WHERE m.hand_id IS NOT NULL GROUP BY 1) g ON g.hand_id = h.hand_id""")


@query("ml2_hand_features", "SELECT * FROM fx_features")
def _(t):
    return hand_features(t)


@query("ml2_named_opponents", """
    SELECT p.hand_id, COALESCE(AVG(c.cluster_id), 1)::DOUBLE AS avg_opponent_cluster
    FROM fx_hand_players p JOIN fx_hands h USING (hand_id) LEFT JOIN fx_names n ON n.tournament_id = h.tournament_id AND n.anonymous_id = p.player_name
    LEFT JOIN (SELECT DISTINCT name, substr(name, 7)::INT % 5 AS cluster_id FROM fx_screenshot_players) c ON c.name = n.player_name
    WHERE NOT p.is_hero GROUP BY 1""")
def _(t):
    named = t.screenshot_players.select(F.col("name").alias("player_name")).distinct()
    grouped = named.withColumn("cluster_id", F.substring("player_name", 7, 9).cast("int") % 5)
    names = resolved_names(d.identity(t), t.hands)
    rows = features.hand_features(t.hands, t.hand_players, t.hand_actions, d.mapping(t), t.screenshots, grouped, names)
    return rows.select("hand_id", "avg_opponent_cluster")


LETTER = "substr('23456789TJQKA', ({})::INT - 1, 1)"


@query("gld22_hand_ev_lookup", f"""
    SELECT {LETTER.format('high_card_rank')} || {LETTER.format('low_card_rank')} ||
               CASE WHEN is_pocket_pair = 1 THEN '' WHEN is_suited = 1 THEN 's' ELSE 'o' END AS hand_type,
           ['Early', 'Middle', 'Late', 'Blinds'][position_encoded::INT + 1] AS position, CASE is_final_stage WHEN 1 THEN 'Final' ELSE 'Rush' END AS stage,
           CASE WHEN opponent_count <= 2 THEN '1-2' WHEN opponent_count <= 4 THEN '3-4' ELSE '5+' END AS opponent_bucket,
           {rnd('AVG(profit_bb)', 2)} AS avg_profit_bb, {rnd('AVG(won_hand) * 100', 1)} AS win_rate_pct, COUNT(*) AS sample_size,
           {rnd('MIN(profit_bb)', 2)} AS min_profit_bb, {rnd('MAX(profit_bb)', 2)} AS max_profit_bb, {rnd('stddev_samp(profit_bb)', 2)} AS stddev_profit_bb
    FROM fx_features GROUP BY 1, 2, 3, 4""")
def _(t):
    return features.hand_ev_lookup(hand_features(t))


@query("ml3_minimum_sample", "SELECT player_name, total_hands FROM fx_statistics WHERE total_hands >= 10")
def _(t):
    return models.trainable(player_features(t)).select("player_name", "total_hands")


@query("ml4_agg20_impute_median", """
    SELECT l_orderkey, l_partkey, l_suppkey, COALESCE(q, median(q) OVER ()) AS q
    FROM (SELECT *, CASE WHEN l_returnflag <> 'R' THEN l_quantity * l_discount END AS q FROM lineitem) x""")
def _(t):
    df = t.lineitem.withColumn("q", F.when(F.col("l_returnflag") != "R", F.col("l_quantity") * F.col("l_discount")))
    return models.impute_median(df, ["q"]).select("l_orderkey", "l_partkey", "l_suppkey", "q")


@query("agg20_median_split", "SELECT median(o_totalprice) AS o_totalprice, median(o_custkey::DOUBLE) AS o_custkey FROM orders")
def _(t):
    return models.medians(t.orders, ["o_totalprice", "o_custkey"], bins=16)


@query("ml5_standard_scaling", f"""
    SELECT o_orderkey, {rnd('(o_totalprice - AVG(o_totalprice) OVER ()) / stddev_pop(o_totalprice) OVER ()', 5)} AS z FROM orders""")
def _(t):
    return models.scaled(t.orders.select("o_orderkey", "o_totalprice"), ["o_totalprice"]).select(
        "o_orderkey", rounded(F.col("o_totalprice_scaled"), 5).alias("z")
    )


_MADE: dict[tuple, object] = {}


def once(t, name: str, make):
    """What several queries over the same tables need is made by the first of them."""
    key = (t.spark.sparkContext.applicationId, t.sf_dir, name)
    if key not in _MADE:
        _MADE[key] = make()
    return _MADE[key]


def stored_players(t):
    """The features of all players, written once: training and scoring read them without another run of the joins."""
    return once(t, "players", lambda: d.stored(t, player_features(t)))


def training(t):
    return once(t, "training", lambda: d.stored(t, models.impute_median(models.trainable(stored_players(t)), FEATURES)))


def searched(t):
    return once(t, "search", lambda: models.k_search(training(t)))


def fitted(t):
    """k from the elbow of the search, then the best of ten starts."""
    return once(t, "clusters", lambda: models.fit_clusters(training(t), models.elbow_k(searched(t))))


@query("ml6_k_search")
def _(t):
    return searched(t)


@query("ml7_elbow")
def _(t):
    return models.elbow(searched(t))


@query("ml8_fit_clusters")
def _(t):
    return fitted(t).transform(training(t)).select("player_name", "cluster_id")


@query("ml7_elbow_of_table", """
    WITH s AS (SELECT (o_custkey % 7 + 2)::BIGINT AS k, SUM(CAST(round(o_totalprice * 100) AS BIGINT))::DOUBLE AS inertia FROM orders GROUP BY 1),
         b AS (SELECT *, abs(lead(inertia, 2) OVER w - 2 * lead(inertia) OVER w + inertia) AS bend, lead(k) OVER w AS next_k FROM s WINDOW w AS (ORDER BY k))
    SELECT k, inertia, k = (SELECT greatest(next_k, 3) FROM b WHERE bend IS NOT NULL ORDER BY bend DESC, k LIMIT 1) AS is_chosen FROM s""")
def _(t):
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    search = t.orders.groupBy((F.col("o_custkey") % 7 + 2).cast("int").alias("k")).agg(F.sum(cents).cast("double").alias("inertia"))
    return models.elbow(search)


TRAINABLE = "(SELECT COUNT(*) FROM fx_statistics WHERE total_hands >= 10)"


@query("ml6_ml8_cluster_checks", f"SELECT {TRAINABLE} AS players, {TRAINABLE} AS with_nearest_centre, true AS all_clusters_used, 7::BIGINT AS ks, true AS inertia_falls, true AS silhouettes_in_range")
def _(t):
    """Search, choice of k, fit: every trainable player sits with the nearest centre, every cluster has players."""
    rows = training(t)
    search, model = searched(t), fitted(t)
    centres = F.array(*[F.array(*map(F.lit, map(float, c))) for c in model.stages[2].clusterCenters()])
    gap = lambda p: F.transform(centres, lambda c: F.aggregate(F.zip_with(p, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda x, y: x + y))
    placed = model.transform(rows).withColumn("gaps", gap(vector_to_array("features")))
    nearest = F.col("gaps")[F.col("cluster_id")] <= F.array_min("gaps") + 1e-9
    counts = placed.agg(F.count(F.lit(1)).alias("players"), F.count_if(nearest).alias("with_nearest_centre"), (F.count_distinct("cluster_id") == len(model.stages[2].clusterCenters())).alias("all_clusters_used"))
    falls = F.col("inertia") <= F.coalesce(F.lag("inertia").over(Window.orderBy("k")), F.col("inertia")) * 1.1
    checks = search.withColumn("falls", falls).agg(F.count(F.lit(1)).alias("ks"), F.bool_and("falls").alias("inertia_falls"), F.bool_and(F.abs("silhouette") <= 1).alias("silhouettes_in_range"))
    return counts.crossJoin(checks)


cte("fx_centroids", """
    SELECT o_custkey % 8 AS cluster_id, AVG(o_totalprice) AS vpip_pct, MAX(o_totalprice) AS pfr_pct, MIN(o_totalprice) AS aggression_factor,
           COUNT(*)::DOUBLE AS allin_pct FROM orders GROUP BY 1""")


def below(column: str) -> str:
    return f"(SELECT COUNT(*) FROM fx_centroids o WHERE o.{column} < c.{column}) / 8.0"


@query("ml9_name_clusters", f"""
    SELECT cluster_id, CASE WHEN v < 0.3 AND hot THEN 'TAG' WHEN v < 0.3 AND cold THEN 'Nit' WHEN v > 0.7 AND hot THEN 'LAG' WHEN v > 0.7 AND cold THEN 'Fish'
                            WHEN a > 0.7 THEN 'Maniac' WHEN hot THEN 'Reg' ELSE 'Rec' END AS cluster_name
    FROM (SELECT cluster_id, {below('vpip_pct')} AS v, {below('allin_pct')} AS a,
                 {below('aggression_factor')} > 0.6 OR {below('pfr_pct')} > 0.6 AS hot, {below('aggression_factor')} < 0.4 AND {below('pfr_pct')} < 0.4 AS cold
          FROM fx_centroids c) x""")
def _(t):
    price = F.col("o_totalprice")
    centroids = t.orders.groupBy((F.col("o_custkey") % 8).alias("cluster_id")).agg(
        F.avg(price).alias("vpip_pct"), F.max(price).alias("pfr_pct"), F.min(price).alias("aggression_factor"),
        F.count(F.lit(1)).cast("double").alias("allin_pct"),
    )
    return models.name_clusters(centroids).select("cluster_id", "cluster_name")


@query("ml10_definitions_of_table", f"""
    SELECT c.cluster_id, {rnd('vpip_pct', 4)} AS centroid_vpip, COUNT(p.player_name) AS player_count, {pct('COUNT(p.player_name)', 'SUM(COUNT(p.player_name)) OVER ()')} AS pct_of_total, '7' AS model_version
    FROM fx_centroids c LEFT JOIN (SELECT DISTINCT player_name FROM fx_hand_players WHERE NOT is_hero) p ON length(p.player_name) % 16 = c.cluster_id GROUP BY c.cluster_id, vpip_pct""")
def _(t):
    price = F.col("o_totalprice")
    centroids = t.orders.groupBy((F.col("o_custkey") % 8).alias("cluster_id")).agg(
        F.avg(price).alias("vpip_pct"), F.max(price).alias("pfr_pct"), F.min(price).alias("aggression_factor"),
        F.count(F.lit(1)).cast("double").alias("allin_pct"), *[F.lit(0.0).alias(c) for c in ("three_bet_pct", "wtsd_pct", "wsd_pct")],
    )
    assigned = clusters(t).withColumn("cluster_id", F.col("cluster_id") % 16)
    named = models.definitions_of(centroids, assigned, "7")
    return named.select("cluster_id", rounded(F.col("centroid_vpip"), 4).alias("centroid_vpip"), "player_count", "pct_of_total", "model_version")


@query("ml11_jn12_score_checks", f"""
    SELECT (SELECT COUNT(*) FROM fx_statistics) AS players, (SELECT COUNT(*) FROM fx_statistics) AS named, true AS distances_positive,
           COUNT(*) FILTER (WHERE total_hands >= 10) AS with_enough_hands FROM fx_statistics""")
def _(t):
    """Search, choice of k, fit, save, load, score: the chain of the two jobs."""
    rows, players_ = training(t), stored_players(t)
    folder = d.fresh_dir(t)
    fitted(t).write().save(f"{folder}/model")
    model = PipelineModel.load(f"{folder}/model")
    definitions = d.stored(t, models.cluster_definitions(model, rows, "2"))
    older = definitions.withColumn("model_version", F.lit("1"))
    scored_ = models.score_players(model, players_, definitions.unionByName(older), rows.count(), "2")
    return scored_.agg(
        F.count(F.lit(1)).alias("players"), F.count("cluster_name").alias("named"),
        F.bool_and(F.col("distance_to_centroid") >= 0).alias("distances_positive"),
        F.count_if(F.col("total_hands") >= 10).alias("with_enough_hands"),
    )


@query("snk6_cluster_overview", """
    SELECT repeat('x', length(player_name) % 4) AS cluster_name, COUNT(*) AS players, CAST(ROUND(CAST(AVG(n) AS DECIMAL(38,10)), 0) AS DOUBLE) AS avg_hands, COUNT(*) FILTER (WHERE n >= 40) AS high_confidence
    FROM (SELECT player_name, COUNT(*) AS n FROM fx_hand_players GROUP BY 1) x GROUP BY 1""")
def _(t):
    hands = t.hand_players.groupBy("player_name").agg(F.count(F.lit(1)).alias("total_hands"))
    named = hands.select(F.repeat(F.lit("x"), F.length("player_name") % 4).alias("cluster_name"), "total_hands", F.when(F.col("total_hands") >= 40, "high").alias("confidence"))
    return models.cluster_overview(named)


@query("ml10_cluster_definitions")
def _(t):
    rows = training(t)
    return models.cluster_definitions(fitted(t), rows).drop("created_at")


@query("ml11_jn12_score_players")
def _(t):
    players_, rows = stored_players(t), training(t)
    model = fitted(t)
    return models.score_players(model, players_, models.cluster_definitions(model, rows), rows.count()).drop("scored_at")


@query("ml12_trim_outliers", """
    SELECT o_orderkey, o_totalprice FROM orders, (SELECT AVG(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM orders)
    WHERE abs(o_totalprice - m) < 1.5 * s""")
def _(t):
    return models.trim_outliers(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", 1.5)


@query("ml12_trim_outliers_at_three", """
    SELECT event_id, value FROM (SELECT event_id, value * value * value * value * value * value AS value FROM events) e,
           (SELECT AVG(value * value * value * value * value * value) AS m, stddev_samp(value * value * value * value * value * value) AS s FROM events) WHERE abs(value - m) < 3 * s""")
def _(t):
    v = F.col("value")
    return models.trim_outliers(t.events.select("event_id", (v * v * v * v * v * v).alias("value")), "value")


@query("ml13_split_checks", "SELECT COUNT(*) AS hands, COUNT(DISTINCT hand_id) AS distinct_hands, true AS a_fifth FROM fx_hands")
def _(t):
    train, test = models.train_test(t.hands.select("hand_id"))
    both = train.withColumn("is_test", F.lit(0)).unionByName(test.withColumn("is_test", F.lit(1)))
    return both.agg(F.count(F.lit(1)).alias("hands"), F.count_distinct("hand_id").alias("distinct_hands"), F.avg("is_test").between(0.15, 0.25).alias("a_fifth"))


@query("ml13_train_test_split")
def _(t):
    train, test = models.train_test(t.hands.select("hand_id"))
    return train.select("hand_id", F.lit("train").alias("part")).unionByName(test.select("hand_id", F.lit("test").alias("part")))


def forest(t):
    """(model, training rows, test rows, all rows) of the profit of a hand."""
    rows = d.stored(t, models.trim_outliers(hand_features(t), "profit_bb"))
    train, test = models.train_test(rows)
    return models.fit_ev(train), train, test, rows


def scored(t):
    model, _, test, rows = once(t, "forest", lambda: forest(t))
    return model, models.predict_ev(model, test), rows


@query("ml15_regression_report_of_table", f"""
    SELECT COUNT(*) AS rows, {rnd('AVG(abs(predicted_ev_bb - profit_bb))', 6)} AS mae, {rnd('sqrt(AVG((predicted_ev_bb - profit_bb) ** 2))', 6)} AS rmse,
           {rnd('1 - SUM((predicted_ev_bb - profit_bb) ** 2) / (var_pop(profit_bb) * COUNT(profit_bb))', 6)} AS r2,
           {rnd('AVG(((predicted_ev_bb > 0) = (profit_bb > 0))::INT)', 6)} AS directional_accuracy FROM fx_scored""")
def _(t):
    report = models.regression_report(fake_scores(t))
    return report.select("rows", *[rounded(F.col(c), 6).alias(c) for c in report.columns[1:]])


RAW = "hand_id, high_card_rank, low_card_rank, is_suited, is_pocket_pair, is_final_stage, position_encoded, is_late_position, opponent_count, won_hand"


@query("ml14_ml16_ml17_forest_checks", f"SELECT {RAW}, true AS in_label_range, true AS forest_as_set, true AS importances_add_up FROM fx_features")
def _(t):
    """The forest scores every hand inside the range of its labels and hands the raw features through."""
    rows = d.stored(t, hand_features(t))
    fitted_, train, _, _ = once(t, "forest", lambda: forest(t))
    folder = d.fresh_dir(t)
    fitted_.write().save(f"{folder}/forest")
    model = PipelineModel.load(f"{folder}/forest")
    low, high = train.agg(F.least(F.min("profit_bb"), F.lit(0.0)), F.greatest(F.max("profit_bb"), F.lit(0.0))).first()
    weights = models.importances(model, t.spark).agg(F.abs(F.sum("importance") - 1) < 1e-6).first()[0]
    grown = model.stages[-1]
    as_set = grown.getNumTrees == models.TREES and max(tree.depth for tree in grown.trees) <= models.DEPTH
    names = RAW.split(", ")
    inside = F.col("predicted_ev_bb").between(low - 1e-9, high + 1e-9)
    return models.score_hands(model, rows).select(*names, inside.alias("in_label_range"), F.lit(as_set).alias("forest_as_set"), F.lit(weights).alias("importances_add_up"))


@query("ml14_ml15_regression_report")
def _(t):
    return models.regression_report(scored(t)[1])


@query("ml16_importances")
def _(t):
    return models.importances(scored(t)[0], t.spark)


@query("ml17_score_hands")
def _(t):
    model, _, rows = scored(t)
    return models.score_hands(model, rows)


def fake_scores(t):
    """The profit with a known shift stands in for a prediction, so that SQL can follow."""
    rows = hand_features(t)
    return rows.withColumn("predicted_ev_bb", F.col("profit_bb") * 0.5 + F.col("stack_bb") * 0.25 - 2.0)


cte("fx_scored", "SELECT *, profit_bb * 0.5::DOUBLE + stack_bb * 0.25::DOUBLE - 2 AS predicted_ev_bb FROM fx_features")


@query("ml18_agg18_ev_report", f"""
    SELECT {rnd('corr(profit_bb, predicted_ev_bb)', 6)} AS correlation, {rnd('AVG(((predicted_ev_bb > 0) = (profit_bb > 0))::INT)', 6)} AS directional_accuracy FROM fx_scored""")
def _(t):
    report = models.ev_report(fake_scores(t))
    return report.select(*[rounded(F.col(c), 6).alias(c) for c in report.columns])


@query("ml18_srt3_best_spots", f"SELECT hand_id, {rnd('predicted_ev_bb', 6)} AS ev FROM fx_scored ORDER BY predicted_ev_bb DESC, hand_id LIMIT 10")
def _(t):
    return models.best_spots(fake_scores(t)).select("hand_id", rounded(F.col("predicted_ev_bb"), 6).alias("ev"))


@query("ml18_srt3_worst_spots", f"SELECT hand_id, {rnd('predicted_ev_bb', 6)} AS ev FROM fx_scored ORDER BY predicted_ev_bb, hand_id LIMIT 10")
def _(t):
    return models.worst_spots(fake_scores(t)).select("hand_id", rounded(F.col("predicted_ev_bb"), 6).alias("ev"))


@query("ml18_agg19_ev_by_situation", f"""
    SELECT is_final_stage, is_late_position, {rnd('AVG(predicted_ev_bb)', 2)} AS predicted_mean, {rnd('stddev_samp(predicted_ev_bb)', 2)} AS predicted_std,
           COUNT(*) AS hands, {rnd('AVG(profit_bb)', 2)} AS profit_mean FROM fx_scored GROUP BY 1, 2""")
def _(t):
    return models.ev_by_situation(fake_scores(t))


@query("ml18_ev_by_position", f"""
    SELECT CASE is_final_stage WHEN 1 THEN 'Final' ELSE 'Rush' END AS stage_name, ['Early', 'Middle', 'Late', 'Blinds'][position_encoded::INT + 1] AS position_name,
           {rnd('AVG(predicted_ev_bb)', 2)} AS predicted_profit_bb, {rnd('AVG(profit_bb)', 2)} AS actual_profit_bb FROM fx_scored GROUP BY 1, 2""")
def _(t):
    return models.ev_by_position(fake_scores(t))
