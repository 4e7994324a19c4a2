"""Matching against a brute-force join, with hot and missing keys."""

import random

from pyspark.sql import functions as F

from pokerlake.operators.linking import interval_join, map_screenshots, named_seats, resolved_names

START = 1_772_600_000


def tables(spark, seed=3):
    rng = random.Random(seed)
    spots = ["AsKd", "KdAs", "7c7d", None]
    seats = ["BTN", "BU", "SB", "UTG", "EP", "P3", None]
    # A third of all rows share cards and one ten-minute span.
    moment = lambda i: START + (rng.randrange(600) if i % 3 == 0 else rng.randrange(6000))
    shots = [(f"s{i:04d}", moment(i), "AsKd" if i % 3 == 0 else rng.choice(spots), rng.choice(seats)) for i in range(400)]
    hands = [(f"h{i:04d}", moment(i), "KdAs" if i % 3 == 0 else rng.choice(spots), rng.choice(seats)) for i in range(300)]
    s = spark.createDataFrame(shots, "file_name string, ts bigint, hero_cards string, hero_pos string")
    h = spark.createDataFrame(hands, "hand_id string, ts bigint, hero_cards string, hero_position string")
    return (
        shots,
        hands,
        s.withColumn("screenshot_at", F.timestamp_seconds("ts")).drop("ts"),
        h.withColumn("hand_timestamp", F.timestamp_seconds("ts")).drop("ts"),
    )


def cards(text):
    return None if text is None else min(text[:2], text[2:]) + max(text[:2], text[2:])


def seat(text):
    return {"BU": "BTN", "EP": "UTG"}.get(text, text)


def test_best_match_agrees_with_brute_force(spark):
    shots, hands, s, h = tables(spark)
    got = {r.file_name: r for r in map_screenshots(s, h).collect()}
    assert len(got) == len(shots)
    for name, ts, hole, pos in shots:
        options = []
        for hand, hts, hhole, hpos in hands:
            if hole is not None and cards(hole) == cards(hhole) and abs(ts - hts) <= 300:
                unknown = pos is None or hpos is None
                grade = 2 if unknown else 0 if seat(pos) == seat(hpos) else 1
                options.append((grade, abs(ts - hts), hand, ts - hts))
        r = got[name]
        if not options:
            assert (r.hand_id, r.match_confidence, r.match_method) == (None, "unmatched", None)
        else:
            grade, _, hand, gap = min(options)
            assert (r.hand_id, r.time_diff_seconds) == (hand, gap), name
            assert r.match_confidence == ["high", "medium", "unmatched"][grade]
            assert r.match_method == ("cards+position+time" if grade == 0 else "cards+time")


def test_interval_join_agrees_with_brute_force(spark):
    shots, hands, s, h = tables(spark, seed=5)
    left = s.select("file_name", F.col("hero_cards").alias("c"), F.unix_timestamp("screenshot_at").alias("lt"))
    right = h.select("hand_id", F.col("hero_cards").alias("c"), F.unix_timestamp("hand_timestamp").alias("rt"))
    got = sorted((r.file_name, r.hand_id or "") for r in interval_join(left, right, ["c"], "lt", "rt", 40).collect())
    want = []
    for name, ts, hole, _ in shots:
        found = [(name, hand) for hand, hts, hhole, _ in hands if hole is not None and hole == hhole and abs(ts - hts) <= 40]
        want += found or [(name, "")]
    assert got == sorted(want)


def test_names_spread_through_a_tournament(spark):
    hands = spark.createDataFrame([(f"h{i}", i // 10) for i in range(40)], "hand_id string, tournament_id long")
    seen = [
        *[(f"h{i}", "a1", "ann") for i in (0, 1, 2)], ("h3", "a1", "bob"),  # three of four
        ("h4", "a2", "bob"), ("h5", "a2", "cat"),  # no majority
        *[(f"h{i}", "a3", "dan") for i in (6, 7)], ("h8", "a4", "dan"),  # a3 has more
        ("h10", "a1", "eve"), ("h11", "a5", "eve"),  # a draw in another tournament
        ("h20", "a1", "fay"), ("h20", "a1", "fay"),
    ]
    identity = spark.createDataFrame(seen, "hand_id string, anonymous_id string, player_name string")
    names = resolved_names(identity, hands)
    assert sorted(tuple(r) for r in names.collect()) == [(0, "a1", "ann", 3), (0, "a3", "dan", 2), (2, "a1", "fay", 1)]
    assert sorted(tuple(r)[1:3] for r in resolved_names(identity, hands, min_hands=2).collect()) == [("a1", "ann"), ("a3", "dan")]
    seats = spark.createDataFrame([("h9", 1, "a1"), ("h9", 2, "a2"), ("h19", 1, "a1"), ("h29", 1, "a1"), ("gone", 1, "a1")], "hand_id string, seat int, player_name string")
    got = {(r.hand_id, r.seat): r.player_name for r in named_seats(seats, hands, names).collect()}
    assert got == {("h9", 1): "ann", ("h9", 2): "a2", ("h19", 1): "a1", ("h29", 1): "fay", ("gone", 1): "a1"}
    assert resolved_names(identity.limit(0), hands).collect() == []
