"""Linking captures to hands and players to identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pokerlake.functions.cards import norm_cards, norm_position
from pokerlake.functions.times import bucket_number
from pokerlake.operators.ordered import first_per_key

# Fixed value: a capture and its hand are at most five minutes apart.
MATCH_SECONDS = 300


def _buckets_within(ts: Column, tolerance: int, width: int) -> Column:
    """The one or two intervals that times within the tolerance of ``ts`` can fall into."""
    return F.array_distinct(F.array(bucket_number(ts - tolerance, width), bucket_number(ts + tolerance, width)))


def interval_join(
    left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, tolerance: int
) -> DataFrame:
    """Left outer join on equal keys and times (in seconds) at most ``tolerance`` apart.

    Both sides meet on the keys and a time interval; the right side is copied to the
    neighbouring interval where its reach extends into it, the left side never is, so
    no pair comes twice. Left rows without a key or time cannot match and are spread
    by hash instead of meeting in the partition of NULL.
    """
    width = 2 * tolerance
    present = F.col(left_ts).isNotNull()
    for key in keys:
        present = present & F.col(key).isNotNull()
    spread = -1 - F.pmod(F.xxhash64(*left.columns), F.lit(100_003))
    lhs = left.withColumn("_bucket", F.when(present, bucket_number(F.col(left_ts), width)).otherwise(spread))
    rhs = right.withColumn("_bucket", F.explode(_buckets_within(F.col(right_ts), tolerance, width)))
    lhs, rhs = lhs.alias("l"), rhs.alias("r")
    on = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in [*keys, "_bucket"]]
    close = F.abs(F.col(f"l.{left_ts}") - F.col(f"r.{right_ts}")) <= tolerance
    kept = [F.col(f"r.{c}") for c in right.columns if c not in keys]
    return lhs.join(rhs, [*on, close], "left").select(*[F.col(f"l.{c}") for c in left.columns], *kept)


def match_confidence(hand_id: Column, same_position: Column) -> Column:
    """A missing position on either side leaves the grade ``unmatched`` although a hand is set."""
    found = hand_id.isNotNull()
    return F.when(found & same_position, "high").when(found & ~same_position, "medium").otherwise("unmatched")


def match_method(hand_id: Column, same_position: Column) -> Column:
    return F.when(same_position, "cards+position+time").when(hand_id.isNotNull(), "cards+time")


def nearest_hands(probes: DataFrame, hands: DataFrame, tolerance: int = MATCH_SECONDS) -> DataFrame:
    """The best hand for each distinct (cards, position, second) of the captures.

    ``probes``: cards, pos, ts. ``hands``: cards, pos, ts, hand_id, hand_cards. A hand in
    the same position wins, then one in another known position, then any with a position
    unknown on either side; the nearest in time decides within a grade, the smaller hand
    id on a tie.

    Both sides are first reduced to one row per cards, position and second. The hands of
    one interval then fit one array however frequent the cards are: it has at most as
    many items as the interval has seconds, times the positions. Every probe meets one
    such array and is answered inside its row, so no pairs are formed.
    """
    width = 2 * tolerance
    near = (
        hands.filter("cards IS NOT NULL AND ts IS NOT NULL")
        .groupBy("cards", "pos", "ts")
        .agg(F.min(F.struct("hand_id", "hand_cards")).alias("hand"))
        .withColumn("bucket", F.explode(_buckets_within(F.col("ts"), tolerance, width)))
        .groupBy("cards", "bucket")
        .agg(F.collect_list(F.struct("ts", "pos", "hand.hand_id", "hand.hand_cards")).alias("near"))
    )
    asked = probes.select("cards", "pos", "ts").distinct().withColumn("bucket", bucket_number(F.col("ts"), width))
    same = lambda e: e["pos"] == F.col("pos")
    gap = lambda e: F.abs(e["ts"] - F.col("ts"))
    graded = F.transform(
        F.filter("near", lambda e: gap(e) <= tolerance),
        lambda e: F.struct(
            F.when(same(e), 0).when(~same(e), 1).otherwise(2).alias("grade"),
            gap(e).alias("gap"),
            *[e[name].alias(name) for name in ("hand_id", "hand_cards", "pos", "ts")],
        ),
    )
    met = asked.join(near, ["cards", "bucket"])
    return met.select("cards", "pos", "ts", F.array_min(graded).alias("best")).filter("best IS NOT NULL")


def map_screenshots(screens: DataFrame, hands: DataFrame, tolerance: int = MATCH_SECONDS) -> DataFrame:
    """One row per capture with its best hand, or none, and the grade of the match.

    ``screens``: file_name (unique), screenshot_at, hero_cards, hero_pos.
    ``hands``: hand_id, hand_timestamp, hero_cards, hero_position.
    """
    shots = screens.select(
        "file_name",
        F.col("hero_cards").alias("screenshot_hero_cards"),
        norm_cards(F.col("hero_cards")).alias("cards"),
        norm_position(F.col("hero_pos")).alias("pos"),
        F.unix_timestamp("screenshot_at").alias("ts"),
    )
    dealt = hands.select(
        "hand_id",
        F.col("hero_cards").alias("hand_cards"),
        norm_cards(F.col("hero_cards")).alias("cards"),
        norm_position(F.col("hero_position")).alias("pos"),
        F.unix_timestamp("hand_timestamp").alias("ts"),
    )
    # Captures without cards or time cannot match; a salt keeps them from meeting in one task.
    hopeless = F.col("cards").isNull() | F.col("ts").isNull()
    salt = F.when(hopeless, F.pmod(F.xxhash64("file_name"), F.lit(10_007))).otherwise(F.lit(0)).cast("bigint").alias("salt")
    probe = F.struct("cards", "pos", "ts", salt)
    best = nearest_hands(shots.filter("cards IS NOT NULL AND ts IS NOT NULL"), dealt, tolerance)
    answered = shots.withColumn("_probe", probe).join(
        best.select(F.struct("cards", "pos", "ts", F.lit(0).cast("bigint").alias("salt")).alias("_probe"), "best"), "_probe", "left"
    )
    same = F.col("pos") == F.col("best.pos")
    hand_id = F.col("best.hand_id")
    return answered.select(
        "file_name",
        hand_id.alias("hand_id"),
        match_confidence(hand_id, same).alias("match_confidence"),
        match_method(hand_id, same).alias("match_method"),
        (F.col("ts") - F.col("best.ts")).cast("int").alias("time_diff_seconds"),
        "screenshot_hero_cards",
        F.col("best.hand_cards").alias("hand_hero_cards"),
        F.col("pos").alias("screenshot_hero_pos"),
        F.col("best.pos").alias("hand_hero_pos"),
        F.current_timestamp().alias("matched_at"),
    )


def player_identity(screen_players: DataFrame, mapping: DataFrame, hand_players: DataFrame) -> DataFrame:
    """Real name of an anonymous player per hand: same capture, hand and seat, first file wins."""
    named = screen_players.filter(
        F.col("name").isNotNull() & ~F.col("name").isin("", "Hero")
    ).select("file_name", "seat", F.col("name").alias("player_name"))
    linked = mapping.filter("hand_id IS NOT NULL").select("file_name", "hand_id")
    anonymous = hand_players.filter("NOT is_hero AND player_name IS NOT NULL").select(
        "hand_id", "seat", F.col("player_name").alias("anonymous_id")
    )
    rows = named.join(linked, "file_name").join(anonymous, ["hand_id", "seat"])
    first = first_per_key(rows, ["player_name", "hand_id"], ["file_name", "seat", "anonymous_id"])
    return first.select("player_name", "hand_id", "anonymous_id", "seat", "file_name")


def resolved_names(identity: DataFrame, hands: DataFrame, min_hands: int = 1) -> DataFrame:
    """Real names of anonymous ids for whole tournaments: tournament_id, anonymous_id, player_name, hands.

    An id stands for one player throughout a tournament, but only hands with a capture show a
    name, and a capture can be linked to the wrong hand. So every hand of ``identity`` votes:

    * an id takes a name that more than half of its hands show, in ``min_hands`` of them at least;
    * where a name wins several ids of a tournament, the id with the most hands keeps it, and none
      does if the first two have equally many.

    Both rules are aggregations by keys of the tournament; no rows of a key meet unsummed.
    """
    voted = identity.join(hands.select("hand_id", "tournament_id"), "hand_id").select("tournament_id", "anonymous_id", "player_name", "hand_id")
    votes = voted.distinct().groupBy("tournament_id", "anonymous_id", "player_name").agg(F.count(F.lit(1)).alias("hands"))
    by_id = votes.groupBy("tournament_id", "anonymous_id").agg(F.max(F.struct("hands", "player_name")).alias("best"), F.sum("hands").alias("all"))
    won = by_id.filter((F.col("best.hands") * 2 > F.col("all")) & (F.col("best.hands") >= min_hands))
    won = won.select("tournament_id", "anonymous_id", F.col("best.player_name").alias("player_name"), F.col("best.hands").alias("hands"))
    # Ids with equal numbers of hands become one row, so that a draw shows as a count above 1.
    drawn = won.groupBy("tournament_id", "player_name", "hands").agg(F.min("anonymous_id").alias("anonymous_id"), F.count(F.lit(1)).alias("ids"))
    kept = drawn.groupBy("tournament_id", "player_name").agg(F.max(F.struct("hands", "ids", "anonymous_id")).alias("best")).filter("best.ids = 1")
    return kept.select("tournament_id", F.col("best.anonymous_id").alias("anonymous_id"), "player_name", F.col("best.hands").alias("hands"))


def named_seats(hand_players: DataFrame, hands: DataFrame, names: DataFrame) -> DataFrame:
    """``hand_players`` with the real name in place of the anonymous one wherever ``names`` has it, seen in a capture or not."""
    keys = hands.select("hand_id", "tournament_id")
    real = names.select("tournament_id", F.col("anonymous_id").alias("player_name"), F.col("player_name").alias("_real"))
    named = hand_players.join(keys, "hand_id", "left").join(real, ["tournament_id", "player_name"], "left")
    return named.withColumn("player_name", F.coalesce("_real", "player_name")).select(*hand_players.columns)
