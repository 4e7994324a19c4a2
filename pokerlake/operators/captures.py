"""JSON captures of decision points to screenshots, players and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pokerlake.functions.times import bucket_number, capture_time
from pokerlake.operators.lists import PART_ROWS, list_parts

# Fixed value: the document of one capture.
DOCUMENT = """
    action_type STRING,
    hero STRUCT<cards: STRING, pos: STRING, stack: DOUBLE, bet: DOUBLE, is_allin: BOOLEAN, seat: INT>,
    stage STRING, street STRING, board ARRAY<STRING>, pot DOUBLE, to_call DOUBLE,
    players ARRAY<STRUCT<pos: STRING, name: STRING, stack: DOUBLE, vpip: INT, bet: DOUBLE,
                         active: BOOLEAN, is_allin: BOOLEAN, seat: INT>>,
    actions ARRAY<STRING>, file STRING,
    hand_history ARRAY<STRUCT<street: STRING, board: ARRAY<STRING>, actions: ARRAY<STRING>,
                              bets: MAP<STRING, DOUBLE>, pot: DOUBLE, hero_prev_action: STRING>>,
    gpt_advice STRUCT<recommendation: STRING,
                      raw: STRUCT<action: STRING, amount: DOUBLE, raw_response: STRING,
                                  prompt_system: STRING, prompt_user: STRING>,
                      time: DOUBLE>
"""
SPOT_SECONDS = 600
MONEY = "decimal(10,2)"


def read_captures(bronze: DataFrame) -> DataFrame:
    """file_name, raw_content, data and is_valid of every document, parsed once.

    A document is valid if it carries advice. Kept and rejected documents are filters of
    this one result.
    """
    # The generator keeps the optimizer from parsing again for each use of the result.
    parsed = F.inline(F.array(F.struct(F.from_json("raw_content", DOCUMENT).alias("data"))))
    return bronze.select("file_name", "raw_content", parsed).withColumn("is_valid", F.col("data.gpt_advice").isNotNull())


def kept_screenshots(read: DataFrame) -> DataFrame:
    """file_name, data and screenshot_at of the valid documents of ``read_captures``."""
    return read.filter("is_valid").select("file_name", "data", capture_time(F.col("file_name")).alias("screenshot_at"))


def parse_screenshots(bronze: DataFrame) -> DataFrame:
    """file_name, data and screenshot_at of the documents that carry advice."""
    return kept_screenshots(read_captures(bronze))


def rejected_screenshots(bronze: DataFrame) -> DataFrame:
    """Documents without advice, unreadable ones among them."""
    return read_captures(bronze).filter("NOT is_valid").select("file_name", "raw_content")


def spot_key(ts: Column, cards: Column, position: Column, street: Column, board: Column, pot: Column) -> Column:
    """Captures of the same spot within ten minutes share this text; missing parts are skipped."""
    start = F.timestamp_seconds(bucket_number(F.unix_timestamp(ts), SPOT_SECONDS) * SPOT_SECONDS)
    return F.concat_ws(
        "|",
        F.date_format(start, "yyyyMMdd_HHmm"),
        cards,
        position,
        street,
        F.concat_ws(",", board),
        pot.cast("string"),
    )


def with_spot_key(parsed: DataFrame) -> DataFrame:
    d = lambda name: F.col(f"data.{name}")
    key = spot_key(F.col("screenshot_at"), d("hero.cards"), d("hero.pos"), d("street"), d("board"), d("pot"))
    return parsed.withColumn("spot_key", key)


def spot_recommendations(keyed: DataFrame) -> DataFrame:
    """Every advice of every spot as a row: the long form of the lists of a screenshot."""
    return keyed.select(
        "spot_key",
        "screenshot_at",
        "file_name",
        F.col("data.gpt_advice.raw.action").alias("action"),
        F.col("data.gpt_advice.recommendation").alias("recommendation"),
        F.col("data.gpt_advice.time").alias("seconds"),
    )


def first_of_spots(keyed: DataFrame) -> DataFrame:
    """The earliest capture of each spot and how often advice was given over the whole spot.

    One shuffle: every task sends one capture and one count per spot, however frequent.
    """
    order = F.struct("screenshot_at", "file_name")
    grouped = keyed.groupBy("spot_key").agg(
        F.min_by(F.struct("file_name", "screenshot_at", "data"), order).alias("_first"),
        F.count("data.gpt_advice.raw.action").cast("int").alias("recommendation_count"),
    )
    return grouped.select("spot_key", "_first.*", "recommendation_count")


def spot_lists(keyed: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """The advice of each spot in the order of time, in parts of ``part_rows`` captures.

    Nearly every spot has one part, number 0; captures without time and cards may share one
    spot and have many.
    """
    values = {"all_recommendations": "action", "all_recommendations_full": "recommendation", "all_gpt_times": "seconds"}
    columns = {name: F.col(column) for name, column in values.items()}
    return list_parts(spot_recommendations(keyed), ["spot_key"], ["screenshot_at", "file_name"], columns, part_rows)


def with_spot_lists(screenshots: DataFrame, lists: DataFrame) -> DataFrame:
    """Rows of ``build_screenshots`` with the lists of their spot from ``spot_lists``.

    A row carries the first part of the lists, which is everything for all but spots without
    time and cards; ``lists_complete`` tells, and ``lists`` has the further parts.
    """
    first = lists.filter("part = 0").drop("part")
    last = lists.groupBy("spot_key").agg((F.max("part") == 0).alias("lists_complete"))
    both = first.join(last, "spot_key")
    return screenshots.join(both, "spot_key", "left")


def build_screenshots(spots: DataFrame) -> DataFrame:
    """The screenshots table; ``spot_lists`` has the advice of the whole spot."""

    def col(path: str, name: str, kind: str | None = None) -> Column:
        value = F.col(f"data.{path}")
        return (value.cast(kind) if kind else value).alias(name)

    return spots.select(
        "file_name",
        "screenshot_at",
        *[col(c, c) for c in ("action_type", "stage", "street", "board")],
        *[col(c, c, MONEY) for c in ("pot", "to_call")],
        col("actions", "actions"),
        col("hero.cards", "hero_cards"),
        col("hero.pos", "hero_pos"),
        col("hero.stack", "hero_stack", MONEY),
        col("hero.bet", "hero_bet", MONEY),
        col("hero.is_allin", "hero_is_allin"),
        col("hero.seat", "hero_seat"),
        col("gpt_advice.recommendation", "gpt_recommendation"),
        col("gpt_advice.raw.action", "gpt_action"),
        col("gpt_advice.raw.amount", "gpt_amount", MONEY),
        col("gpt_advice.time", "gpt_time", "decimal(6,3)"),
        col("gpt_advice.raw.prompt_system", "gpt_prompt_system"),
        "spot_key",
        "recommendation_count",
        F.current_timestamp().alias("ingested_at"),
    )


def build_screenshot_players(spots: DataFrame) -> DataFrame:
    """One row per listed opponent."""
    players = spots.select("file_name", F.explode("data.players").alias("p"))
    return players.select(
        "file_name",
        *[F.col(f"p.{c}").alias(c) for c in ("seat", "pos", "name")],
        F.col("p.stack").cast(MONEY).alias("stack"),
        F.col("p.vpip").alias("vpip"),
        F.col("p.bet").cast(MONEY).alias("bet"),
        F.col("p.active").alias("active"),
        F.col("p.is_allin").alias("is_allin"),
    )


def build_screenshot_history(spots: DataFrame) -> DataFrame:
    """One row per street already played."""
    past = spots.select("file_name", F.explode("data.hand_history").alias("h"))
    return past.select(
        "file_name",
        *[F.col(f"h.{c}").alias(c) for c in ("street", "board", "actions", "bets")],
        F.col("h.pot").cast(MONEY).alias("pot"),
        F.col("h.hero_prev_action").alias("hero_prev_action"),
    )
