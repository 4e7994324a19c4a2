"""Raw files derived from the test tables: what the client would have written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workload.fixture_tables import Tables

HANDS_PER_FILE = 64


def _n(value: Column) -> Column:
    return F.format_number(value.cast("bigint"), 0)


def _spaced(cards: Column) -> Column:
    """``2c7c`` as ``2c 7c``."""
    return F.trim(F.regexp_replace(cards, "(..)", "$1 "))


def hand_texts(t: Tables) -> DataFrame:
    """hand text per hand: k, block."""
    name, amount = F.col("player_name"), _n(F.col("amount"))
    allin = F.when(F.col("is_allin"), " and is all-in").otherwise("")
    kind = F.col("action_type")
    deed = (
        F.when(kind == "fold", F.concat(name, F.lit(": folds")))
        .when(kind == "check", F.concat(name, F.lit(": checks")))
        .when(kind == "call", F.concat(name, F.lit(": calls "), amount, allin))
        .when(kind == "bet", F.concat(name, F.lit(": bets "), amount, allin))
        .otherwise(F.concat(name, F.lit(": raises "), amount, F.lit(" to "), amount, allin))
    )
    deeds = t.hand_actions.groupBy("hand_id").agg(
        F.array_sort(F.collect_list(F.struct("action_order", "street", deed.alias("line")))).alias("deeds")
    )
    seats = t.hand_players.groupBy("hand_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct("seat", "player_name", "position", "chips_start", "hole_cards", "went_to_showdown", "won_hand")
            )
        ).alias("seats")
    )
    df = t.hands.join(seats, "hand_id").join(deeds, "hand_id", "left")
    df = df.withColumn("deeds", F.coalesce("deeds", F.array().cast(deeds.schema["deeds"].dataType)))

    def of(street: str) -> Column:
        return F.transform(F.filter("deeds", lambda d: d["street"] == street), lambda d: d["line"])

    def text(*parts) -> Column:
        return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])

    pot = _n(F.col("total_pot"))
    card = [F.substring("board_str", 1 + 2 * i, 2) for i in range(5)]
    flop = F.concat_ws(" ", *card[:3])
    short = F.col("k") % 9 == 4
    nothing = F.array().cast("array<string>")

    def beyond_flop(lines: Column) -> Column:
        return F.when(short, nothing).otherwise(lines)

    def posts(position: str, what: str, blind: Column) -> Column:
        return F.transform(
            F.filter("seats", lambda p: p["position"] == position),
            lambda p: text(p["player_name"], f": posts {what} blind ", _n(blind)),
        )

    def result(p: Column) -> Column:
        start = text("Seat ", p["seat"].cast("string"), ": ", p["player_name"])
        label = F.when(p["position"] == "BTN", " (button)").when(p["position"] == "SB", " (small blind)").otherwise("")
        shown = text(" showed [", _spaced(p["hole_cards"]), "]")
        return (
            F.when(p["won_hand"] & p["went_to_showdown"], text(start, label, shown, " and won (", pot, ") with two pair, Tens and Fours"))
            .when(p["won_hand"], text(start, label, " won (", pot, ")"))
            .when(p["went_to_showdown"], text(start, label, shown, " and lost with a pair of Twos"))
            .otherwise(text(start, label, " folded before Flop"))
        )

    winner = F.get(F.filter("seats", lambda p: p["won_hand"]), F.lit(0))["player_name"]
    lines = F.concat(
        F.array(
            text(
                "Poker Hand #", F.col("hand_id"), ": Tournament #", F.col("tournament_id").cast("string"),
                ", Evening Series $", F.when(F.col("k") % 2 == 0, "10").otherwise("2.50"), " Hold'em No Limit - Level",
                F.col("level").cast("string"), "(", _n(F.col("small_blind")), "/", _n(F.col("big_blind")), ") - ",
                F.date_format("hand_timestamp", "yyyy/MM/dd HH:mm:ss"),
            ),
            text("Table '", (F.col("k") % 40 + 1).cast("string"), "' 6-max Seat #", F.col("button_seat").cast("string"), " is the button"),
        ),
        F.transform("seats", lambda p: text("Seat ", p["seat"].cast("string"), ": ", p["player_name"], " (", _n(p["chips_start"]), " in chips)")),
        F.transform("seats", lambda p: text(p["player_name"], ": posts the ante ", _n(F.col("big_blind") / 10))),
        posts("SB", "small", F.col("small_blind")),
        posts("BB", "big", F.col("big_blind")),
        F.array(F.lit("*** HOLE CARDS ***"), text("Dealt to Hero [", _spaced(F.col("hero_cards")), "]")),
        F.transform(F.filter("seats", lambda p: p["seat"] > 1), lambda p: text("Dealt to ", p["player_name"], " ")),
        of("preflop"),
        F.array(text("*** FLOP *** [", flop, "]")),
        of("flop"),
        beyond_flop(F.concat(F.array(text("*** TURN *** [", flop, "] [", card[3], "]")), of("turn"))),
        beyond_flop(F.concat(F.array(text("*** RIVER *** [", flop, " ", card[3], "] [", card[4], "]")), of("river"))),
        F.array(
            F.lit("*** SHOWDOWN ***"),
            text(winner, " collected ", pot, " from pot"),
            F.lit("*** SUMMARY ***"),
            text("Total pot ", pot, " | Rake ", (F.col("k") % 3).cast("string"), " | Jackpot 0"),
        ),
        F.transform("seats", result),
    )
    return df.select("k", F.array_join(lines, "\n").alias("block"))


def hand_files(t: Tables) -> DataFrame:
    """raw_content and file_name of hand histories: consecutive hands share a file."""
    numbered = hand_texts(t).withColumn("batch", F.floor(F.col("k") / HANDS_PER_FILE))
    files = numbered.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("k", "block"))).alias("hands"))
    return files.select(
        F.array_join(F.transform("hands", lambda h: h["block"]), "\n\n\n").alias("raw_content"),
        F.concat(F.lit("history_"), F.col("batch").cast("string"), F.lit(".txt")).alias("file_name"),
        "batch",
    )


def summary_files(t: Tables) -> DataFrame:
    """One tournament summary per tournament; every 50th lacks its header."""
    c = lambda name: F.col(name).cast("string")
    money = lambda name: F.format_string("%.2f", F.col(name).cast("double"))
    place = F.col("hero_position")
    ordinal = F.when(place == 1, "st").when(place == 2, "nd").when(place == 3, "rd").otherwise("th")
    head = F.concat(
        F.lit("Tournament #"), c("tournament_id"), F.lit(", Evening Series $"), F.col("buyin_total").cast("int").cast("string"),
        F.lit(", Hold'em No Limit\n"),
    )
    broken = F.col("tournament_id") % 50 == 7
    text = F.concat(
        F.when(broken, "Tournament without header\n").otherwise(head),
        F.lit("Buy-in: $"), money("buyin_prize"), F.lit("+$0.80+$4.20\n"),
        F.lit("18 Players\nTotal Prize Pool: $"), money("buyin_prize"), F.lit("\nTournament started "),
        F.date_format("started_at", "yyyy/MM/dd HH:mm:ss"), F.lit(" \n"),
        c("hero_position"), ordinal, F.lit(" : Hero, $"), money("hero_prize"), F.lit("\n"),
    )
    name = F.concat(F.lit("summary_"), c("tournament_id"), F.lit(".txt"))
    return t.tournaments.select(text.alias("raw_content"), name.alias("file_name"), "tournament_id")


def capture_files(t: Tables) -> DataFrame:
    """JSON captures. Every fifth hand is captured twice, three seconds apart, with other advice."""
    listed = t.screenshot_players.groupBy("file_name").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "seat", "name", "stack", "vpip", F.lit("CO").alias("pos"), F.lit(1.5).alias("bet"),
                    F.lit(True).alias("active"), F.lit(False).alias("is_allin"),
                )
            )
        ).alias("players")
    )
    copies = F.when(F.col("k") % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    df = t.screenshots.join(listed, "file_name", "left").withColumn("copy", F.explode(copies))
    taken = F.col("screenshot_at") + F.make_dt_interval(secs=F.col("copy") * 3)
    name = F.concat_ws(
        "_", F.lit("screenshot"), F.date_format(taken, "yyyyMMdd_HHmmss"), F.col("k").cast("string"),
        F.col("shot").cast("string"), F.col("copy").cast("string"),
    )
    action = F.when(F.col("copy") == 1, "allin").otherwise(F.col("gpt_action"))
    board = F.when(F.col("shot") == 1, F.array(F.lit("2c"), F.lit("7d"), F.lit("Jh")))
    document = F.struct(
        F.lit("decision").alias("action_type"),
        F.struct(
            F.col("hero_cards").alias("cards"), F.col("hero_pos").alias("pos"), F.col("hero_stack").alias("stack"),
            F.lit(0.5).alias("bet"), F.lit(False).alias("is_allin"), F.lit(1).alias("seat"),
        ).alias("hero"),
        "stage", "street", board.alias("board"), "pot", "to_call", "players",
        F.array(F.lit("fold"), F.lit("call")).alias("actions"),
        F.when(
            F.col("shot") == 1,
            F.array(
                F.struct(
                    F.lit("preflop").alias("street"),
                    F.array(F.lit("raise")).alias("actions"),
                    F.create_map(F.lit("Hero"), F.col("pot") / 2).alias("bets"),
                    F.col("pot").alias("pot"),
                    F.lit("call").alias("hero_prev_action"),
                )
            ),
        ).alias("hand_history"),
        F.when(
            F.col("gpt_action").isNotNull(),
            F.struct(
                F.col("gpt_recommendation").alias("recommendation"),
                F.struct(action.alias("action"), F.lit(2.5).alias("amount"), F.lit("text").alias("raw_response")).alias("raw"),
                (F.col("k") % 100 / 8).alias("time"),
            ),
        ).alias("gpt_advice"),
    )
    return df.select(F.to_json(document).alias("raw_content"), name.alias("file_name"))
