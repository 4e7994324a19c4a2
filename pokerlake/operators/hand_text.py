"""Hand-history text to hands, players and actions.

A file is exploded into hand blocks; from there on every hand stays one row, whose lines are
read in plain Python within the tasks (``hand_lines``). Nothing is shuffled, so a client with a third of all
hands costs no more than any other.
"""

from __future__ import annotations

from functools import partial

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pokerlake.functions.labels import STREETS
from pokerlake.functions.numbers import settled
from pokerlake.operators import chips, hand_lines
from pokerlake.sources.files import BLANKS

# Workers get these functions themselves and need no copy of the package.
for _module in (hand_lines, chips):
    cloudpickle.register_pickle_by_value(_module)

EVENT = "kind string, name string, amount bigint, detail string, seat int, all_in boolean, nr int, street string"
SEATS = "seat int, nr int, name string, stack bigint, is_hero boolean, cards string, position string"
RESULTS = "player_name string, position_text string, folded boolean, folded_street string, cards string, won_amount bigint, hand_description string"
PLAYERS = (
    "hole_cards string, showdown boolean, won bigint, invested double, hand_description string, vpip boolean, pfr boolean, three_bet boolean,"
    " preflop_actions array<string>, total_bets int, total_raises int, total_calls int"
)
GROUPS = "_head array<string>, _table array<string>"
#: Fields of a hand that lie in the row itself, and lists of the fields of ``hand_lines.hand``.
HAND = "flop string, turn string, river string, board array<string>, ante bigint, winners array<string>, total_pot bigint, rake int"
HERO = "hero_at int, hero_cards array<string>, hero_won boolean, went_to_showdown boolean, hero_result string, bad_amount boolean"
LISTS = {
    "seats": SEATS,
    "actions": "street string, name string, action string, amount bigint, is_all_in boolean, seat int",
    "results": RESULTS,
    "players": PLAYERS,
}
STRICT_LISTS = {
    "ledger": "seat int, name string, ante bigint, committed bigint, invested bigint, collected bigint, folded boolean, live boolean",
    "pots": "pot_no int, amount bigint, paid bigint, seats array<int>",
    "shares": "pot_no int, line_no int, seat int, amount bigint",
}


def _first(items: Column) -> Column:
    return F.get(items, F.lit(0))


def _words(cards: Column) -> Column:
    return F.split(F.trim(cards), r"\s+")


def _strip(text: Column) -> Column:
    return F.trim(text, F.lit(BLANKS))


def hand_blocks(bronze: DataFrame) -> DataFrame:
    """One row per hand text: file_name, block_no, block. Blocks are parted by blank lines."""
    text = F.ltrim(F.replace("raw_content", F.lit("\r\n"), F.lit("\n")), F.lit(BLANKS))
    return (
        bronze.select("file_name", F.posexplode(F.split(text, "\n\n+")).alias("block_no", "block"))
        .withColumn("block", _strip(F.col("block")))
        .filter(F.col("block").startswith("Poker Hand"))
    )


def _arrow(ddl: str) -> list[pa.Field]:
    return list(to_arrow_schema(StructType.fromDDL(ddl)))


def _with(df: DataFrame, plain: str, lists: dict[str, str], read, without: tuple = ()) -> DataFrame:
    """Add what ``read`` finds in a row: a dict with a value per column of ``plain`` and rows per column of ``lists``.

    ``read`` takes a block. Python runs inside the tasks.
    """
    kept = [c for c in df.columns if c not in without]
    added = StructType.fromDDL(", ".join(filter(None, [plain, *(f"{name} array<struct<{_typed(ddl)}>>" for name, ddl in lists.items())])))
    schema = StructType([*df.select(*kept).schema.fields, *added.fields])
    fields, listed = _arrow(plain) if plain else [], {name: _arrow(ddl) for name, ddl in lists.items()}
    return df.mapInArrow(hand_lines.in_batches(read, kept, fields, listed, schema.names), schema)


def _typed(ddl: str) -> str:
    """``a int, b string`` as the fields of a struct type."""
    return ",".join(f"{field.name}:{field.dataType.simpleString()}" for field in StructType.fromDDL(ddl).fields)


def hand_headers(blocks: DataFrame) -> DataFrame:
    """Add the header and table fields; NULL where the header does not fit.

    The big blind is twice the small one when only one number is given; a missing table
    line means table "", nine seats and the button in seat 1.
    """
    return _header_fields(_with(blocks, GROUPS, {}, hand_lines.header))


def _header_fields(read: DataFrame) -> DataFrame:
    def head(i: int) -> Column:
        return F.get("_head", F.lit(i - 1))

    def table(i: int) -> Column:
        return F.get("_table", F.lit(i - 1))

    blinds = F.split(F.replace(head(7), F.lit(","), F.lit("")), "/")
    small = F.trim(_first(blinds)).try_cast("int")
    big = F.when(F.size(blinds) > 1, F.trim(F.get(blinds, F.lit(1))).try_cast("int")).otherwise(small * 2)
    fields = settled(
        read,
        {
            "hand_id": head(1),
            "tournament_id": head(2).try_cast("bigint"),
            "tournament_name": head(3),
            "buy_in": head(4).try_cast("double"),
            "game_type": head(5),
            "level": head(6).try_cast("int"),
            "small_blind": small,
            "big_blind": big,
            "hand_timestamp": F.try_to_timestamp(head(8), F.lit("yyyy/MM/dd HH:mm:ss")),
            "table_name": F.coalesce(table(1), F.lit("")),
            "max_seats": F.coalesce(table(2).try_cast("int"), F.lit(9)),
            "button_seat": F.coalesce(table(3).try_cast("int"), F.lit(1)),
        },
    )
    return fields.drop("_head", "_table")


def line_streets(headers: DataFrame) -> DataFrame:
    """Add ``events``: the lines between table line and summary, in order, with their street.

    Each has kind, name, amount, detail, seat, all_in, nr and street; the street is that
    of the last marker above, before the flop if there is none.
    """
    return _with(headers, "", {"events": EVENT}, hand_lines.body)


def _invalid() -> Column:
    """Blocks whose header, numbers or time cannot be read."""
    needed = ["hand_id", "tournament_id", "buy_in", "level", "small_blind", "big_blind", "hand_timestamp"]
    missing = F.lit(False)
    for name in needed:
        missing = missing | F.col(name).isNull()
    return missing | F.col("bad_amount")


def _read(blocks: DataFrame, strict: bool, without: tuple = ()) -> DataFrame:
    lists = LISTS | (STRICT_LISTS if strict else {})
    df = _header_fields(_with(blocks, f"{GROUPS}, {HAND}, {HERO}", lists, partial(hand_lines.hand, strict=strict), without))
    df = df.withColumns({"hero": F.get("seats", "hero_at"), "is_valid": ~_invalid()})
    return df.drop("hero_at", "bad_amount")


def read_blocks(blocks: DataFrame, strict: bool = False) -> DataFrame:
    """All fields of every block, valid or not, with ``is_valid``; with ``strict`` also ledger, pots and shares."""
    return _read(blocks, strict)


def parse_hands(bronze: DataFrame, strict: bool = False) -> DataFrame:
    """One nested row per readable hand of the raw files; ``strict`` adds the chips (``operators.chips``)."""
    return parse_blocks(hand_blocks(bronze), strict)


def parse_blocks(blocks: DataFrame, strict: bool = False) -> DataFrame:
    """As ``parse_hands``, from hand texts, such as ``sources.files.read_hand_blocks`` takes from large files."""
    return _read(blocks, strict, without=("block",)).filter("is_valid").drop("is_valid")


def rejected_hands(bronze: DataFrame) -> DataFrame:
    """The blocks that ``parse_hands`` leaves out."""
    return read_blocks(hand_blocks(bronze)).filter("NOT is_valid").select("file_name", "block_no", "block")


def build_hands(parsed: DataFrame, strict: bool = False) -> DataFrame:
    """The hands table; with ``strict`` the hero's result follows the chips and the fold line."""
    stack = F.col("hero.stack").cast("double")
    result = F.col("hero_result")
    if strict:
        mine = _first(F.filter("ledger", lambda s: s["name"] == F.col("hero.name")))
        result = F.when(mine["collected"] > 0, "won").when(mine["folded"], "folded").otherwise("lost")
    return parsed.select(
        "hand_id",
        "tournament_id",
        "tournament_name",
        "game_type",
        "level",
        F.col("small_blind").cast("double").alias("small_blind"),
        F.col("big_blind").cast("double").alias("big_blind"),
        F.col("ante").cast("double").alias("ante"),
        "table_name",
        "max_seats",
        "button_seat",
        "hand_timestamp",
        "board",
        F.col("total_pot").cast("double").alias("total_pot"),
        F.col("rake").cast("double").alias("rake"),
        F.col("hero.seat").alias("hero_seat"),
        F.col("hero.position").alias("hero_position"),
        F.array_join("hero_cards", "").alias("hero_cards"),
        F.nullif(stack, F.lit(0.0)).alias("hero_chips_start"),
        result.alias("hero_result"),
        "file_name",
        F.current_timestamp().alias("ingested_at"),
    )


def build_players(parsed: DataFrame, strict: bool = False) -> DataFrame:
    """The hand_players table: one row per seat with flags, money and counts.

    Money follows the printed lines: a raise counts with its total, blinds and antes do
    not count, and only "won (n)" of the summary is a win. With ``strict`` money follows the
    chips: what the seat put in, what it collected from all pots, and a showdown needs two
    seats that did not fold.
    """
    if strict and "ledger" not in parsed.columns:
        raise ValueError("strict players need hands parsed with strict=True")
    rows = parsed.select("hand_id", "button_seat", "seats", F.posexplode("players").alias("at", "d"))
    df = rows.select("hand_id", "button_seat", F.get("seats", "at").alias("p"), "d")
    position, won, invested = F.col("p.position"), F.col("d.won").cast("double"), F.col("d.invested")
    return df.select(
        "hand_id",
        F.col("p.seat").alias("seat"),
        F.col("p.name").alias("player_name"),
        F.col("p.is_hero").alias("is_hero"),
        position.alias("position"),
        (F.col("p.seat") == F.col("button_seat")).alias("is_button"),
        F.coalesce(position == "SB", F.lit(False)).alias("is_sb"),
        F.coalesce(position == "BB", F.lit(False)).alias("is_bb"),
        F.col("p.stack").cast("double").alias("chips_start"),
        F.col("d.hole_cards").alias("hole_cards"),
        F.col("d.showdown").alias("went_to_showdown"),
        (won > 0).alias("won_hand"),
        won.alias("amount_won"),
        invested.alias("total_invested"),
        (won - invested).alias("net_profit"),
        F.col("d.hand_description").alias("result_description"),
        *[F.col(f"d.{c}").alias(c) for c in ("vpip", "pfr", "three_bet", "preflop_actions", "total_bets", "total_raises", "total_calls")],
    )


def build_actions(parsed: DataFrame) -> DataFrame:
    """The hand_actions table: numbered over the streets of a hand."""
    df = parsed.select("hand_id", F.posexplode("actions").alias("at", "a"))
    return df.select(
        "hand_id",
        (F.col("at") + 1).alias("action_order"),
        F.col("a.street").alias("street"),
        F.col("a.seat").alias("seat"),
        F.col("a.name").alias("player_name"),
        (F.col("a.name") == "Hero").alias("is_hero"),
        F.col("a.action").alias("action_type"),
        F.nullif(F.col("a.amount").cast("double"), F.lit(0.0)).alias("amount"),
        F.col("a.is_all_in").alias("is_allin"),
        F.lit(None).cast("double").alias("raise_to"),
        F.lit(None).cast("string").alias("raw_line"),
    )


def _stack_bb(stack: Column) -> Column:
    return F.bround(F.try_divide(stack.cast("decimal(20,0)"), F.col("big_blind").cast("decimal(20,0)")), 1).cast("double")


def hands_nested(parsed: DataFrame) -> DataFrame:
    """One record per hand with arrays of players, actions per street and results."""

    def street(name: str) -> Column:
        return F.transform(
            F.filter("actions", lambda a: a["street"] == name),
            lambda a: F.struct(
                a["name"].alias("player"), a["action"].alias("action"), a["amount"].alias("amount"),
                a["is_all_in"].alias("is_all_in"),
            ),
        )

    players = F.transform(
        "seats",
        lambda p: F.struct(
            p["name"].alias("name"), p["seat"].alias("seat"), p["stack"].alias("stack"),
            _stack_bb(p["stack"]).alias("stack_bb"), p["position"].alias("position"),
            _words(p["cards"]).alias("hole_cards"), p["is_hero"].alias("is_hero"),
            (p["seat"] == F.col("button_seat")).alias("is_button"),
        ),
    )
    outcome = F.transform(
        "results",
        lambda r: F.struct(
            r["player_name"].alias("player_name"), _words(r["cards"]).alias("hole_cards"),
            r["won_amount"].alias("won_amount"), r["hand_description"].alias("hand_description"),
            r["folded"].alias("folded"), r["folded_street"].alias("folded_street"),
        ),
    )
    return parsed.select(
        "hand_id", "tournament_id", "tournament_name", "buy_in", "game_type", "level",
        F.col("small_blind").alias("sb"), F.col("big_blind").alias("bb"), "ante",
        F.col("hand_timestamp").alias("timestamp"), "table_name", F.col("max_seats").alias("max_players"),
        "button_seat", F.size("seats").alias("num_players"),
        F.col("hero.name").alias("hero_name"), "hero_cards", F.col("hero.position").alias("hero_position"),
        F.col("hero.stack").alias("hero_stack"), _stack_bb(F.col("hero.stack")).alias("hero_stack_bb"),
        *[_words(F.col(c)).alias(c) for c in ("flop", "turn", "river")],
        "board", "total_pot", "rake", "winners", "hero_won", "went_to_showdown",
        players.alias("players"),
        *[street(s).alias(f"{s}_actions") for s in STREETS],
        outcome.alias("results"),
    )


def hands_flat(parsed: DataFrame) -> DataFrame:
    """One record per hand without nesting: single cards and action counts."""

    def at(items: str, i: int) -> Column:
        return F.get(items, F.lit(i))

    def count(street: str) -> Column:
        return F.size(F.filter("actions", lambda a: a["street"] == street))

    flop = _words(F.col("flop"))
    return parsed.select(
        "hand_id", "tournament_id", "tournament_name", "buy_in", "game_type", "level",
        F.col("small_blind").alias("sb"), F.col("big_blind").alias("bb"), "ante",
        F.col("hand_timestamp").alias("timestamp"), "button_seat", F.size("seats").alias("num_players"),
        at("hero_cards", 0).alias("hero_card_1"), at("hero_cards", 1).alias("hero_card_2"),
        F.col("hero.position").alias("hero_position"), F.col("hero.stack").alias("hero_stack"),
        _stack_bb(F.col("hero.stack")).alias("hero_stack_bb"),
        *[F.get(flop, F.lit(i)).alias(f"flop_{i + 1}") for i in range(3)],
        at("board", 3).alias("turn_card"), at("board", 4).alias("river_card"),
        "total_pot", F.array_join("winners", ",").alias("winners"), "hero_won", "went_to_showdown",
        *[count(s).alias(f"{s}_action_count") for s in STREETS],
    )
