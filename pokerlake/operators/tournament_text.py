"""Tournament-summary text to the tournaments table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The shapes of the lines of a tournament summary.
HEADER = r"Tournament #(\d+), (.+?) \$(\d+), (.+)"
BUYIN = r"Buy-in: \$([0-9.]+)\+\$([0-9.]+)\+\$([0-9.]+)"
PLAYERS = r"(\d+) Players"
POOL = r"Total Prize Pool: \$([0-9.]+)"
STARTED = r"Tournament started (\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2})"
FINISH = r"(\d+)(?:st|nd|rd|th) : Hero, \$([0-9.]+)"
MONEY = "decimal(10,2)"


def _read(text: Column) -> dict[str, Column]:
    def part(pattern: str, group: int) -> Column:
        return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))

    def money(pattern: str, group: int) -> Column:
        found = part(pattern, group)
        return F.when(found.isNotNull(), found.try_cast("double")).otherwise(F.lit(0.0))

    def number(pattern: str, group: int) -> Column:
        found = part(pattern, group)
        return F.when(found.isNotNull(), found.try_cast("int")).otherwise(F.lit(0))

    started = part(STARTED, 1)
    return {
        "tournament_id": part(HEADER, 1).try_cast("bigint"),
        "tournament_name": part(HEADER, 2),
        "game_type": part(HEADER, 4),
        "buyin_prize": money(BUYIN, 1),
        "buyin_rake": money(BUYIN, 2),
        "buyin_bounty": money(BUYIN, 3),
        "buyin_total": part(HEADER, 3).try_cast("double"),
        "total_players": number(PLAYERS, 1),
        "prize_pool": money(POOL, 1),
        # A summary without a start time counts as started now.
        "started_at": F.when(started.isNull(), F.current_timestamp()).otherwise(
            F.try_to_timestamp(started, F.lit("yyyy/MM/dd HH:mm:ss"))
        ),
        "hero_position": number(FINISH, 1),
        "hero_prize": money(FINISH, 2),
    }


def read_summaries(df: DataFrame) -> DataFrame:
    """All fields of every summary, readable or not, with ``is_valid``; parsed once for both sides."""
    text = F.regexp_replace("raw_content", "\r\n", "\n")
    fields = _read(F.col("_text"))
    read = df.withColumn("_text", text).withColumns(fields).drop("_text")
    # Every field has a default, so a NULL is a part that is there but cannot be read.
    return read.withColumn("is_valid", F.forall(F.array(*[F.col(c).isNotNull() for c in fields]), lambda ok: ok))


def parse_tournaments(bronze: DataFrame) -> DataFrame:
    """One row per readable summary; files without a header line are left out."""
    return read_summaries(bronze).filter("is_valid").drop("is_valid", "raw_content")


def rejected_tournaments(bronze: DataFrame) -> DataFrame:
    return read_summaries(bronze).filter("NOT is_valid").select("file_name", "raw_content")


def roi(prize: Column, buyin: Column) -> Column:
    """Return on the buy-in in percent; 0 for a free entry."""
    return F.when(buyin == 0, F.lit(0.0)).otherwise(((prize - buyin) / F.nullif(buyin, F.lit(0))).cast("double") * 100)


def is_itm(prize: Column) -> Column:
    return prize > 0


def build_tournaments(parsed: DataFrame) -> DataFrame:
    """The tournaments table, money as decimals."""
    money = ["buyin_prize", "buyin_rake", "buyin_bounty", "buyin_total", "prize_pool", "hero_prize"]
    names = [
        "tournament_id", "tournament_name", "game_type", "buyin_prize", "buyin_rake", "buyin_bounty",
        "buyin_total", "total_players", "prize_pool", "started_at", "hero_position", "hero_prize",
    ]
    return parsed.select(
        *[F.col(c).cast(MONEY).alias(c) if c in money else F.col(c) for c in names],
        "file_name",
        F.current_timestamp().alias("ingested_at"),
    )
