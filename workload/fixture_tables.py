"""Poker tables derived from the star-schema test tables.

One SQL text per table serves Spark and DuckDB alike (FIXTURES.md part B); only the
expansion of a row into a fixed list of seats is spelled per engine: Spark explodes
an array literal, DuckDB reads a VALUES list.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ONCE = {"fx_hands": ["hero_cards", "hand_timestamp"], "fx_screenshots": ["hero_cards", "hero_pos", "screenshot_at"]}
SPREAD = ["orders", "lineitem", "customer"]
STAR = ["orders", "lineitem", "customer", "events", "documents", "pages", "conversations", "labels", "part", "supplier", "nation"]


def _card(step: str) -> str:
    at = f"(a + {step} * s) % 52"
    return (
        f"substr('23456789TJQKA', CAST({at} % 13 AS INT) + 1, 1)"
        f" || substr('cdhs', CAST(floor({at} / 13) AS INT) + 1, 1)"
    )


def _cards(*steps: object) -> str:
    return " || ".join(_card(str(s)) for s in steps)


def _position(shift: str) -> str:
    names = ["BTN", "SB", "BB", "UTG", "MP"]
    whens = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names))
    return f"CASE ({shift}) % 6 {whens} ELSE 'CO' END"


def _per_value(engine: str, table: str, name: str, values: list[int]) -> str:
    if engine == "spark":
        return f"{table} LATERAL VIEW explode(array({', '.join(map(str, values))})) t AS {name}"
    return f"{table} CROSS JOIN (VALUES {', '.join(f'({v})' for v in values)}) AS t({name})"


def table_sql(engine: str) -> dict[str, str]:
    """SQL of each derived table, in dependency order."""
    sql: dict[str, str] = {}
    sql["fx_deal"] = """
        SELECT o_orderkey AS k, o_custkey, o_orderstatus, o_orderdate,
               CAST(floor(o_orderkey / 8) AS BIGINT) % 52 AS a,
               CASE o_orderkey % 8 WHEN 0 THEN 5 WHEN 1 THEN 7 WHEN 2 THEN 9 WHEN 3 THEN 11
                    WHEN 4 THEN 15 WHEN 5 THEN 17 WHEN 6 THEN 19 ELSE 21 END AS s
        FROM orders"""
    sql["fx_hands"] = f"""
        SELECT k, a, s, 'BR' || CAST(k AS VARCHAR(20)) AS hand_id, o_custkey AS tournament_id,
               CAST(1 + k % 12 AS INT) AS level,
               CAST(50 * (1 + k % 8) AS DOUBLE) AS small_blind,
               CAST(100 * (1 + k % 8) AS DOUBLE) AS big_blind,
               CAST(1 + k % 6 AS INT) AS button_seat, CAST(1 AS INT) AS hero_seat,
               o_orderdate + (k % 86400) * INTERVAL '1' SECOND AS hand_timestamp,
               CAST(500 + (k * 131) % 9000 AS DOUBLE) AS total_pot,
               CASE o_orderstatus WHEN 'F' THEN 'won' WHEN 'O' THEN 'lost' ELSE 'folded' END AS hero_result,
               {_position('6 - k % 6')} AS hero_position,
               {_cards(0, 1)} AS hero_cards,
               {_cards(40, 41, 42, 43, 44)} AS board_str
        FROM fx_deal"""
    sql["fx_hand_players"] = f"""
        SELECT hand_id, CAST(seat AS INT) AS seat, seat = 1 AS is_hero,
               CASE WHEN seat = 1 THEN 'Hero'
                    ELSE 'anon' || CAST((tournament_id * 7 + seat * 31) % 400 AS VARCHAR(20)) END AS player_name,
               {_position('seat + 5 - k % 6')} AS position,
               CAST(300 + (k * 53 + seat * 977) % 6000 AS DOUBLE) AS chips_start,
               CASE WHEN seat = 1 OR (k + seat) % 2 = 0
                    THEN {_cards('(2 * seat - 2)', '(2 * seat - 1)')} END AS hole_cards,
               (k + seat) % 2 = 0 AS went_to_showdown, seat = CASE WHEN hero_result = 'won' THEN 1 ELSE 2 + k % 5 END AS won_hand,
               CASE WHEN seat = CASE WHEN hero_result = 'won' THEN 1 ELSE 2 + k % 5 END THEN total_pot ELSE CAST(0 AS DOUBLE) END AS amount_won,
               CAST((k * 37 + seat * 101) % 4001 - 2000 AS DOUBLE) AS net_profit,
               (k * 3 + seat * 5) % 10 < 4 AS vpip, (k * 3 + seat * 5) % 10 < 2 AS pfr,
               (k * 3 + seat * 5) % 10 < 1 AS three_bet,
               CAST((k + seat) % 3 AS INT) AS total_bets, CAST((k + 2 * seat) % 3 AS INT) AS total_raises,
               CAST((k + 3 * seat) % 4 AS INT) AS total_calls
        FROM {_per_value(engine, 'fx_hands', 'seat', [1, 2, 3, 4, 5, 6])}"""
    sql["fx_hand_actions"] = """
        SELECT 'BR' || CAST(l_orderkey AS VARCHAR(20)) AS hand_id,
               CAST(ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INT) AS action_order,
               CASE WHEN l_linenumber <= 3 THEN 'preflop' WHEN l_linenumber <= 5 THEN 'flop'
                    WHEN l_linenumber = 6 THEN 'turn' ELSE 'river' END AS street,
               CAST(1 + l_suppkey % 3 AS INT) AS seat, l_suppkey % 3 = 0 AS is_hero,
               CASE WHEN l_suppkey % 3 = 0 THEN 'Hero'
                    ELSE 'anon' || CAST((o_custkey * 7 + (1 + l_suppkey % 3) * 31) % 400 AS VARCHAR(20)) END AS player_name,
               CASE WHEN l_returnflag = 'R' THEN 'fold'
                    WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'check'
                    WHEN l_returnflag = 'A' THEN 'call' WHEN l_linestatus = 'F' THEN 'bet' ELSE 'raise' END AS action_type,
               CASE WHEN l_returnflag = 'R' OR (l_returnflag = 'A' AND l_linestatus = 'F')
                    THEN CAST(NULL AS DOUBLE) ELSE l_quantity * 20 END AS amount,
               l_quantity >= 35 AND l_returnflag <> 'R' AS is_allin
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""
    advice = "CASE (k + 2 * shot) % 5 WHEN 0 THEN 'fold' WHEN 1 THEN 'call' WHEN 2 THEN {raised} WHEN 3 THEN 'check' ELSE CAST(NULL AS VARCHAR(8)) END"
    raised = "'raise ' || CASE k % 3 WHEN 0 THEN '2.5 BB' WHEN 1 THEN '2 BB' ELSE '9 BB' END"
    sql["fx_screenshots"] = f"""
        SELECT 'screenshot_' || CAST(k AS VARCHAR(20)) || '_' || CAST(shot AS VARCHAR(4)) AS file_name, k, shot,
               hand_timestamp + ((k * 37 + shot * 41) % 701 - 350) * INTERVAL '1' SECOND AS screenshot_at,
               CASE WHEN k % 7 < 4 THEN 'rush' ELSE 'final' END AS stage,
               CASE WHEN shot = 0 THEN 'preflop' WHEN k % 9 = 3 THEN 'turn' WHEN k % 9 = 6 THEN 'river' ELSE 'flop' END AS street,
               CASE WHEN k % 2 = 0 THEN hero_cards ELSE substr(hero_cards, 3, 2) || substr(hero_cards, 1, 2) END AS hero_cards,
               CASE WHEN k % 11 = 0 THEN CAST(NULL AS VARCHAR(8)) WHEN k % 7 = 0 THEN 'P3'
                    WHEN k % 13 < 2 AND hero_position = 'BTN' THEN 'BU' WHEN k % 13 = 2 AND hero_position = 'BTN' THEN 'D'
                    WHEN k % 13 < 3 AND hero_position = 'UTG' THEN 'EP' WHEN k % 13 = 3 THEN 'HJ' WHEN k % 13 = 4 THEN 'UTG+1'
                    ELSE hero_position END AS hero_pos,
               CAST(5 + (k * 17) % 30 AS DOUBLE) AS hero_stack, CAST(2 + (k * 5 + shot) % 20 AS DOUBLE) AS pot,
               CAST((k * 3) % 25 AS DOUBLE) AS to_call,
               {advice.format(raised="'raise'")} AS gpt_action,
               {advice.format(raised=raised)} AS gpt_recommendation
        FROM {_per_value(engine, 'fx_hands', 'shot', [0, 1])}
        WHERE shot = 0 OR k % 3 = 0"""
    sql["fx_screenshot_players"] = f"""
        SELECT file_name, CAST(seat AS INT) AS seat,
               'player' || CAST((k * 3 + seat * 11) % 61 AS VARCHAR(20)) AS name,
               CAST(5 + (k + seat * 7) % 40 AS DOUBLE) AS stack, CAST((k + seat * 13) % 100 AS INT) AS vpip
        FROM {_per_value(engine, 'fx_screenshots', 'seat', [2, 3, 4, 5, 6])}
        WHERE (k % 4 = 0 AND seat = 2) OR (k % 4 <> 0 AND (k + seat) % 3 <> 0)"""
    sql["fx_tournaments"] = """
        SELECT c_custkey AS tournament_id,
               CAST(CASE WHEN c_custkey % 2 = 0 THEN 10 ELSE 25 END AS DECIMAL(10,2)) AS buyin_total,
               CAST(CASE WHEN c_custkey % 2 = 0 THEN 5 ELSE 12.5 END AS DECIMAL(10,2)) AS buyin_prize,
               CAST(1 + c_custkey % 18 AS INT) AS hero_position,
               CAST(CASE WHEN c_custkey % 18 < 3 THEN 120 - 30 * (c_custkey % 18) WHEN c_custkey % 7 = 0 THEN 8 ELSE 0 END
                    AS DECIMAL(10,2)) AS hero_prize,
               TIMESTAMP '2026-01-01 00:00:00' + c_custkey * INTERVAL '7' MINUTE AS started_at
        FROM customer"""
    return sql


class Tables:
    """The test tables and the derived poker tables of one scale factor."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._derived = table_sql("spark")
        self._built: dict[str, DataFrame] = {}

    def star(self, name: str) -> DataFrame:
        """A test table; one that is a single small file is spread over the cores."""
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        casts = {
            f.name: F.col(f.name).cast("timestamp") for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"
        }
        df = df.withColumns(casts) if casts else df
        cores = self.spark.sparkContext.defaultParallelism
        return df.repartition(cores) if name in SPREAD and df.rdd.getNumPartitions() < cores else df

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        key = name if name in STAR else f"fx_{name}"
        if key not in self._built:
            self._built[key] = self.star(name) if name in STAR else self._derive(key)
        return self._built[key]

    def _derive(self, key: str) -> DataFrame:
        if key not in self._derived:
            raise AttributeError(key)
        text = self._derived[key]
        for name in [*SPREAD, *self._derived]:
            if name != key and re.search(rf"\b{name}\b", text):
                getattr(self, name.removeprefix("fx_")).createOrReplaceTempView(name)
        df, once = self.spark.sql(text), ONCE.get(key, [])
        # A one-row generator computes these long expressions once, wherever filters on them move.
        packed = [F.inline_outer(F.array(F.struct(*once)))] if once else []
        return df.select(*[c for c in df.columns if c not in once], *packed)
