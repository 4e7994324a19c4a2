"""Registration of queries and of the SQL they are compared with."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pokerlake.session import broadcast_measured
from workload.fixture_tables import Tables, table_sql

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, str] = dict(table_sql("duckdb"))


def query(name: str, sql: str | None = None):
    """Register a function of the tables under ``name``, with its SQL if there is one."""

    def add(function: Callable[[Tables], DataFrame]):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def cte(name: str, sql: str) -> None:
    CTES[name] = sql


def oracles() -> dict[str, str]:
    """The SQL of every query that has one, complete with the derived tables it reads."""
    return {name: with_ctes(sql) for name, sql in ORACLES.items()}


def with_ctes(body: str) -> str:
    """The query with those derived tables in front that it reads, directly or not."""
    needed: set[str] = set()
    pending = [body]
    while pending:
        text = pending.pop()
        for name, sql in CTES.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                pending.append(sql)
    items = [f"{name} AS MATERIALIZED ({sql})" for name, sql in CTES.items() if name in needed]
    return (f"WITH {', '.join(items)} " if items else "") + body


def portable(df: DataFrame) -> DataFrame:
    """Decimals as doubles and small integers as bigint, the types the SQL side states."""
    casts = {}
    for field in df.schema.fields:
        kind = field.dataType.typeName()
        if kind == "decimal":
            casts[field.name] = F.col(field.name).cast("double")
        elif kind in ("integer", "short", "byte"):
            casts[field.name] = F.col(field.name).cast("bigint")
    return df.withColumns(casts) if casts else df


def runnable(function: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        broadcast_measured(spark)
        return portable(function(Tables(spark, sf_dir)))

    return run


def rnd(value: str, digits: int) -> str:
    return f"CAST(ROUND(CAST({value} AS DECIMAL(38,10)), {digits}) AS DOUBLE)"


def pct(part: str, whole: str, digits: int = 1) -> str:
    return rnd(f"CAST({part} AS DOUBLE) / NULLIF({whole}, 0) * 100", digits)


def n(condition: str | None = None) -> str:
    """Count of rows, optionally of those that meet a condition."""
    return "COUNT(*)" if condition is None else f"COUNT(*) FILTER (WHERE {condition})"


def dbl(value: str) -> str:
    return f"CAST({value} AS DOUBLE)"
