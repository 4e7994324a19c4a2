"""Ordered lists per key, in parts of a bounded number of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pokerlake.operators.ordered import running

PART_ROWS = 10_000


def list_parts(
    df: DataFrame, keys: list[str], order: list[str], values: dict[str, Column], part_rows: int = PART_ROWS
) -> DataFrame:
    """One array per key, part and value, in order, without NULL items.

    Part 0 holds the first ``part_rows`` rows of the key, part 1 the next ones and so on, so
    every row is in a list and no list is longer than that. ``order`` must end with a unique
    column.
    """
    named = df.select(*keys, *order, *[value.alias(f"_item_{name}") for name, value in values.items()])
    numbered = running(named, keys, order, number="_number")
    part = F.floor((F.col("_number") - 1) / part_rows).alias("part")
    items = [F.array_sort(F.collect_list(F.struct("_number", F.col(f"_item_{name}").alias("item")))).alias(name) for name in values]
    collected = numbered.groupBy(*keys, part).agg(*items)
    return collected.withColumns(
        {
            name: F.transform(F.filter(name, lambda x: x["item"].isNotNull()), lambda x: x["item"])
            for name in values
        }
    )


def repeated_text(df: DataFrame, keys: list[str], value: str, separator: str, part_rows: int = PART_ROWS) -> DataFrame:
    """All values of a key as text in parts, sorted, repeats kept. Adds ``part`` and ``text``.

    Equal values are counted before anything is spelled out; a value that repeats across
    the border of a part continues in the next one.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    placed = running(counted, keys, [value], {"_upto": F.col("_n")})
    first, last = F.col("_upto") - F.col("_n"), F.col("_upto") - 1
    parts = F.sequence(F.floor(first / part_rows), F.floor(last / part_rows))
    dealt = placed.withColumn("part", F.explode(parts))
    low, high = F.greatest(first, F.col("part") * part_rows), F.least(last, (F.col("part") + 1) * part_rows - 1)
    held = dealt.select(*keys, "part", value, (high - low + 1).cast("int").alias("_times"))
    grouped = held.groupBy(*keys, "part").agg(F.array_sort(F.collect_list(F.struct(value, "_times"))).alias("_items"))
    spelled = F.flatten(F.transform("_items", lambda x: F.array_repeat(x[value], x["_times"])))
    return grouped.select(*keys, "part", F.array_join(spelled, separator).alias("text"))
