"""Ordered calculations per key that stay bounded when one key holds most rows.

A plain window sends a whole key to one task. Here the order itself is cut into slices of
about ``SLICE_ROWS`` rows of the whole table, and a key falls into one group per slice. Each
group is summed, the sums of a key are accumulated (a row per slice), and only the rows of
one group are ever sorted together.

The input is evaluated once: it is written to the shared folder, where its rows are counted,
and the rows whose hash falls below a threshold that follows from the count, about ``SAMPLE``
of all partitions together, give the points at which slices begin. Everything after that reads
the written rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pokerlake.sinks.scratch import stored

SLICE_ROWS = 1_000_000
SAMPLE = 50_000
BLOCK_ROWS = 100_000


def slice_bounds(df: DataFrame, order: list[str], slices: int, every: int) -> DataFrame:
    """One row: ``_bounds``, ascending, the places of the order at which slices 1 and up begin.

    One row in ``every`` is a point, chosen by its hash, so that every run has the same ones.
    """
    point = F.struct(*order)
    points = df.select(point.alias("_point")).filter(F.pmod(F.xxhash64("_point"), F.lit(every)) == 0)
    row = points.agg(F.array_sort(F.collect_list("_point")).alias("_points"))
    at = lambda i: F.try_element_at("_points", (1 + F.floor(i * F.size("_points") / slices)).cast("int"))
    # Sequences cannot be empty, so the first item is left out afterwards.
    bounds = F.transform(F.sequence(F.lit(0), F.lit(max(slices - 1, 0))), lambda i: F.when(i > 0, at(i)))
    return row.select(F.array_distinct(F.filter(bounds, lambda b: b.isNotNull())).alias("_bounds"))


def slice_number(point: Column, bounds: Column, slices: int) -> Column:
    """Number of bounds up to the point, by bisection."""
    steps = F.array(*[F.lit(1 << i) for i in range(slices.bit_length() - 1, -1, -1)])

    def step(passed: Column, width: Column) -> Column:
        further = passed + width
        return F.when((further <= F.size(bounds)) & (F.try_element_at(bounds, further) <= point), further).otherwise(passed)

    return F.aggregate(steps, F.lit(0), step)


def _sliced(df: DataFrame, order: list[str], slice_rows: int) -> DataFrame:
    """The rows, written once, with ``_slice``."""
    kept = stored(df, "ordered")
    rows = kept.count()
    slices = -(-rows // slice_rows)
    if slices <= 1:  # no place to begin another slice at
        return kept.withColumn("_slice", F.lit(0))
    bounds = F.broadcast(stored(slice_bounds(kept, order, slices, max(1, rows // SAMPLE)), "bounds"))  # one row, at most a point per slice
    return kept.crossJoin(bounds).withColumn("_slice", slice_number(F.struct(*order), F.col("_bounds"), slices)).drop("_bounds")


def _group(keys: list[str]) -> Column:
    return F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    sums: dict[str, Column] | None = None,
    number: str | None = None,
    total: str | None = None,
    lags: dict[str, str] | None = None,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Add running sums, the row number and the row count of each key (bigint), and values of the row before.

    ``order`` must end with a unique column, so that equal times have one order.
    """
    sums, lags = sums or {}, lags or {}
    sliced = _sliced(df, order, slice_rows).withColumn("_group", _group(keys))
    parts = sliced.groupBy("_group", "_slice").agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.sum(v).alias(f"_sum_{n}") for n, v in sums.items()],
        *[F.max_by(F.struct(F.col(source)), F.struct(*order)).alias(f"_last_{n}") for n, source in lags.items()],
    )
    before = Window.partitionBy("_group").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        "_group",
        "_slice",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
        F.sum("_rows").over(Window.partitionBy("_group")).alias("_rows_all"),
        *[F.sum(f"_sum_{n}").over(before).alias(f"_before_{n}") for n in sums],
        *[F.lag(f"_last_{n}").over(Window.partitionBy("_group").orderBy("_slice"))[source].alias(f"_lag_{n}") for n, source in lags.items()],
    )
    inside = Window.partitionBy("_group", "_slice").orderBy(*order)
    rows = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    added = {}
    for name, value in sums.items():
        # NULL only while no value has been seen, as in a plain window sum.
        here, earlier = F.sum(value).over(rows), F.col(f"_before_{name}")
        added[name] = F.coalesce(here + earlier, here, earlier)
    for name, source in lags.items():
        # The first row of a slice follows the last one of the key's slice before.
        added[name] = F.when(F.row_number().over(inside) == 1, F.col(f"_lag_{name}")).otherwise(F.lag(source).over(inside))
    if number:
        added[number] = F.col("_rows_before") + F.row_number().over(inside)
    if total:
        added[total] = F.col("_rows_all")
    return sliced.join(offsets, ["_group", "_slice"]).withColumns(added).select(*df.columns, *added)


def lookback(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    lags: dict[str, str] | None = None,
    sums: dict[str, tuple[Column, int]] | None = None,
    block_rows: int = BLOCK_ROWS,
    number: str | None = None,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Add values of the previous row and sums over the n rows before the current one.

    A key is cut into blocks of consecutive rows; the last rows of a block are handed to the
    next block as well, where they are read but not returned. ``number`` names a column
    that already holds the row numbers of the key.
    """
    lags, sums = lags or {}, sums or {}
    depth = max([1 if lags else 0, *[n for _, n in sums.values()]])
    if depth >= block_rows:
        raise ValueError("a block must be longer than the frame")
    numbered = df.withColumn("_number", F.col(number)) if number else running(df, keys, order, number="_number", slice_rows=slice_rows)
    block = F.floor((F.col("_number") - 1) / block_rows)
    closing = (F.col("_number") - 1) % block_rows >= block_rows - depth
    spread = numbered.withColumns(
        {
            "_own": block,
            "_group": _group(keys),
            "_block": F.explode(F.when(closing, F.array(block, block + 1)).otherwise(F.array(block))),
        }
    )
    window = Window.partitionBy("_group", "_block").orderBy("_number")
    columns = {name: F.lag(source).over(window) for name, source in lags.items()}
    columns |= {name: F.sum(v).over(window.rowsBetween(-n, -1)) for name, (v, n) in sums.items()}
    return spread.withColumns(columns).filter("_own = _block").select(*df.columns, *columns)


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key.

    A rank filter is pushed below the shuffle by Spark, so a frequent key sends one
    row per input partition.
    """
    numbered = df.withColumn("_nr", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return numbered.filter("_nr = 1").drop("_nr")


def top(df: DataFrame, order: list, n: int) -> DataFrame:
    """First n rows of an order; every task keeps n rows at most."""
    return df.orderBy(*order).limit(n)
