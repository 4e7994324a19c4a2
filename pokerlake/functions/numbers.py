"""Rounding, null-safe ratios and rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rounded(value: Column, digits: int) -> Column:
    """Half-up rounding of a double.

    The value goes through a decimal with ten places, so that noise from the order in
    which a distributed sum adds its parts cannot move a half to the other side.
    """
    return F.round(value.cast("decimal(38,10)"), digits).cast("double")


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` in doubles; NULL when the divisor is zero or NULL."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def count_where(condition: Column, weight: Column | None = None) -> Column:
    """Rows (or their weights) for which the condition is true; 0 for none."""
    return F.sum(F.when(condition, F.lit(1) if weight is None else weight).otherwise(0)).cast("bigint")


def pct(part: Column, whole: Column, digits: int = 1) -> Column:
    return rounded(ratio(part, whole) * 100, digits)


def rate(condition: Column, base: Column | None = None, digits: int = 1) -> Column:
    """Percentage of rows meeting ``condition`` among those meeting ``base`` (all rows if None)."""
    if base is None:
        return pct(count_where(condition), F.count(F.lit(1)), digits)
    return pct(count_where(condition & base), count_where(base), digits)


def weighted_mean(value: Column, weight: Column, condition: Column | None = None) -> Column:
    """Mean of ``value`` where each row stands for ``weight`` equal rows."""
    keep = value.isNotNull() if condition is None else condition & value.isNotNull()
    return ratio(F.sum(F.when(keep, value * weight)), F.sum(F.when(keep, weight)))


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it several times inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def settled(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are computed once per row.

    A generator of one row keeps the optimizer from pasting their expressions into the
    lambdas that use them, where they would run once per array item.
    """
    packed = F.array(F.struct(*[value.alias(name) for name, value in columns.items()]))
    return df.select("*", F.inline_outer(packed))
