"""Aggregate and scalar measures.

Money and other fractional measures are decimals inside the plans, so their sums
are exact and do not depend on the order in which partitions are merged. A mean
is the exact sum, as a double, over the count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rows() -> Column:
    return F.expr("count(1)")


def exact_mean(value: Column | str) -> Column:
    """Mean of the non-null values; null for a group without any."""
    return ratio(F.sum(value), F.count(value))


def ratio(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole)


def percent(part: Column, whole: Column) -> Column:
    return F.try_divide(part * F.lit(100.0), whole)


def share_of_rows(condition: Column) -> Column:
    """Rows that meet the condition, as a percentage of all rows of the group."""
    return percent(F.count_if(condition), rows())


def zero_if_null(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def change_percent(current: Column, base: Column) -> Column:
    """Relative change in percent; null when the base is zero or missing."""
    current, base = current.cast("double"), base.cast("double")
    return F.try_divide(current - base, base) * F.lit(100.0)


def delta(current: Column, base: Column) -> Column:
    """Relative change in percent, 0 where it is not defined."""
    return zero_if_null(change_percent(current, base))


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def round_half_even(value: Column, digits: int) -> Column:
    """Scale, round to the even neighbour, scale back: array-library rounding."""
    scale = F.lit(float(10**digits))
    return F.rint(value * scale) / scale


def ordered_mean(order: Column | str, value: Column | str) -> Column:
    """Unweighted mean of a few doubles, added up in a fixed order.

    For groups bounded by a small domain (a ticket category's priorities), where
    plain double addition would vary in the last bit with the merge order.
    """
    order = F.col(order) if isinstance(order, str) else order
    value = F.col(value) if isinstance(value, str) else value
    kept = F.array_sort(
        F.collect_list(F.when(value.isNotNull(), F.struct(order.alias("o"), value.alias("v"))))
    )
    added = F.aggregate(kept, F.lit(0.0), lambda acc, item: acc + item["v"])
    return F.try_divide(added, F.size(kept))


def as_output(df: DataFrame) -> DataFrame:
    """Exact decimals become doubles where a result leaves the library."""
    decimals = {name for name, kind in df.dtypes if kind.startswith("decimal")}
    if not decimals:
        return df
    return df.selectExpr(
        *[f"CAST(`{c}` AS DOUBLE) AS `{c}`" if c in decimals else f"`{c}`" for c in df.columns]
    )
