"""Operators on small, already aggregated frames (weeks, states, categories).

Windows here have no partition key, which puts all rows into one task. That is
safe only because the row count is bounded by a calendar or a label domain; never
call them on fact rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tillwise.functions.rules import rank_in

def whole() -> WindowSpec:
    """All rows of a small frame."""
    return Window.partitionBy()


def top(df: DataFrame, count: int, by: str, *ties: str) -> DataFrame:
    """The ``count`` rows with the largest ``by``; ``ties`` make the cut unique."""
    return df.orderBy(F.desc(by), *ties).limit(count)


def last_of(df: DataFrame, count: int, key: str) -> DataFrame:
    """The ``count`` rows with the greatest keys, in ascending order."""
    return df.orderBy(F.desc(key)).limit(count).orderBy(key)


def complete_domain(df: DataFrame, key: str, domain: Sequence[str]) -> DataFrame:
    """Add one row with nulls for each domain value, ahead of a group by ``key``,
    so that absent values still form a group."""
    names = (
        df.sparkSession.range(1)
        .select(F.explode(F.array(*[F.lit(value) for value in domain])).alias(key))
    )
    return df.unionByName(names, allowMissingColumns=True)


def in_domain_order(df: DataFrame, key: str, domain: Sequence[str], *then: str) -> DataFrame:
    return df.orderBy(rank_in(F.col(key), domain), *then)


MOST_COLUMNS = 10_000


def values_of(df: DataFrame, column: str, most: int = MOST_COLUMNS) -> list:
    """The different values of a column that become columns of a result, in order. More
    than ``most`` are an error: none is left out."""
    found = df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"{column} has more than {most} values: too many for columns")
    return [row[0] for row in found]


def share_of_total(value: str) -> Column:
    total = F.sum(value).over(whole())
    return F.try_divide(F.col(value).cast("double") * F.lit(100.0), total.cast("double"))


def share_of_max(value: str) -> Column:
    largest = F.max(F.col(value)).over(whole()).cast("double")
    return F.try_divide(F.col(value).cast("double"), largest) * F.lit(100.0)


def fill_weeks(df: DataFrame, start: str, measures: Sequence[str]) -> DataFrame:
    """One row per week from the first to the last week start; empty weeks are 0."""
    return _fill(df, start, measures, lambda nxt: F.date_sub(nxt, 7), "INTERVAL 7 DAYS")


def fill_months(df: DataFrame, start: str, measures: Sequence[str]) -> DataFrame:
    """One row per month from the first to the last month start; empty months are 0."""
    return _fill(df, start, measures, lambda nxt: F.add_months(nxt, -1), "INTERVAL 1 MONTH")


def _fill(df, start, measures, before, step):
    # Each bucket emits itself and the empty buckets up to the next one, so the
    # aggregate is read once and no calendar join is needed.
    following = F.lead(start).over(Window.orderBy(start))
    until = F.coalesce(before(F.col("following")), F.col(start))
    spread = df.withColumn("following", following).select(
        *measures, F.posexplode(F.sequence(F.col(start), until, F.expr(step))).alias("gap", start)
    )
    return spread.select(
        start,
        *[
            F.when(F.col("gap") == 0, F.col(m)).otherwise(F.lit(0).cast(df.schema[m].dataType)).alias(m)
            for m in measures
        ],
    )


def long_form(df: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Measures one below the other as (keys, metric, value)."""
    return df.select(
        *keys, *[F.col(m).cast("double").alias(m) for m in measures]
    ).unpivot(list(keys), list(measures), "metric", "value")

