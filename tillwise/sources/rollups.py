"""Daily roll-ups: partial sums of a fact for each day and the columns it is split by.

A measure is a sum or a count, perhaps of the rows that meet a condition on the split
columns only. From the fact it is an aggregate; a roll-up keeps the unconditional one for
each day and split, and sums of these give it back exactly, money being decimal. Their
number of rows is bounded by the calendar and the domains of the split columns.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.operators.selection import PLACED


@dataclass(frozen=True)
class Measure:
    """The sum of ``value``, or the number of rows that have one; of all rows without."""

    kind: str
    value: str | None = None
    when: str | None = None

    @property
    def kept(self) -> str:
        """The name under which a roll-up keeps it."""
        return f"{self.kind}_{self.value or 'rows'}"

    @property
    def filtered(self) -> str:
        return f" FILTER (WHERE {self.when})" if self.when else ""

    @property
    def of_fact(self) -> str:
        return f"{self.kind}({self.value or 1}){self.filtered}"

    @property
    def of_rollup(self) -> str:
        summed = f"sum({self.kept}){self.filtered}"
        return f"coalesce({summed}, 0L)" if self.kind == "count" else summed


@dataclass(frozen=True)
class Rollup:
    split: tuple[str, ...]
    measures: Mapping[str, Measure]

    def columns(self, names: Iterable[str]) -> list[str]:
        """The fact's columns that the measures are computed from."""
        wanted = [self.measures[name] for name in names]
        values = [m.value for m in wanted if m.value]
        return [*values, *(c for c in self.split for m in wanted if m.when and c in m.when)]

    def aggregated(self, fact: DataFrame, by: Mapping[str, str], names: Sequence[str]) -> DataFrame:
        keys = [F.expr(sql).alias(name) for name, sql in by.items()]
        return fact.groupBy(*keys).agg(*[F.expr(self.measures[n].of_fact).alias(n) for n in names] or [F.lit(1).alias("there")])

    def combined(self, kept: DataFrame, by: Mapping[str, str], names: Sequence[str]) -> DataFrame:
        keys = [F.expr(sql).alias(name) for name, sql in by.items()]
        return kept.groupBy(*keys).agg(*[F.expr(self.measures[n].of_rollup).alias(n) for n in names] or [F.lit(1).alias("there")])

    def partial(self, fact: DataFrame, *more: str) -> DataFrame:
        """The roll-up of some rows of the fact."""
        parts = {m.kept: f"{m.kind}({m.value or 1})" for m in self.measures.values()}
        return fact.groupBy(*self.split, *more).agg(*[F.expr(sql).alias(name) for name, sql in parts.items()])


class Buyers:
    """Exact sets of the customers with placed orders, as bitmaps that can be merged: one for
    each day, state, zone and 32,768 neighbouring customer numbers. A set takes a bit for
    each customer number at most, less where Parquet compresses long runs; those of any days
    and places are put together by OR, without the orders."""

    split = ("order_date", "state", "zone")

    def partial(self, fact: DataFrame, *more: str) -> DataFrame:
        bought = fact.where(PLACED).where("customer_id IS NOT NULL")
        bucket = F.bitmap_bucket_number("customer_id").alias("bucket")
        return bought.groupBy(*self.split, *more, bucket).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position("customer_id")).alias("buyers")
        )

    def counted(self, kept: DataFrame, by: str) -> DataFrame:
        """Distinct customers by a split column."""
        merged = kept.groupBy(by, "bucket").agg(F.bitmap_or_agg("buyers").alias("buyers"))
        return merged.groupBy(by).agg(F.sum(F.bitmap_count("buyers")).alias("customers"))


BUYERS = Buyers()

ROLLUPS = {
    "orders": Rollup(
        ("order_date", "state", "zone", "category", "payment_method", "order_status"),
        {
            "orders": Measure("count"),
            "revenue": Measure("sum", "final_amount"),
            "amounts": Measure("count", "final_amount"),
            "discount": Measure("sum", "discount"),
            "gst": Measure("sum", "gst_amount"),
            "days": Measure("sum", "delivery_days"),
            "deliveries": Measure("count", "delivery_days"),
            "returned": Measure("count", None, "order_status = 'Returned'"),
            "cancelled": Measure("count", None, "order_status = 'Cancelled'"),
        },
    ),
    "tickets": Rollup(
        ("created_date", "state", "ticket_category", "priority", "status"),
        {
            "tickets": Measure("count"),
            "csat_sum": Measure("sum", "csat_score"),
            "ratings": Measure("count", "csat_score"),
            "escalated": Measure("count", None, "status = 'Escalated'"),
        },
    ),
}
