"""Periods, optional filters and order-status rules."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NO_CHOICE = ("All", "", None)
NO_FILTERS_TEXT = "No filters applied"


@dataclass(frozen=True)
class Period:
    """An inclusive range of days."""

    start: date
    end: date

    def __post_init__(self):
        if self.start > self.end:
            raise ValueError(f"period starts {self.start}, after its end {self.end}")

    @classmethod
    def of(cls, start: str, end: str) -> Period:
        return cls(date.fromisoformat(start), date.fromisoformat(end))

    def within(self, first: date, last: date) -> Period:
        """The period itself, or an error when the data does not cover it."""
        if self.start < first or self.end > last:
            raise ValueError(f"{self.start}..{self.end} is outside the data, {first}..{last}")
        return self

    def prior(self) -> Period:
        """The comparison window: as many days as lie between start and end (at
        least one), ending the day before this period."""
        days = max((self.end - self.start).days, 1)
        return Period(self.start - timedelta(days=days), self.start - timedelta(days=1))

    def with_prior(self) -> Period:
        return Period(self.prior().start, self.end)

    def shifted(self, start_days: int, end_days: int) -> Period:
        return Period(
            self.start + timedelta(days=start_days), self.end + timedelta(days=end_days)
        )

    def covers(self, other: Period) -> bool:
        return self.start <= other.start and other.end <= self.end

    @property
    def sql(self) -> str:
        """Both ends, as the operands of BETWEEN."""
        return f"DATE'{self.start}' AND DATE'{self.end}'"

    def contains(self, day: str) -> Column:
        return F.expr(f"{day} BETWEEN {self.sql}")


@dataclass(frozen=True)
class Filters:
    """Optional equality filters; "All", an empty text and None mean no filter."""

    state: str | None = "All"
    zone: str | None = "All"
    category: str | None = "All"
    segment: str | None = "All"

    def active(self, *fields: str) -> list[str]:
        """The fields among ``fields`` that filter anything."""
        return [field for field in fields if getattr(self, field) not in NO_CHOICE]

    def on(self, *fields: str) -> Column:
        condition = F.lit(True)
        for field in self.active(*fields):
            condition = condition & (F.col(field) == F.lit(getattr(self, field)))
        return condition

    def summary(self, separator: str = " / ", default: str = NO_FILTERS_TEXT) -> Column:
        """Text naming the active filters."""
        terms = [
            F.concat(F.lit(f"{field.capitalize()}: "), F.lit(getattr(self, field)))
            for field in self.active("state", "zone", "category", "segment")
        ]
        return F.concat_ws(separator, *terms) if terms else F.lit(default)


NO_FILTERS = Filters()


def newest(days: DataFrame, label, count: int, has_rows) -> Period | None:
    """A period that holds the newest ``count`` labels that have rows, or all there are.

    ``days`` is the column ``day`` of all days that may have rows, ``label`` names a day's
    label, and ``has_rows(period)`` is a frame of the days in a period that do; None if all
    do. Labels without rows don't count: where they make the period too short, it is widened.
    """
    firsts = days.distinct().groupBy(label(F.col("day")).alias("label")).agg(F.min("day").alias("first"), F.max("day").alias("last"))
    asked = count
    while True:
        found = firsts.where("label IS NOT NULL").orderBy(F.desc("label")).limit(asked).collect()
        if not found:
            return None
        period = Period(min(r["first"] for r in found), max(r["last"] for r in found))
        if has_rows is None or len(found) < asked:
            return period
        if has_rows(period).select(label(F.col("day"))).distinct().count() >= count:
            return period
        asked *= 4


PLACED = "order_status <> 'Processing'"


def placed() -> Column:
    """Orders past processing; cancelled ones still count."""
    return F.expr(PLACED)


SETTLED = "order_status NOT IN ('Cancelled', 'Processing')"


def settled() -> Column:
    """Orders that are neither cancelled nor in processing."""
    return F.expr(SETTLED)


def is_status(status: str) -> Column:
    return F.col("order_status") == F.lit(status)
