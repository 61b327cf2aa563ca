"""Stores: where the five operations tables come from.

Every plan asks a store for the columns and the period it needs. A store may use
both to read less: skip joins, prune partitions, filter before joining.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.functions import rules
from tillwise.operators.selection import NO_FILTERS, Filters, Period
from tillwise.sources.rollups import ROLLUPS
from tillwise.sources.schemas import TABLES


class OpsStore:
    """Base store; subclasses give ``table``."""

    #: Delivered spend from which a customer is of a tier.
    tier_thresholds: Mapping[str, float] = rules.TIER_THRESHOLDS

    def table(self, name: str, columns: tuple[str, ...], period: Period | None) -> DataFrame:
        raise NotImplementedError

    def read(self, name: str, *columns: str, period: Period | None = None) -> DataFrame:
        """The columns of a table (all if none are named), rows of the period only."""
        if name not in TABLES:
            raise ValueError(f"unknown table {name!r}; known: {', '.join(TABLES)}")
        wanted = tuple(dict.fromkeys(columns)) or tuple(TABLES[name].columns)
        return self.table(name, wanted, period)

    #: Gives the rows of a frame with customer_id the place columns, where an order's place
    #: is its customer's; None where orders have a place of their own.
    placed_by_customer: Callable | None = None

    def customers(self, *columns: str) -> DataFrame:
        return self.read("customers", *columns)

    def counted(self, name: str) -> DataFrame:
        """One row: ``total_rows`` of a table, and ``n_<column>``, the values of each column."""
        return self._counts(name, self.read(name))

    @staticmethod
    def _counts(name: str, rows: DataFrame) -> DataFrame:
        return rows.selectExpr("count(1) AS total_rows", *[f"count({c}) AS n_{c}" for c in TABLES[name].columns])

    def customer_parts(self) -> Sequence[OpsStore]:
        """Stores that share out the customers, each with all facts of its own."""
        return [self]

    def by_customer(self, plan: Callable[[OpsStore], DataFrame]) -> DataFrame:
        """A plan whose rows each come from one customer's facts and profile, whatever
        others have: run on each part, its rows put together. Facts that belong to no
        customer may be left out."""
        return reduce(DataFrame.unionByName, map(plan, self.customer_parts()))

    def totals(
        self,
        name: str,
        by: Mapping[str, str],
        measures: Sequence[str],
        filters: Filters = NO_FILTERS,
        chosen: Sequence[str] = (),
        keep: str | None = None,
        period: Period | None = None,
    ) -> DataFrame:
        """Measures of ``ROLLUPS[name]`` by the named SQL expressions ``by``, over the rows
        of the period that the filters among ``chosen`` and the condition ``keep`` leave,
        all on the roll-up's split columns."""
        rollup = ROLLUPS[name]
        columns = self._split_columns(name, by, filters, chosen, keep) + rollup.columns(measures)
        fact = self.read(name, *columns, period=period).where(filters.on(*chosen))
        return rollup.aggregated(fact if keep is None else fact.where(keep), by, measures)

    def placed_buyers(self, by: str, filters: Filters, chosen: Sequence[str], period: Period | None) -> DataFrame | None:
        """Distinct customers with placed orders by a place column, where the store has them
        without reading the orders."""
        return None

    @staticmethod
    def _split_columns(name, by, filters, chosen, keep) -> list[str]:
        told = " ".join([*by.values(), keep or ""])
        split = [c for c in ROLLUPS[name].split if re.search(rf"\b{c}\b", told)]
        return [*split, *filters.active(*chosen)]

    def has_days_exactly(self, name: str) -> bool:
        """Whether ``days`` has no day without rows."""
        return False

    def days(self, name: str) -> DataFrame:
        """The column ``day``: all days on which a fact may have rows, perhaps repeated and
        perhaps more. Cheaper than reading the fact where a store can tell."""
        return self.read(name, TABLES[name].date).select(F.col(TABLES[name].date).alias("day"))

    def customers_of(self, keys: DataFrame, *columns: str) -> DataFrame:
        """The customers with a customer_id in ``keys``, a few rows."""
        return self.customers("customer_id", *columns).join(keys, "customer_id", "left_semi")

    def customers_with_orders(
        self,
        columns: Sequence[str],
        sums: Mapping[str, str],
        read: Sequence[str],
        counted: str,
        period: Period | None = None,
    ) -> DataFrame:
        """The customers with aggregates, SQL text by name, over those of their orders that
        the condition ``counted`` takes. A customer without such orders stays: its sums are
        null, its counts null or 0."""
        orders = self.orders(*dict.fromkeys(("customer_id", "order_status", *read)), period=period)
        by_customer = orders.where(counted).groupBy("customer_id")
        totals = by_customer.agg(*[F.expr(sql).alias(name) for name, sql in sums.items()])
        return self.customers(*dict.fromkeys(("customer_id", *columns))).join(totals, "customer_id", "left")

    def orders(self, *columns: str, period: Period | None = None) -> DataFrame:
        return self.read("orders", *columns, period=period)

    def tickets(self, *columns: str, period: Period | None = None) -> DataFrame:
        return self.read("tickets", *columns, period=period)

    def agents(self, *columns: str) -> DataFrame:
        return self.read("agents", *columns)

    def returns(self, *columns: str, period: Period | None = None) -> DataFrame:
        return self.read("returns", *columns, period=period)


class FrameStore(OpsStore):
    """Tables given as DataFrames; missing ones come from ``fallback``.

    ``window`` says which period the given frames cover: a read outside it goes to
    the fallback.
    """

    def __init__(
        self,
        frames: dict[str, DataFrame],
        fallback: OpsStore | None = None,
        window: Period | None = None,
    ):
        self.frames, self.fallback, self.window = frames, fallback, window
        if fallback is not None:
            self.tier_thresholds = fallback.tier_thresholds

    def _covers(self, name, columns, period):
        frame = self.frames.get(name)
        if frame is None:
            return False
        if self.fallback is None:
            return True
        in_window = self.window is None or (period is not None and self.window.covers(period))
        return in_window and set(columns) <= set(frame.columns)

    def table(self, name, columns, period):
        if not self._covers(name, columns, period):
            if self.fallback is None:
                raise KeyError(f"no table {name!r} in this store")
            return self.fallback.table(name, columns, period)
        df = self.frames[name]
        if period is not None:
            df = df.where(period.contains(TABLES[name].date))
        return df.select(*columns)
