"""Totals by several columns of the orders from one scan of them."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.operators.selection import NO_FILTERS, Filters, Period
from tillwise.session import stage
from tillwise.sources.rollups import ROLLUPS, Measure
from tillwise.sources.store import OpsStore

FACT = "orders"


@dataclass(frozen=True)
class Mix:
    """Measures of the orders by one of their columns, named ``label`` in the result, over
    the rows that the filters among ``chosen`` and the condition ``keep`` leave."""

    by: str
    label: str
    measures: tuple[str, ...]
    chosen: tuple[str, ...] = ()
    keep: str | None = None
    buyers: bool = False  # also distinct customers

    def of(self, store: OpsStore, period: Period | None, filters: Filters) -> DataFrame:
        """The totals of this mix alone."""
        return store.totals(FACT, {self.label: self.by}, self.measures, filters, self.chosen, self.keep, period)


def one_pass(store: OpsStore, mixes: Sequence[Mix], period: Period | None, filters: Filters = NO_FILTERS) -> DataFrame:
    """``mix`` (the column it is by), the columns of all mixes, of which the mix's own has
    a value, their measures, and ``customers`` where a mix asks for buyers.

    One grouping set for each mix; a mix's rows and conditions are marks on the order that
    its aggregates are filtered by. The set of a mix with buyers has the customer as a second
    key, so that distinct customers are rows and a hot place is spread; its labels are put
    together afterwards, from rows combined by task.
    """
    labels = [m.by for m in mixes]
    if len(set(labels)) < len(labels):
        raise ValueError(f"a column stands in several mixes: {labels}")
    rollup, keys = ROLLUPS[FACT], [*labels, "customer_id"]
    columns = [c for m in mixes for c in store._split_columns(FACT, {m.label: m.by}, filters, m.chosen, m.keep)]
    columns += rollup.columns([name for m in mixes for name in m.measures]) + [m.by for m in mixes]
    if any(m.buyers for m in mixes):
        columns.append("customer_id")
    else:
        keys.remove("customer_id")
    fact = store.orders(*dict.fromkeys(columns), period=period)
    # Values are copied: an aggregate of a grouping column would see the set's null.
    copies = {c: f"v_{c}" for c in dict.fromkeys(rollup.columns([n for m in mixes for n in m.measures]))}
    marks = {f"in_{m.by}": filters.on(*m.chosen) & _condition(m.keep) for m in mixes}
    fact = fact.select(*keys, *[F.col(c).alias(v) for c, v in copies.items()], *[mark.alias(name) for name, mark in marks.items()])
    sets = [[m.by, "customer_id"] if m.buyers else [m.by] for m in mixes]
    aggregates = [F.expr(f"count(1) FILTER (WHERE in_{m.by})").alias(f"there_{m.by}") for m in mixes]
    for m in mixes:
        for name in m.measures:
            aggregates.append(F.expr(_filtered(rollup.measures[name], copies, f"in_{m.by}")).alias(f"{name}_{m.by}"))
    grouped = fact.groupingSets(sets, *keys).agg(F.grouping_id().alias("gid"), *aggregates)
    numbers = {m.by: sum(1 << (len(keys) - 1 - k) for k, key in enumerate(keys) if key not in chosen) for m, chosen in zip(mixes, sets)}

    def own(name: str, among: Sequence[Mix]) -> Column:
        """The value of the row's own mix."""
        cases = " ".join(f"WHEN {numbers[m.by]} THEN {name}_{m.by}" for m in among)
        return F.expr(f"CASE gid {cases} END")

    measures = list(dict.fromkeys(name for m in mixes for name in m.measures))
    one = grouped.select(
        F.expr("CASE gid " + " ".join(f"WHEN {n} THEN '{by}'" for by, n in numbers.items()) + " END").alias("mix"),
        *keys,
        own("there", mixes).alias("there"),
        *[own(name, [m for m in mixes if name in m.measures]).alias(name) for name in measures],
    ).where("there > 0")
    sums = [F.sum(name).alias(name) for name in measures]
    buyers = [F.count("customer_id").alias("customers")] if "customer_id" in keys else []
    return one.groupBy("mix", *labels).agg(*sums, *buyers)


def _condition(keep: str | None) -> Column:
    return F.lit(True) if keep is None else F.coalesce(F.expr(keep), F.lit(False))


def _filtered(measure: Measure, copies: Mapping[str, str], mark: str) -> str:
    when = measure.when
    for column, copy in copies.items():
        when = when and re.sub(rf"\b{column}\b", copy, when)
    value = copies[measure.value] if measure.value else "1"
    return f"{measure.kind}({value}) FILTER (WHERE {mark}{f' AND {when}' if when else ''})"


class PassStore(OpsStore):
    """A store that has some totals already, from one scan of the orders; everything else
    comes from ``store``."""

    def __init__(self, store: OpsStore, mixes: Sequence[Mix], period: Period, filters: Filters = NO_FILTERS):
        self.store, self.mixes, self.period, self.filters = store, {m.by: m for m in mixes}, period, filters
        self.tier_thresholds = store.tier_thresholds
        self.placed_by_customer = store.placed_by_customer
        # a few rows, written once: datasets that are asked for later read these
        self.written = stage(one_pass(store, mixes, period, filters))

    def _mix(self, name, by, filters, chosen, keep, period) -> Mix | None:
        mix = self.mixes.get(by) if name == FACT and period == self.period and filters == self.filters else None
        same = mix is not None and mix.keep == keep and set(filters.active(*mix.chosen)) == set(filters.active(*chosen))
        return mix if same else None

    def totals(self, name, by, measures, filters=NO_FILTERS, chosen=(), keep=None, period=None):
        (label, column), *more = by.items()
        mix = None if more else self._mix(name, column, filters, chosen, keep, period)
        if mix is None or not set(measures) <= set(mix.measures):
            return self.store.totals(name, by, measures, filters, chosen, keep, period)
        return self.written.where(F.col("mix") == column).select(F.col(column).alias(label), *measures)

    def placed_buyers(self, by, filters, chosen, period):
        placed = [m.keep for m in self.mixes.values() if m.buyers]
        mix = self._mix(FACT, by, filters, chosen, placed[0], period) if placed else None
        if mix is None or not mix.buyers:
            return self.store.placed_buyers(by, filters, chosen, period)
        return self.written.where(F.col("mix") == by).select(by, "customers")

    def table(self, name, columns, period):
        return self.store.table(name, columns, period)

    def counted(self, name):
        return self.store.counted(name)

    def days(self, name):
        return self.store.days(name)

    def has_days_exactly(self, name):
        return self.store.has_days_exactly(name)

    def customers_of(self, keys, *columns):
        return self.store.customers_of(keys, *columns)

    def customers_with_orders(self, columns, sums, read, counted, period=None):
        return self.store.customers_with_orders(columns, sums, read, counted, period)

    def customer_parts(self):
        return self.store.customer_parts()
