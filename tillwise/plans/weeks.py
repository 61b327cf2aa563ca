"""The newest week labels of a fact."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import functions as F

from tillwise.functions import calendar
from tillwise.operators.selection import Filters, Period, newest
from tillwise.sources.schemas import TABLES
from tillwise.sources.store import OpsStore


def newest_days(store: OpsStore, name: str, weeks: int, filters: Filters, chosen: Sequence[str]) -> Period | None:
    """A period that holds the newest ``weeks`` week labels with rows of a fact that the
    filters among ``chosen`` leave. Found from a roll-up where the store has one; whether
    labels have rows is asked only where filters, or the store, leave that open."""
    day = TABLES[name].date

    def has_rows(period):
        return store.totals(name, {"day": day}, (), filters, chosen, period=period)

    sure = store.has_days_exactly(name) and not filters.active(*chosen)
    return newest(store.days(name), calendar.week_label, weeks, None if sure else has_rows)
