"""Headline figures of a period against the window before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions.measures import delta
from tillwise.operators.selection import NO_FILTERS, Filters, Period, placed
from tillwise.sources.store import OpsStore

WINDOWS = ("current", "prior")

SUMMARY = [
    "gmv",
    "gmv_delta",
    "orders",
    "orders_delta",
    "customers",
    "customers_delta",
    "aov",
    "aov_delta",
    "csat",
    "csat_delta",
    "resolution",
    "resolution_delta",
    "avg_delivery",
    "return_rate",
    "cancel_rate",
    "total_discount",
    "total_gst",
]


def kpi_summary(store: OpsStore, period: Period, filters: Filters = NO_FILTERS) -> DataFrame:
    """One row of 12 figures, of which 6 have a change against the prior window."""
    both = _both_windows(store, period, filters)
    now, before = (_figures(w) for w in WINDOWS)
    changes = {
        f"{name}_delta": delta(now[name], before[name])
        for name in ("gmv", "orders", "customers", "aov", "csat", "resolution")
    }
    figures = {**now, **changes}
    return both.select(*[figures[name].alias(name) for name in SUMMARY])


def kpi_by_period_pair(
    store: OpsStore, period: Period, filters: Filters = NO_FILTERS
) -> DataFrame:
    """The same figures as two rows, current and prior, each with its window."""
    both = _both_windows(store, period, filters)
    spans = {"current": period, "prior": period.prior()}
    pair = [
        F.struct(
            F.lit(w).alias("period_window"),
            F.lit(spans[w].start).alias("window_start"),
            F.lit(spans[w].end).alias("window_end"),
            *[value.alias(name) for name, value in _figures(w).items()],
        )
        for w in WINDOWS
    ]
    return both.select(F.inline(F.array(*pair)))


def return_rate(store: OpsStore, period: Period, filters: Filters = NO_FILTERS) -> DataFrame:
    """The summary's return rate alone: one pass over the period's orders."""
    chosen = ("state", "zone", "category")

    def counted(part: OpsStore) -> DataFrame:
        orders = part.orders(
            "customer_id", "order_status", *filters.active(*chosen), period=period
        ).where(placed() & filters.on(*chosen))
        by_customer = orders.groupBy("customer_id").agg(
            F.expr("count(1) AS orders"), F.expr("count_if(order_status = 'Returned') AS returned")
        )
        known = part.customers("customer_id", *filters.active("segment")).where(filters.on("segment"))
        return by_customer.join(known.select("customer_id"), "customer_id")

    return store.by_customer(counted).agg(
        F.expr("coalesce(try_divide(sum(returned) * 100D, sum(orders)), 0D)").alias("return_rate")
    )


def _both_windows(store: OpsStore, period: Period, filters: Filters) -> DataFrame:
    """Sums and counts of both windows in one row.

    Each fact is scanned once and first aggregated by customer, map-side, so a busy
    customer shrinks to one row before any shuffle. The join with the customers then
    costs one row per customer, and distinct customers become a plain count.
    """

    def of_known(by_customer):
        def joined(part: OpsStore) -> DataFrame:
            known = part.customers("customer_id", *filters.active("segment")).where(filters.on("segment"))
            return by_customer(part, period, filters).join(known.select("customer_id"), "customer_id")

        return store.by_customer(joined)

    orders, tickets = of_known(_orders_by_customer), of_known(_tickets_by_customer)
    buyers = [f"count_if(orders_{w} > 0) AS customers_{w}" for w in WINDOWS]
    order_totals = orders.selectExpr(*_totals(orders), *buyers)
    ticket_totals = tickets.selectExpr(*_totals(tickets))
    # Both are one row; put together by a union, each column has one value.
    merged = order_totals.unionByName(ticket_totals, allowMissingColumns=True)
    return merged.selectExpr(*[f"max({c}) AS {c}" for c in merged.columns])


def _totals(by_customer: DataFrame) -> list[str]:
    return [f"sum({c}) AS {c}" for c in by_customer.columns if c != "customer_id"]


def _in_windows(day: str, period: Period, measures: dict[str, str]) -> list[Column]:
    """Each aggregate of ``measures`` over the rows of each window."""
    spans = {"current": period, "prior": period.prior()}
    return [
        F.expr(f"{aggregate} FILTER (WHERE {day} BETWEEN {span.sql})").alias(f"{name}_{w}")
        for w, span in spans.items()
        for name, aggregate in measures.items()
    ]


def _orders_by_customer(store: OpsStore, period: Period, filters: Filters) -> DataFrame:
    chosen = ("state", "zone", "category")
    orders = store.orders(
        "customer_id",
        "order_date",
        "order_status",
        "final_amount",
        "discount",
        "gst_amount",
        "delivery_days",
        *filters.active(*chosen),
        period=period.with_prior(),
    ).where(placed() & filters.on(*chosen))
    measures = {
        "gmv": "sum(final_amount)",
        "total_discount": "sum(discount)",
        "total_gst": "sum(gst_amount)",
        "delivery_days": "sum(delivery_days)",
        "orders": "count(1)",
        "amounts": "count(final_amount)",
        "deliveries": "count(delivery_days)",
        "returned": "count_if(order_status = 'Returned')",
        "cancelled": "count_if(order_status = 'Cancelled')",
    }
    return orders.groupBy("customer_id").agg(*_in_windows("order_date", period, measures))


def _tickets_by_customer(store: OpsStore, period: Period, filters: Filters) -> DataFrame:
    """Tickets follow the state and segment filters only."""
    tickets = store.tickets(
        "customer_id",
        "created_date",
        "status",
        "csat_score",
        *filters.active("state"),
        period=period.with_prior(),
    ).where(filters.on("state"))
    measures = {
        "csat_sum": "sum(csat_score)",
        "tickets": "count(1)",
        "ratings": "count(csat_score)",
        "resolved": "count_if(status = 'Resolved')",
    }
    return tickets.groupBy("customer_id").agg(*_in_windows("created_date", period, measures))


def _figures(w: str) -> dict[str, Column]:
    def mean(total, number):
        return f"coalesce(try_divide(CAST({total}_{w} AS DOUBLE), {number}_{w}), 0D)"

    def share(part, whole):
        return f"coalesce(try_divide({part}_{w} * 100D, {whole}_{w}), 0D)"

    figures = {
        "gmv": f"coalesce(CAST(gmv_{w} AS DOUBLE), 0D)",
        "orders": f"coalesce(orders_{w}, 0L)",
        "customers": f"coalesce(customers_{w}, 0L)",
        "aov": mean("gmv", "amounts"),
        "csat": mean("csat_sum", "ratings"),
        "resolution": share("resolved", "tickets"),
        "avg_delivery": mean("delivery_days", "deliveries"),
        "return_rate": share("returned", "orders"),
        "cancel_rate": share("cancelled", "orders"),
        "total_discount": f"coalesce(CAST(total_discount_{w} AS DOUBLE), 0D)",
        "total_gst": f"coalesce(CAST(total_gst_{w} AS DOUBLE), 0D)",
    }
    return {name: F.expr(sql) for name, sql in figures.items()}
