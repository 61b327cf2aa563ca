"""Return plans: reasons, refunds, return rate by state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.functions.measures import exact_mean, round_half_even, rows
from tillwise.functions.rules import RETURN_BENCHMARK_PERCENT
from tillwise.operators.selection import NO_FILTERS, Filters, Period, placed
from tillwise.operators.shaping import share_of_total
from tillwise.sources.store import OpsStore


def returns_analysis(
    store: OpsStore, period: Period, filters: Filters = NO_FILTERS
) -> DataFrame:
    """Returns and refunds by reason, refund status and state, most returns first."""
    keys = ["reason", "refund_status", "state"]
    return (
        store.returns(*keys, "refund_amount", period=period)
        .where(filters.on("state"))
        .groupBy(*keys)
        .agg(
            rows().alias("returns"),
            F.sum("refund_amount").alias("refund_value"),
            exact_mean("refund_amount").alias("avg_refund"),
        )
        .orderBy(F.desc("returns"), *keys)
    )


def return_reasons(
    store: OpsStore, period: Period, filters: Filters = NO_FILTERS
) -> DataFrame:
    return (
        returns_analysis(store, period, filters)
        .groupBy("reason")
        .agg(F.sum("returns").alias("returns"), F.sum("refund_value").alias("refund_value"))
        .orderBy("returns", "reason")
    )


def refund_status_share(
    store: OpsStore, period: Period, filters: Filters = NO_FILTERS
) -> DataFrame:
    by_status = (
        returns_analysis(store, period, filters)
        .groupBy("refund_status")
        .agg(F.sum("returns").alias("returns"))
    )
    return by_status.select(
        "refund_status", "returns", share_of_total("returns").alias("returns_share")
    )


def state_return_rate(
    store: OpsStore,
    period: Period,
    filters: Filters = NO_FILTERS,
    benchmark: float = RETURN_BENCHMARK_PERCENT,
) -> DataFrame:
    """Returns against placed orders by state, highest rate first."""
    returned = (
        returns_analysis(store, period, filters)
        .groupBy("state")
        .agg(F.sum("returns").alias("returns"))
    )
    orders = (
        store.orders("state", "order_status", period=period)
        .where(placed())
        .groupBy("state")
        .agg(rows().alias("orders"))
    )
    rate = F.try_divide(F.col("returns").cast("double"), F.col("orders")) * F.lit(100.0)
    return (
        returned.join(orders, "state")
        .withColumn("return_pct", round_half_even(rate, 2))
        .withColumn("above_benchmark", (F.col("return_pct") > benchmark).cast("int"))
        .orderBy(F.desc("return_pct"), "state")
    )
