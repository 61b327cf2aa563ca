"""Report datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwise.functions import text
from tillwise.functions.rules import RETURN_BENCHMARK_PERCENT
from tillwise.operators.selection import NO_FILTERS, Filters, Period
from tillwise.operators.shaping import last_of, share_of_max, top, whole
from tillwise.plans import alerts, customers, kpis, returns, sales, support
from tillwise.sources.passes import PassStore
from tillwise.sources.store import OpsStore
from tillwise.sources.warehouse import Warehouse, WindowStore

# --- Fixed values: the executive figures ------------------------------------------
# label, figure, its change, prefix, decimals, thousands separators, suffix

SHEET = [
    ("Gross Merchandise Value", f"gmv / {text.LAKH}D", "gmv_delta", "₹", 1, False, "L"),
    ("Total Orders", "orders", "orders_delta", "", 0, True, ""),
    ("Active Customers", "customers", "customers_delta", "", 0, True, ""),
    ("Avg Order Value", "aov", "aov_delta", "₹", 0, True, ""),
    ("CSAT Score", "csat", "csat_delta", "", 2, False, ""),
    ("Resolution Rate", "resolution", "resolution_delta", "", 0, False, "%"),
    ("Return Rate", "return_rate", None, "", 1, False, "%"),
    ("Avg Delivery Days", "avg_delivery", None, "", 1, False, "d"),
    ("Total GST Collected", "total_gst", None, "₹", 0, True, ""),
    ("Total Discounts Given", "total_discount", None, "₹", 0, True, ""),
    ("Cancellation Rate", "cancel_rate", None, "", 1, False, "%"),
]

# --- Datasets ---------------------------------------------------------------------


def top_states(
    store: OpsStore, period: Period, filters: Filters = NO_FILTERS, limit: int = 5
) -> DataFrame:
    ranked = top(sales.state_performance(store, period, filters), limit, "revenue", "state")
    return ranked.select("state", "revenue", "orders")


def top_categories(
    store: OpsStore, period: Period, filters: Filters = NO_FILTERS, limit: int = 5
) -> DataFrame:
    ranked = top(sales.category_mix(store, period, filters), limit, "revenue", "category")
    return ranked.select("category", "revenue", "orders", "aov")


def top_payments(
    store: OpsStore, period: Period, filters: Filters = NO_FILTERS, limit: int = 5
) -> DataFrame:
    ranked = top(sales.payment_analysis(store, period, filters), limit, "revenue", "payment_method")
    return ranked.select("payment_method", "orders", "revenue")


def state_share(
    store: OpsStore, period: Period, filters: Filters = NO_FILTERS, limit: int = 8
) -> DataFrame:
    """Bar lengths of the first states, relative to the largest."""
    states = sales.state_performance(store, period, filters).select(
        "state", "revenue", share_of_max("revenue").alias("bar_share")
    )
    return top(states, limit, "revenue", "state")


def category_share(store: OpsStore, period: Period, filters: Filters = NO_FILTERS) -> DataFrame:
    """Bar lengths of all categories, relative to the largest."""
    return (
        sales.category_mix(store, period, filters)
        .select("category", "orders", "revenue", share_of_max("revenue").alias("bar_share"))
        .orderBy(F.desc("revenue"), "category")
    )


def top3_concentration(
    store: OpsStore, period: Period, filters: Filters = NO_FILTERS
) -> DataFrame:
    """Share of the three largest states, and the fourth's name."""
    place = F.row_number().over(whole().orderBy(F.desc("revenue"), "state"))
    ranked = sales.state_performance(store, period, filters).select(
        "state", "revenue", place.alias("place")
    )
    leading = F.sum(F.when(F.col("place") <= 3, F.col("revenue"))).cast("double")
    fourth = F.max(F.when(F.col("place") == 4, F.col("state")))
    return ranked.agg(
        (F.try_divide(leading, F.sum("revenue").cast("double")) * F.lit(100.0)).alias(
            "top3_share"
        ),
        F.coalesce(fourth, F.lit("other states")).alias("next_state"),
    )


def weekly_totals(
    store: OpsStore, period: Period, filters: Filters = NO_FILTERS, weeks: int = 12
) -> DataFrame:
    """Revenue and orders of the period's last weeks."""
    filled = sales.revenue_weekly_filled(store, period, filters)
    return last_of(filled.select("date", "revenue", "orders"), weeks, "date")


def return_benchmark(
    store: OpsStore, period: Period, filters: Filters = NO_FILTERS
) -> DataFrame:
    rate = F.col("return_rate")
    return kpis.return_rate(store, period, filters).select(
        "return_rate",
        F.when(rate > RETURN_BENCHMARK_PERCENT, "above").otherwise("within").alias("benchmark"),
    )


def kpi_sheet(store: OpsStore, period: Period, filters: Filters = NO_FILTERS) -> DataFrame:
    """The executive figures, one per row: number, change and display text."""
    lines = [
        f"{place}, {text.quoted(label)}, CAST({value} AS DOUBLE), {change or 'CAST(NULL AS DOUBLE)'}, "
        f"{text.quoted(prefix)}, {digits}, {grouped}, {text.quoted(suffix)}"
        for place, (label, value, change, prefix, digits, grouped, suffix) in enumerate(SHEET, 1)
    ]
    return (
        kpis.kpi_summary(store, period, filters)
        .selectExpr(
            f"stack({len(lines)}, {', '.join(lines)}) AS "
            "(position, label, value, delta, prefix, digits, grouped, suffix)"
        )
        .withColumn("number", F.expr("format_number(value, digits)"))
        .select(
            "position",
            "label",
            "value",
            F.expr(
                "concat(prefix, if(grouped, number, replace(number, ',', '')), suffix)"
            ).alias("shown"),
            "delta",
            text.signed_percent(F.col("delta")).alias("delta_shown"),
            filters.summary(separator=" | ").alias("filters"),
        )
        .orderBy("position")
    )


def payment_display(
    store: OpsStore, period: Period, filters: Filters = NO_FILTERS
) -> DataFrame:
    """The payment table as display text."""
    return (
        sales.payment_analysis(store, period, filters)
        .orderBy(F.desc("revenue"), "payment_method")
        .select(
            F.col("payment_method").alias("method"),
            text.grouped(F.col("orders")).alias("orders"),
            text.money_text(F.col("revenue")).alias("revenue"),
            text.money_text(F.col("aov")).alias("avg_order"),
            text.suffixed(F.col("cancel_rate"), 1, "%").alias("cancel_rate"),
        )
    )


def state_display(
    store: OpsStore, period: Period, filters: Filters = NO_FILTERS
) -> DataFrame:
    """The state table as display text."""
    return sales.state_performance(store, period, filters).select(
        "state",
        text.money_text(F.col("revenue")).alias("revenue"),
        "orders",
        "customers",
        text.suffixed(F.col("avg_delivery"), 1, "d").alias("avg_delivery"),
        text.suffixed(F.col("return_rate"), 1, "%").alias("return_rate"),
    )


def top_customers_display(
    store: OpsStore, period: Period, filters: Filters = NO_FILTERS, limit: int = 20
) -> DataFrame:
    """The table of top customers as display text."""
    return customers.top_customers(store, period, filters, limit).select(
        F.col("full_name").alias("name"),
        "city",
        "state",
        "tier",
        "segment",
        "age_group",
        "orders",
        text.money_text(F.col("lifetime_value")).alias("lifetime_value"),
        text.money_text(F.col("aov")).alias("avg_order"),
        text.plain(F.col("csat_avg"), 2).alias("csat"),
    )


def agent_scorecard(
    store: OpsStore, period: Period, filters: Filters = NO_FILTERS
) -> DataFrame:
    """The agent table as display text, with the resolution rate."""
    return (
        support.by_agent(store, period, filters)
        .withColumn("res_rate", support.resolution_rate())
        .select(
            F.col("agent_name").alias("agent"),
            "team",
            "shift",
            "total",
            "resolved",
            "escalated",
            F.col("repeat_contacts").alias("repeat"),
            text.suffixed(F.col("avg_resolution_h"), 1, "h").alias("avg_res"),
            text.suffixed(F.col("avg_frt_h"), 1, "h").alias("frt"),
            text.plain(F.col("avg_csat"), 2).alias("csat"),
            text.suffixed(F.col("res_rate"), 1, "%").alias("res_rate"),
        )
    )


STAGED = ("orders", "tickets")


def staged(spark: SparkSession, store: OpsStore, period: Period, folder: str) -> WindowStore:
    """A store whose facts, for the period and its prior window, are written below ``folder``
    as Parquet: the datasets of a report then share one pass over the sources, and each
    reads only its columns. Tables stand in a folder named by their window, so those of
    another period are never taken for this one's."""
    window = period.with_prior()
    house = Warehouse(spark, f"{folder}/{window.start}_{window.end}")
    for name in STAGED:
        if not house.exists(name):
            house.append(name, store.read(name, period=window))
    return WindowStore(house, STAGED, window, store)


def in_one_pass(store: OpsStore, period: Period, filters: Filters = NO_FILTERS) -> PassStore:
    """A store whose totals by day, state, category and payment method, for this period and
    these filters, come from one scan of the orders. Without any copy of the facts, eight
    datasets of the report share it."""
    return PassStore(store, sales.REPORT_MIXES, period, filters)


def report_bundle(
    store: OpsStore, period: Period, filters: Filters = NO_FILTERS
) -> dict[str, DataFrame]:
    """All datasets of one report; pass ``staged(...)`` or ``in_one_pass(...)`` as the store to
    share the reads."""
    weekly = sales.weekly_ops(store)
    found = alerts.trend_alerts(weekly, support.weekly_csat(store))
    return {
        "kpi_sheet": kpi_sheet(store, period, filters),
        "top_states": top_states(store, period, filters),
        "state_share": state_share(store, period, filters),
        "top3_concentration": top3_concentration(store, period, filters),
        "top_categories": top_categories(store, period, filters),
        "category_share": category_share(store, period, filters),
        "top_payments": top_payments(store, period, filters),
        "top_agents": support.top_agents(store, period, filters),
        "tickets_by_category": support.tickets_by_category(store, period, filters),
        "churn_bands": customers.churn_bands(store, period, filters),
        "weekly_totals": weekly_totals(store, period, filters),
        "return_benchmark": return_benchmark(store, period, filters),
        "return_reasons": returns.return_reasons(store, period, filters),
        "alerts": found,
        "recommendations": alerts.alert_recommendations(found),
        "sparkline": alerts.revenue_sparkline(weekly),
    }
