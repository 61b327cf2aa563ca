"""Every query by name, on the star-schema tables, with its default arguments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwise.functions.measures import as_output
from tillwise.functions.rules import TIERS
from tillwise.operators.selection import Filters, Period
from tillwise.plans import (
    alerts,
    catalog,
    customers,
    enrichment,
    kpis,
    report,
    returns,
    sales,
    support,
)
from tillwise.sources.star import StarStore
from tillwise.sources.store import OpsStore

PERIOD = Period.of("2000-01-01", "2000-12-31")
FILTERED = Filters(state="NATION_7", category="PROMO", segment="BUILDING")
IN_ASIA = Filters(zone="ASIA", category="ECONOMY")
IN_STATE = Filters(state="NATION_3")
ONE_SEGMENT = Filters(segment="MACHINERY")

# --- Fixed values: the domains and price tables of the test data ------------------

GST_PERCENT = {"ECONOMY": 5, "LARGE": 12, "MEDIUM": 12, "PROMO": 18, "SMALL": 0, "STANDARD": 18}
PRICE_RANGE = {
    "ECONOMY": (900, 20000),
    "LARGE": (1500, 90000),
    "MEDIUM": (1200, 60000),
    "PROMO": (2000, 105000),
    "SMALL": (950, 10000),
    "STANDARD": (1000, 50000),
}
MULTIPLIER = {"AUTOMOBILE": "1.5", "BUILDING": "1.3", "FURNITURE": "1.1", "HOUSEHOLD": "1.0"}

# --- Queries ----------------------------------------------------------------------


def _trend_alerts(store: OpsStore) -> DataFrame:
    return alerts.trend_alerts(sales.weekly_ops(store), support.weekly_csat(store))


def _tier_update(store: OpsStore) -> DataFrame:
    # The stored tiers differ from the earned ones for customers with and without spend.
    stored = F.element_at(F.array(*map(F.lit, TIERS)), (F.col("customer_id") % 4 + 1).cast("int"))
    base = store.customers("customer_id", "full_name", "segment").withColumn("tier", stored)
    return enrichment.updated(base, enrichment.tier_assignment(store), "customer_id", "tier")


def _explore_orders(store: OpsStore) -> DataFrame:
    shown = ["final_amount", "order_date", "order_id", "state", "order_status"]
    return catalog.explore(
        store, "orders", "state = 'NATION_4' AND final_amount > 5000", 500, shown, shown
    )


PLANS: dict[str, Callable[[OpsStore], DataFrame]] = {
    # Headline figures
    "kpi_summary": lambda s: kpis.kpi_summary(s, PERIOD),
    "kpi_summary_filtered": lambda s: kpis.kpi_summary(s, PERIOD, FILTERED),
    "kpi_by_period_pair": lambda s: kpis.kpi_by_period_pair(s, PERIOD),
    # Sales
    "revenue_daily": lambda s: sales.revenue_daily(s, PERIOD),
    "revenue_daily_filtered": lambda s: sales.revenue_daily(s, PERIOD, IN_ASIA),
    "revenue_weekly_filled": lambda s: sales.revenue_weekly_filled(s, PERIOD, IN_STATE),
    "revenue_monthly_filled": lambda s: sales.revenue_monthly_filled(s, PERIOD),
    "temporal_daily": lambda s: sales.temporal_daily(s, PERIOD),
    "dow_profile": lambda s: sales.dow_profile(s, PERIOD),
    "month_profile": lambda s: sales.month_profile(s, PERIOD),
    "yoy_monthly": lambda s: sales.yoy_monthly(s),
    "yoy_wide": lambda s: sales.yoy_wide(s),
    "weekly_ops": lambda s: sales.weekly_ops(s),
    "weekly_ops_complete": lambda s: sales.weekly_ops(s, complete_weeks_only=True),
    "weekly_metrics_long": lambda s: sales.weekly_metrics_long(s),
    "state_performance": lambda s: sales.state_performance(s, PERIOD),
    "zone_comparison": lambda s: sales.zone_comparison(s, PERIOD),
    "zone_metrics_long": lambda s: sales.zone_metrics_long(s, PERIOD),
    "category_mix": lambda s: sales.category_mix(s, PERIOD),
    "payment_analysis": lambda s: sales.payment_analysis(s, PERIOD),
    "payment_share": lambda s: sales.payment_share(s, PERIOD),
    "product_top30": lambda s: sales.product_top(s, PERIOD),
    "product_return_watchlist": lambda s: sales.product_return_watchlist(s, PERIOD),
    "orders_export": lambda s: sales.orders_export(s, PERIOD),
    # Customers
    "customer_tiers": lambda s: customers.customer_tiers(s, PERIOD),
    "tier_summary": lambda s: customers.tier_summary(s, PERIOD),
    "age_segment_matrix": lambda s: customers.age_segment_matrix(s, PERIOD),
    "churn_risk": lambda s: customers.churn_risk(s, PERIOD),
    "churn_export": lambda s: customers.churn_export(s, PERIOD, ONE_SEGMENT),
    "churn_bands": lambda s: customers.churn_bands(s, PERIOD),
    "cohort_retention_long": lambda s: customers.cohort_retention_long(s),
    "cohort_retention_matrix": lambda s: customers.cohort_retention_matrix(s),
    "top_customers": lambda s: customers.top_customers(s, PERIOD),
    "top_customers_fanout": lambda s: customers.top_customers_fanout(s, PERIOD),
    # Support and returns
    "agent_performance": lambda s: support.agent_performance(s, PERIOD),
    "agent_resolution_rate": lambda s: support.agent_resolution_rate(s, PERIOD),
    "ticket_analytics": lambda s: support.ticket_analytics(s, PERIOD),
    "ticket_analytics_filtered": lambda s: support.ticket_analytics(s, PERIOD, IN_STATE),
    "ticket_category_rollup": lambda s: support.ticket_category_rollup(s, PERIOD),
    "ticket_priority_matrix": lambda s: support.ticket_priority_matrix(s, PERIOD),
    "weekly_csat": lambda s: support.weekly_csat(s),
    "returns_analysis": lambda s: returns.returns_analysis(s, PERIOD),
    "return_reasons": lambda s: returns.return_reasons(s, PERIOD),
    "refund_status_share": lambda s: returns.refund_status_share(s, PERIOD),
    "state_return_rate": lambda s: returns.state_return_rate(s, PERIOD),
    # Alerts
    "trend_alerts": _trend_alerts,
    "alert_recommendations": lambda s: alerts.alert_recommendations(_trend_alerts(s)),
    "alert_status": lambda s: alerts.alert_status(_trend_alerts(s)),
    "revenue_sparkline": lambda s: alerts.revenue_sparkline(sales.weekly_ops(s)),
    # Report
    "report_kpi_sheet": lambda s: report.kpi_sheet(s, PERIOD, IN_STATE),
    "report_top_states": lambda s: report.top_states(s, PERIOD),
    "report_state_share": lambda s: report.state_share(s, PERIOD),
    "report_top3_concentration": lambda s: report.top3_concentration(s, PERIOD),
    "report_top_categories": lambda s: report.top_categories(s, PERIOD),
    "report_category_share": lambda s: report.category_share(s, PERIOD),
    "report_top_payments": lambda s: report.top_payments(s, PERIOD),
    "report_top_agents": lambda s: support.top_agents(s, PERIOD),
    "report_tickets_by_category": lambda s: support.tickets_by_category(s, PERIOD),
    "report_mixes": lambda s: sales.mixes(s, PERIOD, IN_ASIA),
    "report_weekly_12": lambda s: report.weekly_totals(s, PERIOD),
    "report_return_benchmark": lambda s: report.return_benchmark(s, PERIOD),
    "payment_display": lambda s: report.payment_display(s, PERIOD),
    "state_display": lambda s: report.state_display(s, PERIOD),
    "top_customers_display": lambda s: report.top_customers_display(s, PERIOD),
    "agent_scorecard": lambda s: report.agent_scorecard(s, PERIOD),
    # Enrichment
    "order_enrichment": lambda s: enrichment.order_enrichment(
        s,
        s.states(),
        gst_percent=GST_PERCENT,
        price_range=PRICE_RANGE,
        multiplier=MULTIPLIER,
    ),
    "festival_normalised": lambda s: enrichment.festival_normalised(s, PERIOD),
    "tier_assignment": lambda s: enrichment.tier_assignment(s),
    "tier_update": _tier_update,
    "derived_returns": lambda s: s.returns(),
    "customer_contacts": lambda s: enrichment.customer_contacts(s),
    "ticket_enrichment": lambda s: enrichment.ticket_enrichment(s),
    # Catalog
    "filter_options": lambda s: catalog.filter_options(s),
    "period_bounds": lambda s: catalog.period_bounds(s),
    "explore_orders": _explore_orders,
    "key_quality": lambda s: catalog.key_quality(s),
    "schema_catalog": lambda s: catalog.schema_catalog(s),
}


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_output(PLANS[name](StarStore(spark, sf_dir)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bound(name):
        return lambda spark, sf_dir: run(name, spark, sf_dir)

    return {name: bound(name) for name in PLANS}
