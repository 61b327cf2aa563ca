"""Support plans: agents, ticket categories and priorities, weekly satisfaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions import calendar
from tillwise.functions.measures import (
    exact_mean,
    ordered_mean,
    percent,
    round_half_even,
    rows,
)
from tillwise.functions.rules import PRIORITIES
from tillwise.operators.selection import NO_FILTERS, Filters, Period
from tillwise.operators.shaping import last_of, top
from tillwise.plans.weeks import newest_days
from tillwise.sources.store import OpsStore

MEASURES = ("resolution_hours", "first_response_h", "csat_score", "is_repeat", "status")


def _tickets(store, period, filters, *columns):
    return store.tickets(*columns, *filters.active("state"), period=period).where(
        filters.on("state")
    )


def _status(name):
    return F.count_if(F.col("status") == name)


def agent_performance(
    store: OpsStore, period: Period, filters: Filters = NO_FILTERS
) -> DataFrame:
    """Ticket figures by agent, most resolved first. Agents without tickets are left
    out. Tickets are aggregated before they meet the agents."""
    return by_agent(store, period, filters).drop("agent_id")


def by_agent(store: OpsStore, period: Period, filters: Filters = NO_FILTERS) -> DataFrame:
    """Agent performance with the agents' keys: two agents may have one name."""
    figures = (
        _tickets(store, period, filters, "agent_id", *MEASURES)
        .groupBy("agent_id")
        .agg(
            rows().alias("total"),
            _status("Resolved").alias("resolved"),
            _status("Escalated").alias("escalated"),
            exact_mean("resolution_hours").alias("avg_resolution_h"),
            exact_mean("first_response_h").alias("avg_frt_h"),
            exact_mean("csat_score").alias("avg_csat"),
            F.sum("is_repeat").alias("repeat_contacts"),
        )
    )
    agents = store.agents("agent_id", "agent_name", "team", "shift")
    return agents.join(figures, "agent_id").orderBy(F.desc("resolved"), "agent_name", "agent_id")


def resolution_rate() -> Column:
    """Resolved against resolved plus escalated, with at least one escalation assumed."""
    escalated = F.when(F.col("escalated") == 0, F.lit(1)).otherwise(F.col("escalated"))
    rate = F.try_divide(F.col("resolved").cast("double"), F.col("resolved") + escalated)
    return round_half_even(rate * F.lit(100.0), 1).alias("res_rate")


def agent_resolution_rate(
    store: OpsStore, period: Period, filters: Filters = NO_FILTERS
) -> DataFrame:
    """Each agent's resolution rate."""
    return agent_performance(store, period, filters).select(
        "agent_name", "team", "shift", "resolved", "escalated", resolution_rate()
    )


def ticket_analytics(
    store: OpsStore, period: Period, filters: Filters = NO_FILTERS
) -> DataFrame:
    """Ticket figures by category and priority, most tickets first."""
    return (
        _tickets(store, period, filters, "ticket_category", "priority", *MEASURES)
        .groupBy("ticket_category", "priority")
        .agg(
            rows().alias("total"),
            exact_mean("resolution_hours").alias("avg_res_h"),
            exact_mean("first_response_h").alias("avg_frt_h"),
            exact_mean("csat_score").alias("avg_csat"),
            F.sum("is_repeat").alias("repeat_contacts"),
            _status("Escalated").alias("escalated"),
        )
        .orderBy(F.desc("total"), "ticket_category", "priority")
    )


def ticket_category_rollup(
    store: OpsStore, period: Period, filters: Filters = NO_FILTERS
) -> DataFrame:
    """By category: summed counts, and unweighted means of the priorities' means."""
    return (
        ticket_analytics(store, period, filters)
        .groupBy("ticket_category")
        .agg(
            F.sum("total").alias("total"),
            ordered_mean("priority", "avg_res_h").alias("mean_of_avg_res_h"),
            ordered_mean("priority", "avg_frt_h").alias("mean_of_avg_frt_h"),
            ordered_mean("priority", "avg_csat").alias("mean_of_avg_csat"),
            F.sum("escalated").alias("escalated"),
            F.sum("repeat_contacts").alias("repeat_contacts"),
        )
    )


def ticket_priority_matrix(
    store: OpsStore, period: Period, filters: Filters = NO_FILTERS
) -> DataFrame:
    """Tickets by category, one column per priority, 0 where there are none."""
    return (
        _tickets(store, period, filters, "ticket_category", "priority")
        .groupBy("ticket_category")
        .pivot("priority", PRIORITIES)
        .agg(rows())
        .na.fill(0)
        .orderBy("ticket_category")
    )


def tickets_by_category(
    store: OpsStore, period: Period, filters: Filters = NO_FILTERS
) -> DataFrame:
    """Ticket volume by category, largest first."""
    return (
        ticket_analytics(store, period, filters)
        .groupBy("ticket_category")
        .agg(F.sum("total").alias("total"))
        .orderBy(F.desc("total"), "ticket_category")
    )


def top_agents(
    store: OpsStore, period: Period, filters: Filters = NO_FILTERS, limit: int = 5
) -> DataFrame:
    best = top(by_agent(store, period, filters), limit, "resolved", "agent_name", "agent_id")
    return best.select("agent_name", "resolved", "avg_csat", "avg_resolution_h")


def weekly_csat(store: OpsStore, weeks: int = 8, filters: Filters = NO_FILTERS) -> DataFrame:
    """Satisfaction and escalations of the newest weeks, oldest first; only their days are
    read in full."""
    period = newest_days(store, "tickets", weeks, filters, ("state",))
    measures = ("csat_sum", "ratings", "escalated", "tickets")
    days = store.totals("tickets", {"created_date": "created_date"}, measures, filters, ("state",), period=period)
    total = F.sum("tickets")
    by_week = days.groupBy(calendar.week_label(F.col("created_date")).alias("week")).agg(
        F.try_divide(F.sum("csat_sum").cast("double"), F.sum("ratings")).alias("avg_csat"),
        percent(F.sum("escalated"), total).alias("escalation_rate"),
        total.alias("total_tickets"),
    )
    return last_of(by_week, weeks, "week")
