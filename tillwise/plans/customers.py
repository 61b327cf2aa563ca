"""Customer plans: tiers, churn risk, cohort retention, top customers.

Facts are aggregated by customer before they meet the customers, so a customer with
a large share of the orders is one row by the time anything is joined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwise.functions import calendar
from tillwise.functions.measures import (
    clip,
    exact_mean,
    ratio,
    round_half_even,
    rows,
    zero_if_null,
)
from tillwise.functions.rules import TIERS
from tillwise.operators.selection import NO_FILTERS, SETTLED, Filters, Period, settled
from tillwise.operators.shaping import in_domain_order, top, values_of
from tillwise.sources.store import OpsStore

WHO = ("state", "segment")
NEVER_ORDERED_DAYS = 999


def _customers(store: OpsStore, filters: Filters, *columns: str) -> DataFrame:
    return store.customers("customer_id", *columns, *filters.active(*WHO)).where(
        filters.on(*WHO)
    )


def _settled(store: OpsStore, *columns: str, period: Period | None = None) -> DataFrame:
    return store.orders("customer_id", "order_status", *columns, period=period).where(settled())


# Tiers.

TIER_KEYS = ["tier", "segment", "zone", "age_group", "status"]


def customer_tiers(
    store: OpsStore, period: Period, filters: Filters = NO_FILTERS
) -> DataFrame:
    """Customers, revenue and orders by tier, segment, zone, age group and status.

    Customers without orders in the period stay, with 0.
    """
    spend = {"revenue": "sum(final_amount)", "amounts": "count(final_amount)", "orders": "count(1)"}
    columns = (*TIER_KEYS, *filters.active(*WHO))
    return (
        store.by_customer(lambda part: part.customers_with_orders(columns, spend, ["final_amount"], SETTLED, period))
        .where(filters.on(*WHO))
        .groupBy(*TIER_KEYS)
        .agg(
            rows().alias("customers"),
            F.coalesce(F.sum("revenue"), F.lit(0)).alias("revenue"),
            zero_if_null(ratio(F.sum("revenue"), F.sum("amounts"))).alias("aov"),
            F.coalesce(F.sum("orders"), F.lit(0).cast("bigint")).alias("orders"),
        )
    )


def tier_summary(
    store: OpsStore, period: Period, filters: Filters = NO_FILTERS
) -> DataFrame:
    """Customers and revenue by tier, highest tier first."""
    by_tier = (
        customer_tiers(store, period, filters)
        .groupBy("tier")
        .agg(F.sum("customers").alias("customers"), F.sum("revenue").alias("revenue"))
    )
    return in_domain_order(by_tier, "tier", TIERS)


def age_segment_matrix(
    store: OpsStore,
    period: Period,
    segments: Sequence[str] | None = None,
    filters: Filters = NO_FILTERS,
) -> DataFrame:
    """Customers by age group, one column per segment, 0 where there are none. Without
    ``segments`` there is a column for each segment that the chosen customers have."""
    if segments is None:
        segments = values_of(_customers(store, filters, "segment"), "segment")
    return (
        customer_tiers(store, period, filters)
        .groupBy("age_group")
        .pivot("segment", list(segments))
        .agg(F.sum("customers"))
        .na.fill(0)
        .orderBy("age_group")
    )


# Churn.

CHURN_EXPORT = [
    "full_name",
    "city",
    "state",
    "tier",
    "segment",
    "lifetime_value",
    "total_orders",
    "days_since_order",
    "churn_score",
]
CHURN_BANDS = ("high", "medium", "low")


def churn_score(
    days: Column, status: Column, orders: Column, noise: Column | None = None
) -> Column:
    """Recency, status and frequency in one score between 0 and 1."""
    score = (
        clip(days, 0, 180) / F.lit(180.0) * F.lit(0.45)
        + F.when(status == "Churned", 1.0).otherwise(0.0) * F.lit(0.40)
        + F.when(status == "At-Risk", 1.0).otherwise(0.0) * F.lit(0.25)
        + (F.lit(1.0) - clip(orders, 0, 10) / F.lit(10.0)) * F.lit(0.10)
    )
    if noise is not None:
        score = score + noise
    return clip(score, 0.0, 1.0)


def hash_noise(seed: int, upto: float = 0.05) -> Column:
    """A repeatable pseudo-random amount per customer."""
    step = F.pmod(F.xxhash64("customer_id", F.lit(seed)), F.lit(10000))
    return step / F.lit(10000.0) * F.lit(upto)


def churn_risk(
    store: OpsStore,
    period: Period,
    filters: Filters = NO_FILTERS,
    noise_seed: int | None = None,
) -> DataFrame:
    """Each customer's lifetime figures and churn score.

    Only the period's end matters: recency is counted back from it, and it is
    negative for a customer who ordered later.
    """
    profile = ("full_name", "city", "state", "tier", "segment", "status")
    scored = _churn(store, period, filters, *profile, noise_seed=noise_seed)
    return scored.select(
        "customer_id",
        *profile,
        "lifetime_value",
        "total_orders",
        "days_since_order",
        "avg_order_value",
        "churn_score",
    )


def _churn(store, period, filters, *columns, noise_seed=None):
    history = {
        "spent": "sum(final_amount)",
        "amounts": "count(final_amount)",
        "order_count": "count(1)",
        "last_order": "max(order_date)",
    }
    days = F.coalesce(
        F.datediff(F.lit(period.end), F.col("last_order")), F.lit(NEVER_ORDERED_DAYS)
    )
    noise = None if noise_seed is None else hash_noise(noise_seed)
    shown = ("status", *columns, *filters.active(*WHO))
    return (
        store.by_customer(lambda part: part.customers_with_orders(shown, history, ["order_date", "final_amount"], SETTLED))
        .where(filters.on(*WHO))
        .withColumns(
            {
                "lifetime_value": F.coalesce(F.col("spent"), F.lit(0)),
                "total_orders": F.coalesce(F.col("order_count"), F.lit(0).cast("bigint")),
                "days_since_order": days,
                "avg_order_value": zero_if_null(ratio(F.col("spent"), F.col("amounts"))),
            }
        )
        .withColumn(
            "churn_score",
            churn_score(
                F.col("days_since_order"), F.col("status"), F.col("total_orders"), noise
            ),
        )
    )


def churn_export(
    store: OpsStore, period: Period, filters: Filters = NO_FILTERS
) -> DataFrame:
    return churn_risk(store, period, filters).select(*CHURN_EXPORT)


def churn_bands(
    store: OpsStore, period: Period, filters: Filters = NO_FILTERS
) -> DataFrame:
    """Customers, mean lifetime value and mean recency of each risk band; an empty
    band has zeros."""
    scored = _churn(store, period, filters)
    score = F.col("churn_score")
    inside = {
        "high": score > 0.7,
        "medium": (score > 0.4) & (score <= 0.7),
        "low": score <= 0.4,
    }
    totals = scored.agg(
        *[
            part
            for band, test in inside.items()
            for part in (
                F.count_if(test).alias(f"n_{band}"),
                F.sum(F.when(test, F.col("lifetime_value"))).alias(f"value_{band}"),
                F.sum(F.when(test, F.col("days_since_order"))).alias(f"days_{band}"),
            )
        ]
    )
    lines = [
        F.struct(
            F.lit(band).alias("band"),
            F.col(f"n_{band}").alias("customers"),
            zero_if_null(ratio(F.col(f"value_{band}"), F.col(f"n_{band}"))).alias(
                "avg_lifetime_value"
            ),
            zero_if_null(ratio(F.col(f"days_{band}"), F.col(f"n_{band}"))).alias(
                "avg_days_since_order"
            ),
        )
        for band in CHURN_BANDS
    ]
    return totals.select(F.inline(F.array(*lines)))


# Cohorts.

def cohort_retention_long(
    store: OpsStore, filters: Filters = NO_FILTERS, max_period: int | None = None
) -> DataFrame:
    """Buyers of each joining cohort, by months since joining, against all its buyers.

    Orders placed before joining give negative periods. Rows of later periods than
    ``max_period`` are left out; cohort size counts customers with any settled order,
    whatever its period.
    """
    joined = calendar.month_start(F.col("join_date"))

    def active_months(part: OpsStore) -> DataFrame:
        # One row per customer and month before the join; a customer's earliest month
        # then stands for the customer in the cohort size.
        months = (
            _settled(part, "order_date")
            .groupBy("customer_id", calendar.month_start(F.col("order_date")).alias("order_month"))
            .agg(F.lit(1).alias("active"))
        )
        earliest = F.min("order_month").over(Window.partitionBy("customer_id"))
        first = (F.col("order_month") == earliest).cast("int")
        return months.withColumn("is_first", first).join(_customers(part, filters, "join_date"), "customer_id")

    activity = (
        store.by_customer(active_months)
        .groupBy(
            joined.alias("cohort_month"),
            calendar.months_between_months(F.col("order_month"), joined).alias("period"),
        )
        .agg(rows().alias("customers"), F.sum("is_first").alias("firsts"))
    )
    size = F.sum("firsts").over(Window.partitionBy("cohort_month"))
    sized = activity.withColumn("cohort_size", size)
    if max_period is not None:
        sized = sized.where(F.col("period") <= max_period)
    return (
        sized.select(
            "cohort_month",
            "period",
            "customers",
            "cohort_size",
            percent_of(F.col("customers"), F.col("cohort_size")).alias("retention"),
        )
        .orderBy("cohort_month", "period")
    )


def percent_of(part: Column, whole: Column) -> Column:
    return ratio(part, whole) * F.lit(100.0)


def cohort_retention_matrix(
    store: OpsStore,
    filters: Filters = NO_FILTERS,
    periods: Sequence[int] | None = None,
    digits: int = 1,
) -> DataFrame:
    """Retention with one row per buying cohort and one column per period, holes as 0.

    Without ``periods`` there is a column for each period from the first to the last
    that any join month and order month can give. Periods outside the ones asked for
    have no column, but their cohorts keep their row.
    """
    if periods is None:
        periods = possible_periods(store, filters)
    long = cohort_retention_long(store, filters)
    wide = (
        long.groupBy("cohort_month")
        .pivot("period", list(periods))
        .agg(F.max(round_half_even(F.col("retention"), digits)))
        .na.fill(0.0)
        .orderBy("cohort_month")
    )
    return wide.withColumn("cohort_month", F.date_format("cohort_month", "MMM yyyy")).toDF(
        "cohort", *[f"M+{k}" for k in periods]
    )


def possible_periods(store: OpsStore, filters: Filters = NO_FILTERS) -> range:
    """From the first order month and the last join month to the reverse. Two one-row
    jobs over a date column each."""
    ordered = _settled(store, "order_date").agg(F.min("order_date"), F.max("order_date")).first()
    joined = _customers(store, filters, "join_date").agg(F.min("join_date"), F.max("join_date")).first()
    if None in (*ordered, *joined):
        return range(0)
    month = lambda day: 12 * day.year + day.month
    return range(month(ordered[0]) - month(joined[1]), month(ordered[1]) - month(joined[0]) + 1)


# Top customers.

PROFILE = ("full_name", "city", "state", "tier", "segment", "age_group")


def _spend(store: OpsStore, period: Period, filters: Filters) -> DataFrame:
    """Orders, spend and mean order value of the chosen customers who bought."""

    def spent(part: OpsStore) -> DataFrame:
        spend = (
            _settled(part, "order_id", "final_amount", period=period)
            .groupBy("customer_id")
            .agg(
                F.countDistinct("order_id").alias("orders"),
                F.sum("final_amount").alias("lifetime_value"),
                exact_mean("final_amount").alias("aov"),
            )
        )
        return spend.join(_customers(part, filters).select("customer_id"), "customer_id")

    return store.by_customer(spent)


def _ratings(store: OpsStore, period: Period, keys: DataFrame | None = None) -> DataFrame:
    tickets = store.tickets("customer_id", "csat_score", period=period)
    if keys is not None:
        tickets = tickets.join(keys, "customer_id", "left_semi")
    return (
        tickets.groupBy("customer_id")
        .agg(rows().alias("ticket_count"), exact_mean("csat_score").alias("csat"))
    )


def _with_profile(store: OpsStore, best: DataFrame) -> DataFrame:
    """The few ranked customers with their profile, in rank order."""
    profiles = store.customers_of(best.select("customer_id"), *PROFILE)
    return (
        best.join(profiles, "customer_id")
        .orderBy(F.desc("lifetime_value"), "customer_id")
        .select(
            *PROFILE,
            "orders",
            "lifetime_value",
            "aov",
            zero_if_null(F.col("csat")).alias("csat_avg"),
        )
    )


def top_customers(
    store: OpsStore, period: Period, filters: Filters = NO_FILTERS, limit: int = 20
) -> DataFrame:
    """The customers with the largest settled spend in the period, with their mean
    ticket rating (0 without tickets). Only keys and sums are ranked; the profile is
    looked up for the rows that remain."""
    best = top(_spend(store, period, filters), limit, "lifetime_value", "customer_id")
    rated = best.join(_ratings(store, period, best.select("customer_id")), "customer_id", "left")
    return _with_profile(store, rated)


def top_customers_fanout(
    store: OpsStore, period: Period, filters: Filters = NO_FILTERS, limit: int = 20
) -> DataFrame:
    """The ranking that results when every order is repeated per ticket of its
    customer: the spend is multiplied by the ticket count, while means and distinct
    counts stay. It is computed from the per-customer figures, without the repeats.
    """
    rated = _spend(store, period, filters).join(_ratings(store, period), "customer_id", "left")
    repeated = rated.withColumn(
        "lifetime_value",
        F.col("lifetime_value") * F.expr("CAST(coalesce(ticket_count, 1) AS DECIMAL(12,0))"),
    )
    return _with_profile(store, top(repeated, limit, "lifetime_value", "customer_id"))
