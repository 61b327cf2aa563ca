"""Order roll-ups: revenue over time, geography, categories, payments, products.

Which orders count differs by query and is part of each query's meaning:
settled (no cancelled, no processing), placed (no processing) or all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions import calendar, rules
from tillwise.functions.measures import exact_mean, percent, ratio, rows, share_of_rows
from tillwise.operators.selection import (
    NO_FILTERS,
    PLACED,
    SETTLED,
    Filters,
    Period,
    is_status,
    placed,
    settled,
)
from tillwise.operators.shaping import (
    complete_domain,
    fill_months,
    fill_weeks,
    in_domain_order,
    last_of,
    long_form,
    share_of_total,
    top,
    whole,
)
from tillwise.plans.weeks import newest_days
from tillwise.sources.passes import Mix, one_pass
from tillwise.sources.store import OpsStore

SERIES = ["revenue", "discount", "orders", "gst"]
PLACE_AND_KIND = ("state", "zone", "category")

# The totals that several datasets of a report come from.
BY_DAY = Mix("order_date", "date", tuple(SERIES), PLACE_AND_KIND, SETTLED)
BY_STATE = Mix("state", "state", ("revenue", "orders", "days", "deliveries", "returned"), ("category",), PLACED, buyers=True)
BY_CATEGORY = Mix(
    "category", "category", ("revenue", "orders", "amounts", "discount", "days", "deliveries"), ("state", "zone"), SETTLED
)
BY_METHOD = Mix("payment_method", "payment_method", ("orders", "revenue", "amounts", "cancelled"), ("state",))
REPORT_MIXES = (BY_DAY, BY_STATE, BY_CATEGORY, BY_METHOD)


def _orders(
    store: OpsStore,
    columns: Sequence[str],
    period: Period | None,
    filters: Filters,
    chosen: Sequence[str],
    keep: Column | None = None,
) -> DataFrame:
    """The orders a roll-up reads; ``chosen`` are the filters it honours."""
    status = ["order_status"] if keep is not None else []
    orders = store.orders(*columns, *status, *filters.active(*chosen), period=period)
    orders = orders.where(filters.on(*chosen))
    return orders if keep is None else orders.where(keep)


def _revenue() -> Column:
    return F.sum("final_amount").alias("revenue")


def _count() -> Column:
    return rows().alias("orders")


def _aov() -> Column:
    return exact_mean("final_amount").alias("aov")


def _mean_order() -> Column:
    """The mean order value of totals."""
    return ratio(F.col("revenue"), F.col("amounts")).alias("aov")


def _return_rate() -> Column:
    return share_of_rows(is_status("Returned")).alias("return_rate")


# Time.


def revenue_daily(store: OpsStore, period: Period, filters: Filters = NO_FILTERS) -> DataFrame:
    """Settled revenue, discount, order count and GST by day."""
    daily = BY_DAY.of(store, period, filters)
    return daily.select("date", *SERIES).orderBy("date")


def _bucketed(daily: DataFrame, start: Column) -> DataFrame:
    return daily.groupBy(start.alias("start")).agg(*[F.sum(m).alias(m) for m in SERIES])


def revenue_weekly_filled(
    store: OpsStore, period: Period, filters: Filters = NO_FILTERS
) -> DataFrame:
    """The daily series by week, labelled with the closing Sunday; empty weeks are 0."""
    weeks = _bucketed(
        revenue_daily(store, period, filters), calendar.week_start(F.col("date"))
    )
    return fill_weeks(weeks, "start", SERIES).select(
        F.date_add("start", 6).alias("date"), *SERIES
    )


def revenue_monthly_filled(
    store: OpsStore, period: Period, filters: Filters = NO_FILTERS
) -> DataFrame:
    """The daily series by month, labelled with the month's end; empty months are 0."""
    months = _bucketed(
        revenue_daily(store, period, filters), calendar.month_start(F.col("date"))
    )
    return fill_months(months, "start", SERIES).select(
        F.last_day("start").alias("date"), *SERIES
    )


def temporal_daily(store: OpsStore, period: Period) -> DataFrame:
    """Settled revenue and orders by day, with month and weekday attributes."""
    orders = _orders(store, ["order_date", "final_amount"], period, NO_FILTERS, (), settled())
    day = F.col("order_date")
    return (
        orders.groupBy("order_date")
        .agg(_revenue(), _count())
        .select(
            "order_date",
            F.month(day).alias("month"),
            calendar.weekday_number(day).alias("dow"),
            "revenue",
            "orders",
            day.alias("date"),
            calendar.weekday_name(day).alias("dow_name"),
            calendar.month_name(day).alias("month_name"),
        )
        .orderBy("order_date")
    )


def dow_profile(store: OpsStore, period: Period) -> DataFrame:
    """Mean of the daily totals by weekday, Monday first, null for absent weekdays."""
    days = temporal_daily(store, period).select("dow_name", "revenue", "orders")
    profile = (
        complete_domain(days, "dow_name", calendar.WEEKDAYS)
        .groupBy("dow_name")
        .agg(exact_mean("revenue").alias("revenue"), exact_mean("orders").alias("orders"))
    )
    return in_domain_order(profile, "dow_name", calendar.WEEKDAYS)


def month_profile(store: OpsStore, period: Period) -> DataFrame:
    """Mean daily revenue by month of the year; months without orders are dropped."""
    profile = (
        temporal_daily(store, period)
        .groupBy("month_name")
        .agg(exact_mean("revenue").alias("revenue"))
        .na.drop()
        .withColumn("festival", F.col("month_name").isin(rules.FESTIVAL_MONTHS).cast("int"))
    )
    return in_domain_order(profile, "month_name", calendar.MONTHS)


def yoy_monthly(store: OpsStore, filters: Filters = NO_FILTERS) -> DataFrame:
    """Settled revenue, orders and mean order value by year and month, all years."""
    by_month = store.totals(
        "orders",
        {"first": "trunc(order_date, 'month')"},
        ("revenue", "orders", "amounts"),
        filters,
        ("state", "category"),
        SETTLED,
    )
    return by_month.select(
        F.year("first").alias("year"),
        F.month("first").alias("month_num"),
        calendar.month_name(F.col("first")).alias("month"),
        "revenue",
        "orders",
        _mean_order(),
    ).orderBy("year", "month_num")


def yoy_wide(
    store: OpsStore, years: Sequence[int] | None = None, filters: Filters = NO_FILTERS
) -> DataFrame:
    """Monthly revenue with one column per year; without ``years``, per year from the
    first order to the last."""
    if years is None:
        ends = store.orders("order_date").agg(
            F.year(F.min("order_date")), F.year(F.max("order_date"))
        ).first()
        years = range(ends[0], ends[1] + 1) if ends[0] is not None else ()
    return (
        yoy_monthly(store, filters)
        .groupBy("month_num", "month")
        .pivot("year", list(years))
        .agg(F.sum("revenue"))
        .orderBy("month_num")
    )


def weekly_ops(
    store: OpsStore,
    weeks: int = 8,
    filters: Filters = NO_FILTERS,
    complete_weeks_only: bool = False,
) -> DataFrame:
    """The newest weeks, oldest first, over all orders whatever their status.

    Which days these weeks have is found first, so only they are read in full. The newest
    week, and one that New Year cuts off, may be incomplete.
    """
    wanted = weeks + 2 if complete_weeks_only else weeks
    period = newest_days(store, "orders", wanted, filters, PLACE_AND_KIND)
    # Days first: the label is then computed once per day, not once per order.
    measures = ("revenue", "orders", "days", "deliveries", "returned", "cancelled")
    days = store.totals("orders", {"order_date": "order_date"}, measures, filters, PLACE_AND_KIND, period=period)
    total = F.sum("orders")
    by_week = days.groupBy(calendar.week_label(F.col("order_date")).alias("week")).agg(
        _sum("revenue"),
        total.alias("orders"),
        F.try_divide(F.sum("days").cast("double"), F.sum("deliveries")).alias("avg_delivery"),
        F.try_divide(F.sum("returned") * F.lit(100.0), total).alias("return_rate"),
        F.try_divide(F.sum("cancelled") * F.lit(100.0), total).alias("cancel_rate"),
        F.max("order_date").alias("last_day"),
    )
    if complete_weeks_only:
        dated = by_week.withColumn("newest_day", F.max("last_day").over(whole()))
        by_week = dated.where(calendar.week_end(F.col("last_day")) <= F.col("newest_day"))
    return last_of(by_week.drop("last_day", "newest_day"), weeks, "week")


def _sum(name: str) -> Column:
    return F.sum(name).alias(name)


def weekly_metrics_long(store: OpsStore, weeks: int = 8) -> DataFrame:
    """Four weekly measures, one below the other."""
    return long_form(
        weekly_ops(store, weeks), ["week"], ["revenue", "orders", "return_rate", "cancel_rate"]
    )


# Geography.


def state_performance(
    store: OpsStore, period: Period, filters: Filters = NO_FILTERS
) -> DataFrame:
    """Placed orders by state, largest revenue first."""
    return _by_place(store, "state", period, filters).orderBy(F.desc("revenue"), "state")


def zone_comparison(
    store: OpsStore, period: Period, filters: Filters = NO_FILTERS
) -> DataFrame:
    """Placed orders by zone."""
    return _by_place(store, "zone", period, filters)


def _by_place(store, place, period, filters):
    """Orders are summed by customer first. Where a customer has one place, only those
    sums meet the places; and distinct customers are rows by then. A store that has the
    totals and the sets of customers by day puts these together instead."""
    buyers = store.placed_buyers(place, filters, ("category",), period)
    if buyers is not None:
        totals = store.totals("orders", {place: place}, BY_STATE.measures, filters, ("category",), PLACED, period)
        # a union, so that orders without a place meet
        sums = totals.unionByName(buyers, allowMissingColumns=True)
        customers = F.coalesce(F.sum("customers"), F.lit(0).cast("bigint"))
    else:
        of_customer = store.placed_by_customer
        keys = ["customer_id"] if of_customer else [place, "customer_id"]
        orders = _orders(
            store, [*keys, "final_amount", "delivery_days"], period, filters, ("category",), placed()
        )
        sums = orders.groupBy(*keys).agg(
            _revenue(),
            _count(),
            F.sum("delivery_days").alias("days"),
            F.count("delivery_days").alias("deliveries"),
            F.count_if(is_status("Returned")).alias("returned"),
        )
        if of_customer:
            sums = of_customer(sums, place)
        customers = F.count("customer_id")
    total = F.sum("orders")
    return sums.groupBy(place).agg(
        _sum("revenue"),
        total.alias("orders"),
        ratio(F.sum("days"), F.sum("deliveries")).alias("avg_delivery"),
        customers.alias("customers"),
        percent(F.sum("returned"), total).alias("return_rate"),
    )


def zone_metrics_long(
    store: OpsStore, period: Period, filters: Filters = NO_FILTERS
) -> DataFrame:
    """Three zone measures, one below the other."""
    return long_form(
        zone_comparison(store, period, filters), ["zone"], ["revenue", "avg_delivery", "return_rate"]
    )


# Categories, payments, products.


def category_mix(store: OpsStore, period: Period, filters: Filters = NO_FILTERS) -> DataFrame:
    """Settled orders by category, largest revenue first."""
    return BY_CATEGORY.of(store, period, filters).select(
        "category",
        "revenue",
        "orders",
        _mean_order(),
        "discount",
        ratio(F.col("days"), F.col("deliveries")).alias("avg_delivery"),
    ).orderBy(F.desc("revenue"), "category")


def payment_analysis(
    store: OpsStore, period: Period, filters: Filters = NO_FILTERS
) -> DataFrame:
    """All orders by payment method, whatever their status, largest revenue first."""
    return BY_METHOD.of(store, period, filters).select(
        "payment_method",
        "orders",
        "revenue",
        _mean_order(),
        percent(F.col("cancelled"), F.col("orders")).alias("cancel_rate"),
    ).orderBy(F.desc("revenue"), "payment_method")


def payment_share(
    store: OpsStore, period: Period, filters: Filters = NO_FILTERS
) -> DataFrame:
    """Each payment method's percentage of the orders."""
    return payment_analysis(store, period, filters).select(
        "payment_method", "orders", share_of_total("orders").alias("orders_share")
    )


def product_top(
    store: OpsStore, period: Period, filters: Filters = NO_FILTERS, limit: int = 30
) -> DataFrame:
    """The products with the largest placed revenue."""
    orders = _orders(
        store,
        ["product_name", "category", "final_amount", "discount"],
        period,
        filters,
        ("state", "category"),
        placed(),
    )
    products = orders.groupBy("product_name", "category").agg(
        _count(), _revenue(), _aov(), exact_mean("discount").alias("avg_discount"), _return_rate()
    )
    return top(products, limit, "revenue", "product_name", "category")


def product_return_watchlist(
    store: OpsStore,
    period: Period,
    filters: Filters = NO_FILTERS,
    limit: int = 15,
    among: int = 30,
) -> DataFrame:
    """The highest return rates among the products with the largest revenue."""
    returned = product_top(store, period, filters, among).where(F.col("return_rate") > 0)
    return top(returned, limit, "return_rate", "product_name", "category")


def mixes(store: OpsStore, period: Period, filters: Filters = NO_FILTERS) -> DataFrame:
    """Orders, revenue and mean delivery days by day, state, category and payment method, one
    below the other, each over the orders that its own query counts: one scan of them."""
    found = one_pass(store, REPORT_MIXES, period, filters)
    label = F.coalesce(*[F.col(m.by).cast("string") for m in REPORT_MIXES])
    return found.select(
        "mix",
        label.alias("label"),
        "orders",
        "revenue",
        F.when(F.col("mix") == "state", F.col("customers")).alias("customers"),
        ratio(F.col("days"), F.col("deliveries")).alias("avg_delivery"),
    ).orderBy("mix", "label")


# Exports.

ORDER_EXPORT = [
    "order_id",
    "customer_id",
    "order_date",
    "category",
    "product_name",
    "final_amount",
    "payment_method",
    "order_status",
    "state",
    "zone",
    "delivery_days",
]


def orders_export(
    store: OpsStore, period: Period, filters: Filters = NO_FILTERS
) -> DataFrame:
    """The order rows of a period, newest first. The further sort keys only spread a
    busy day over several tasks."""
    chosen = ("state", "zone", "category")
    orders = store.orders(*ORDER_EXPORT, period=period).where(filters.on(*chosen))
    return orders.orderBy(F.desc("order_date"), "order_id", "delivery_days", "final_amount")
