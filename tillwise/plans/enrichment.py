"""Derivations that fill the operations tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions import calendar, rules, text
from tillwise.functions.measures import clip
from tillwise.operators.selection import Period, settled
from tillwise.sources.schemas import MONEY
from tillwise.sources.star import delivered_spend
from tillwise.sources.store import OpsStore


def with_zone(
    df: DataFrame,
    zones: DataFrame | Mapping[str, str] = rules.ZONE_OF_STATE,
    default: str = rules.DEFAULT_ZONE,
) -> DataFrame:
    """Add the zone of each row's state, from a table (state, zone) or a mapping."""
    if isinstance(zones, DataFrame):
        known = zones.select("state", F.col("zone").alias("known_zone"))
        found = F.coalesce(F.col("known_zone"), F.lit(default))
        return df.join(known, "state", "left").withColumn("zone", found).drop("known_zone")
    return df.withColumn("zone", rules.lookup(F.col("state"), zones, default))


def with_prices(
    df: DataFrame,
    gst_percent: Mapping[str, int] = rules.GST_PERCENT_OF_CATEGORY,
    price_range: Mapping[str, tuple] = rules.PRICE_RANGE_OF_CATEGORY,
    multiplier: Mapping[str, str] = rules.MULTIPLIER_OF_SEGMENT,
) -> DataFrame:
    """From a base price (amount), category and segment: the segment price, its GST
    and the final amount after discount, each rounded to 2 decimals."""
    factor = rules.lookup(F.col("segment"), multiplier, "1.0").cast("decimal(3,1)")
    rate = rules.lookup(F.col("category"), gst_percent, 0).cast("decimal(3,0)")
    low = rules.lookup(F.col("category"), {c: r[0] for c, r in price_range.items()}, 0)
    high = rules.lookup(F.col("category"), {c: r[1] for c, r in price_range.items()}, 0)
    return (
        df.withColumn("in_price_range", F.col("amount").between(low, high).cast("int"))
        .withColumn("price", F.round(F.col("amount") * factor, 2).cast(MONEY))
        .withColumn("gst", F.round(F.col("price") * rate / 100, 2).cast(MONEY))
        .withColumn("final", (F.col("price") + F.col("gst") - F.col("discount")).cast(MONEY))
    )


def with_delivery(df: DataFrame) -> DataFrame:
    """Delivery date, returned flag and the order month's festival weight."""
    return df.withColumns(
        {
            "delivery_date": F.date_add("order_date", F.col("delivery_days")),
            "is_returned": F.when(F.col("order_status") == "Returned", 1).otherwise(0),
            "festival_weight": rules.lookup(
                F.month("order_date"), rules.FESTIVAL_WEIGHT_OF_MONTH, 1.0
            ),
        }
    )


def order_enrichment(
    store: OpsStore,
    zones: DataFrame | Mapping[str, str] = rules.ZONE_OF_STATE,
    **price_tables,
) -> DataFrame:
    """Every order with all its derived columns."""
    orders = store.orders(
        "order_id",
        "customer_id",
        "order_date",
        "state",
        "category",
        "amount",
        "discount",
        "order_status",
        "delivery_days",
    )
    segments = store.customers("customer_id", "segment")
    enriched = with_zone(orders.join(segments, "customer_id", "left"), zones)
    enriched = with_delivery(with_prices(enriched, **price_tables))
    return enriched.withColumn("order_code", text.code("ORD", 6, F.col("order_id")))


def festival_normalised(store: OpsStore, period: Period) -> DataFrame:
    """Monthly settled revenue, raw and divided by the month's festival weight."""
    month = calendar.month_start(F.col("order_date"))
    weight = rules.lookup(F.month("month"), rules.FESTIVAL_WEIGHT_OF_MONTH, 1.0)
    return (
        store.orders("order_date", "final_amount", "order_status", period=period)
        .where(settled())
        .groupBy(month.alias("month"))
        .agg(F.sum("final_amount").alias("revenue"))
        .withColumn("weight", weight)
        .withColumn("normalised_revenue", F.col("revenue").cast("double") / F.col("weight"))
        .orderBy("month")
    )


def tier_assignment(
    store: OpsStore, thresholds: Mapping[str, float] | None = None
) -> DataFrame:
    """Each customer's delivered spend, 0 for none, and the tier it earns, by the store's
    thresholds if none are given."""
    thresholds = store.tier_thresholds if thresholds is None else thresholds
    return (
        store.customers("customer_id")
        .join(delivered_spend(store), "customer_id", "left")
        .select("customer_id", F.coalesce(F.col("spent"), F.lit(0)).alias("spent"))
        .withColumn("tier", rules.tier_of(F.col("spent"), thresholds))
    )


def updated(base: DataFrame, updates: DataFrame, key: str, column: str) -> DataFrame:
    """``base`` with ``column`` replaced where ``updates`` has the key. Keys that only
    ``updates`` has are ignored, as in an UPDATE."""
    new = updates.select(key, F.col(column).alias("new_value"))
    value = F.coalesce(F.col("new_value"), F.col(column)).alias(column)
    others = [F.col(c) for c in base.columns]
    return base.join(new, key, "left").select(
        *[value if name == column else col for name, col in zip(base.columns, others)]
    )


def customer_contacts(store: OpsStore, domain: str = "example.com") -> DataFrame:
    """Customer codes and contact addresses made from the name."""
    return store.customers("customer_id", "full_name").select(
        "customer_id",
        text.code("CUST", 5, F.col("customer_id")).alias("customer_code"),
        F.concat(text.contact_handle(F.col("full_name")), F.lit(f"@{domain}")).alias("email"),
    )


def kept_rating(raw: Column) -> Column:
    """A rating rounded to one decimal and kept between 1 and 5."""
    return clip(F.round(raw, 1).cast("double"), 1.0, 5.0)


def ticket_enrichment(store: OpsStore) -> DataFrame:
    """Ticket codes, resolution dates, and a rating of 0.05 points per hour."""
    hours = F.col("resolution_hours")
    return store.tickets("ticket_id", "created_date", "resolution_hours").select(
        "ticket_id",
        text.code("TKT", 6, F.col("ticket_id")).alias("ticket_code"),
        calendar.add_hours(F.col("created_date"), hours).alias("resolved_date"),
        kept_rating(hours * F.lit("0.05").cast("decimal(3,2)")).alias("csat_score"),
    )
