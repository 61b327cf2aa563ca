"""Fixed business values and the rules that use them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values -----------------------------------------------------------------

ZONE_OF_STATE = {
    "Maharashtra": "West",
    "Gujarat": "West",
    "Rajasthan": "West",
    "Karnataka": "South",
    "Tamil Nadu": "South",
    "Telangana": "South",
    "Andhra Pradesh": "South",
    "Kerala": "South",
    "Delhi": "North",
    "Uttar Pradesh": "North",
    "Punjab": "North",
    "Haryana": "North",
    "Madhya Pradesh": "North",
    "West Bengal": "East",
    "Bihar": "East",
}
DEFAULT_ZONE = "North"

GST_PERCENT_OF_CATEGORY = {
    "Electronics": 18,
    "Fashion": 12,
    "Home & Kitchen": 18,
    "Grocery & FMCG": 5,
    "Beauty & Personal": 18,
    "Pharma & Health": 5,
    "Sports & Fitness": 12,
    "Books & Education": 0,
}

PRICE_RANGE_OF_CATEGORY = {
    "Electronics": (499, 55000),
    "Fashion": (199, 4999),
    "Home & Kitchen": (299, 22000),
    "Grocery & FMCG": (49, 799),
    "Beauty & Personal": (99, 1999),
    "Pharma & Health": (29, 1899),
    "Sports & Fitness": (299, 4999),
    "Books & Education": (79, 899),
}

MULTIPLIER_OF_SEGMENT = {"Corporate": "1.5", "Wholesale": "1.3", "SME": "1.1", "Retail": "1.0"}

TIER_THRESHOLDS = {"Platinum": 50000, "Gold": 20000, "Silver": 8000, "Bronze": 0}
TIERS = ["Platinum", "Gold", "Silver", "Bronze"]

FESTIVAL_WEIGHT_OF_MONTH = {10: 2.8, 11: 2.2, 1: 1.8, 8: 1.5, 3: 1.3, 7: 1.2}
FESTIVAL_MONTHS = ["Oct", "Nov", "Jan", "Aug"]

PRIORITIES = ["Low", "Medium", "High", "Critical"]
SEVERITIES = ["critical", "warning", "positive", "neutral"]

RETURN_BENCHMARK_PERCENT = 8.0

# --- Rules ------------------------------------------------------------------------


def lookup(key: Column, table: Mapping, default) -> Column:
    """Value of a small in-memory table, ``default`` for an unknown or null key."""
    pairs = [F.lit(item) for pair in table.items() for item in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def rank_in(key: Column, domain: Sequence[str]) -> Column:
    """Position in a fixed domain order; values outside it come last."""
    position = F.array_position(F.array(*[F.lit(v) for v in domain]), key)
    return F.when(position > 0, position.cast("int")).otherwise(F.lit(len(domain) + 1))


def tier_of(spent: Column, thresholds: Mapping[str, float]) -> Column:
    """First tier whose threshold the spend reaches, from the highest down."""
    ladder = sorted(thresholds.items(), key=lambda step: -step[1])
    lowest = ladder[-1][0]
    tier = F.lit(lowest)
    for name, threshold in reversed(ladder[:-1]):
        tier = F.when(spent >= F.lit(threshold), F.lit(name)).otherwise(tier)
    return tier


def first_containing(text: Column, table: Mapping[str, str], default: Column) -> Column:
    """Value of the first table key found in ``text``, ignoring case."""
    found = default
    for key, value in reversed(list(table.items())):
        found = F.when(F.contains(F.lower(text), F.lit(key.lower())), F.lit(value)).otherwise(found)
    return found
