"""Trend alerts: the newest week against the mean of the weeks before it.

All inputs are weekly aggregates of a few rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions import text
from tillwise.functions.measures import change_percent
from tillwise.functions.rules import SEVERITIES, first_containing, rank_in
from tillwise.operators.shaping import last_of, whole

# --- Fixed values -----------------------------------------------------------------

CRITICAL_PERCENT = 15.0
MIN_WEEKS = 4


@dataclass(frozen=True)
class Rule:
    metric: str
    column: str
    unit: str
    higher_better: bool
    threshold: float


OPS_RULES = [
    Rule("Revenue", "revenue", "₹", True, 8.0),
    Rule("Orders", "orders", "", True, 8.0),
    Rule("Return Rate", "return_rate", "%", False, 5.0),
    Rule("Cancellation Rate", "cancel_rate", "%", False, 5.0),
    Rule("Delivery Days", "avg_delivery", "d", False, 5.0),
]
CSAT_RULES = [
    Rule("CSAT Score", "avg_csat", "", True, 3.0),
    Rule("Escalation Rate", "escalation_rate", "%", False, 5.0),
]

RECOMMENDATIONS = {
    "Revenue": "Investigate order pipeline for the current week. Check if promotional campaigns are active and consider flash sale or targeted discount to boost GMV.",
    "Orders": "Review acquisition channels. Check if there are any technical issues with checkout flow or if competitor activity is causing volume drop.",
    "Return Rate": "Audit product listings and QC for top-returned categories. Consider tightening return windows for Electronics and Fashion. Review courier partner performance.",
    "Cancellation Rate": "Identify if cancellations are pre-delivery or post-payment. Review payment gateway uptime and implement cancellation deterrence at checkout.",
    "Delivery Days": "Escalate to logistics partners for the affected states. Review last-mile carrier SLAs and consider activating backup delivery partners.",
    "CSAT Score": "Pull CSAT verbatims for the past week. Schedule urgent CX review with Tier-2 support team. Check for any product-specific complaint spikes.",
    "Escalation Rate": "Review Tier-1 agent training for the categories driving escalations. Check if new product launches are causing knowledge gaps.",
}
NOTHING_TO_DO = "Continue monitoring. No critical actions required this week."
LOOK_INTO = ("Review ", " trend and investigate root cause with the respective team.")
RISEN, FALLEN = " has increased by ", " has decreased by "
CURRENT, AVERAGE, TREND = " (current: ", ", 4-week avg: ", "). Trend is "
BETTER, WORSE, STOP = "improving", "concerning", "."
DAYS = " days"

# --- Detection --------------------------------------------------------------------


def trend_alerts(weekly_ops: DataFrame, weekly_csat: DataFrame) -> DataFrame:
    """One row per metric whose change reaches its threshold, most severe first.

    The baseline of the order metrics skips the week before the newest; that of the
    ticket metrics does not. Fewer than four weeks of orders give no alerts at all,
    fewer than four weeks of tickets none on tickets.
    """
    ops = _newest_week(weekly_ops, OPS_RULES, 5, 2, 0)
    csat = _newest_week(weekly_csat, CSAT_RULES, 4, 1, len(OPS_RULES))
    compared = (
        ops.unionByName(csat)
        .withColumn("has_ops", F.min("position").over(whole()) < len(OPS_RULES))
        .where(F.col("has_ops"))
        .withColumn("pct_change", change_percent(F.col("current"), F.col("baseline")))
        .where(F.abs("pct_change") >= F.col("threshold"))
    )
    return (
        compared.select(
            "metric",
            "current",
            "baseline",
            "pct_change",
            F.when(F.col("pct_change") > 0, "up").otherwise("down").alias("direction"),
            severity(F.col("pct_change"), F.col("higher_better"), F.col("threshold")).alias(
                "severity"
            ),
            F.upper(severity(F.col("pct_change"), F.col("higher_better"), F.col("threshold"))).alias(
                "severity_label"
            ),
            "unit",
            _message().alias("message"),
            "position",
        )
        .orderBy(rank_in(F.col("severity"), SEVERITIES), "position")
    )


def _newest_week(weekly, rules, first, last, offset):
    """The newest week's value and baseline of each rule, one row per rule."""
    frame = f"ORDER BY week ROWS BETWEEN {first} PRECEDING AND {last} PRECEDING"
    columns = [r.column for r in rules]
    measured = weekly.selectExpr(
        "max(week) OVER () = week AS newest",
        "count(1) OVER () AS weeks",
        *[f"CAST({c} AS DOUBLE) AS current_{c}" for c in columns],
        *[f"avg(CAST({c} AS DOUBLE)) OVER ({frame}) AS baseline_{c}" for c in columns],
    )
    lines = [
        f"{position}, {text.quoted(r.metric)}, {text.quoted(r.unit)}, {r.higher_better}, {r.threshold}D, "
        f"current_{r.column}, baseline_{r.column}"
        for position, r in enumerate(rules, offset)
    ]
    return measured.where(f"newest AND weeks >= {MIN_WEEKS}").selectExpr(
        f"stack({len(lines)}, {', '.join(lines)}) AS "
        "(position, metric, unit, higher_better, threshold, current, baseline)"
    )


def severity(pct: Column, higher_better: Column, threshold: Column) -> Column:
    harm = F.when(higher_better, -pct).otherwise(pct)
    return (
        F.when(harm > CRITICAL_PERCENT, "critical")
        .when(harm > threshold, "warning")
        .when(harm < -threshold, "positive")
        .otherwise("neutral")
    )


def _message() -> Column:
    pct = F.col("pct_change")
    better = F.when(F.col("higher_better"), pct > 0).otherwise(pct < 0)
    return F.concat(
        F.col("metric"),
        F.when(pct > 0, F.lit(RISEN)).otherwise(F.lit(FALLEN)),
        text.suffixed(F.abs(pct), 1, "%"),
        F.lit(CURRENT),
        _in_unit(F.col("current")),
        F.lit(AVERAGE),
        _in_unit(F.col("baseline")),
        F.lit(TREND),
        F.when(better, F.lit(BETTER)).otherwise(F.lit(WORSE)),
        F.lit(STOP),
    )


def _in_unit(value: Column) -> Column:
    unit = F.col("unit")
    return (
        F.when(unit == "₹", text.money_text(value))
        .when(unit == "%", text.suffixed(value, 1, "%"))
        .when(unit == "d", text.suffixed(value, 1, DAYS))
        .otherwise(text.grouped(value, 1))
    )


# --- What follows from the alerts -------------------------------------------------


def alert_recommendations(alerts: DataFrame) -> DataFrame:
    """An action for each critical or warning alert; one default line if there is none."""
    default = F.concat(F.lit(LOOK_INTO[0]), F.col("metric"), F.lit(LOOK_INTO[1]))
    actions = alerts.where(F.col("severity").isin("critical", "warning")).select(
        rank_in(F.col("severity"), SEVERITIES).alias("severity_rank"),
        "position",
        "severity",
        "metric",
        first_containing(F.col("metric"), RECOMMENDATIONS, default).alias("recommendation"),
    )
    fallback = alerts.sparkSession.range(1).select(
        F.lit(len(SEVERITIES) + 1).alias("severity_rank"),
        F.lit(NOTHING_TO_DO).alias("recommendation"),
    )
    merged = actions.unionByName(fallback, allowMissingColumns=True)
    needed = F.col("metric").isNotNull() | (F.count("metric").over(whole()) == 0)
    return (
        merged.withColumn("needed", needed)
        .where("needed")
        .orderBy("severity_rank", "position")
        .select("severity", "metric", "recommendation")
    )


def alert_status(alerts: DataFrame) -> DataFrame:
    """Alert counts and the banner they lead to."""
    counts = alerts.agg(
        F.count(F.lit(1)).alias("alerts"),
        F.count_if(F.col("severity") == "critical").alias("critical"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
    )
    banner = (
        F.when(F.col("critical") > 0, F.concat(F.lit("CRITICAL: "), F.col("critical")))
        .when(F.col("warnings") > 0, F.concat(F.lit("WARNINGS: "), F.col("warnings")))
        .otherwise(F.lit("All Clear"))
    )
    return counts.withColumn("banner", banner)


def revenue_sparkline(weekly_ops: DataFrame, weeks: int = 6) -> DataFrame:
    """Bar heights, 2 to 24, of the newest weeks; none for a single week."""
    recent = last_of(weekly_ops.select("week", F.col("revenue").cast("double")), weeks, "week")
    largest = F.max("revenue").over(whole())
    height = F.when(
        largest > 0, F.floor(F.try_divide(F.col("revenue"), largest) * F.lit(24.0))
    ).otherwise(F.lit(4))
    return (
        recent.select(
            "week",
            "revenue",
            F.greatest(F.lit(2), height.cast("int")).alias("height"),
            F.count(F.lit(1)).over(whole()).alias("bars"),
        )
        .where(F.col("bars") > 1)
        .drop("bars")
        .orderBy("week")
    )
