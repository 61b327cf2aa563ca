import pytest

from conftest import dicts, rows
from tillwise.plans import alerts

OPS = "week string, revenue double, orders bigint, avg_delivery double, return_rate double, cancel_rate double"
CSAT = "week string, avg_csat double, escalation_rate double, total_tickets bigint"


@pytest.fixture(scope="module")
def weekly(spark):
    def build(revenue, csat=None, **fixed):
        n = len(revenue)
        flat = {"orders": 100, "avg_delivery": 4.0, "return_rate": 6.0, "cancel_rate": 3.0, **fixed}
        columns = {k: v if isinstance(v, list) else [v] * n for k, v in flat.items()}
        ops = [
            (f"2024-W{i:02d}", None if revenue[i] is None else float(revenue[i]), *[columns[c][i] for c in columns])
            for i in range(n)
        ]
        scores = [(f"2024-W{i:02d}", float(c), 5.0, 10) for i, c in enumerate(csat or [])]
        return spark.createDataFrame(ops, OPS), spark.createDataFrame(scores, CSAT)

    return build


def found(ops, csat):
    return {r["metric"]: r for r in dicts(alerts.trend_alerts(ops, csat))}


def expected_baseline(values, skip):
    """What precedes the newest week, by list positions."""
    if skip:
        return values[-6:-2] if len(values) >= 6 else values[:-2]
    return values[-5:-1] if len(values) >= 5 else values[:-1]


@pytest.mark.parametrize("n", [4, 5, 6, 7, 8])
def test_baselines(weekly, n):
    revenue = [100 + 10 * i for i in range(n - 1)] + [1000]
    csat = [3 + 0.1 * i for i in range(n - 1)] + [1]
    got = found(*weekly(revenue, csat))
    base = expected_baseline(revenue, True)
    assert got["Revenue"]["baseline"] == pytest.approx(sum(base) / len(base))
    base = expected_baseline(csat, False)
    assert got["CSAT Score"]["baseline"] == pytest.approx(sum(base) / len(base))
    assert set(got) == {"Revenue", "CSAT Score"}


def test_short_histories(weekly):
    assert found(*weekly([1, 2, 900], [5, 5, 5, 1])) == {}
    assert set(found(*weekly([1, 1, 1, 900], [5, 5, 1]))) == {"Revenue"}


@pytest.mark.parametrize(
    "last, severity",
    [
        (108, "neutral"),
        (92, "neutral"),
        (108.5, "positive"),
        (91.5, "warning"),
        (85, "warning"),
        (84.9, "critical"),
        (150, "positive"),
        (107.9, None),
    ],
)
def test_higher_is_better(weekly, last, severity):
    got = found(*weekly([100] * 6 + [last]))
    assert got.get("Revenue", {}).get("severity") == severity


@pytest.mark.parametrize(
    "last, severity",
    [(10.5, "neutral"), (9.5, "neutral"), (10.6, "warning"), (11.6, "critical"), (9.4, "positive"), (10.2, None)],
)
def test_lower_is_better(weekly, last, severity):
    got = found(*weekly([100] * 7, return_rate=[10.0] * 6 + [last]))
    assert got.get("Return Rate", {}).get("severity") == severity


def test_no_alert_on_zero_or_missing_baseline(weekly):
    assert found(*weekly([0] * 6 + [50])) == {}
    assert found(*weekly([None] * 6 + [50])) == {}
    assert found(*weekly([100] * 6 + [None])) == {}


def test_messages(weekly):
    got = found(
        *weekly(
            [100000] * 6 + [1234567],
            [4, 4, 4, 4, 3],
            avg_delivery=[4.0] * 6 + [5.0],
            return_rate=[10.0] * 6 + [9.0],
        )
    )
    assert got["Revenue"]["message"] == (
        "Revenue has increased by 1134.6% (current: ₹1,234,567, 4-week avg: ₹100,000). "
        "Trend is improving."
    )
    assert got["Delivery Days"]["message"] == (
        "Delivery Days has increased by 25.0% (current: 5.0 days, 4-week avg: 4.0 days). "
        "Trend is concerning."
    )
    assert got["Return Rate"]["message"].startswith("Return Rate has decreased by 10.0% (current: 9.0%,")
    assert "(current: 3.0, 4-week avg: 4.0)" in got["CSAT Score"]["message"]
    assert got["CSAT Score"]["direction"] == "down"


def test_order_recommendations_and_status(weekly):
    found_alerts = alerts.trend_alerts(
        *weekly([100] * 6 + [90], [4, 4, 4, 4, 2], return_rate=[10.0] * 6 + [20.0], cancel_rate=[10.0] * 6 + [9.0])
    )
    assert [(r["severity"], r["metric"]) for r in dicts(found_alerts)] == [
        ("critical", "Return Rate"),
        ("critical", "CSAT Score"),
        ("warning", "Revenue"),
        ("positive", "Cancellation Rate"),
    ]
    actions = dicts(alerts.alert_recommendations(found_alerts))
    assert [r["metric"] for r in actions] == ["Return Rate", "CSAT Score", "Revenue"]
    assert actions[2]["recommendation"] == alerts.RECOMMENDATIONS["Revenue"]
    assert rows(alerts.alert_status(found_alerts)) == [(4, 2, 1, "CRITICAL: 2")]


def test_nothing_to_recommend(weekly):
    calm = alerts.trend_alerts(*weekly([100] * 7))
    assert rows(alerts.alert_recommendations(calm)) == [(None, None, alerts.NOTHING_TO_DO)]
    assert rows(alerts.alert_status(calm)) == [(0, 0, 0, "All Clear")]
    warned = alerts.trend_alerts(*weekly([100] * 6 + [90]))
    assert rows(alerts.alert_status(warned))[0][3] == "WARNINGS: 1"


def test_unknown_metric_gets_the_general_advice(spark):
    odd = spark.createDataFrame(
        [("warning", "Footfall", 0), ("warning", "Net Revenue", 1)],
        "severity string, metric string, position int",
    )
    got = rows(alerts.alert_recommendations(odd).select("recommendation"))
    assert got[0] == ("Review Footfall trend and investigate root cause with the respective team.",)
    assert got[1] == (alerts.RECOMMENDATIONS["Revenue"],)


def test_sparkline(weekly):
    ops, _ = weekly([9999, 0, 1, 50, 100, 75, 33])
    assert [r[2] for r in rows(alerts.revenue_sparkline(ops))] == [2, 2, 12, 24, 18, 7]
    zero, _ = weekly([0, 0, 0])
    assert [r[2] for r in rows(alerts.revenue_sparkline(zero))] == [4, 4, 4]
    single, _ = weekly([5])
    assert rows(alerts.revenue_sparkline(single)) == []
