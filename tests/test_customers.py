from datetime import date

import pytest
from pyspark.sql import functions as F

from conftest import dicts, rows
from tillwise import Filters, Period, registry
from tillwise.operators.shaping import values_of
from tillwise.plans import customers, enrichment

YEAR = Period.of("2024-01-01", "2024-12-31")


def customer(key, **more):
    return {
        "customer_id": key,
        "full_name": f"C{key}",
        "segment": "SME",
        "status": "Active",
        "tier": "Gold",
        "join_date": "2024-01-15",
        **more,
    }


def order(customer_id, day, amount, order_id=1, status="Delivered"):
    return {
        "customer_id": customer_id,
        "order_date": day,
        "final_amount": amount,
        "order_id": order_id,
        "order_status": status,
    }


def test_tiers_keep_customers_without_orders(store):
    s = store(
        customers=[customer(1), customer(2), customer(3, tier="Platinum")],
        orders=[
            order(1, "2024-03-01", 10),
            order(1, "2024-03-02", 30),
            order(1, "2023-03-02", 900),
            order(2, "2024-03-02", 500, status="Cancelled"),
        ],
    )
    got = {r["tier"]: r for r in dicts(customers.customer_tiers(s, YEAR))}
    gold, platinum = got["Gold"], got["Platinum"]
    assert (gold["customers"], gold["revenue"], gold["aov"], gold["orders"]) == (2, 40, 20.0, 2)
    assert (platinum["customers"], platinum["revenue"], platinum["aov"]) == (1, 0, 0.0)
    summary = rows(customers.tier_summary(s, YEAR))
    assert [r[0] for r in summary] == ["Platinum", "Gold"]
    assert sum(r[2] for r in summary) == 40


def test_age_segment_matrix_fills_holes(store):
    s = store(
        customers=[customer(1, age_group="18-25"), customer(2, age_group="60+", segment="Retail")]
    )
    got = rows(customers.age_segment_matrix(s, YEAR, ["Retail", "SME"]))
    assert got == [("18-25", 0, 1), ("60+", 1, 0)]
    assert dicts(customers.age_segment_matrix(s, YEAR)) == [
        {"age_group": "18-25", "Retail": 0, "SME": 1},
        {"age_group": "60+", "Retail": 1, "SME": 0},
    ]


def test_a_segment_of_its_own_has_a_column(store):
    s = store(customers=[customer(1, segment="Nobody else's"), customer(2, segment=None)])
    assert customers.age_segment_matrix(s, YEAR).columns == ["age_group", "Nobody else's"]
    with pytest.raises(ValueError, match="more than 1 values"):
        values_of(store(agents=[{"team": "a"}, {"team": "b"}]).agents("team"), "team", most=1)


@pytest.fixture(scope="module")
def churn_store(store):
    return store(
        customers=[
            customer(1, status="Churned"),
            customer(2, status="At-Risk"),
            customer(3),
            customer(4, status="Churned"),
        ],
        orders=[order(2, "2024-12-31", 10), order(3, "2025-01-10", 10), order(3, "2024-01-01", 20)]
        + [order(4, "2024-10-02", 5, order_id=i) for i in range(12)],
    )


def test_churn_score(churn_store):
    got = {r["customer_id"]: r for r in dicts(customers.churn_risk(churn_store, YEAR))}
    never, today, later, often = (got[k] for k in (1, 2, 3, 4))
    assert (never["days_since_order"], never["total_orders"], never["lifetime_value"]) == (999, 0, 0)
    assert never["churn_score"] == pytest.approx(0.45 + 0.40 + 0.10)
    assert today["days_since_order"] == 0
    assert today["churn_score"] == pytest.approx(0.25 + 0.09)
    assert later["days_since_order"] == -10  # ordered after the period's end
    assert later["churn_score"] == pytest.approx(0.08)
    assert often["days_since_order"] == 90
    assert often["churn_score"] == pytest.approx(0.225 + 0.40)
    assert customers.churn_export(churn_store, YEAR).columns == customers.CHURN_EXPORT


def test_churn_noise_is_repeatable_and_bounded(churn_store):
    plain = dict(rows(customers.churn_risk(churn_store, YEAR).select("customer_id", "churn_score")))
    noisy = customers.churn_risk(churn_store, YEAR, noise_seed=42).select("customer_id", "churn_score")
    once, again = dict(rows(noisy)), dict(rows(noisy))
    assert once == again
    assert all(0 <= once[k] - plain[k] <= 0.05 and 0 <= once[k] <= 1 for k in plain)


def test_churn_bands_hold_every_customer(churn_store):
    got = dicts(customers.churn_bands(churn_store, YEAR))
    assert [(r["band"], r["customers"]) for r in got] == [("high", 1), ("medium", 1), ("low", 2)]
    none = dicts(customers.churn_bands(churn_store, YEAR, Filters(segment="Nobody")))
    assert [(r["customers"], r["avg_lifetime_value"], r["avg_days_since_order"]) for r in none] == [
        (0, 0.0, 0.0)
    ] * 3


def test_band_limits(spark):
    limits = spark.createDataFrame([(0.4,), (0.7,), (0.71,)], "s double").select(
        F.col("s") > 0.7, (F.col("s") > 0.4) & (F.col("s") <= 0.7), F.col("s") <= 0.4
    )
    assert rows(limits) == [(False, False, True), (False, True, False), (True, False, False)]


@pytest.fixture(scope="module")
def cohort_store(store):
    return store(
        customers=[customer(1), customer(2), customer(3), customer(4, join_date="2024-03-02")],
        orders=[
            order(1, "2024-01-20", 1),
            order(1, "2024-01-25", 1),
            order(1, "2024-02-25", 1),
            order(2, "2023-12-25", 1),
            order(2, "2025-03-01", 1),
            order(3, "2024-02-01", 1, status="Cancelled"),
            order(4, "2024-03-09", 1),
        ],
    )


def test_cohorts(cohort_store):
    got = rows(customers.cohort_retention_long(cohort_store))
    january, march = date(2024, 1, 1), date(2024, 3, 1)
    assert got == [
        (january, -1, 1, 2, 50.0),
        (january, 0, 1, 2, 50.0),
        (january, 1, 1, 2, 50.0),
        (january, 14, 1, 2, 50.0),
        (march, 0, 1, 1, 100.0),
    ]
    assert rows(customers.cohort_retention_long(cohort_store, max_period=11)) == got[:3] + got[4:]


def test_cohort_matrix(cohort_store):
    got = dicts(customers.cohort_retention_matrix(cohort_store, periods=range(-1, 12)))
    assert [r["cohort"] for r in got] == ["Jan 2024", "Mar 2024"]
    assert list(got[0]) == ["cohort", "M+-1", "M+0"] + [f"M+{k}" for k in range(1, 12)]
    assert [got[0][f"M+{k}"] for k in (-1, 0, 1, 2, 11)] == [50.0, 50.0, 50.0, 0.0, 0.0]
    assert rows(customers.cohort_retention_matrix(cohort_store, Filters(segment="Nobody"))) == []
    every = dicts(customers.cohort_retention_matrix(cohort_store))
    assert list(every[0]) == ["cohort"] + [f"M+{k}" for k in range(-3, 15)]
    assert [every[0][f"M+{k}"] for k in (-3, -1, 11, 14)] == [0.0, 50.0, 0.0, 50.0]


def test_every_buying_cohort_has_a_row(store):
    """Also if it only bought long after, or only before, its members joined."""
    s = store(
        customers=[
            customer(1, join_date="2023-01-10"),
            customer(2, join_date="2024-06-10"),
            customer(3, join_date="2024-03-10"),
        ],
        orders=[
            order(1, "2024-06-20", 1),
            order(2, "2024-05-20", 1),
            order(3, "2024-03-20", 1, status="Cancelled"),
        ],
    )
    got = {r["cohort"]: r for r in dicts(customers.cohort_retention_matrix(s))}
    assert set(got) == {"Jan 2023", "Jun 2024"}
    assert got["Jan 2023"]["M+17"] == 100.0 and got["Jun 2024"]["M+-1"] == 100.0
    short = dicts(customers.cohort_retention_matrix(s, periods=range(12)))
    assert [r["cohort"] for r in short] == ["Jan 2023", "Jun 2024"]


def test_top_customers_with_and_without_fanout(store):
    s = store(
        customers=[customer(1), customer(2), customer(3)],
        orders=[
            order(1, "2024-02-01", 100, order_id=1),
            order(1, "2024-02-02", 100, order_id=1),
            order(2, "2024-02-02", 150, order_id=2),
            order(3, "2024-02-02", 20, order_id=3),
            order(9, "2024-02-02", 9000, order_id=4),  # no such customer
        ],
        tickets=[
            {"customer_id": 2, "created_date": "2024-05-01", "csat_score": c} for c in (3, 4, 5)
        ]
        + [{"customer_id": 1, "created_date": "2023-05-01", "csat_score": 1}],
    )
    shown = ["full_name", "orders", "lifetime_value", "aov", "csat_avg"]
    real = rows(customers.top_customers(s, YEAR, limit=2).select(*shown))
    assert real == [("C1", 1, 200, 100.0, 0.0), ("C2", 1, 150, 150.0, 4.0)]
    repeated = rows(customers.top_customers_fanout(s, YEAR, limit=2).select(*shown))
    assert repeated == [("C2", 1, 450, 150.0, 4.0), ("C1", 1, 200, 100.0, 0.0)]


def test_tier_assignment_and_update(store):
    s = store(
        customers=[customer(1), customer(2), customer(3)],
        orders=[
            order(1, "2024-02-01", 50000),
            order(2, "2024-02-01", 8000),
            order(2, "2024-02-01", 90000, status="Shipped"),
        ],
    )
    assigned = enrichment.tier_assignment(s)
    assert sorted(rows(assigned)) == [(1, 50000, "Platinum"), (2, 8000, "Silver"), (3, 0, "Bronze")]
    base = s.customers("customer_id", "tier")
    updates = assigned.where("spent > 0").unionByName(assigned.selectExpr("99 AS customer_id", "spent", "tier").limit(1))
    assert sorted(rows(enrichment.updated(base, updates, "customer_id", "tier"))) == [
        (1, "Platinum"),
        (2, "Silver"),
        (3, "Gold"),
    ]


def test_the_tier_update_reaches_every_customer(store):
    keys = range(1, 22)
    s = store(customers=[customer(k) for k in keys], orders=[order(k, "2024-02-01", 50000) for k in keys if k % 2])
    got = {r.customer_id: r.tier for r in registry.PLANS["tier_update"](s).collect()}
    assert got == {k: "Platinum" if k % 2 else "Bronze" for k in keys}
