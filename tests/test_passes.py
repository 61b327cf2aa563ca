"""Several totals from one scan of the orders."""

import pytest

from conftest import rows
from test_rollups import calendar_days, facts
from tillwise import Filters, Period
from tillwise.functions.measures import as_output
from tillwise.operators.selection import NO_FILTERS
from tillwise.plans import report, sales
from tillwise.sources.passes import Mix, one_pass
from tillwise.sources.star import StarStore
from tillwise.sources.store import FrameStore
from tillwise.sources.warehouse import Warehouse

YEAR = Period.of("2023-01-01", "2023-12-31")
SHARED = ("top_states", "state_share", "top3_concentration", "top_categories", "category_share", "top_payments", "weekly_totals")


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("filters", [NO_FILTERS, Filters(state="Goa", category="Toys"), Filters(zone="Mars")])
def test_datasets_of_one_pass_equal_their_own(spark, store, filters):
    direct = FrameStore(facts(spark, calendar_days()), store())
    shared = report.in_one_pass(direct, YEAR, filters)
    for name, plan in {
        "daily": sales.revenue_daily,
        "weekly": sales.revenue_weekly_filled,
        "monthly": sales.revenue_monthly_filled,
        "states": sales.state_performance,
        "categories": sales.category_mix,
        "payments": sales.payment_analysis,
    }.items():
        assert rows(as_output(plan(shared, YEAR, filters))) == rows(as_output(plan(direct, YEAR, filters))), name
    # what was not asked for in the pass comes from the store itself
    other = Filters(category="Books")
    assert rows(sales.category_mix(shared, YEAR, other)) == rows(sales.category_mix(direct, YEAR, other))
    assert rows(sales.zone_comparison(shared, YEAR, filters).orderBy("zone")) == rows(
        sales.zone_comparison(direct, YEAR, filters).orderBy("zone")
    )
    assert rows(sales.weekly_ops(shared)) == rows(sales.weekly_ops(direct))


def test_one_scan_of_the_orders(spark, tmp_path):
    house = Warehouse(spark, str(tmp_path / "house"))
    house.append("orders", facts(spark, calendar_days())["orders"])
    once = one_pass(house, sales.REPORT_MIXES, YEAR)
    assert plan_of(once).count("Relation [") == 1 and "Expand" in plan_of(once)
    star = StarStore(spark, "/root/testdata/sf0.001")
    year = Period.of("2000-01-01", "2000-12-31")
    bundle = report.report_bundle(report.in_one_pass(star, year), year)
    direct = report.report_bundle(star, year)
    for name in SHARED:
        assert "Relation [" not in plan_of(bundle[name]), name
        assert rows(as_output(bundle[name])) == rows(as_output(direct[name])), name


def test_real_nulls_are_labels_of_their_own(store):
    """A null label is a group, apart from the nulls of the other sets."""
    orders = [
        {"order_id": 1, "customer_id": 5, "order_date": "2023-01-01", "final_amount": 2, "order_status": "Delivered"},
        {"order_id": 2, "customer_id": 5, "order_date": "2023-01-01", "final_amount": 3, "order_status": "Delivered", "state": "Goa"},
        {"order_id": 3, "customer_id": None, "order_date": None, "final_amount": 4, "order_status": "Cancelled", "state": "Goa"},
        {"order_id": 4, "customer_id": 6, "order_date": "2023-01-02", "final_amount": None, "order_status": None},
    ]
    found = one_pass(store(orders=orders), (sales.BY_STATE, sales.BY_METHOD), None)
    assert sorted(rows(found.select("mix", "state", "orders", "revenue", "customers")), key=str) == [
        ("payment_method", None, 4, 9, 0),
        ("state", "Goa", 2, 7, 1),
        ("state", None, 1, 2, 1),
    ]
    none = one_pass(store(), sales.REPORT_MIXES, YEAR)
    assert none.count() == 0
    with pytest.raises(ValueError, match="several mixes"):
        one_pass(store(), (sales.BY_STATE, Mix("state", "place", ("orders",))), YEAR)


def test_a_hot_state_is_spread(spark):
    """A state with most orders has one key for each customer, combined by task."""
    hot = facts(spark, [d for d in calendar_days() for _ in range(20)])["orders"]
    direct = FrameStore({"orders": hot})
    plan = one_pass(direct, (sales.BY_STATE,), YEAR)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "hashpartitioning" in line]
    assert "customer_id" in exchanges[-1]
