from datetime import date

import pytest

from conftest import dicts
from tillwise import Filters, Period
from tillwise.plans import kpis, report

PERIOD = Period.of("2024-01-11", "2024-01-20")  # 9 days apart, so prior is 01-02..01-10


def order(day, customer, amount, status="Delivered", **more):
    return {
        "order_id": 1,
        "order_date": day,
        "customer_id": customer,
        "final_amount": amount,
        "discount": 1,
        "gst_amount": 2,
        "delivery_days": 4,
        "order_status": status,
        **more,
    }


def ticket(day, customer, csat, status="Resolved", **more):
    return {"created_date": day, "customer_id": customer, "csat_score": csat, "status": status, **more}


CUSTOMERS = [{"customer_id": 1, "segment": "SME"}, {"customer_id": 2, "segment": "Retail"}]


@pytest.fixture(scope="module")
def shop(store):
    return store(
        customers=CUSTOMERS,
        orders=[
            order("2024-01-11", 1, 100),
            order("2024-01-20", 1, 50, "Cancelled"),
            order("2024-01-15", 2, 30, "Returned", state="Goa"),
            order("2024-01-15", 2, 999, "Processing"),
            order("2024-01-15", 9, 777),  # no such customer
            order("2024-01-21", 1, 500),  # after the period
            order("2024-01-02", 1, 60),
            order("2024-01-10", 1, 30),
            order("2024-01-01", 1, 40),  # before the prior window
        ],
        tickets=[
            ticket("2024-01-12", 1, 4.0),
            ticket("2024-01-13", 2, 2.0, "Open", state="Goa"),
            ticket("2024-01-05", 1, 2.0),
        ],
    )


def test_summary(shop):
    [row] = dicts(kpis.kpi_summary(shop, PERIOD))
    assert list(row) == kpis.SUMMARY
    assert row["gmv"] == 180.0 and row["orders"] == 3 and row["customers"] == 2
    assert row["aov"] == 60.0 and row["gmv_delta"] == 100.0 and row["orders_delta"] == 50.0
    assert row["customers_delta"] == 100.0
    assert row["csat"] == 3.0 and row["csat_delta"] == 50.0
    assert row["resolution"] == 50.0 and row["resolution_delta"] == -50.0
    assert row["return_rate"] == row["cancel_rate"] == pytest.approx(100 / 3)
    assert row["total_discount"] == 3.0 and row["total_gst"] == 6.0 and row["avg_delivery"] == 4.0


def test_pair(shop):
    now, before = dicts(kpis.kpi_by_period_pair(shop, PERIOD))
    assert (now["period_window"], now["gmv"]) == ("current", 180.0)
    assert (before["window_start"], before["window_end"]) == (date(2024, 1, 2), date(2024, 1, 10))
    assert (before["gmv"], before["orders"], before["customers"]) == (90.0, 2, 1)


def test_filters(shop):
    [sme] = dicts(kpis.kpi_summary(shop, PERIOD, Filters(segment="SME")))
    assert (sme["gmv"], sme["orders"], sme["csat"]) == (150.0, 2, 4.0)
    [goa] = dicts(kpis.kpi_summary(shop, PERIOD, Filters(state="Goa")))
    assert (goa["gmv"], goa["orders"], goa["csat"], goa["resolution"]) == (30.0, 1, 2.0, 0.0)


def test_empty_period_is_zero(shop):
    [row] = dicts(kpis.kpi_summary(shop, Period.of("2030-01-01", "2030-01-31")))
    assert all(value == 0 for value in row.values())


def test_kpi_sheet(shop):
    sheet = {r["label"]: r for r in dicts(report.kpi_sheet(shop, PERIOD, Filters(segment="SME")))}
    assert len(sheet) == 11
    assert sheet["Avg Order Value"]["shown"] == "₹75"
    assert sheet["CSAT Score"]["shown"] == "4.00"
    assert sheet["CSAT Score"]["delta_shown"] == "+100.0%"
    assert sheet["Cancellation Rate"]["shown"] == "50.0%"
    assert sheet["Return Rate"]["delta"] is None
    assert sheet["Total Orders"]["filters"] == "Segment: SME"


def test_return_benchmark(shop):
    [row] = dicts(report.return_benchmark(shop, PERIOD))
    assert row["benchmark"] == "above"
    [row] = dicts(report.return_benchmark(shop, PERIOD, Filters(segment="SME")))
    assert row["benchmark"] == "within"
