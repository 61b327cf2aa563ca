import pytest

from conftest import dicts, rows
from tillwise import Filters, Period
from tillwise.plans import enrichment, report, returns, support

YEAR = Period.of("2024-01-01", "2024-12-31")


def ticket(agent, category, priority, status="Resolved", hours=2, csat=4, repeat=0, **more):
    return {
        "ticket_id": 1,
        "agent_id": agent,
        "ticket_category": category,
        "priority": priority,
        "status": status,
        "resolution_hours": hours,
        "first_response_h": 1,
        "csat_score": csat,
        "is_repeat": repeat,
        "created_date": "2024-05-01",
        **more,
    }


@pytest.fixture(scope="module")
def desk(store):
    return store(
        agents=[{"agent_id": k, "agent_name": f"A{k}", "team": "T", "shift": "S"} for k in (1, 2, 3)],
        tickets=[
            ticket(1, "Late", "Low", hours=1, csat=5),
            ticket(1, "Late", "Low", hours=3, csat=3, repeat=1),
            ticket(1, "Late", "High", "Escalated", hours=10, csat=1, state="Goa"),
            ticket(2, "Wrong", "Critical"),
            ticket(2, "Wrong", "Critical", "Open", created_date="2023-01-01"),
        ],
    )


def test_agents(desk):
    got = dicts(support.agent_performance(desk, YEAR))
    assert [r["agent_name"] for r in got] == ["A1", "A2"]  # A3 has no tickets
    first = got[0]
    assert (first["total"], first["resolved"], first["escalated"], first["repeat_contacts"]) == (3, 2, 1, 1)
    assert first["avg_resolution_h"] == pytest.approx(14 / 3) and first["avg_csat"] == 3.0
    rates = {r["agent_name"]: r["res_rate"] for r in dicts(support.agent_resolution_rate(desk, YEAR))}
    assert rates == {"A1": 66.7, "A2": 50.0}  # no escalation counts as one
    card = dicts(report.agent_scorecard(desk, YEAR))[0]
    assert (card["avg_res"], card["csat"], card["res_rate"]) == ("4.7h", "3.00", "66.7%")


def test_two_agents_of_one_name(store):
    s = store(
        agents=[{"agent_id": k, "agent_name": "A", "team": f"T{k}", "shift": "S"} for k in (1, 2)],
        tickets=[ticket(1, "Late", "Low"), ticket(1, "Late", "Low", "Escalated"), ticket(2, "Late", "Low")],
    )
    card = report.agent_scorecard(s, YEAR)
    assert [(r["team"], r["res_rate"]) for r in dicts(card)] == [("T1", "50.0%"), ("T2", "50.0%")]
    plan = card._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ticket_id") == plan.count("ticket_category") <= 1  # one scan, pruned


def test_ticket_rollups(desk):
    got = rows(support.ticket_analytics(desk, YEAR).select("ticket_category", "priority", "total"))
    assert got == [("Late", "Low", 2), ("Late", "High", 1), ("Wrong", "Critical", 1)]
    late = next(r for r in dicts(support.ticket_category_rollup(desk, YEAR)) if r["ticket_category"] == "Late")
    assert late["total"] == 3
    assert late["mean_of_avg_res_h"] == 6.0  # mean of 2 (Low) and 10 (High), not of 1, 3, 10
    assert rows(support.ticket_priority_matrix(desk, YEAR)) == [("Late", 2, 0, 1, 0), ("Wrong", 0, 0, 0, 1)]
    assert rows(support.tickets_by_category(desk, YEAR)) == [("Late", 3), ("Wrong", 1)]
    assert support.ticket_analytics(desk, YEAR, Filters(state="Goa")).count() == 1


def test_weekly_csat(store):
    days = {"2024-01-01": 1, "2024-01-08": 2, "2024-01-14": 4, "2024-01-15": 5}
    s = store(tickets=[ticket(1, "x", "Low", created_date=d, csat=c) for d, c in days.items()])
    got = rows(support.weekly_csat(s, weeks=2))
    assert got == [("2024-W02", 3.0, 0.0, 2), ("2024-W03", 5.0, 0.0, 1)]


@pytest.fixture(scope="module")
def returned(store):
    def row(state, reason, status, amount, day="2024-06-01"):
        return {"state": state, "reason": reason, "refund_status": status, "refund_amount": amount, "return_date": day}

    return store(
        returns=[
            row("Goa", "Late", "Completed", 10),
            row("Goa", "Late", "Completed", 20),
            row("Goa", "Size", "Pending", 5),
            row("Punjab", "Size", "Completed", 1),
            row("Punjab", "Size", "Completed", 1, "2023-06-01"),
            row("Nowhere", "Size", "Completed", 1),
        ],
        orders=[{"state": "Goa", "order_date": "2024-02-01", "order_status": "Delivered"}] * 8
        + [{"state": "Punjab", "order_date": "2024-02-01", "order_status": "Cancelled"}] * 20
        + [{"state": "Punjab", "order_date": "2024-02-01", "order_status": "Processing"}] * 5,
    )


def test_returns(returned):
    first = dicts(returns.returns_analysis(returned, YEAR))[0]
    assert (first["state"], first["returns"], first["refund_value"], first["avg_refund"]) == ("Goa", 2, 30, 15.0)
    assert rows(returns.return_reasons(returned, YEAR)) == [("Late", 2, 30), ("Size", 3, 7)]
    shares = {r[0]: r[2] for r in rows(returns.refund_status_share(returned, YEAR))}
    assert shares == {"Completed": 80.0, "Pending": 20.0}


def test_state_return_rate(returned):
    got = rows(returns.state_return_rate(returned, YEAR))
    assert got == [("Goa", 3, 8, 37.5, 1), ("Punjab", 1, 20, 5.0, 0)]  # Nowhere has no orders


def test_enrichment(store, spark):
    s = store(
        customers=[{"customer_id": 7, "full_name": "Asha Rao", "segment": "Corporate"}],
        orders=[
            {
                "order_id": 12,
                "customer_id": 7,
                "order_date": "2024-10-30",
                "state": "Kerala",
                "category": "Grocery & FMCG",
                "amount": "100.15",
                "discount": "10.00",
                "order_status": "Returned",
                "delivery_days": 3,
            }
        ],
        tickets=[{"ticket_id": 5, "created_date": "2024-02-28", "resolution_hours": "30.50"}],
    )
    [row] = dicts(enrichment.order_enrichment(s))
    assert row["zone"] == "South" and row["order_code"] == "ORD000012"
    assert (str(row["price"]), str(row["gst"]), str(row["final"])) == ("150.23", "7.51", "147.74")
    assert str(row["delivery_date"]) == "2024-11-02" and row["is_returned"] == 1
    assert row["festival_weight"] == 2.8 and row["in_price_range"] == 1
    assert rows(enrichment.customer_contacts(s)) == [(7, "CUST00007", "asha.rao@example.com")]
    [ticket_row] = dicts(enrichment.ticket_enrichment(s))
    assert str(ticket_row["resolved_date"]) == "2024-02-29" and ticket_row["csat_score"] == 1.5
    zones = spark.createDataFrame([("Kerala", "Deep South")], "state string, zone string")
    [row] = dicts(enrichment.order_enrichment(s, zones))
    assert row["zone"] == "Deep South"


@pytest.mark.parametrize("raw, kept", [("0.2", 1.0), ("5.36", 5.0), ("3.14", 3.1)])
def test_rating_is_kept_in_range(spark, raw, kept):
    from pyspark.sql import functions as F

    value = F.lit(raw).cast("decimal(6,2)")
    assert spark.range(1).select(enrichment.kept_rating(value)).first()[0] == kept


def test_concentration(store):
    def states(*revenues):
        return store(
            orders=[
                {"state": f"S{i}", "final_amount": r, "order_date": "2024-02-01", "order_status": "Delivered"}
                for i, r in enumerate(revenues)
            ]
        )

    assert rows(report.top3_concentration(states(50, 30, 10, 6, 4), YEAR)) == [(90.0, "S3")]
    assert rows(report.top3_concentration(states(50, 30), YEAR)) == [(100.0, "other states")]
    assert rows(report.top3_concentration(states(), YEAR)) == [(None, "other states")]
    bars = rows(report.state_share(states(*range(10, 110, 10)), YEAR))
    assert len(bars) == 8 and bars[0][2] == 100.0 and bars[1][2] == 90.0
