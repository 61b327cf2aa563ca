"""Daily roll-ups of a warehouse: equal to the facts, fresh after an append, found weeks."""

import os
from collections import Counter
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tillwise import Filters, Period
from tillwise.functions.measures import as_output
from tillwise.plans import report, sales, support
from tillwise.sources.rollups import ROLLUPS
from tillwise.sources.schemas import TABLES
from tillwise.sources.store import FrameStore
from tillwise.sources.warehouse import Warehouse

YEAR = Period.of("2023-01-01", "2023-12-31")
STATUSES = ("Delivered", "Returned", "Cancelled", "Processing")


def facts(spark, days, first=0):
    """An order and a ticket or two for each of the days; every third in Goa."""
    listed = [(first + k, day) for k, day in enumerate(days)]
    seen = spark.createDataFrame(listed, "id long, day date")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("id") % len(values) + 1).cast("int"))
    cells = {
        "order_id": F.col("id"),
        "ticket_id": F.col("id"),
        "customer_id": F.when(F.col("id") % 11 > 0, F.col("id") * 9973 % 100_003 * (F.col("id") % 3)),
        "order_date": F.col("day"),
        "created_date": F.col("day"),
        "final_amount": F.col("id") * 1.25,
        "discount": F.when(F.col("id") % 5 > 0, F.col("id") % 5),
        "delivery_days": F.when(F.col("id") % 4 > 0, F.col("id") % 9),
        "category": pick(("Books", "Toys")),
        "payment_method": pick(("UPI", "Card", None)),
        "order_status": pick(STATUSES),
        "status": pick(("Resolved", "Escalated", "Open")),
        "state": pick(("Goa", "Bihar", "Bihar")),
        "zone": pick(("West", "East", "East")),
        "csat_score": F.when(F.col("id") % 6 > 0, F.col("id") % 5),
        "priority": F.lit("High"),
    }
    return {
        name: seen.select(*[cells.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in TABLES[name].columns.items()])
        for name in ("orders", "tickets")
    }


def calendar_days():
    """Weeks with gaps, a month without rows, both sides of New Year."""
    start = date(2023, 9, 4)
    days = [start + timedelta(days=k) for k in range(0, 130)]
    return [d for d in days if d.month != 11 and d.day not in (5, 6, 7, 20, 21) and d != date(2024, 1, 2)] + [date(2024, 1, 9), date(2024, 1, 9)]


@pytest.fixture
def pair(spark, tmp_path):
    """A warehouse, and the frames that it was made of."""
    frames = facts(spark, calendar_days()) | {
        name: spark.createDataFrame([], TABLES[name].struct) for name in ("customers", "agents", "returns")
    }
    plain = FrameStore(frames)
    house = Warehouse(spark, str(tmp_path / "ops"))
    house.create_missing(plain)
    return house, plain


PLANS = {
    "daily": lambda s, f: sales.revenue_daily(s, YEAR, f),
    "weekly": lambda s, f: sales.revenue_weekly_filled(s, YEAR, f),
    "monthly": lambda s, f: sales.revenue_monthly_filled(s, YEAR, f),
    "years": lambda s, f: sales.yoy_monthly(s, f),
    "categories": lambda s, f: sales.category_mix(s, YEAR, f),
    "payments": lambda s, f: sales.payment_analysis(s, YEAR, f),
    "states": lambda s, f: sales.state_performance(s, YEAR),
    "zones": lambda s, f: sales.zone_comparison(s, Period.of("2023-10-02", "2023-10-17")).orderBy("zone"),
    "weeks": lambda s, f: sales.weekly_ops(s, 6, f),
    "complete weeks": lambda s, f: sales.weekly_ops(s, 3, f, complete_weeks_only=True),
    "ratings": lambda s, f: support.weekly_csat(s, 6, f),
}


@pytest.mark.parametrize("filters", [Filters(), Filters(state="Goa"), Filters(zone="East", category="Toys"), Filters(state="Nowhere")])
@pytest.mark.parametrize("name", PLANS)
def test_equal_to_the_facts(pair, name, filters):
    house, plain = pair
    here, there = (as_output(PLANS[name](s, filters)) for s in (house, plain))
    assert here.columns == there.columns
    assert rows(here) == rows(there)


@pytest.mark.parametrize("name", PLANS)
def test_facts_are_not_read(pair, name, monkeypatch):
    """Neither by the plan nor by a job before it: the weeks come from the roll-up."""
    house, _ = pair

    def refused(self, table, columns, period):
        raise AssertionError(f"reads {table}")

    monkeypatch.setattr(Warehouse, "table", refused)
    for filters in (Filters(), Filters(state="Bihar")):
        found = PLANS[name](house, filters)
        assert found.inputFiles() and all("/_daily_" in path or "/_buyers_" in path for path in found.inputFiles())


def modified(root):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, files in os.walk(root) for f in files if f.startswith("part-")}


def test_an_append_rewrites_the_touched_months_only(spark, pair):
    house, plain = pair
    before = modified(house.path("_daily_orders"))
    more = facts(spark, [date(2023, 10, 3), date(2024, 2, 1)], first=1000)["orders"]
    house.append("orders", more)
    after = modified(house.path("_daily_orders"))
    month = lambda path: path.split("year_month=")[1].split("/")[0]
    assert {month(p) for p in after if p not in before} == {"2023-10", "2024-02"}
    assert {month(p) for p in before if p not in after} == {"2023-10"}
    whole = FrameStore({**plain.frames, "orders": plain.frames["orders"].unionByName(more)})
    for name, plan in PLANS.items():
        assert rows(as_output(plan(house, Filters()))) == rows(as_output(plan(whole, Filters()))), name


def test_a_broken_off_append_is_seen(spark, pair, monkeypatch):
    """Without a roll-up that is up to date the facts are read, until it is refreshed."""
    house, plain = pair
    more = facts(spark, [date(2023, 10, 3)], first=1000)["orders"]
    with monkeypatch.context() as broken:
        broken.setattr(Warehouse, "refresh", lambda self, name: None)
        house.append("orders", more)
    assert not house.rolled_up("orders")
    whole = FrameStore({**plain.frames, "orders": plain.frames["orders"].unionByName(more)})
    expected = rows(as_output(sales.revenue_daily(whole, YEAR)))
    assert rows(as_output(sales.revenue_daily(house, YEAR))) == expected
    assert house.refresh("orders") == ["2023-10"]
    assert house.rolled_up("orders")
    assert rows(as_output(sales.revenue_daily(house, YEAR))) == expected


def test_rows_without_a_day(spark, pair):
    house, plain = pair
    more = facts(spark, [None, date(2023, 9, 8)], first=2000)["orders"]
    house.append("orders", more)
    whole = FrameStore({**plain.frames, "orders": plain.frames["orders"].unionByName(more)})
    for name in ("daily", "years", "categories", "weeks"):
        assert Counter(rows(as_output(PLANS[name](house, Filters())))) == Counter(rows(as_output(PLANS[name](whole, Filters())))), name


def test_a_rollup_is_bounded_by_calendar_and_domains(spark, tmp_path):
    """A day with most of the rows is as many roll-up rows as any other."""
    days = [date(2023, 5, 1)] * 3000 + [date(2023, 5, 2)] * 30
    house = Warehouse(spark, str(tmp_path))
    house.append("orders", facts(spark, days)["orders"])
    sizes = dict(rows(house._rollup("orders", None).groupBy("order_date").count()))
    assert sizes[date(2023, 5, 1)] <= 2 * 3 * 4 * 3
    buckets = house.spark.read.parquet(house.path("_buyers_orders"))
    assert buckets.count() <= 2 * 3 * (100_003 * 2 // 32_768 + 1)
    assert set(ROLLUPS["orders"].split) <= set(TABLES["orders"].columns)


def test_staged_report_of_another_period(spark, tmp_path):
    """Facts staged for one period are not taken for another's."""
    from tillwise.plans import kpis
    from tillwise.sources.star import StarStore

    star, folder = StarStore(spark, "/root/testdata/sf0.001"), str(tmp_path / "staged")
    for period in (Period.of("1995-01-01", "1995-06-30"), Period.of("2000-01-01", "2000-12-31")):
        shared = report.staged(spark, star, period, folder)
        assert rows(as_output(kpis.kpi_summary(shared, period))) == rows(as_output(kpis.kpi_summary(star, period)))


def test_customers_of_any_period_equal_a_distinct_count(pair):
    house, plain = pair
    for first, last in (("2023-09-04", "2023-09-04"), ("2023-09-30", "2023-12-01"), ("2023-12-25", "2024-03-01"), ("2030-01-01", "2030-02-01")):
        period = Period.of(first, last)
        orders = plain.orders("state", "customer_id", "order_status", period=period).where("order_status <> 'Processing'")
        expected = rows(orders.groupBy("state").agg(F.countDistinct("customer_id")))
        assert Counter(rows(house.placed_buyers("state", Filters(), (), period))) == Counter(r for r in expected if r[1])
    here, there = (sales.state_performance(s, YEAR, Filters(category="Books")) for s in (house, plain))
    assert house.placed_buyers("state", Filters(category="Books"), ("category",), YEAR) is None
    assert rows(as_output(here)) == rows(as_output(there))


# Updates by key.


@pytest.fixture
def people(spark, tmp_path):
    columns = TABLES["customers"].columns
    cells = {"customer_id": F.col("id"), "full_name": F.concat(F.lit("C"), F.col("id")), "tier": F.lit("Bronze")}
    listed = spark.range(400).select(*[cells.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in columns.items()])
    house = Warehouse(spark, str(tmp_path / "people"))
    house.append("customers", listed)
    return house


def tiers(house):
    return dict(rows(house.customers("customer_id", "tier")))


def test_an_update_writes_the_changed_folders_only(spark, people):
    before = modified(people.path("customers"))
    changes = spark.createDataFrame([(7, "Gold"), (8, "Bronze"), (9999, "Gold")], "customer_id long, tier string")
    [slice_] = people.update("customers", changes)
    after = modified(people.path("customers"))
    assert {p for p in before if p not in after} == {p for p in before if f"key_slice={slice_}/" in p}
    assert tiers(people) == {**{k: "Bronze" for k in range(400)}, 7: "Gold"}
    assert people.customers().count() == 400
    assert people.update("customers", changes) == []


def test_an_update_can_set_null_and_several_columns(spark, people):
    changes = spark.createDataFrame([(k, None, f"N{k}") for k in range(0, 400, 3)], "customer_id long, tier string, full_name string")
    assert len(people.update("customers", changes)) > 10
    assert tiers(people)[3] is None and tiers(people)[4] == "Bronze"
    assert dict(rows(people.customers("customer_id", "full_name")))[399] == "N399"


def test_a_failed_update_leaves_the_table(spark, people):
    bad = F.when(F.col("customer_id") == 12, F.raise_error(F.lit("lost"))).otherwise(F.lit("Gold"))
    with pytest.raises(Exception, match="lost"):
        people.update("customers", spark.range(400).withColumnRenamed("id", "customer_id").withColumn("tier", bad))
    assert set(tiers(people).values()) == {"Bronze"}
    twice = spark.createDataFrame([(1, "Gold"), (1, "Silver")], "customer_id long, tier string")
    for changes, message in ((twice, "more than once"), (twice.select("customer_id"), "changes need"), (twice.withColumn("x", F.lit(1)), "unknown")):
        with pytest.raises(ValueError, match=message):
            people.update("customers", changes)
    with pytest.raises(ValueError, match="not a table"):
        people.update("orders", twice)


def test_earned_tiers_are_stored(spark, tmp_path):
    from tillwise.plans import enrichment
    from tillwise.sources.star import StarStore

    star = StarStore(spark, "/root/testdata/sf0.001")
    house = Warehouse(spark, str(tmp_path / "ops"))
    house.create_missing(star)
    house.update("customers", spark.range(20).selectExpr("id AS customer_id", "'Unset' AS tier"))
    earned = dict(rows(enrichment.tier_assignment(house).select("customer_id", "tier")))
    assert house.update("customers", enrichment.tier_assignment(house).select("customer_id", "tier"))
    assert earned.items() <= tiers(house).items()
    assert house.update("customers", enrichment.tier_assignment(house).select("customer_id", "tier")) == []


# Metadata.


def test_schema_listing_reads_footers_only(spark, pair, people):
    from tillwise.plans import catalog

    house, plain = pair
    assert rows(catalog.schema_catalog(house)) == rows(catalog.schema_catalog(plain))
    for store, name in ((house, "orders"), (house, "tickets"), (people, "customers")):
        plan = store.counted(name)._jdf.queryExecution().executedPlan().toString()
        assert "PushedAggregation: [COUNT(*)" in plan
    listed = {(t, c): (k, kind, needed, key) for t, k, c, kind, needed, key in catalog.declared()}
    assert {(r.table_name, r.column_name): (r.position, r.data_type, r.not_null, r.primary_key) for r in catalog.schema_catalog(plain).collect()} == listed


def test_results_are_found_again_until_a_file_changes(spark, pair, tmp_path):
    from tillwise.session import Results

    house, plain = pair
    results = Results(spark, str(tmp_path / "kept"))
    query = lambda period=YEAR, filters=Filters(): sales.revenue_daily(house, period, filters)
    assert not results.has(query())
    first = results.of(query())
    assert rows(first) == rows(query())
    assert results.has(query()) and all("/kept/" in path for path in first.inputFiles())
    written = modified(str(tmp_path / "kept"))
    assert rows(results.of(query())) == rows(first) and modified(str(tmp_path / "kept")) == written
    assert not results.has(query(filters=Filters(state="Goa")))
    assert not results.has(query(period=Period.of("2023-01-01", "2023-12-30")))
    house.append("orders", facts(spark, [date(2023, 12, 24)], first=5000)["orders"])
    assert not results.has(query())
    assert rows(results.of(query())) == rows(query())
    results.forget(query())
    assert not results.has(query())
    results.of(query())
    results.clear()
    assert not results.has(query()) and not os.path.exists(tmp_path / "kept")
    frames = results.of(plain.orders("state").groupBy("state").count())
    assert frames.count() == 2
    other = spark.createDataFrame([(1, 2)], "a int, b int"), spark.createDataFrame([(1, 3)], "a int, b int")
    assert results.key(other[0]) != results.key(other[1])
    with pytest.raises(ValueError, match="not kept"):
        results.of(spark.range(3).withColumn("x", F.rand()))
