from datetime import date

import pandas as pd
from pyspark.sql import functions as F

from conftest import dicts, rows
from tillwise import Period
from tillwise.operators import shaping
from tillwise.plans import sales
from tillwise.sources.star import StarStore

YEAR = Period.of("2023-01-01", "2024-12-31")


def daily_orders():
    days = ["2023-12-30", "2023-12-31", "2024-01-01", "2024-01-25", "2024-05-07"]
    return [
        {"order_date": d, "final_amount": 10 * (i + 1), "discount": 1, "gst_amount": 2, "order_status": "Shipped"}
        for i, d in enumerate(days)
    ]


def check_against_resample(spark_rows, rule):
    frame = pd.DataFrame(daily_orders())
    frame["date"] = pd.to_datetime(frame["order_date"])
    expected = frame.set_index("date").resample(rule).agg({"final_amount": "sum", "order_status": "count"})
    got = [(r["date"], float(r["revenue"]), r["orders"]) for r in spark_rows]
    assert got == [
        (day.date(), float(a), n)
        for day, a, n in zip(expected.index, expected["final_amount"], expected["order_status"])
    ]


def test_weekly_fill_is_resample(store):
    s = store(orders=daily_orders())
    got = sorted(dicts(sales.revenue_weekly_filled(s, YEAR)), key=lambda r: r["date"])
    assert any(r["orders"] == 0 for r in got)
    check_against_resample(got, "W")


def test_monthly_fill_is_resample(store):
    s = store(orders=daily_orders())
    got = sorted(dicts(sales.revenue_monthly_filled(s, YEAR)), key=lambda r: r["date"])
    assert [r["orders"] for r in got] == [2, 2, 0, 0, 0, 1]
    check_against_resample(got, "ME")


def test_buckets_add_up_to_the_days(store):
    s = store(orders=daily_orders())
    total = sales.revenue_daily(s, YEAR).agg(F.sum("revenue"), F.sum("orders")).first()
    for plan in (sales.revenue_weekly_filled, sales.revenue_monthly_filled):
        assert plan(s, YEAR).agg(F.sum("revenue"), F.sum("orders")).first() == total


def test_empty_period_gives_no_buckets(store):
    assert rows(sales.revenue_weekly_filled(store(orders=daily_orders()), Period.of("2020-01-01", "2020-12-31"))) == []


def test_top_breaks_ties_by_key(spark):
    df = spark.createDataFrame([("b", 5), ("a", 5), ("c", 9), ("d", 5)], "k string, v int")
    assert rows(shaping.top(df, 3, "v", "k")) == [("c", 9), ("a", 5), ("b", 5)]
    assert rows(shaping.last_of(df, 2, "k")) == [("c", 9), ("d", 5)]


def test_shares(spark):
    df = spark.createDataFrame([("a", 1), ("b", 3)], "k string, v int")
    assert rows(df.select("k", shaping.share_of_total("v"))) == [("a", 25.0), ("b", 75.0)]
    assert rows(df.select("k", shaping.share_of_max("v")))[1] == ("b", 100.0)
    zero = df.withColumn("v", F.lit(0))
    assert rows(zero.select(shaping.share_of_max("v"))) == [(None,), (None,)]


def test_complete_domain_adds_absent_values(spark):
    df = spark.createDataFrame([("Mon", 4)], "d string, v int")
    full = shaping.complete_domain(df, "d", ["Mon", "Tue"]).groupBy("d").agg(F.sum("v").alias("v"))
    assert rows(shaping.in_domain_order(full, "d", ["Tue", "Mon"])) == [("Tue", None), ("Mon", 4)]


def test_dow_profile_means_daily_totals(store):
    base = {"order_status": "Delivered"}
    s = store(
        orders=[
            {**base, "order_date": "2024-01-01", "final_amount": 10},
            {**base, "order_date": "2024-01-01", "final_amount": 20},
            {**base, "order_date": "2024-01-08", "final_amount": 6},
            {**base, "order_date": "2024-01-09", "final_amount": 5, "order_status": "Cancelled"},
        ]
    )
    got = rows(sales.dow_profile(s, YEAR))
    assert got[0] == ("Mon", 18.0, 1.5)
    assert got[1:] == [(d, None, None) for d in ("Tue", "Wed", "Thu", "Fri", "Sat", "Sun")]
    months = rows(sales.month_profile(s, YEAR))
    assert months == [("Jan", 18.0, 1)]


def test_new_year_week_splits(store):
    s = store(orders=daily_orders())
    got = rows(sales.weekly_ops(s).select("week", "orders"))
    assert got == [("2023-W52", 2), ("2024-W01", 1), ("2024-W04", 1), ("2024-W19", 1)]


def test_days_without_rows_do_not_cost_a_week(spark, store):
    """A store may name days on which it turns out to have no orders."""
    s = store(orders=daily_orders())
    every = spark.sql("SELECT explode(sequence(DATE'2023-12-01', DATE'2024-12-31')) AS day")
    s.days = lambda name: every
    got = rows(sales.weekly_ops(s, weeks=3).select("week", "orders"))
    assert got == [("2024-W01", 1), ("2024-W04", 1), ("2024-W19", 1)]
    assert len(rows(sales.weekly_ops(s, weeks=50))) == 4
    assert rows(sales.weekly_ops(store())) == []


def test_only_the_newest_weeks_are_read(spark):
    plan = sales.weekly_ops(StarStore(spark, "/root/testdata/sf0.001"), weeks=2)
    scans = plan._jdf.queryExecution().executedPlan().toString().splitlines()
    header = next(line for line in scans if "FileScan" in line and "o_orderdate" in line)
    assert "o_orderdate" in header.split("PushedFilters")[1]


def test_complete_weeks_only(store):
    days = ["2023-12-31", "2024-01-07", "2024-01-09"]
    s = store(orders=[{"order_date": d, "final_amount": 1, "order_status": "Shipped"} for d in days])
    assert [r[0] for r in rows(sales.weekly_ops(s).select("week"))][-1] == "2024-W02"
    complete = rows(sales.weekly_ops(s, complete_weeks_only=True).select("week"))
    assert complete == [("2023-W52",), ("2024-W01",)]


def test_yoy_wide(store):
    s = store(
        orders=[
            {"order_date": date(2023, 3, 5), "final_amount": 5, "order_status": "Shipped"},
            {"order_date": date(2024, 3, 9), "final_amount": 7, "order_status": "Shipped"},
            {"order_date": date(2024, 4, 9), "final_amount": 8, "order_status": "Processing"},
        ]
    )
    got = dicts(sales.yoy_wide(s, [2022, 2023, 2024]))
    assert [(r["month"], r["2022"], int(r["2023"]), int(r["2024"])) for r in got] == [
        ("Mar", None, 5, 7)
    ]
    assert sales.yoy_wide(s).columns == ["month_num", "month", "2023", "2024"]
    assert sales.yoy_wide(store()).columns == ["month_num", "month"]
