"""Plan shapes and behaviour under skew."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import rows
from tillwise import Period, registry
from tillwise.functions.measures import as_output
from tillwise.plans import catalog, customers, kpis, sales
from tillwise.sources.schemas import TABLES
from tillwise.sources.star import StarStore
from tillwise.sources.store import FrameStore
from tillwise.sources.warehouse import Warehouse

SMALL = "/root/testdata/sf0.001"
YEAR = Period.of("2000-01-01", "2000-12-31")
PYTHON_NODES = ("PythonUDF", "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroups")


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


@pytest.mark.parametrize("name", registry.PLANS)
def test_plan_is_built_in_and_scales(spark, no_broadcast, name):
    """No Python, no pairing of all rows, and with broadcasts off none is forced."""
    plan = physical(entry.queries()[name](spark, SMALL))
    for node in PYTHON_NODES + ("CartesianProduct", "NestedLoopJoin", "Broadcast"):
        assert node not in plan, node


def test_period_and_columns_reach_the_scans(spark):
    plan = physical(entry.queries()["payment_analysis"](spark, SMALL))
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert len(scans) == 2  # lines and headers: no place, no product
    header = next(line for line in scans if "o_orderdate" in line)
    pushed = re.search(r"PushedFilters: \[[^\]]*", header).group()
    assert "o_orderdate" in pushed
    assert "o_totalprice" not in header and "c_name" not in plan


def test_top_k_is_not_a_full_sort(spark):
    assert "TakeOrderedAndProject" in physical(entry.queries()["product_top30"](spark, SMALL))


# One customer holds a third of the orders and of the tickets.


@pytest.fixture(scope="module")
def skewed(spark):
    n = 30000
    hot = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 997)
    day = F.date_add(F.lit(YEAR.start), (F.col("id") % 366).cast("int"))
    orders = spark.range(n).select(
        F.col("id").alias("order_id"),
        hot.alias("customer_id"),
        day.alias("order_date"),
        (F.col("id") % 1000).cast("decimal(12,2)").alias("final_amount"),
        F.lit(1).cast("decimal(12,2)").alias("discount"),
        F.lit(2).cast("decimal(12,2)").alias("gst_amount"),
        F.lit(3).alias("delivery_days"),
        F.lit("Delivered").alias("order_status"),
        F.concat(F.lit("S"), F.col("id") % 5).alias("state"),
    )
    tickets = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 997).alias("customer_id"),
        day.alias("created_date"),
        F.lit("Resolved").alias("status"),
        F.lit(4).cast("decimal(3,1)").alias("csat_score"),
    )
    people = spark.range(997).select(
        F.col("id").alias("customer_id"),
        F.lit("SME").alias("segment"),
        *[F.lit("x").alias(c) for c in ("full_name", "city", "state", "tier", "age_group", "status")],
    )
    return FrameStore({"orders": orders, "tickets": tickets, "customers": people})


def brute(skewed):
    got = {}
    for r in skewed.frames["orders"].select("customer_id", "final_amount").collect():
        got.setdefault(r[0], []).append(r[1])
    return got


def test_hot_customer_in_kpis(skewed):
    by_customer = brute(skewed)
    [row] = [r.asDict() for r in kpis.kpi_summary(skewed, YEAR).collect()]
    assert row["orders"] == sum(len(v) for v in by_customer.values())
    assert row["customers"] == len(by_customer)
    assert row["gmv"] == float(sum(sum(v) for v in by_customer.values()))


def test_hot_customer_meets_the_fanout_as_one_row(skewed):
    got = customers.top_customers_fanout(skewed, YEAR, limit=1)
    tickets = skewed.frames["tickets"].where("customer_id = 0").count()
    amounts = brute(skewed)[0]
    assert rows(got.select("orders", "lifetime_value")) == [
        (len(amounts), sum(amounts) * tickets)
    ]
    # No join reads the orders or the tickets before they are aggregated by customer.
    for line in physical(got).splitlines():
        if "Join" in line:
            assert "final_amount" not in line and "csat_score" not in line


def test_orphans_of_a_hot_key_are_counted_by_row(spark, skewed):
    empty = {name: spark.createDataFrame([], t.struct) for name, t in TABLES.items()}
    tickets = skewed.frames["tickets"].withColumn("ticket_id", F.monotonically_increasing_id())
    few = FrameStore({**empty, **skewed.frames, "tickets": tickets, "customers": skewed.frames["customers"].where("customer_id > 0")})
    found = catalog.key_quality(few)
    got = {(t, rule): n for t, rule, n in rows(found)}
    assert got["orders", "foreign key customer_id"] == len(brute(skewed)[0])
    # One shuffle by key, what a task has of a key being one row before it.
    plan = physical(catalog.key_quality(few))
    assert plan.count("Exchange hashpartitioning(space") == 1
    before = plan.split("Exchange hashpartitioning(space")[1]
    assert "HashAggregate" in before.split("Union")[0]


def test_distinct_customers_are_counted_in_two_steps(skewed):
    plan = physical(sales.state_performance(skewed, YEAR))
    assert "hashpartitioning(state" in plan
    assert "keys=[state#" in plan and "customer_id#" in plan.split("partial_sum(final_amount")[0]


def test_hot_join_key_is_split(spark, tmp_path):
    """AQE cuts the partition of an order that has a third of the lines."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    before = {k: spark.conf.get(k, None) for k in conf}

    class Hot(StarStore):
        def raw(self, name):
            df = super().raw(name)
            if name == "lineitem":
                spread = df.repartition(16, "l_partkey", "l_suppkey")
                hot = F.when(F.col("l_partkey") % 3 == 0, F.lit(7)).otherwise(F.col("l_orderkey"))
                df = spread.withColumn("l_orderkey", hot.cast("bigint"))
            return df

    for key, value in conf.items():
        spark.conf.set(key, value)
    try:
        df = as_output(sales.revenue_daily(Hot(spark, "/root/testdata/sf0.01"), Period.of("1995-01-01", "2001-12-31")))
        df.collect()
        plan = physical(df)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    assert "SortMergeJoin(skew=true)" in plan


def test_hot_month_is_written_by_several_tasks(spark, tmp_path):
    """A month with nearly all rows becomes several files, cold months one each."""
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    day = F.when(
        F.col("id") % 50 == 0, F.date_add(F.lit(YEAR.start), (F.col("id") % 100).cast("int"))
    ).otherwise(F.lit(YEAR.end))
    known = {"order_id": F.xxhash64("id"), "order_date": day}
    orders = spark.range(0, 40000, 1, 8).select(
        *[
            known.get(name, F.lit(None)).cast(kind).alias(name)
            for name, kind in TABLES["orders"].columns.items()
        ]
    )
    spark.conf.set(key, "65536")
    try:
        house = Warehouse(spark, str(tmp_path))
        house.append("orders", orders)
    finally:
        spark.conf.set(key, before)
    files = house.orders("order_id").inputFiles()
    assert len([f for f in files if "year_month=2000-12" in f]) > 1
    assert len([f for f in files if "year_month=2000-02" in f]) == 1
    assert house.orders("order_id").distinct().count() == 40000
