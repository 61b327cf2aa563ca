"""The store bucketed by customer: same results, no shuffle below joins, hot customers apart."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tillwise import Period, registry
from tillwise.functions.measures import as_output
from tillwise.plans import customers, kpis
from tillwise.sources.buckets import BUCKETED, CustomerBuckets
from tillwise.sources.schemas import TABLES
from tillwise.sources.star import StarStore
from tillwise.sources.store import FrameStore
from tillwise.sources.warehouse import Warehouse

SMALL = "/root/testdata/sf0.001"
YEAR = Period.of("2000-01-01", "2000-12-31")
BY_CUSTOMER = ["churn_risk", "customer_tiers", "cohort_retention_long", "top_customers", "kpi_summary", "report_return_benchmark"]


@pytest.fixture(scope="module")
def house(spark, tmp_path_factory):
    built = Warehouse(spark, str(tmp_path_factory.mktemp("ops")))
    built.create_missing(StarStore(spark, SMALL))
    return built


@pytest.fixture(scope="module")
def store(spark, house, tmp_path_factory):
    return CustomerBuckets.create(spark, str(tmp_path_factory.mktemp("buckets") / "store"), house, 4)


@pytest.fixture
def no_broadcast(spark):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def above(plan: str, scan: str) -> list[list[str]]:
    """For each scan whose line has ``scan``, the operators over it, the nearest first."""
    lines = [(len(re.match(r"[ :+\-*()\d]*", line).group()), line) for line in plan.splitlines() if line.strip()]
    paths = []
    for k, (depth, line) in enumerate(lines):
        if scan in line:
            path = []
            for d, over in reversed(lines[:k]):
                if d < depth:
                    depth = d
                    path.append(over)
            paths.append(path)
    return paths


@pytest.mark.parametrize("name", BY_CUSTOMER)
def test_no_shuffle_below_the_join(store, no_broadcast, name):
    assert not store.hot
    scans = above(physical(registry.PLANS[name](store)), "Bucketed: true")
    assert len(scans) >= 2
    for path in scans:
        joined = next((k for k, line in enumerate(path) if "Join" in line), len(path))
        # ratings and profiles of the ranked customers are looked up by their few keys
        looked_up = any("LeftSemi" in line for line in path[joined : joined + 1])
        assert looked_up or not any("Exchange" in line for line in path[:joined]), path


@pytest.mark.parametrize("name", [n for n in registry.PLANS if n != "order_enrichment"])
def test_same_results(house, store, name):
    here, there = (as_output(registry.PLANS[name](s)) for s in (store, house))
    assert here.columns == there.columns
    assert Counter(rows(here)) == Counter(rows(there))


@pytest.fixture(scope="module")
def skewed(spark):
    """A customer with a third of the orders, and orders of no customer."""
    n = 6000
    owner = F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.col("id") % 211)
    known = {
        "order_id": F.col("id"),
        "customer_id": owner,
        "order_date": F.date_add(F.lit(YEAR.start), (F.col("id") % 800).cast("int")),
        "final_amount": F.col("id") % 90,
        "order_status": F.element_at(F.array(*map(F.lit, ("Delivered", "Returned", "Processing"))), (F.col("id") % 3 + 1).cast("int")),
        "ticket_id": F.col("id"),
        "created_date": F.date_add(F.lit(YEAR.start), (F.col("id") % 300).cast("int")),
        "csat_score": F.col("id") % 5,
        "join_date": F.date_add(F.lit(YEAR.start), -(F.col("id") % 90).cast("int")),
        "status": F.lit("Churned"),
        "segment": F.concat(F.lit("S"), F.col("id") % 3),
        "tier": F.lit("Gold"),
    }

    def table(name, n):
        columns = TABLES[name].columns
        cells = {**known, "customer_id": F.col("id")} if name == "customers" else known
        return spark.range(0, n, 1, 4).select(*[cells.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in columns.items()])

    return FrameStore({name: table(name, {"customers": 250, "orders": n, "tickets": 900}.get(name, 0)) for name in TABLES})


def test_hot_customer_stands_apart(spark, skewed, tmp_path, no_broadcast):
    store = CustomerBuckets.create(spark, str(tmp_path / "store"), skewed, 8)
    assert store.hot == {7}
    sizes = rows(store.part("orders", False, ["customer_id"], None).groupBy(F.spark_partition_id()).count())
    assert max(n for _, n in sizes) < 6000 / 8 * 1.5
    assert store.part("orders", True, ["customer_id"], None).where("customer_id = 7").count() == sum(k % 3 == 0 or (k % 50 != 1 and k % 211 == 7) for k in range(6000))
    for plan in (
        lambda s: customers.churn_risk(s, YEAR),
        lambda s: customers.customer_tiers(s, YEAR),
        lambda s: customers.cohort_retention_long(s),
        lambda s: customers.top_customers(s, YEAR, limit=500),
        lambda s: kpis.kpi_summary(s, YEAR),
    ):
        assert Counter(rows(as_output(plan(store)))) == Counter(rows(as_output(plan(skewed))))
    # the hot customer's orders are one row a task before they are shuffled
    plan = physical(customers.churn_risk(store, YEAR))
    for path in above(plan, "orders_apart"):
        exchange = next(k for k, line in enumerate(path) if "Exchange" in line)
        assert any("Aggregate" in line for line in path[:exchange])


def test_another_session_finds_the_tables(spark, skewed, tmp_path):
    root = str(tmp_path / "store")
    CustomerBuckets.create(spark, root, skewed, 4)
    other = spark.newSession()
    for name in BUCKETED:
        spark.sql(f"DROP TABLE {CustomerBuckets(spark, root, skewed)._named(name)}")
    again = CustomerBuckets(other, root, FrameStore(skewed.frames))
    assert again.orders("order_id").count() == 6000
    assert "Bucketed: true" in physical(again.orders("customer_id").groupBy("customer_id").count())


def test_append_and_refused_folder(spark, skewed, tmp_path):
    root = str(tmp_path / "store")
    store = CustomerBuckets.create(spark, root, skewed, 4)
    store.append("orders", skewed.orders().where("order_id < 100").withColumn("order_id", F.col("order_id") + 10_000))
    assert store.orders("order_id").count() == 6100
    assert store.orders("order_id", period=YEAR).count() == skewed.orders("order_id", period=YEAR).count() + 100
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        CustomerBuckets.create(spark, root, skewed, 4)
