import glob
from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import dicts, rows
from tillwise import Filters, Period, registry
from tillwise.functions.measures import as_output
from tillwise.plans import catalog, report, sales
from tillwise.sources import sinks
from tillwise.sources.schemas import TABLES
from tillwise.sources.star import StarStore
from tillwise.sources.warehouse import Warehouse

SMALL = "/root/testdata/sf0.001"
YEAR = Period.of("2000-01-01", "2000-12-31")


@pytest.fixture(scope="module")
def star(spark):
    return StarStore(spark, SMALL)


@pytest.fixture(scope="module")
def warehouse(spark, star, tmp_path_factory):
    built = Warehouse(spark, str(tmp_path_factory.mktemp("ops")))
    assert sorted(built.create_missing(star)) == sorted(TABLES)
    return built


# Catalog.


def test_explore(spark, store):
    s = store(agents=[{"agent_id": k, "agent_name": f"A{k}", "team": "T"} for k in range(60)])
    assert catalog.explore(s, "agents", limit=50).count() == 50
    found = catalog.explore(s, "agents", "agent_id >= 58 AND team = 'T'", order_by=["agent_id"])
    assert [r["agent_name"] for r in dicts(found)] == ["A58", "A59"]
    assert found.columns == list(TABLES["agents"].columns)
    for table, condition, limit in [
        ("secrets", "", 50),
        ("agents", "no_such_column = 1", 50),
        ("agents", "agent_id = = 1", 50),
        ("agents", "", 0),
        ("agents", "reflect('java.lang.Math', 'abs', -1) = 1", 50),
    ]:
        with pytest.raises(catalog.ExplorerError):
            catalog.explore(s, table, condition, limit)
    # what cannot be converted or divided by is null
    for condition in ("CAST(agent_name AS INT) = 1", "agent_name = 5", "agent_id / 0 = 1", "agent_name::date = current_date()"):
        assert catalog.explore(s, "agents", condition).collect() == []
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"
    for condition in ("agent_id IN (SELECT 1)", "raise_error('x') IS NULL", "java_method('java.lang.Math', 'abs', -1) = 1", "agent_id = rand()"):
        with pytest.raises(catalog.ExplorerError):
            catalog.explore(s, "agents", condition)
    for condition in ("lower(agent_name) LIKE 'a5%'", "agent_id BETWEEN 50 AND 58 OR agent_id = 5 AND team IS NOT NULL", "substr(agent_name, 2, 1) = '5' AND length(agent_name) < 4 OR agent_name = 'A5'"):
        assert catalog.explore(s, "agents", condition).count() >= 10, condition
    assert catalog.explore(s, "agents", limit=5000).count() == 60
    assert catalog.explore(s, "agents", limit=7).count() == 7


def test_valid_period(store):
    s = store(orders=[{"order_date": "2024-01-05"}, {"order_date": "2024-03-01"}])
    assert catalog.valid_period(s, Period.of("2024-02-01", "2024-03-01")).end.month == 3
    with pytest.raises(ValueError, match="outside the data"):
        catalog.valid_period(s, Period.of("2024-02-01", "2024-03-02"))
    with pytest.raises(ValueError, match="no orders"):
        catalog.valid_period(store(), YEAR)


def test_a_missing_raw_column_is_an_error(spark, tmp_path):
    spark.range(1).selectExpr("1 AS n_nationkey", "'x' AS n_title", "1 AS n_regionkey").write.parquet(
        f"{tmp_path}/nation.parquet"
    )
    with pytest.raises(ValueError, match="no column n_name"):
        StarStore(spark, str(tmp_path)).states()


def test_a_bad_property_does_not_end_the_job(spark, tmp_path):
    spark.sql(
        "SELECT id AS event_id, TIMESTAMP_NTZ'2024-01-02' AS ts, id AS user_id, 'x' AS event_type, "
        "1.0D AS value, IF(id = 0, '{\"k\":\"bad\"}', '{\"k\":95}') AS props FROM range(2)"
    ).write.parquet(f"{tmp_path}/events.parquet")
    got = rows(StarStore(spark, str(tmp_path)).tickets("ticket_id", "priority", "status"))
    assert sorted(got) == [(0, None, None), (1, "Critical", "Resolved")]


def test_filter_options(store):
    s = store(
        orders=[
            {"state": "Goa", "zone": "West", "category": "Books"},
            {"state": "Bihar", "zone": "East", "category": "Books"},
        ],
        customers=[{"segment": "SME"}],
    )
    assert rows(catalog.filter_options(s)) == [
        ("category", 0, "All"),
        ("category", 1, "Books"),
        ("segment", 0, "All"),
        ("segment", 1, "SME"),
        ("state", 0, "All"),
        ("state", 1, "Bihar"),
        ("state", 2, "Goa"),
        ("zone", 0, "All"),
        ("zone", 1, "East"),
        ("zone", 2, "West"),
    ]


def test_key_quality(store):
    s = store(
        customers=[
            {"customer_id": 1, "full_name": "a"},
            {"customer_id": 1, "full_name": None},
            {"customer_id": 2, "full_name": "b"},
        ],
        orders=[{"order_id": 1, "customer_id": 7}, {"order_id": 2, "customer_id": 7}, {"order_id": 3}],
        tickets=[{"ticket_id": 1, "customer_id": 2}],
    )
    got = {(t, rule): n for t, rule, n in rows(catalog.key_quality(s))}
    assert got[("customers", "primary key customer_id")] == 1
    assert got[("customers", "not null full_name")] == 1
    assert got[("orders", "foreign key customer_id")] == 2  # a null refers to nothing
    assert got[("orders", "primary key order_id")] == 0
    assert got[("tickets", "foreign key customer_id")] == 0
    assert len(got) == 9


def test_bounds(star):
    [bounds] = dicts(catalog.period_bounds(star))
    assert YEAR.within(bounds["first_day"], bounds["last_day"]) == YEAR


# Warehouse.


def test_warehouse_holds_the_same_rows(star, warehouse):
    for name in TABLES:
        there, here = warehouse.read(name), star.read(name)
        assert there.dtypes == here.dtypes
        assert there.count() == here.count()
        assert there.exceptAll(here).count() == 0


@pytest.mark.parametrize("name", [n for n in registry.PLANS if n != "order_enrichment"])
def test_queries_agree_on_both_stores(star, warehouse, name):
    """All but the one that needs the star schema's list of states."""
    here, there = (as_output(registry.PLANS[name](s)) for s in (warehouse, star))
    assert here.columns == there.columns
    assert Counter(rows(here)) == Counter(rows(there))


def test_period_prunes_months(warehouse):
    df = warehouse.orders("final_amount", period=Period.of("2000-03-05", "2000-04-10"))
    read = {r[0] for r in rows(df.select(F.input_file_name()))}
    assert {path.split("year_month=")[1].split("/")[0] for path in read} == {"2000-03", "2000-04"}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year_month" in plan


def test_lookup_columns_have_bloom_filters(spark, tmp_path):
    """Parquet writes them where a column has outgrown its dictionary."""
    known = {
        "ticket_id": F.col("id"),
        "agent_id": F.xxhash64("id"),
        "created_date": F.to_date(F.lit("2024-05-01")),
    }
    columns = TABLES["tickets"].columns
    house = Warehouse(spark, str(tmp_path))
    house.append(
        "tickets",
        spark.range(0, 300000, 1, 1).select(
            *[known.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in columns.items()]
        ),
    )
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(house.tickets("agent_id").inputFiles()[0])
    file = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(
        path, spark._jsc.hadoopConfiguration()
    )
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(file)
    chunks = reader.getFooter().getBlocks()[0].getColumns()
    filtered = {c.getPath().toDotString(): c.getBloomFilterOffset() > 0 for c in chunks}
    reader.close()
    assert filtered["agent_id"] and not filtered["ticket_id"]
    assert house.tickets().where("agent_id = xxhash64(7L)").count() == 1


def test_create_is_done_once(spark, star, warehouse):
    before = sorted(glob.glob(f"{warehouse.root}/**/*.parquet", recursive=True))
    assert warehouse.create_missing(star) == []
    assert sorted(glob.glob(f"{warehouse.root}/**/*.parquet", recursive=True)) == before


def test_unfinished_table_is_refused(spark, star, tmp_path):
    (tmp_path / "agents" / "_temporary").mkdir(parents=True)
    with pytest.raises(RuntimeError, match="did not finish"):
        Warehouse(spark, str(tmp_path)).create_missing(star)


def test_append_and_rewrite(spark, store, tmp_path, frame):
    first = store(customers=[{"customer_id": 1, "full_name": "a", "tier": "Bronze"}])
    base = Warehouse(spark, str(tmp_path / "v1"))
    base.create_missing(first)
    base.append("customers", frame("customers", [{"customer_id": 2, "full_name": "b"}]))
    base.append("orders", frame("orders", [{"order_id": 5, "order_date": "2024-02-03"}]))
    assert sorted(rows(base.customers("customer_id"))) == [(1,), (2,)]
    assert rows(base.orders("order_id", period=Period.of("2024-02-01", "2024-02-29"))) == [(5,)]
    gold = base.customers().withColumn("tier", F.lit("Gold"))
    with pytest.raises(ValueError, match="new folder"):
        base.rewritten("customers", gold, base.root)
    after = base.rewritten("customers", gold, str(tmp_path / "v2"))
    assert sorted(rows(after.customers("customer_id", "tier"))) == [(1, "Gold"), (2, "Gold")]
    assert {r[0] for r in rows(base.customers("tier"))} == {"Bronze", None}
    assert rows(after.orders("order_id", period=Period.of("2024-02-01", "2024-02-29"))) == [(5,)]
    assert after.agents().count() == 0


def test_views(spark, warehouse):
    warehouse.register_views()
    found = spark.sql("SELECT count(*) FROM orders WHERE zone = :zone", args={"zone": "ASIA"})
    assert found.first()[0] > 0


# Reports and exports.


def test_bundle_on_staged_facts(spark, star, tmp_path):
    shared = report.staged(spark, star, YEAR, str(tmp_path / "staged"))
    bundle = report.report_bundle(shared, YEAR, Filters(category="PROMO"))
    direct = report.report_bundle(star, YEAR, Filters(category="PROMO"))
    for name in ("kpi_sheet", "top_states", "top_agents", "weekly_totals", "churn_bands"):
        assert rows(as_output(bundle[name])) == rows(as_output(direct[name])), name
    plan = bundle["top_categories"]._jdf.queryExecution().optimizedPlan().toString()
    assert "lineitem" not in plan and "category" in plan
    read = bundle["top_categories"]._jdf.queryExecution().executedPlan().toString()
    assert "payment_method" not in read and "PartitionFilters: [isnotnull(year_month" in read
    wanted = {k: bundle[k] for k in ("top_categories", "alerts")}
    paths = sinks.write_bundle(wanted, str(tmp_path / "report"))
    assert spark.read.parquet(paths[0]).count() == 5
    sinks.write_bundle(wanted, str(tmp_path / "csv"), fmt="csv")
    with pytest.raises(ValueError, match="expected parquet or csv"):
        sinks.write_bundle(wanted, str(tmp_path / "x"), fmt="xls")


def test_csv_export_is_ordered(spark, star, tmp_path):
    path = str(tmp_path / "orders")
    sinks.write_csv(
        sales.orders_export(star, YEAR),
        path,
        columns=["order_date", "order_id", "final_amount"],
        order_by=[F.desc("order_date"), "order_id"],
    )
    lines = []
    for part in sorted(glob.glob(f"{path}/part-*")):
        head, *body = open(part).read().splitlines()
        assert head == "order_date,order_id,final_amount"
        lines += body
    assert len(lines) == star.orders("order_id", period=YEAR).count()
    days = [line.split(",")[0] for line in lines]
    assert days == sorted(days, reverse=True)


def test_kept_results_are_released(spark):
    from tillwise.session import forget_all, kept

    with kept(spark.range(5)) as df:
        assert df.count() == 5 and df.is_cached
    assert not df.is_cached
    spark.range(3).cache().count()
    forget_all(spark)
    assert not spark.range(3).is_cached
