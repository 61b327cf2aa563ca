"""Every registered query against its SQL statement, on the test data."""

import os

import pytest

import __spark_entry__ as entry
from compare import connect, differences
import oracles
from oracles import load_oracles
from tillwise import registry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_each_query_has_a_statement():
    assert set(registry.PLANS) <= set(entry.queries())
    assert set(registry.PLANS) == set(load_oracles())


def test_pivoted_columns_are_those_of_the_data(con):
    """The statements name their columns; these are the bounds of the data."""
    tables = (oracles.HERE / "_tables.sql").read_text()
    month = "12 * year({0}) + month({0})"
    settled = "FROM ops_orders WHERE order_status NOT IN ('Cancelled', 'Processing')"
    found = con.execute(
        f"""WITH {tables}
        SELECT (SELECT [min(year(order_date)), max(year(order_date))] FROM ops_orders),
               (SELECT list(DISTINCT segment ORDER BY segment) FROM ops_customers),
               (SELECT min({month.format("order_date")}) {settled}) - max({month.format("join_date")}),
               (SELECT max({month.format("order_date")}) {settled}) - min({month.format("join_date")})
        FROM ops_customers"""
    ).fetchone()
    assert found == (list(oracles.YEARS), list(oracles.SEGMENTS), oracles.PERIODS[0], oracles.PERIODS[-1])


def test_statements_can_be_views(con):
    for name, sql in load_oracles().items():
        con.execute(f"CREATE OR REPLACE TEMP VIEW checked_{name} AS {sql}")


@pytest.mark.parametrize("name", registry.PLANS)
def test_query_equals_its_statement(spark, con, name):
    df = entry.queries()[name](spark, SF_DIR)
    assert differences(df, con, entry.oracle_sql()[name]) is None


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 1
