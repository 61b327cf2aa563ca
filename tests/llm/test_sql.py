"""The queries that have SQL statements, against them."""

import pytest

import __spark_entry__ as entry
from compare import connect, differences
from tillwise.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", queries.SQL)
def test_query_equals_its_statement(spark, name):
    con = connect(DATA)
    assert entry.oracle_sql()[name] == queries.SQL[name]
    con.execute(f"CREATE VIEW checked AS {queries.SQL[name]}")
    assert differences(entry.queries()[name](spark, DATA), con, queries.SQL[name]) is None
