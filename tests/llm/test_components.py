from tillwise.llm import components


def test_the_mark_has_no_upper_number_of_edges(spark):
    edges = spark.range(1 << 25).selectExpr("id + 1 AS u", "0L AS v")
    count, mark = components._state(edges)
    assert count == 1 << 25
    assert components._state(edges) == (count, mark)
    assert components._state(edges.selectExpr("u", "IF(u = 7, 1L, v) AS v")) != (count, mark)
    assert components._state(edges.limit(0)) == (0, 0)
