"""Connected components of a link table, in Spark rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.llm.staging import Stages


def components(links: DataFrame, stages: Stages, name: str = "components") -> DataFrame:
    """node and component (its smallest node) of every node of the links (u, v).

    Large-star and small-star steps alternate until the links are stars around smallest
    nodes. A hub's links are never gathered: its smallest neighbour is a combined minimum,
    and the join that hands it out is split by AQE. Each round is a written table.
    """
    edges = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    edges, at = stages.write(edges, f"{name}-0"), 0
    before = _state(edges)
    while before[0]:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _starred(both, stages, f"{name}-near").where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
        large = stages.write(large.distinct(), f"{name}-large")
        small = _starred(large, stages, f"{name}-far")
        small = small.select(F.col("v").alias("u"), F.col("least").alias("v")).unionAll(small.select("u", F.col("least").alias("v")))
        edges, at = stages.write(small.where("u <> v").distinct(), f"{name}-{at + 1}"), at + 1
        stages.drop(f"{name}-{at - 1}")
        now = _state(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)


def _starred(edges: DataFrame, stages: Stages, name: str) -> DataFrame:
    """The edges with the smallest of u and its neighbours. The minima are a table of their
    own: AQE splits a join partition only where both sides come straight from a shuffle."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("least"))
    return edges.join(stages.write(least, name), "u")


def _state(edges: DataFrame) -> tuple[int, int]:
    """The number of edges and a mark that tells whether they changed, for any number of them."""
    row = edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
    return row[0], row[1]
