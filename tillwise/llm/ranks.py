"""Places of rows within their groups, found without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwise.llm.staging import Stages

#: monotonically_increasing_id has the partition in the bits above these.
ROW_BITS = 33


def row_number(rows: DataFrame) -> DataFrame:
    """A different number `row` for each row, which splits ties when rows are dealt out."""
    return rows.withColumn("row", F.monotonically_increasing_id())


def ranked(stages: Stages, name: str, rows: DataFrame, group: str, order: list[str | Column]) -> DataFrame:
    """`rows` with `pos`, the place from 0 within `group` (never null) by `order`, and `n`,
    the group's size. `order` has to be without ties.

    Rows are dealt out by ranges of (group, order), so a group of any size is spread. Each
    task numbers its rows; the numbers of rows that a group has in earlier tasks are added.
    These counts have a row for each group and task that holds it.
    """
    laid = (
        rows.repartitionByRange(F.col(group), *order)
        .sortWithinPartitions(F.col(group), *order)
        .withColumn("laid", F.monotonically_increasing_id())
    )
    laid = stages.write(laid, f"{name}-laid").withColumn("part", F.shiftright("laid", ROW_BITS))
    counts = laid.groupBy(group, "part").agg(F.count("*").alias("rows"), F.min("laid").alias("first"))
    whole = Window.partitionBy(group)
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        group,
        "part",
        (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("rows").over(whole).alias("n"),
    )
    counts = stages.write(counts, f"{name}-counts")
    return laid.join(counts, [group, "part"]).withColumn("pos", F.col("laid") + F.col("shift")).drop("laid", "part", "shift")
