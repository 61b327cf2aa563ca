"""Exports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame

from tillwise.functions.measures import as_output


def write_csv(
    df: DataFrame,
    path: str,
    columns: Sequence[str] | None = None,
    order_by: Sequence[str | Column] = (),
    mode: str = "errorifexists",
) -> None:
    """CSV with a header. An ordered export is range-partitioned by the sort keys, so
    its part files, read in name order, are the ordered whole; give enough keys that
    no single key value holds a large share of the rows."""
    df = df.orderBy(*order_by) if order_by else df
    df = df.select(*columns) if columns else df
    as_output(df).write.mode(mode).option("header", True).csv(path)


def write_bundle(
    datasets: Mapping[str, DataFrame], root: str, fmt: str = "parquet", mode: str = "errorifexists"
) -> list[str]:
    """Each dataset under its own name in one report folder; returns the paths."""
    paths = []
    for name, df in datasets.items():
        path = f"{root}/{name}"
        writer = as_output(df).write.mode(mode)
        if fmt == "csv":
            writer.option("header", True).csv(path)
        elif fmt == "parquet":
            writer.parquet(path)
        else:
            raise ValueError(f"format {fmt!r}: expected parquet or csv")
        paths.append(path)
    return paths
