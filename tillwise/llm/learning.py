"""Which rows a model learns from, and held-out splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """The fold of a document: the CRC-32 of its id as text; a null id is in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0))


def unit(*keys: Column, seed: int) -> Column:
    """A draw from 0 to 1 by the 64-bit hash of the keys: the same on every run, and fine
    enough that a sample of any table has its share."""
    return F.xxhash64(F.lit(seed), *keys).cast("double") / F.lit(2.0**64) + F.lit(0.5)


def bounded_sample(rows: DataFrame, key: Column, most: int, seed: int = 7) -> DataFrame:
    """All rows if there are at most `most`; else 0.9 * most of them on average, picked by a
    hash of `key`, one row for each key: the same rows on every run, whatever the
    partitioning. `key` being a column of a joined table, the pick is made before the join."""
    n = rows.count()
    if n <= most:
        return rows
    drawn = rows.withColumn("sample draw", unit(key, seed=seed)).where(F.col("sample draw") < 0.9 * most / n)
    first = F.min_by(F.struct(*rows.columns), F.xxhash64(*rows.columns))
    return drawn.groupBy("sample draw").agg(first.alias("row")).select("row.*")
