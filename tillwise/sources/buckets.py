"""Orders, tickets and customers bucketed by customer: what belongs to one customer is read
by one task, so joins and aggregations by customer need no shuffle.

A bucket is read by one task, so a customer with a large share of the rows must not be in
one. Hot customers, those with more than half a mean bucket's rows of a fact, stand apart in
tables without buckets, with the rows that have no customer; there are fewer than four for
each bucket. The two halves hold different customers: a plan that works customer by customer
runs on each and its rows are put together (``by_customer``). The other half aggregates
before it shuffles, as on any store.

Facts are partitioned by year and sorted by day inside a bucket, so a period prunes folders
and row groups. The number of buckets and the hot customers are kept beside the tables;
tables are known to the session's catalog by their folder.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwise.operators.selection import Period
from tillwise.sources.schemas import TABLES
from tillwise.sources.store import OpsStore

KEY = "customer_id"
BUCKETED = ("customers", "orders", "tickets")
YEAR = "fact_year"
#: A customer is hot from this share of a mean bucket's rows on.
HOT = 0.5


class CustomerBuckets(OpsStore):
    """The bucketed tables below ``root``; the other tables are those of ``base``."""

    def __init__(self, spark: SparkSession, root: str, base: OpsStore):
        self.spark, self.root, self.base = spark, root.rstrip("/"), base
        self.tier_thresholds = base.tier_thresholds

    @classmethod
    def create(cls, spark: SparkSession, root: str, base: OpsStore, buckets: int) -> CustomerBuckets:
        """Write the tables of ``base``. A folder that has any of them is an error."""
        store = cls(spark, root, base)
        hot = set()
        for name in ("orders", "tickets"):
            counts = base.read(name, KEY).groupBy(KEY).agg(F.count("*").alias("n"))
            total = counts.agg(F.sum("n")).first()[0] or 0
            hot |= {r[0] for r in counts.where(F.col("n") > HOT * total / buckets).select(KEY).collect()}
        layout = spark.createDataFrame([(buckets, sorted(hot - {None}))], "buckets INT, hot ARRAY<BIGINT>")
        for name in BUCKETED:
            store._write(name, base.read(name), buckets, hot - {None}, "errorifexists")
        # last, so that a store with a layout is whole
        layout.coalesce(1).write.parquet(f"{store.root}/_layout")
        return store

    @cached_property
    def _layout(self) -> tuple[int, frozenset]:
        buckets, hot = self.spark.read.schema("buckets INT, hot ARRAY<BIGINT>").parquet(f"{self.root}/_layout").first()
        return buckets, frozenset(hot)

    @property
    def buckets(self) -> int:
        return self._layout[0]

    @property
    def hot(self) -> frozenset:
        """The customers that stand apart."""
        return self._layout[1]

    def append(self, name: str, rows: DataFrame) -> None:
        """Add rows to a bucketed table. Which customers are hot stays as it was found."""
        self._write(name, rows.select(*TABLES[name].columns), self.buckets, self.hot, "append")

    def _write(self, name: str, rows: DataFrame, buckets: int, hot: set, mode: str) -> None:
        day = TABLES[name].date
        if day:
            rows = rows.withColumn(YEAR, F.year(day))
        apart = F.col(KEY).isNull() | F.col(KEY).isin(*hot)
        # one task for each bucket, by the hash that buckets are numbered by
        cold = rows.where(~apart).repartition(buckets, KEY)
        cold = cold.write.mode(mode).format("parquet").bucketBy(buckets, KEY).sortBy(day or KEY)
        hot_rows = rows.where(apart)
        hot_rows = (hot_rows.hint("rebalance", YEAR).sortWithinPartitions(YEAR, day) if day else hot_rows).write.mode(mode)
        if day:
            cold, hot_rows = cold.partitionBy(YEAR), hot_rows.partitionBy(YEAR)
        cold.option("path", f"{self.root}/{name}").saveAsTable(self._named(name))
        hot_rows.parquet(f"{self.root}/{name}_apart")

    def _named(self, name: str) -> str:
        """The table's name in the catalog, by its folder."""
        return f"tillwise_{zlib.crc32(self.root.encode()):08x}_{name}"

    def _struct(self, name: str) -> T.StructType:
        table = TABLES[name]
        return T.StructType([*table.struct.fields, *([T.StructField(YEAR, T.IntegerType())] if table.date else [])])

    def _bucketed(self, name: str) -> DataFrame:
        known = self._named(name)
        if not self.spark.catalog.tableExists(known):
            # another session wrote it
            day = TABLES[name].date
            columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in self._struct(name).fields)
            self.spark.sql(
                f"CREATE TABLE {known} ({columns}) USING parquet {f'PARTITIONED BY ({YEAR})' if day else ''} "
                f"CLUSTERED BY ({KEY}) SORTED BY ({day or KEY}) INTO {self.buckets} BUCKETS LOCATION '{self.root}/{name}'"
            )
            if day:
                self.spark.sql(f"MSCK REPAIR TABLE {known}")
        return self.spark.table(known)

    def part(self, name: str, hot: bool, columns: Sequence[str], period: Period | None) -> DataFrame:
        df = self.spark.read.schema(self._struct(name)).parquet(f"{self.root}/{name}_apart") if hot else self._bucketed(name)
        if period is not None:
            df = df.where(F.col(YEAR).between(period.start.year, period.end.year) & period.contains(TABLES[name].date))
        return df.select(*columns)

    def table(self, name: str, columns: tuple[str, ...], period: Period | None) -> DataFrame:
        if name not in BUCKETED:
            return self.base.table(name, columns, period)
        return self.part(name, False, columns, period).unionByName(self.part(name, True, columns, period))

    def customer_parts(self) -> Sequence[OpsStore]:
        """Rows without a customer have none to be joined with, and are none's."""
        return [Half(self, hot) for hot in ([False, True] if self.hot else [False])]


class Half(OpsStore):
    """The hot customers of a bucketed store, or the others, with all their facts."""

    def __init__(self, whole: CustomerBuckets, hot: bool):
        self.whole, self.hot = whole, hot
        self.tier_thresholds = whole.tier_thresholds

    def table(self, name: str, columns: tuple[str, ...], period: Period | None) -> DataFrame:
        if name not in BUCKETED:
            return self.whole.table(name, columns, period)
        return self.whole.part(name, self.hot, columns, period)
