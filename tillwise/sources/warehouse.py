"""The operations tables as Parquet, written once and read by every plan.

Facts are laid out by month of their date, so a period prunes directories, and
sorted by date inside each file, so it prunes row groups as well. Bloom filters on the
lookup columns (customer, state, agent) prune row groups for an equality filter. The
orders table is denormalised here: after that no plan repeats the star-schema joins.

Beside orders and tickets stands a daily roll-up of each (``rollups``), by month as well.
Time series and mixes read it instead of the fact, and so does the search for the newest
weeks. An append writes the roll-up of the touched months anew.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwise.operators.selection import NO_FILTERS, Period
from tillwise.sources.rollups import BUYERS, ROLLUPS
from tillwise.sources.schemas import TABLES
from tillwise.sources.store import OpsStore

MONTH = "year_month"
TIERS = "_tier_thresholds"
#: Folders of a fact's daily roll-up, and of the months it has to be brought up to date for.
ROLLED, PENDING = "_daily_", "_pending_"
#: That of the customers who bought.
BOUGHT = "_buyers_"
#: Tables without a date stand in folders by a hash of their key, which an update replaces.
SLICE, SLICES = "key_slice", 16


class Warehouse(OpsStore):
    """Reads ``<root>/<table>``; tables not there are those of ``base``, if given."""

    def __init__(self, spark: SparkSession, root: str, base: OpsStore | None = None):
        self.spark, self.root, self.base = spark, root, base

    @cached_property
    def tier_thresholds(self):
        """Those of the store that the tables were made from, kept beside them."""
        if self.base is not None:
            return self.base.tier_thresholds
        if not self._there(TIERS):
            return OpsStore.tier_thresholds
        kept = self.spark.read.schema("tier STRING, threshold DOUBLE").parquet(self.path(TIERS))
        return dict(map(tuple, kept.collect()))

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        """Whether the table was written in full. A folder that a failed job left
        without its success mark is an error: it must not pass for the table."""
        if not self._there(name):
            return False
        if not self._there(f"{name}/_SUCCESS"):
            raise RuntimeError(f"{self.path(name)} has no _SUCCESS mark: its write did not finish")
        return True

    def _there(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _delete(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def create_missing(self, source: OpsStore) -> list[str]:
        """Write the tables that are not there yet; returns their names."""
        missing = [name for name in TABLES if not self.exists(name)]
        for name in missing:
            self._write(name, source.read(name), "errorifexists")
        for name in ROLLUPS:
            self.refresh(name)
        if not self._there(TIERS):
            steps = [(tier, float(least)) for tier, least in source.tier_thresholds.items()]
            steps = self.spark.createDataFrame(steps, "tier STRING, threshold DOUBLE")
            steps.coalesce(1).write.parquet(self.path(TIERS))
        return missing

    def append(self, name: str, rows: DataFrame) -> None:
        """Add rows. Of the fact's roll-up only the months of these rows are written anew."""
        rows = rows.select(*TABLES[name].columns)
        if name not in ROLLUPS or not self.exists(name):
            self._write(name, rows, "append")
            self.refresh(name)
            return
        months = [m for (m,) in rows.select(self._month(name)).distinct().collect()]
        # Until the mark is gone, the roll-up is not read: see ``rolled_up``.
        mark = self.spark.createDataFrame([(m,) for m in months], f"{MONTH} STRING")
        mark.coalesce(1).write.mode("append").parquet(self.path(PENDING + name))
        self._write(name, rows, "append")
        self.refresh(name)

    def refresh(self, name: str) -> list[str | None]:
        """Bring a roll-up up to date: all of it if there is none, else the months that an
        append left a mark for, also one that was broken off. Returns these months."""
        if name not in ROLLUPS or not self.exists(name):
            return []
        whole = not self._there(f"{ROLLED + name}/_SUCCESS")
        months = None
        if not whole:
            if not self._there(PENDING + name):
                return []
            months = [m for (m,) in self.spark.read.schema(f"{MONTH} STRING").parquet(self.path(PENDING + name)).distinct().collect()]
        fact = self.spark.read.schema(self._schema(name)).parquet(self.path(name))
        if months is not None:
            here = F.col(MONTH).isin([m for m in months if m is not None])
            fact = fact.where(here | F.col(MONTH).isNull() if None in months else here)
        # the roll-up last: that it was written says that all of it was
        for folder, kept in ((BOUGHT, BUYERS), (ROLLED, ROLLUPS[name])):
            if folder == ROLLED or name == "orders":
                writer = kept.partial(fact, MONTH).repartition(MONTH).write.mode("overwrite").partitionBy(MONTH)
                if not whole:
                    writer = writer.option("partitionOverwriteMode", "dynamic")
                writer.parquet(self.path(folder + name))
        self._delete(PENDING + name)
        return sorted(months or [], key=str)

    def rolled_up(self, name: str) -> bool:
        """Whether the fact has a roll-up that is up to date."""
        return self.exists(name) and self._there(f"{ROLLED + name}/_SUCCESS") and not self._there(PENDING + name)

    def _rollup(self, name: str, period: Period | None) -> DataFrame:
        fact = {f.name: f.dataType for f in self._schema(name).fields}
        rollup = ROLLUPS[name]
        fields = [T.StructField(c, fact[c]) for c in rollup.split]
        for m in {m.kept: m for m in rollup.measures.values()}.values():
            kind = fact.get(m.value, T.LongType())
            if m.kind == "count" or isinstance(kind, T.IntegerType):
                kind = T.LongType()
            elif isinstance(kind, T.DecimalType):
                kind = T.DecimalType(kind.precision + 10, kind.scale)
            fields.append(T.StructField(m.kept, kind))
        kept = self.spark.read.schema(T.StructType([*fields, T.StructField(MONTH, T.StringType())])).parquet(self.path(ROLLED + name))
        return kept if period is None else kept.where(self._inside(name, period))

    def totals(self, name, by, measures, filters=NO_FILTERS, chosen=(), keep=None, period=None):
        """From the roll-up, whose rows are few, where it is up to date."""
        if not self.rolled_up(name):
            return super().totals(name, by, measures, filters, chosen, keep, period)
        kept = self._rollup(name, period).where(filters.on(*chosen))
        return ROLLUPS[name].combined(kept if keep is None else kept.where(keep), by, measures)

    def placed_buyers(self, by, filters, chosen, period):
        """From merged bitmaps. A filter on anything but a place asks for the orders."""
        active = filters.active(*chosen)
        if by not in BUYERS.split or not set(active) <= set(BUYERS.split) or not self.rolled_up("orders"):
            return None
        fact = {f.name: f.dataType for f in self._schema("orders").fields}
        fields = [T.StructField(c, fact[c]) for c in (*BUYERS.split, MONTH)]
        fields += [T.StructField("bucket", T.LongType()), T.StructField("buyers", T.BinaryType())]
        kept = self.spark.read.schema(T.StructType(fields)).parquet(self.path(BOUGHT + "orders"))
        if period is not None:
            kept = kept.where(self._inside("orders", period))
        return BUYERS.counted(kept.where(filters.on(*active)), by)

    def days(self, name: str) -> DataFrame:
        if name not in ROLLUPS or not self.rolled_up(name):
            return super().days(name)
        return self._rollup(name, None).select(F.col(TABLES[name].date).alias("day"))

    def has_days_exactly(self, name: str) -> bool:
        return name in ROLLUPS and self.rolled_up(name)

    def update(self, name: str, changes: DataFrame) -> list[int]:
        """Give rows of a table without a date new values: ``changes`` has its key, once each,
        and the columns to change; keys that the table lacks are passed over. Only the folders
        with a row that really changes are written anew, and put in place once all are
        written, so that an update that fails leaves the table as it was. Returns these
        folders' numbers."""
        table = TABLES[name]
        if table.date or not self.exists(name):
            raise ValueError(f"{name} is not a table here that rows are updated in")
        key, changed = table.primary_key, [c for c in changes.columns if c != table.primary_key]
        unknown = set(changed) - set(table.columns)
        if key not in changes.columns or not changed or unknown:
            raise ValueError(f"changes need {key} and columns of {name}; unknown: {sorted(unknown)}")
        if changes.groupBy(key).count().where("count > 1").limit(1).count():
            raise ValueError(f"changes have a {key} more than once")
        new = changes.select(key, *[F.col(c).cast(table.columns[c]).alias(f"new_{c}") for c in changed], F.lit(True).alias("hit"))
        rows = self.spark.read.schema(self._schema(name)).parquet(self.path(name))
        differs = reduce(Column.__or__, [~F.col(c).eqNullSafe(F.col(f"new_{c}")) for c in changed])
        slices = [k for (k,) in rows.join(new, key).where(differs).select(SLICE).distinct().orderBy(SLICE).collect()]
        if slices:
            rows = rows.where(F.col(SLICE).isin(slices)).join(new, key, "left")
            rows = rows.withColumns({c: F.when(F.col("hit"), F.col(f"new_{c}")).otherwise(F.col(c)) for c in changed})
            writer = rows.select(*table.columns, SLICE).hint("rebalance", SLICE).write.mode("overwrite")
            writer.option("partitionOverwriteMode", "dynamic").partitionBy(SLICE).parquet(self.path(name))
        return slices

    def rewritten(self, name: str, rows: DataFrame, root: str) -> Warehouse:
        """Write an updated table under a new root, which must not be this one: the rows
        are usually derived from the files they replace. The store returned has the new
        table and all others of this one."""
        if root.rstrip("/") == self.root.rstrip("/"):
            raise ValueError("an updated table goes to a new folder")
        target = Warehouse(self.spark, root, base=self)
        target._write(name, rows.select(*TABLES[name].columns), "errorifexists")
        return target

    def register_views(self) -> None:
        for name in TABLES:
            self.read(name).createOrReplaceTempView(name)

    def _schema(self, name: str) -> T.StructType:
        table = TABLES[name]
        fields = list(table.struct.fields)
        fields.append(T.StructField(MONTH, T.StringType()) if table.date else T.StructField(SLICE, T.IntegerType()))
        return T.StructType(fields)

    def _write(self, name: str, rows: DataFrame, mode: str) -> None:
        day = TABLES[name].date
        if day is None:
            rows = rows.withColumn(SLICE, F.pmod(F.xxhash64(TABLES[name].primary_key), F.lit(SLICES)).cast("int"))
            rows.hint("rebalance", SLICE).write.mode(mode).partitionBy(SLICE).parquet(self.path(name))
            return
        # Rebalancing gathers a month into few files and splits a large month, or a
        # hot one, into several, by map blocks rather than by value.
        rows = rows.withColumn(MONTH, self._month(name)).hint("rebalance", MONTH)
        writer = rows.sortWithinPartitions(MONTH, day).write.mode(mode).partitionBy(MONTH)
        writer = writer.option("parquet.bloom.filter.adaptive.enabled", "true")
        for column in TABLES[name].lookups:
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        writer.parquet(self.path(name))

    def table(self, name: str, columns: tuple[str, ...], period: Period | None) -> DataFrame:
        if self.base is not None and not self.exists(name):
            return self.base.table(name, columns, period)
        df = self.spark.read.schema(self._schema(name)).parquet(self.path(name))
        if period is not None:
            df = df.where(self._inside(name, period))
        return df.select(*columns)

    def counted(self, name: str) -> DataFrame:
        """From the footers of the files: the second version of the Parquet source counts
        there, where ``spark.sql.parquet.aggregatePushdown`` is on."""
        if self.base is not None and not self.exists(name):
            return self.base.counted(name)
        key = "spark.sql.sources.useV1SourceList"
        before = self.spark.conf.get(key)
        self.spark.conf.set(key, ",".join(x for x in before.split(",") if x != "parquet"))
        try:
            # the source is chosen here, and stays what it is
            rows = self.spark.read.schema(self._schema(name)).parquet(self.path(name))
        finally:
            self.spark.conf.set(key, before)
        # sums of no footers' counts would be null
        return self._counts(name, rows) if rows.inputFiles() else super().counted(name)

    @staticmethod
    def _month(name: str) -> Column:
        return F.date_format(TABLES[name].date, "yyyy-MM").alias(MONTH)

    @staticmethod
    def _inside(name: str, period: Period) -> Column:
        months = F.col(MONTH).between(f"{period.start:%Y-%m}", f"{period.end:%Y-%m}")
        return months & period.contains(TABLES[name].date)


class WindowStore(OpsStore):
    """Some facts for one window of days from a near store, everything else from afar."""

    def __init__(self, near: OpsStore, names: tuple[str, ...], window: Period, far: OpsStore):
        self.near, self.names, self.window, self.far = near, names, window, far
        self.tier_thresholds = far.tier_thresholds

    def _holder(self, name: str, period: Period | None) -> OpsStore:
        inside = name in self.names and period is not None and self.window.covers(period)
        return self.near if inside else self.far

    def table(self, name: str, columns: tuple[str, ...], period: Period | None) -> DataFrame:
        return self._holder(name, period).table(name, columns, period)

    def totals(self, name, by, measures, filters=NO_FILTERS, chosen=(), keep=None, period=None):
        return self._holder(name, period).totals(name, by, measures, filters, chosen, keep, period)

    def days(self, name: str) -> DataFrame:
        return self.far.days(name)

    def has_days_exactly(self, name: str) -> bool:
        return self.far.has_days_exactly(name)

    def placed_buyers(self, by, filters, chosen, period):
        return self._holder("orders", period).placed_buyers(by, filters, chosen, period)
