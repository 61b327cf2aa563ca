"""Session settings and durable staging."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # Recording the call site of every column expression costs more than the
    # analysis of the plan.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # Counts of whole tables come from the footers of their files (``Warehouse.counted``).
    "spark.sql.parquet.aggregatePushdown": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # One order, customer or part may own a large share of the rows. AQE cuts such
    # a join partition by map blocks, so the hot key is read by many tasks.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Cut it even where a later aggregation by the same key then needs a shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
}


def build_session(
    app: str = "tillwise", master: str | None = None, **extra: str
) -> SparkSession:
    """A session with the settings the plans rely on; the master is left to
    spark-submit unless one is given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@contextmanager
def kept(df: DataFrame) -> Iterator[DataFrame]:
    """Keep a result that several queries read, for the length of a ``with`` block.
    Lost parts are computed again; what does not fit in memory goes to disk."""
    df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield df
    finally:
        df.unpersist()


class Results:
    """Results kept as Parquet below a folder, found again by what they are computed from.

    A result's key is its plan, with all arguments, and the name, length and time of each
    file that the plan reads. The same query on the same files is read back instead of
    computed, by any session; files that were added or replaced make it another key. Plans
    whose rows may change from run to run are refused.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def of(self, df: DataFrame) -> DataFrame:
        """The rows of ``df``, computed if they are not there yet."""
        path = f"{self.folder}/{self.key(df)}"
        if not self._there(f"{path}/_SUCCESS"):
            df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def has(self, df: DataFrame) -> bool:
        return self._there(f"{self.folder}/{self.key(df)}/_SUCCESS")

    def forget(self, df: DataFrame) -> None:
        """Drop one result; the next ``of`` computes it again."""
        self._delete(f"{self.folder}/{self.key(df)}")

    def clear(self) -> None:
        """Drop all results."""
        self._delete(self.folder)

    def key(self, df: DataFrame) -> str:
        plan = df._jdf.queryExecution().analyzed()
        if not plan.deterministic():
            raise ValueError("the result may change from run to run: it is not kept")
        setting = "spark.sql.debug.maxToStringFields"
        before = self.spark.conf.get(setting)
        # the text of a plan names all its columns and expressions only so
        self.spark.conf.set(setting, str(1 << 20))
        try:
            text = plan.canonicalized().toString()
        finally:
            self.spark.conf.set(setting, before)
        told = [text, str(df.semanticHash()), df.schema.json(), *self._files(df)]
        return hashlib.sha256("\n".join(told).encode()).hexdigest()

    def _files(self, df: DataFrame) -> list[str]:
        """Name, length and time of the files read, a listing for each of their folders."""
        files = set(df.inputFiles())
        found = []
        for folder in sorted({name.rsplit("/", 1)[0] for name in files}):
            path = self._path(folder)
            for status in path.getFileSystem(self._conf()).listStatus(path):
                name = status.getPath().toUri().getRawPath()
                if not name.rsplit("/", 1)[-1].startswith(("_", ".")):
                    found.append(f"{name} {status.getLen()} {status.getModificationTime()}")
        return sorted(found)

    def _conf(self):
        return self.spark._jsc.hadoopConfiguration()

    def _path(self, name: str):
        # the names of files read are URIs
        jvm = self.spark._jvm
        return jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI.create(name)) if "://" in name or name.startswith("file:") else jvm.org.apache.hadoop.fs.Path(name)

    def _there(self, name: str) -> bool:
        path = self._path(name)
        return path.getFileSystem(self._conf()).exists(path)

    def _delete(self, name: str) -> None:
        path = self._path(name)
        path.getFileSystem(self._conf()).delete(path, True)


def forget_all(spark: SparkSession) -> None:
    """Drop every kept result."""
    spark.catalog.clearCache()


def stage(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint.

    The files go to the shared folder the cluster names in ``spark.checkpoint.dir``
    and outlive lost executors.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            raise ValueError(
                "staging needs a shared folder: set spark.checkpoint.dir"
            )
        if folder.startswith("file:") and not context.master.startswith("local"):
            raise ValueError(f"{folder} is local to each machine; executors must share it")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
