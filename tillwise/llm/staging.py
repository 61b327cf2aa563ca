"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where none is named, a local master gets
    a temporary one of its own; a cluster is refused."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='checkpoints-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Let Python workers that see this source tree import it, also where only the driver
    has it on its path. Elsewhere the package has to be installed."""
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment
    parts = [p for p in known.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in parts:
        known["PYTHONPATH"] = os.pathsep.join([*parts, root])


class Stages:
    """Tables written as Parquet to cut lineage: a lost executor costs a read, not a rerun.

    drop() deletes a table that nothing reads any more, so disk holds only live ones.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return self.read(name, df)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(f"{self.folder}/{name}")

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
