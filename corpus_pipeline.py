"""From raw documents to a training mix: five stages over the table `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwise.llm import decontamination, mixing, near_duplicates, personal_data, toxicity
from tillwise.llm.learning import fold
from tillwise.llm.staging import Stages, ship


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.3 or more go. The model learns as in the query:
    from the labelled documents outside fold 2 of 4."""
    raw = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.accepted(docs, toxicity.fit(raw, labels, fold(F.col("doc_id"), 4) != 2))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest id stays."""
    return near_duplicates.deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind's name; all documents stay."""
    return personal_data.redacted(docs, personal_data.fit(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix of sources takes, with the number of copies."""
    return mixing.mixture(docs)


STAGES = [
    ("toxicity", toxic_out),
    ("near-duplicates", one_of_each),
    ("benchmark decontamination", decontaminate),
    ("personal data", without_personal_data),
    ("source mixing", mix),
]

#: Trained models, sampled hashes and a seeded choice: not expressible in SQL. The stages
#: are tested against brute force and held-out labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written and read again by the next."""
    ship(spark)
    stages = Stages(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stages.write(stage(spark, docs, sf_dir), str(k))
        if k:
            stages.drop(str(k - 1))
    return docs
