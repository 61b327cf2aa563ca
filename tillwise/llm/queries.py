"""The registered queries of this subpackage: each operator on its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwise.llm import (
    conversations,
    decontamination,
    embeddings,
    extraction,
    language,
    manifest,
    mixing,
    near_duplicates,
    personal_data,
    quality,
    recompression,
    secret_scan,
    sql,
    toxicity,
)
from tillwise.llm.learning import fold
from tillwise.llm.staging import ship

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def predicted(threshold: float = 0.3) -> Column:
    return F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, split = table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 4)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), split != 2)
    return toxicity.scored(docs, model).select(
        "doc_id", (split == 2).alias("held_out"), "score", predicted(), "n_toxic", "spans"
    )


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return personal_data.reported(docs, personal_data.fit(docs))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))


def op5_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.deduplicated(table(spark, sf_dir, "documents"), with_text=False)


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extracted(table(spark, sf_dir, "pages"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, split = table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 5)
    found = language.identified(docs, language.fit(docs.where(split != 0)), reject=False)
    return found.select("doc_id", (split == 0).alias("held_out"), "lang_pred", "score", "rejected")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, split = table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 5)
    model = quality.fit(docs, table(spark, sf_dir, "labels"), "quality", split != 0)
    return quality.scored(docs, model).select("doc_id", (split == 0).alias("held_out"), "score", predicted())


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_scan.scanned(docs, secret_scan.fit(docs))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repaired(table(spark, sf_dir, "conversations"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.proved(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_decontamination": op1_decontamination,
    "op2_toxicity": op2_toxicity,
    "op3_personal_data": op3_personal_data,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_recompression": op5_recompression,
    "op6_embeddings": op6_embeddings,
    "op7_extraction": op7_extraction,
    "op8_language": op8_language,
    "op9_mixing": op9_mixing,
    "op10_quality": op10_quality,
    "op11_secrets": op11_secrets,
    "op12_conversations": op12_conversations,
    "op13_manifest": op13_manifest,
}
SQL: dict[str, str] = sql.SQL
