"""The test tables seen as chunks, questions, jobs, messages and stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OWNERS = ("en", "de", "fr", "es")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks without embeddings: language is the tenant, source the document."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("chunk_id"), F.col("lang").alias("owner_id"), F.col("source").alias("document_id"),
        F.col("doc_id").alias("chunk_index"), F.col("source").alias("title"), F.lit("").alias("heading_path"), "text",
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks; the embedding is null where there is none."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_index"), "embedding", "label")
    return texts(spark, sf_dir).join(e, "chunk_index", "left")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as questions, dealt to the tenants in turn, with the embedding of the same number."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), "text", F.element_at(F.array(*map(F.lit, OWNERS)), (F.col("item_id") % 4 + 1).cast("int")).alias("owner_id"))
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("question_id"), "embedding")
    return b.join(e, "question_id", "left")
