"""Which reader takes a file, upload checksums, the chunk table, gold sets and report files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import file_parts

READERS = {".pdf": "pdf", ".md": "markdown", ".markdown": "markdown"}
MAX_UPLOAD = 50 * 1024 * 1024
GOLDSET = "version int, owner_email string, questions array<struct<question:string,expected_section:string,document_title:string,source_chunk_id:string,reference_answer:string,note:string>>"


def readers(files: DataFrame, path: str = "path") -> DataFrame:
    """Add reader (null: not supported) and status by the file's suffix."""
    _, _, suffix = file_parts(F.col(path))
    reader = F.element_at(F.create_map(*[F.lit(x) for kv in READERS.items() for x in kv]), suffix)
    return files.withColumn("reader", reader).withColumn("status", F.when(F.col("reader").isNull(), "unsupported").otherwise("accepted"))


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """path, byte_size, checksum and stored_name of files up to the size limit."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("length") <= MAX_UPLOAD)
    _, _, suffix = file_parts(F.col("path"))
    checksum = F.sha2("content", 256)
    return files.select("path", F.col("length").alias("byte_size"), checksum.alias("checksum"), F.concat(checksum, suffix).alias("stored_name"))


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Replace the chunks of the documents that are in ``chunks``, and no others'."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("owner_id", "document_id").parquet(path)


def read_goldset(spark: SparkSession, path: str) -> DataFrame:
    """One row a question, with the set's version and owner."""
    return spark.read.schema(GOLDSET).json(path, multiLine=True).select("version", "owner_email", F.inline("questions"))


def write_goldset(questions: DataFrame, path: str) -> None:
    names = ["question", "expected_section", "document_title", "source_chunk_id", "reference_answer", "note"]
    questions.groupBy("version", "owner_email").agg(F.collect_list(F.struct(*names)).alias("questions")).write.mode("overwrite").json(path)


def log_lines(rows: DataFrame) -> DataFrame:
    """One JSON object a row; nulls are written as null."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("line"))
