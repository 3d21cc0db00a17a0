"""Ingestion of files as they arrive: Markdown to sections to chunks, a batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..conf import SETTINGS, Settings
from ..operators.chunking import chunk_sections
from ..sources.files import write_chunks
from ..sources.markdown import FILES as MARKDOWN_FILES
from ..sources.markdown import decoded, sections

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def markdown_chunks(files: DataFrame, owner: str, conf: Settings = SETTINGS) -> DataFrame:
    """Chunks of files (path, content) with owner_id."""
    docs = files.select("path", decoded(F.col("content")).alias("body"))
    found = sections(docs).select(F.md5("path").alias("document_id"), "section_order", "heading_path", "text", F.lit(None).cast("int").alias("page_start"), F.lit(None).cast("int").alias("page_end"))
    return chunk_sections(found, conf).withColumn("owner_id", F.lit(owner))


def ingest_stream(spark: SparkSession, source: str, target: str, checkpoint: str, owner: str, conf: Settings = SETTINGS) -> StreamingQuery:
    """Take what has arrived in ``source`` and stop. Chunks are written before their document's status row, so a ready document has its chunks.

    A batch that is run again replaces the same partitions. Without multi-table commits, readers may see chunks of a document that isn't ready yet.
    """
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", MARKDOWN_FILES).load(source)

    def store(batch: DataFrame, number: int) -> None:
        chunks = markdown_chunks(batch, owner, conf).persist()
        write_chunks(chunks, f"{target}/chunks")
        done = batch.select(F.md5("path").alias("document_id"), "path").join(chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunk_count")), "document_id", "left")
        status = done.withColumn("status", F.when(F.col("chunk_count") > 0, "ready").otherwise("failed")).withColumn("batch", F.lit(number))
        status.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{target}/status")
        chunks.unpersist()

    return files.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
