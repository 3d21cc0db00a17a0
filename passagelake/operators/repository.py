"""Lookups, listings, quotas and changes of documents, sessions and their children, as rewrites of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..conf import SETTINGS, Settings


def point_lookup(df: DataFrame, key: str, value: object, owner: str) -> DataFrame:
    """The row of that key if the owner's; another owner's is as good as missing."""
    return df.where((F.col(key) == value) & (F.col("owner_id") == owner))


def folded_lookup(df: DataFrame, column: str, value: str) -> DataFrame:
    """Rows whose column, stored in lower case, is that value but for case. A comparison with a literal, which reaches the scan."""
    return df.where(F.col(column) == value.lower())


def first_uploads(documents: DataFrame) -> DataFrame:
    """One document for each owner and checksum: the one with the smallest id. Ids alone are compared; rows are joined back."""
    kept = documents.groupBy("owner_id", "checksum").agg(F.min("document_id").alias("document_id"))
    return documents.join(kept, ["owner_id", "checksum", "document_id"], "left_semi")


def usage(documents: DataFrame) -> DataFrame:
    return documents.groupBy("owner_id").agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("byte_size"), F.lit(0)).alias("bytes"))


def quota_check(used: DataFrame, incoming: Column, conf: Settings = SETTINGS) -> DataFrame:
    """used with the verdict on ``incoming`` more bytes, and what remains."""
    verdict = F.when(F.col("documents") >= conf.max_documents, "too many documents").when(F.col("bytes") + incoming > conf.max_bytes, "too many bytes").otherwise("ok")
    return used.select("*", verdict.alias("verdict"), F.greatest(F.lit(conf.max_bytes) - F.col("bytes"), F.lit(0)).alias("remaining"))


def status_merge(documents: DataFrame, updates: DataFrame) -> DataFrame:
    """documents with new statuses. The error is always overwritten, the chunk count only by one that is given."""
    new = updates.select("document_id", F.col("status").alias("_status"), F.col("chunk_count").alias("_count"), F.col("error").alias("_error"), F.lit(True).alias("_new"))
    j = documents.join(new, "document_id", "left")
    put = {"status": F.when(F.col("_new"), F.col("_status")).otherwise(F.col("status")), "error": F.when(F.col("_new"), F.col("_error")).otherwise(F.col("error")), "chunk_count": F.coalesce("_count", "chunk_count")}
    return j.withColumns(put).select(*documents.columns)


def without(rows: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """Rows that a deletion leaves; apply it to the parent and each child table."""
    return rows.join(deleted.select(key).distinct(), key, "left_anti")


def orphans(stored: DataFrame, documents: DataFrame) -> DataFrame:
    """Stored files whose checksum no document has, of any owner."""
    return stored.join(documents, "checksum", "left_anti")


def in_use(stored: DataFrame, documents: DataFrame) -> DataFrame:
    return stored.join(documents, "checksum", "left_semi")


def upload_action(uploads: DataFrame, documents: DataFrame) -> DataFrame:
    """What an upload leads to: ingest if new, requeue if the same bytes had failed, else nothing. documents hold an owner's checksum once."""
    known = documents.select("owner_id", "checksum", F.col("status").alias("_status"), F.col("document_id").alias("existing_id"))
    j = uploads.join(known, ["owner_id", "checksum"], "left")
    action = F.when(F.col("existing_id").isNull(), "ingest").when(F.col("_status") == "failed", "requeue").otherwise("none")
    return j.select(*uploads.columns, "existing_id", action.alias("action"))
