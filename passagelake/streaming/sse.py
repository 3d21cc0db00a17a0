"""Frames of a server-sent event stream: encoding, decoding, the protocol, and what a client shows.

Rows are stream_id, seq, event and data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def frame(event: Column, data: Column) -> Column:
    """One frame; data is JSON, which keeps line ends escaped."""
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), data, F.lit("\n\n"))


def decode(streams: DataFrame, body: str = "body") -> DataFrame:
    """stream_id, seq, event and data of each whole frame. Comments and frames without data or with broken JSON are dropped."""
    frames = streams.select("stream_id", F.posexplode(F.split(F.regexp_replace(body, "\r\n", "\n"), "\n\n")).alias("seq", "frame"))
    lines = F.filter(F.split("frame", "\n"), lambda x: ~x.startswith(":"))
    field = lambda name: F.array_join(F.transform(F.filter(lines, lambda x: x.startswith(f"{name}:")), lambda x: F.regexp_replace(x, f"^{name}: ?", "")), "\n")
    found = frames.withColumn("event", field("event")).withColumn("data", field("data")).where(F.col("data") != "")
    return found.where(F.try_parse_json("data").isNotNull()).select("stream_id", "seq", F.when(F.col("event") == "", "message").otherwise(F.col("event")).alias("event"), "data")


def protocol(events: DataFrame) -> DataFrame:
    """stream_id, valid and complete: meta first, then tokens, then one done; or an error at the end."""
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "event"))), lambda x: x["event"]), " ")
    seen = events.groupBy("stream_id").agg(names.alias("names"))
    return seen.select("stream_id", F.col("names").rlike("^(meta( token)* done|(meta( token)* )?error)$").alias("valid"), F.col("names").rlike("^meta( token)* done$").alias("complete"))


def reconcile(events: DataFrame) -> DataFrame:
    """stream_id and the text that a client keeps: all tokens in order, unless an error came."""
    tokens = F.array_sort(F.collect_list(F.when(F.col("event") == "token", F.struct("seq", "data"))))
    kept = events.groupBy("stream_id").agg(F.array_join(F.transform(tokens, lambda x: x["data"]), "").alias("content"), F.bool_or(F.col("event") == "error").alias("failed"))
    return kept.where(~F.col("failed")).select("stream_id", "content")
