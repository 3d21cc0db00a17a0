"""Registered queries over changes that run through several tables or batches: cascades and streamed answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cascade
from ..sources.shared import shared_path
from ..streaming import answers
from . import tables as t

DOOMED = ("src1", "src4", "src13")
PARTS = 3


def cascade_levels(spark: SparkSession, d: str) -> DataFrame:
    """What is left of all tables when three users go, and the files that lose their last document. Vectors stand for chunks, events for jobs, conversations for sessions."""
    dealt = lambda c: F.concat(F.lit("src"), (F.col(c) % 20).cast("string"))
    docs, turns = t.table(spark, d, "documents"), t.table(spark, d, "conversations")
    checksum = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    tables = {
        "users": docs.select(F.col("source").alias("owner_id")).distinct(), "documents": docs.select(F.col("doc_id").alias("document_id"), F.col("source").alias("owner_id"), checksum.alias("checksum")),
        "chunks": t.table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("vec_id").alias("document_id"), dealt("vec_id").alias("owner_id")),
        "jobs": t.table(spark, d, "events").select(F.col("event_id").alias("job_id"), (F.col("event_id") % 997).alias("document_id"), dealt("user_id").alias("owner_id")),
        "sessions": turns.select(F.col("conv_id").alias("session_id"), dealt("conv_id").alias("owner_id")).distinct(), "messages": turns.select(F.col("conv_id").alias("session_id"), "turn"),
    }
    left, gone = cascade.delete(tables, "users", tables["users"].where(F.col("owner_id").isin(*DOOMED)))
    shown = {"users": ("owner_id", F.lit(0)), "documents": ("document_id", F.lit(0)), "chunks": ("chunk_id", F.lit(0)), "jobs": ("job_id", F.lit(0)), "sessions": ("session_id", F.lit(0)), "messages": ("session_id", F.col("turn"))}
    parts = [left[n].select(F.lit(n).alias("kind"), F.col(c).cast("string").alias("id"), part.cast("long").alias("part")) for n, (c, part) in shown.items()]
    files = cascade.unlinked(gone["documents"], left["documents"]).select(F.lit("files to unlink").alias("kind"), F.col("checksum").alias("id"), F.lit(0).cast("long").alias("part"))
    return reduce(DataFrame.unionByName, [*parts, files])


def _frames(spark: SparkSession, d: str) -> DataFrame:
    """The assistant's turns as frames, a word a token with two markers at the end. Each fifth stream loses its first token, each seventh ends in an error; every fourth frame comes twice."""
    turns = t.table(spark, d, "conversations").where(F.col("role") == "assistant").withColumn("n", F.col("conv_id") + F.col("turn"))
    source = lambda m: F.struct(F.lit(m).alias("marker"), F.concat(F.lit("d"), F.lit(m)).alias("document_id"))
    sources = F.to_json(F.struct(F.lit(True).alias("grounded"), F.array(*map(source, (1, 2, 3))).alias("sources")))
    text = lambda x: F.struct(F.lit("token").alias("event"), F.to_json(F.struct(x.alias("text"))).alias("data"))
    frame = lambda event, data: F.array(F.struct(F.lit(event).alias("event"), data.alias("data")))
    end = F.when(F.col("n") % 7 == 0, frame("error", F.lit('{"detail": "late"}'))).otherwise(frame("done", F.lit("{}")))
    pieces = F.concat(F.split(F.coalesce("text", F.lit("")), "(?<= )"), F.array(F.lit(" [2][5]"), F.lit("[1]")))
    rows = turns.select(F.format_string("%d-%d", "conv_id", "turn").alias("stream_id"), "n", F.posexplode(F.concat(frame("meta", sources), F.transform(pieces, text), end)).alias("seq", "f"))
    kept = rows.where((F.col("n") % 5 != 0) | (F.col("seq") != 1)).select("stream_id", "seq", "f.event", "f.data", F.timestamp_seconds(F.col("n") % 1000 + 1_700_000_000).alias("at"))
    place = F.pmod(F.xxhash64("stream_id", "seq"), F.lit(PARTS))
    twice = F.when(F.col("seq") % 4 == 0, F.array(place, (place + 1) % PARTS)).otherwise(F.array(place))
    return kept.withColumn("part", F.explode(twice))


def answer_streams(spark: SparkSession, d: str) -> DataFrame:
    """The complete answers of frames that come out of order in several batches."""
    path = shared_path(spark, "answers")
    for i in range(PARTS):
        _frames(spark, d).where(F.col("part") == i).drop("part").write.parquet(f"{path}/in/part={i}")
    schema = "stream_id string, seq int, event string, data string, at timestamp"
    files = len(spark.read.schema(schema).parquet(f"{path}/in/*").inputFiles())
    frames = spark.readStream.schema(schema).option("maxFilesPerTrigger", -(-files // PARTS)).parquet(f"{path}/in/*")
    answers.store_answers(frames, f"{path}/out", f"{path}/checkpoint", 7200).awaitTermination()
    stored = spark.read.schema("stream_id string, content string, grounded boolean, citations string").parquet(f"{path}/out/messages")
    return stored.select("stream_id", F.md5(F.col("content").cast("binary")).alias("content_md5"), "grounded", "citations")


QUERIES = {f.__name__: f for f in (cascade_levels, answer_streams)}

_GONE = f"('{DOOMED[0]}', '{DOOMED[1]}', '{DOOMED[2]}')"
ORACLES = {
    "cascade_levels": f"""WITH docs AS (SELECT doc_id, source, sha256(coalesce(text, '')) AS checksum, coalesce(source IN {_GONE}, false) AS gone FROM documents), lost AS (SELECT doc_id FROM docs WHERE gone),
conv AS (SELECT conv_id, turn FROM conversations WHERE 'src' || conv_id % 20 NOT IN {_GONE})
SELECT 'users' AS kind, source AS id, 0::BIGINT AS part FROM docs WHERE NOT gone GROUP BY ALL
UNION ALL SELECT 'documents', CAST(doc_id AS VARCHAR), 0 FROM docs WHERE NOT gone
UNION ALL SELECT 'chunks', CAST(vec_id AS VARCHAR), 0 FROM embeddings WHERE 'src' || vec_id % 20 NOT IN {_GONE} AND vec_id NOT IN (FROM lost)
UNION ALL SELECT 'jobs', CAST(event_id AS VARCHAR), 0 FROM events WHERE 'src' || user_id % 20 NOT IN {_GONE} AND event_id % 997 NOT IN (FROM lost)
UNION ALL SELECT DISTINCT 'sessions', CAST(conv_id AS VARCHAR), 0 FROM conv
UNION ALL SELECT 'messages', CAST(conv_id AS VARCHAR), turn FROM conv
UNION ALL SELECT DISTINCT 'files to unlink', checksum, 0 FROM docs WHERE gone AND checksum NOT IN (SELECT checksum FROM docs WHERE NOT gone)""",
    "answer_streams": r"""SELECT conv_id || '-' || turn AS stream_id, md5(regexp_replace(coalesce(text, ''), '^\s+', '') || ' [2][5][1]') AS content_md5, true AS grounded,
  '[{"marker": 2, "document_id": "d2"}, {"marker": 1, "document_id": "d1"}]' AS citations
FROM conversations WHERE role = 'assistant' AND (conv_id + turn) % 5 <> 0 AND (conv_id + turn) % 7 <> 0""",
}
