"""Registered queries over documents, sessions, jobs, stages and evaluations, and their SQL.

Events stand in for jobs, heartbeats, stages and attempts; ``NOW`` is a fixed time after the last of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..conf import SETTINGS
from ..functions import text as tx
from ..operators import evaluation as ev
from ..operators import jobs as jb
from ..operators import observe as ob
from ..operators import repository as rp
from ..sources import files as fs
from ..streaming import sse
from . import retrieval as rt
from . import tables as t

NOW = "2024-02-01 00:00:00"
STAGES = ("view", "click", "purchase")
MOST, WINDOW = 3, 36000.0


def _now() -> Column:
    return F.to_timestamp(F.lit(NOW))


def _documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents with owner, checksum, size and status."""
    status = F.element_at(F.array(*map(F.lit, ("pending", "processing", "ready", "failed"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return t.table(spark, d, "documents").select(
        F.col("doc_id").alias("document_id"), F.col("source").alias("owner_id"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("checksum"), F.octet_length("text").cast("long").alias("byte_size"),
        status.alias("status"), (F.col("doc_id") % 9).alias("chunk_count"), F.when(F.col("doc_id") % 4 == 3, "broken").alias("error"), F.length("text").alias("chars"), "lang",
    )


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    """A job for each event: its type is the status, and its time the heartbeat's."""
    e = t.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    status = F.when(F.col("event_type") == "view", "queued").when(F.col("event_type") == "click", "running").when(F.col("event_type") == "purchase", "succeeded").otherwise("dead")
    return e.select(
        F.col("event_id").alias("job_id"), (F.col("event_id") % 997).alias("document_id"), status.alias("status"), (F.col("event_id") % 4).cast("int").alias("attempts"), F.lit(3).alias("max_attempts"),
        F.lit(None).cast("string").alias("last_error"), F.col("ts").alias("run_after"), F.when(F.col("event_id") % 5 != 0, F.col("ts")).alias("heartbeat_at"), F.concat(F.lit("w"), F.col("user_id").cast("string")).alias("locked_by"),
        F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"), "event_type", "value",
    )


def owner_scope(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).where(F.col("owner_id") == "src1").select("document_id", "owner_id", "checksum")


def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d)
    hit = docs.groupBy("owner_id").agg(F.min("document_id").alias("document_id"))
    return docs.join(hit, ["document_id", "owner_id"], "left_semi").select("document_id", "owner_id", "status")


def ci_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Names are stored in lower case, as e-mail addresses are."""
    stored = t.table(spark, d, "customer").select("c_custkey", F.lower("c_name").alias("name"))
    return rp.folded_lookup(stored, "name", "CUSTOMER#000000007")


def dedup_owner_checksum(spark: SparkSession, d: str) -> DataFrame:
    return rp.first_uploads(_documents(spark, d)).select("document_id", "owner_id", "checksum")


def min_length(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).where(F.col("chars") >= 300).select("document_id")


def input_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Turns and document texts judged as questions and as passwords."""
    turns = t.table(spark, d, "conversations").select(F.lit("turn").alias("kind"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    docs = t.table(spark, d, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text")
    question = tx.valid_question(F.col("text"), SETTINGS.question_chars)
    password = tx.valid_password(F.col("text"), SETTINGS.password_chars, SETTINGS.password_bytes)
    return turns.unionByName(docs).select("kind", "id", question.alias("question"), password.alias("password"))


def references_available(spark: SparkSession, d: str) -> DataFrame:
    """Turns as reference answers of their conversation: those of the system count as missing, every fifth of these as empty."""
    reference = F.when(F.col("role") != "system", F.col("text")).when(F.col("conv_id") % 5 == 0, F.lit(""))
    return ev.all_referenced(t.table(spark, d, "conversations").select("conv_id", reference.alias("reference")), "reference", "conv_id")


def time_stamps(spark: SparkSession, d: str) -> DataFrame:
    """Times of events with their number as microseconds, as ISO text and for names of files."""
    at = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.col("event_id") % 3)
    return t.table(spark, d, "events").select("event_id", tx.iso_stamp(at).alias("iso"), tx.file_stamp(at).alias("stamp"))


def doc_listing(spark: SparkSession, d: str) -> DataFrame:
    """The newest first."""
    return _documents(spark, d).select("document_id", "owner_id", "status", "chunk_count").orderBy(F.desc("document_id"))


def session_listing(spark: SparkSession, d: str) -> DataFrame:
    c = t.table(spark, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last_turn"), F.count(F.lit(1)).alias("messages"))
    return c.orderBy(F.desc("last_turn"), "conv_id")


def message_listing(spark: SparkSession, d: str) -> DataFrame:
    return t.table(spark, d, "conversations").select("conv_id", "turn", "role").orderBy("conv_id", "turn")


def request_level(spark: SparkSession, d: str) -> DataFrame:
    """Errors are status 500; every seventh request is a probe."""
    e = t.table(spark, d, "events")
    r = e.select("event_id", F.when(F.col("event_id") % 7 == 0, "/health/live").otherwise("/query").alias("path"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"), (F.col("value") * 100).alias("duration_ms"))
    return ob.logged(r).select("event_id", "level")


def usage_for_owner(spark: SparkSession, d: str) -> DataFrame:
    return rp.usage(_documents(spark, d))


def quota_check(spark: SparkSession, d: str) -> DataFrame:
    return rp.quota_check(rp.usage(_documents(spark, d)), F.lit(SETTINGS.max_bytes) - 100_000)


def ready_chunk_total(spark: SparkSession, d: str) -> DataFrame:
    ready = _documents(spark, d).where(F.col("status") == "ready")
    return ready.groupBy("owner_id").agg(F.sum("chunk_count").alias("chunks"))


def any_pending(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).groupBy("owner_id").agg(F.bool_or(F.col("status").isin("pending", "processing")).alias("waiting"))


def count_chunks(spark: SparkSession, d: str) -> DataFrame:
    return t.chunks(spark, d).groupBy("owner_id").agg(F.count(F.lit(1)).alias("chunks"), F.count("embedding").alias("embedded"))


def _stored(spark: SparkSession, d: str) -> DataFrame:
    """Stored files: those of all documents, and benchmark texts that no document is."""
    own = _documents(spark, d).select("checksum").distinct()
    return own.unionByName(t.table(spark, d, "benchmark").select(F.sha2(F.col("text").cast("binary"), 256).alias("checksum"))).distinct()


def checksum_in_use(spark: SparkSession, d: str) -> DataFrame:
    return rp.in_use(_stored(spark, d), _documents(spark, d).where(F.col("document_id") % 2 == 0).select("checksum"))


def orphan_files(spark: SparkSession, d: str) -> DataFrame:
    return rp.orphans(_stored(spark, d), _documents(spark, d).where(F.col("document_id") % 2 == 0).select("checksum"))


def upload_checksum(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("document_id", "byte_size", "checksum", F.concat("checksum", F.lit(".md")).alias("stored_name"))


def upload_action(spark: SparkSession, d: str) -> DataFrame:
    """The owners upload all their texts again, and those of the next document."""
    docs = _documents(spark, d)
    known = rp.first_uploads(docs.where(F.col("document_id") % 3 != 0))
    return rp.upload_action(docs.select(F.col("document_id").alias("upload_id"), "owner_id", "checksum"), known).select("upload_id", "existing_id", "action")


def status_merge(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d)
    new = docs.where(F.col("document_id") % 2 == 0).select("document_id", F.lit("ready").alias("status"), F.when(F.col("document_id") % 3 == 0, F.lit(99).cast("long")).alias("chunk_count"), F.lit(None).cast("string").alias("error"))
    return rp.status_merge(docs, new).select("document_id", "status", "chunk_count", "error")


def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    """The messages that are left when every third session goes."""
    m = t.table(spark, d, "conversations")
    return rp.without(m, m.where(F.col("conv_id") % 3 == 0), "conv_id").select("conv_id", "turn")


def queue_depth(spark: SparkSession, d: str) -> DataFrame:
    return jb.depth(_jobs(spark, d).where(F.col("status") != "dead"))


def backoff_delay(spark: SparkSession, d: str) -> DataFrame:
    return t.table(spark, d, "events").select("event_id", jb.backoff_seconds((F.col("event_id") % 51).cast("int")).alias("delay"))


def claim_next(spark: SparkSession, d: str) -> DataFrame:
    return jb.claim(_jobs(spark, d), _now(), 8).select("job_id", "worker", "status", "attempts")


def enqueue_dedup(spark: SparkSession, d: str) -> DataFrame:
    jobs = _jobs(spark, d)
    return jb.enqueue(jobs.select("document_id", "job_id"), jobs.where(F.col("document_id") % 2 == 0))


def last_heartbeat(spark: SparkSession, d: str) -> DataFrame:
    beats = _jobs(spark, d).select(F.col("document_id").alias("job_id"), F.col("heartbeat_at").alias("ts"))
    return jb.last_heartbeat(beats).select("job_id", F.unix_micros("heartbeat_at").alias("heartbeat_us"))


def job_transition(spark: SparkSession, d: str) -> DataFrame:
    outcome = F.when(F.col("value") < 20, "succeeded").when(F.col("value") < 60, "failed").otherwise("permanent")
    done = jb.finish(_jobs(spark, d).where(F.col("status") == "running"), outcome, F.lit("  bad file "), _now())
    return done.select("job_id", "status", "document_status", "will_retry", "last_error", F.unix_micros("run_after").alias("run_after_us"))


def reap_stale(spark: SparkSession, d: str) -> DataFrame:
    return jb.reap(_jobs(spark, d), F.to_timestamp(F.lit("2024-01-15 00:00:00"))).select("job_id", "status", "document_status", "last_error")


def purge_old(spark: SparkSession, d: str) -> DataFrame:
    return jb.purge(_jobs(spark, d), F.to_timestamp(F.lit("2024-01-20 00:00:00"))).select("job_id", "status")


def requeue_all(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d)
    return jb.requeue_all(docs, docs.where(F.col("document_id") % 5 != 0)).select("document_id", "owner_id", "status", "attempts")


def stage_breakdown(spark: SparkSession, d: str) -> DataFrame:
    s = t.table(spark, d, "events").select((F.col("event_id") % 2000).alias("request_id"), F.col("event_type").alias("stage"), F.col("value").alias("elapsed_ms"))
    return ob.stage_totals(s, STAGES)


def unattributed_time(spark: SparkSession, d: str) -> DataFrame:
    e = t.table(spark, d, "events").select((F.col("event_id") % 2000).alias("request_id"), F.col("event_type").alias("stage"), F.col("value").alias("elapsed_ms"))
    total = e.groupBy("request_id").agg(F.max("elapsed_ms").alias("total_ms")).withColumn("total_ms", F.col("total_ms") * 4)
    out = ob.unattributed(ob.stage_totals(e, STAGES), total)
    return out.select("request_id", F.round("unattributed_ms", 3).alias("unattributed_ms"))


def stage_means(spark: SparkSession, d: str) -> DataFrame:
    return t.table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean_ms"))


def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return ev.percentiles(t.table(spark, d, "events"), "event_type", "value", 0.5, 0.95)


def _outcomes(spark: SparkSession, d: str) -> DataFrame:
    """config, question_id and the rank of the first chunk with the label of the question's own embedding."""
    q, c = t.questions(spark, d), t.chunks(spark, d)
    labels = t.table(spark, d, "embeddings").select(F.col("vec_id").alias("question_id"), F.col("label").cast("string").alias("expected"))
    # Both searches run once: their fusion holds all three ranks.
    ranks = F.array(*(F.struct(F.lit(config).alias("config"), F.col(rank).alias("rank")) for config, rank in (("dense", "vector_rank"), ("lexical", "lexical_rank"), ("hybrid", "position"))))
    ranked = rt._fused(spark, d).select("question_id", "chunk_id", F.inline(ranks)).where(F.col("rank") <= SETTINGS.top_k)
    joined = ranked.join(c.select("chunk_id", F.coalesce(F.col("label").cast("string"), F.lit("none")).alias("section")), "chunk_id").join(labels, "question_id")
    return ev.first_relevant_rank(joined)


def first_relevant_rank(spark: SparkSession, d: str) -> DataFrame:
    return _outcomes(spark, d)


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    return ev.ir_metrics(_outcomes(spark, d))


def ir_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = _metrics(spark, d)
    return m.withColumns({c: F.round(c, 6) for c in ("hit_rate", "mrr", "ndcg")})


def wilson_interval(spark: SparkSession, d: str) -> DataFrame:
    low, high = ev.wilson(F.col("hits"), F.col("n"))
    return _metrics(spark, d).select("config", F.round(low, 6).alias("ci_low"), F.round(high, 6).alias("ci_high"))


def delta_vs_baseline(spark: SparkSession, d: str) -> DataFrame:
    return ev.delta_points(_metrics(spark, d), "dense").select("config", "delta")


def report_table(spark: SparkSession, d: str) -> DataFrame:
    low, high = ev.wilson(F.col("hits"), F.col("n"))
    return ev.report_lines(ev.delta_points(_metrics(spark, d), "dense").withColumns({"ci_low": low, "ci_high": high}))


def rate_limit(spark: SparkSession, d: str) -> DataFrame:
    e = t.table(spark, d, "events")
    seconds = (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t")
    attempts = e.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), seconds, F.when(F.col("event_type") == "signup", "reset").otherwise("check").alias("kind"))
    return ob.rate_limit(attempts, MOST, WINDOW).select("key", "seq", "allowed", "retry_after")


def _frames(spark: SparkSession, d: str) -> DataFrame:
    """A conversation as a stream: meta, its turns as tokens, then done, or for every fourth an error."""
    c = t.table(spark, d, "conversations").select(F.col("conv_id").alias("stream_id"), (F.col("turn") + 1).alias("seq"), F.lit("token").alias("event"), F.col("text").alias("data"))
    ids = c.select("stream_id").distinct()
    meta = ids.select("stream_id", F.lit(-1).cast("long").alias("seq"), F.lit("meta").alias("event"), F.lit("").alias("data"))
    end = ids.select("stream_id", F.lit(1000000).cast("long").alias("seq"), F.when(F.col("stream_id") % 4 == 0, "error").otherwise("done").alias("event"), F.lit("").alias("data"))
    return c.unionByName(meta).unionByName(end)


def stream_reconcile(spark: SparkSession, d: str) -> DataFrame:
    return sse.reconcile(_frames(spark, d))


def sse_protocol(spark: SparkSession, d: str) -> DataFrame:
    return sse.protocol(_frames(spark, d))


def sse_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Frames written as one body a stream and parsed again."""
    f = _frames(spark, d).where(F.col("event") == "token").withColumn("frame", sse.frame(F.col("event"), F.to_json(F.struct(F.col("data").alias("text")))))
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "frame"))), lambda x: x["frame"]), "")
    back = sse.decode(f.groupBy("stream_id").agg(F.concat(F.lit(": hello\n\n"), ordered, F.lit("event: token\ndata: {broken\n\n")).alias("body")))
    return back.select("stream_id", "event", F.get_json_object("data", "$.text").alias("text"))


def file_readers(spark: SparkSession, d: str) -> DataFrame:
    """Which reader takes each page's address as a file name."""
    p = t.table(spark, d, "pages").select("page_id", F.concat(F.regexp_extract("url", r"/(\d+)", 1), F.element_at(F.array(*map(F.lit, (".md", ".PDF", ".markdown", ".html", ""))), (F.col("page_id") % 5 + 1).cast("int"))).alias("path"))
    return fs.readers(p).select("page_id", "reader", "status")


def log_lines(spark: SparkSession, d: str) -> DataFrame:
    return fs.log_lines(t.table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("role") != "system", F.col("role")).alias("role")))


def sample_chunks(spark: SparkSession, d: str) -> DataFrame:
    """A seeded draw of 25 ready documents of some length: a draw is what this operator is for."""
    return _documents(spark, d).where((F.col("status") == "ready") & (F.col("chars") >= 300)).orderBy(F.xxhash64(F.lit(7), "document_id"), "document_id").limit(25).select("document_id")


QUERIES = {f.__name__: f for f in (
    owner_scope, point_lookup, ci_lookup, dedup_owner_checksum, min_length, input_lengths, references_available, time_stamps, doc_listing, session_listing, message_listing, request_level, usage_for_owner, quota_check, ready_chunk_total, any_pending, count_chunks,
    checksum_in_use, orphan_files, upload_checksum, upload_action, status_merge, cascade_delete, queue_depth, backoff_delay, claim_next, enqueue_dedup, last_heartbeat, job_transition, reap_stale, purge_old, requeue_all,
    stage_breakdown, unattributed_time, stage_means, latency_percentiles, first_relevant_rank, ir_metrics, wilson_interval, delta_vs_baseline, report_table, rate_limit, stream_reconcile, sse_protocol, sse_roundtrip, file_readers, log_lines, sample_chunks,
)}

_DOCS = """docs AS (SELECT doc_id AS document_id, source AS owner_id, sha256(coalesce(text, '')) AS checksum, strlen(text) AS byte_size, ['pending','processing','ready','failed'][CAST(doc_id % 4 + 1 AS INT)] AS status,
  doc_id % 9 AS chunk_count, CASE WHEN doc_id % 4 = 3 THEN 'broken' END AS error, length(text) AS chars, lang FROM documents)"""
_JOBS = """jobs AS (SELECT event_id AS job_id, event_id % 997 AS document_id, CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'succeeded' ELSE 'dead' END AS status,
  CAST(event_id % 4 AS INT) AS attempts, ts AS run_after, CASE WHEN event_id % 5 <> 0 THEN ts END AS heartbeat_at, 'w' || user_id AS locked_by, ts, value FROM events)"""
_BACKOFF = "CAST(least(30 * pow(2, greatest({0}, 1) - 1), 900) AS INT)"
_STORED = f"{_DOCS}, stored AS (SELECT DISTINCT checksum FROM docs UNION SELECT sha256(text) FROM benchmark), kept AS (SELECT DISTINCT checksum FROM docs WHERE document_id % 2 = 0)"
_STAGE = "stages AS (SELECT request_id, stage, round_even(sum(value::DECIMAL(20,6))::DOUBLE, 1) AS total_ms, count(*) AS n FROM (SELECT event_id % 2000 AS request_id, event_type AS stage, value FROM events) GROUP BY ALL)"
_OUTCOMES = rt._BASE + """, ranked AS (SELECT 'dense' AS config, question_id, chunk_id, rank FROM dense WHERE rank <= 6 UNION ALL SELECT 'lexical', question_id, chunk_id, rank FROM lexical WHERE rank <= 6
  UNION ALL SELECT 'hybrid', question_id, chunk_id, position FROM fused WHERE position <= 6),
outcomes AS (SELECT config, question_id, min(CASE WHEN contains(coalesce(CAST(e.label AS VARCHAR), 'none'), CAST(x.label AS VARCHAR)) THEN rank END) AS rank
  FROM ranked LEFT JOIN embeddings e ON CAST(e.vec_id AS VARCHAR) = chunk_id JOIN embeddings x ON x.vec_id = question_id GROUP BY ALL),
metrics AS (SELECT config, count(*) AS n, sum(coalesce((rank <= 6)::INT, 0)) AS hits, avg(coalesce((rank <= 6)::INT, 0)) AS hit_rate, avg(coalesce(1.0::DOUBLE / rank, 0)) AS mrr,
  avg(CASE WHEN rank <= 6 THEN 1.0::DOUBLE / log2(rank + 1.0) ELSE 0 END) AS ndcg FROM outcomes GROUP BY 1),
bounds AS (SELECT *, (hit_rate + 1.96::DOUBLE * 1.96 / (2 * n)) / (1 + 1.96::DOUBLE * 1.96 / n) AS mid, 1.96::DOUBLE * sqrt(hit_rate * (1 - hit_rate) / n + 1.96::DOUBLE * 1.96 / (4.0::DOUBLE * n * n)) / (1 + 1.96::DOUBLE * 1.96 / n) AS half FROM metrics),
deltas AS (SELECT b.*, greatest(mid - half, 0) AS ci_low, least(mid + half, 1) AS ci_high, CASE WHEN config = 'dense' THEN 'baseline' ELSE printf('%+.1f pp', (hit_rate - (SELECT hit_rate FROM metrics WHERE config = 'dense')) * 100) END AS delta FROM bounds b)"""
_FRAMES = """tokens AS (SELECT conv_id AS stream_id, turn, text AS data FROM conversations)"""

ORACLES = {
    "owner_scope": f"WITH {_DOCS} SELECT document_id, owner_id, checksum FROM docs WHERE owner_id = 'src1'",
    "point_lookup": f"WITH {_DOCS} SELECT document_id, owner_id, status FROM docs WHERE (owner_id, document_id) IN (SELECT owner_id, min(document_id) FROM docs GROUP BY 1)",
    "ci_lookup": "SELECT c_custkey, lower(c_name) AS name FROM customer WHERE lower(c_name) = 'customer#000000007'",
    "dedup_owner_checksum": f"WITH {_DOCS} SELECT min(document_id) AS document_id, owner_id, checksum FROM docs GROUP BY owner_id, checksum",
    "min_length": "SELECT doc_id AS document_id FROM documents WHERE length(text) >= 300",
    "input_lengths": """SELECT kind, id, length(text) >= 1 AND length(text) <= 4000 AS question, length(text) >= 10 AND strlen(text) <= 72 AS password
  FROM (SELECT 'turn' AS kind, conv_id * 1000 + turn AS id, text FROM conversations UNION ALL SELECT 'document', doc_id, text FROM documents)""",
    "references_available": """SELECT conv_id, count(*) FILTER (role = 'system' OR role IS NULL OR coalesce(text, '') = '') = 0 AS referenced FROM conversations GROUP BY 1""",
    "time_stamps": """SELECT event_id, strftime(moment, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(moment) % 1000000 = 0 THEN '' ELSE strftime(moment, '.%f') END || '+00:00' AS iso, strftime(moment, '%Y%m%dT%H%M%SZ') AS stamp
  FROM (SELECT event_id, ts + to_microseconds(event_id % 3) AS moment FROM events)""",
    "doc_listing": f"WITH {_DOCS} SELECT document_id, owner_id, status, chunk_count FROM docs ORDER BY document_id DESC",
    "session_listing": "SELECT conv_id, max(turn) AS last_turn, count(*) AS messages FROM conversations GROUP BY 1 ORDER BY 2 DESC, 1",
    "message_listing": "SELECT conv_id, turn, role FROM conversations ORDER BY 1, 2",
    "request_level": "SELECT event_id, CASE WHEN event_type = 'error' THEN 'error' WHEN value * 100 >= 5000 THEN 'warning' ELSE 'info' END AS level FROM events WHERE event_id % 7 <> 0 OR event_type = 'error'",
    "usage_for_owner": f"WITH {_DOCS} SELECT owner_id, count(*) AS documents, coalesce(sum(byte_size), 0)::BIGINT AS bytes FROM docs GROUP BY 1",
    "quota_check": f"""WITH {_DOCS}, u AS (SELECT owner_id, count(*) AS documents, sum(byte_size)::BIGINT AS bytes FROM docs GROUP BY 1)
SELECT *, CASE WHEN documents >= 100 THEN 'too many documents' WHEN bytes + 524288000 - 100000 > 524288000 THEN 'too many bytes' ELSE 'ok' END AS verdict, greatest(524288000 - bytes, 0) AS remaining FROM u""",
    "ready_chunk_total": f"WITH {_DOCS} SELECT owner_id, sum(chunk_count)::BIGINT AS chunks FROM docs WHERE status = 'ready' GROUP BY 1",
    "any_pending": f"WITH {_DOCS} SELECT owner_id, bool_or(status IN ('pending', 'processing')) AS waiting FROM docs GROUP BY 1",
    "count_chunks": "SELECT lang AS owner_id, count(*) AS chunks, count(embedding) AS embedded FROM documents LEFT JOIN embeddings ON vec_id = doc_id GROUP BY 1",
    "checksum_in_use": f"WITH {_STORED} SELECT checksum FROM stored SEMI JOIN kept USING (checksum)",
    "orphan_files": f"WITH {_STORED} SELECT checksum FROM stored ANTI JOIN kept USING (checksum)",
    "upload_checksum": f"WITH {_DOCS} SELECT document_id, byte_size, checksum, checksum || '.md' AS stored_name FROM docs",
    "upload_action": f"""WITH {_DOCS}, k AS (SELECT owner_id, checksum, min(document_id) AS existing_id FROM docs WHERE document_id % 3 <> 0 GROUP BY 1, 2)
SELECT d.document_id AS upload_id, existing_id, CASE WHEN existing_id IS NULL THEN 'ingest' WHEN existing_id % 4 = 3 THEN 'requeue' ELSE 'none' END AS action FROM docs d LEFT JOIN k USING (owner_id, checksum)""",
    "status_merge": f"WITH {_DOCS} SELECT document_id, CASE WHEN document_id % 2 = 0 THEN 'ready' ELSE status END AS status, CASE WHEN document_id % 6 = 0 THEN 99 ELSE chunk_count END AS chunk_count, CASE WHEN document_id % 2 = 0 THEN NULL ELSE error END AS error FROM docs",
    "cascade_delete": "SELECT conv_id, turn FROM conversations WHERE conv_id % 3 <> 0",
    "queue_depth": f"WITH {_JOBS} SELECT s AS status, (SELECT count(*) FROM jobs WHERE status = s AND s <> 'dead') AS n FROM (SELECT unnest(['queued', 'running', 'succeeded', 'dead']) AS s)",
    "backoff_delay": f"SELECT event_id, {_BACKOFF.format('event_id % 51')} AS delay FROM events",
    "claim_next": f"WITH {_JOBS} SELECT job_id, CAST(row_number() OVER (ORDER BY ts, job_id) AS INT) AS worker, 'running' AS status, attempts + 1 AS attempts FROM jobs WHERE status = 'queued' QUALIFY row_number() OVER (ORDER BY ts, job_id) <= 8",
    "enqueue_dedup": f"WITH {_JOBS} SELECT document_id, min(job_id) AS job_id FROM jobs WHERE document_id NOT IN (SELECT document_id FROM jobs WHERE document_id % 2 = 0 AND status IN ('queued', 'running')) GROUP BY 1",
    "last_heartbeat": f"WITH {_JOBS} SELECT document_id AS job_id, epoch_us(max(heartbeat_at)) AS heartbeat_us FROM jobs GROUP BY 1",
    "job_transition": f"""WITH {_JOBS}, o AS (SELECT *, value < 20 AS ok, value >= 20 AND value < 60 AND attempts < 3 AS retry FROM jobs WHERE status = 'running')
SELECT job_id, CASE WHEN ok THEN 'succeeded' WHEN retry THEN 'queued' ELSE 'dead' END AS status, CASE WHEN ok THEN 'ready' WHEN retry THEN 'pending' ELSE 'failed' END AS document_status, retry AS will_retry,
  CASE WHEN NOT ok THEN 'bad file' END AS last_error, CASE WHEN retry THEN epoch_us(TIMESTAMP '{NOW}') + 1000000::BIGINT * {_BACKOFF.format('attempts')} ELSE epoch_us(run_after) END AS run_after_us FROM o""",
    "reap_stale": f"""WITH {_JOBS} SELECT job_id, CASE WHEN attempts < 3 THEN 'queued' ELSE 'dead' END AS status, CASE WHEN attempts < 3 THEN 'pending' ELSE 'failed' END AS document_status, 'Worker ' || locked_by || ' stopped responding; requeued.' AS last_error
  FROM jobs WHERE status = 'running' AND heartbeat_at < TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 300 SECOND""",
    "purge_old": f"WITH {_JOBS} SELECT job_id, status FROM jobs WHERE NOT (status IN ('succeeded', 'dead') AND ts < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 168 HOUR)",
    "requeue_all": f"WITH {_DOCS} SELECT document_id, owner_id, 'queued' AS status, 0 AS attempts FROM docs WHERE checksum IN (SELECT checksum FROM docs WHERE document_id % 5 <> 0)",
    "stage_breakdown": f"WITH {_STAGE} SELECT request_id, stage, total_ms, n, CASE stage WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END AS place FROM stages",
    "unattributed_time": f"WITH {_STAGE} SELECT request_id, round(greatest((SELECT max(value) FROM events WHERE event_id % 2000 = s.request_id) * 4 - sum(total_ms), 0), 3) AS unattributed_ms FROM stages s GROUP BY request_id",
    "stage_means": "SELECT event_type, round(avg(value), 6) AS mean_ms FROM events GROUP BY 1",
    "latency_percentiles": "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1",
    "first_relevant_rank": f"WITH {_OUTCOMES} SELECT config, question_id, rank FROM outcomes",
    "ir_metrics": f"WITH {_OUTCOMES} SELECT config, n, hits::BIGINT AS hits, round(hit_rate, 6) AS hit_rate, round(mrr, 6) AS mrr, round(ndcg, 6) AS ndcg FROM metrics",
    "wilson_interval": f"WITH {_OUTCOMES} SELECT config, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high FROM deltas",
    "delta_vs_baseline": f"WITH {_OUTCOMES} SELECT config, delta FROM deltas",
    "report_table": f"WITH {_OUTCOMES} SELECT config, '| ' || config || printf(' | **%.1f%%** | %.1f%%–%.1f%% | %.3f | %.3f | ', hit_rate * 100, ci_low * 100, ci_high * 100, mrr, ndcg) || delta || ' |' AS line FROM deltas",
    "rate_limit": """WITH a AS (SELECT CAST(user_id AS VARCHAR) AS key, list(struct_pack(seq := event_id, at := epoch_us(ts) / 1e6, clear := event_type = 'signup') ORDER BY ts, event_id) AS l FROM events GROUP BY 1),
f AS (SELECT key, list_reduce(l, lambda s, e: struct_pack(
    hits := CASE WHEN e.clear THEN []::DOUBLE[] WHEN len(list_filter(s.hits, lambda h: e.at - h <= 36000)) >= 3 THEN list_filter(s.hits, lambda h: e.at - h <= 36000) ELSE list_append(list_filter(s.hits, lambda h: e.at - h <= 36000), e.at) END,
    done := list_append(s.done, struct_pack(seq := e.seq, allowed := e.clear OR len(list_filter(s.hits, lambda h: e.at - h <= 36000)) < 3,
      retry_after := CASE WHEN NOT e.clear AND len(list_filter(s.hits, lambda h: e.at - h <= 36000)) >= 3 THEN CAST(trunc(36000 - (e.at - list_filter(s.hits, lambda h: e.at - h <= 36000)[1])) AS BIGINT) + 1 END))),
  struct_pack(hits := []::DOUBLE[], done := []::STRUCT(seq BIGINT, allowed BOOLEAN, retry_after BIGINT)[])) AS r FROM a)
SELECT key, d.seq AS seq, d.allowed AS allowed, d.retry_after AS retry_after FROM (SELECT key, unnest(r.done) AS d FROM f)""",
    "stream_reconcile": f"WITH {_FRAMES} SELECT stream_id, string_agg(data, '' ORDER BY turn) AS content FROM tokens WHERE stream_id % 4 <> 0 GROUP BY 1",
    "sse_protocol": "SELECT DISTINCT conv_id AS stream_id, true AS valid, conv_id % 4 <> 0 AS complete FROM conversations",
    "sse_roundtrip": f"WITH {_FRAMES} SELECT stream_id, 'token' AS event, data AS text FROM tokens",
    "file_readers": "SELECT page_id, ['markdown', 'pdf', 'markdown', NULL, NULL][CAST(page_id % 5 + 1 AS INT)] AS reader, CASE WHEN page_id % 5 < 3 THEN 'accepted' ELSE 'unsupported' END AS status FROM pages",
    "log_lines": """SELECT '{"conv_id":' || conv_id || ',"turn":' || turn || ',"role":' || CASE WHEN role <> 'system' THEN '"' || role || '"' ELSE 'null' END || '}' AS line FROM conversations""",
}
