"""Streams driven to their end over small files."""

from datetime import datetime

from passagelake.streaming import ingest, limiter


def drain(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.sql(f"select * from {name}").collect()


def test_limiter_keeps_its_state(spark, tmp_path):
    schema = "key string, seq bigint, t double, kind string"
    for i, rows in enumerate(([("k", 0, 0.0, "check"), ("k", 1, 1.0, "check"), ("k", 2, 2.0, "check")], [("k", 3, 3.0, "check"), ("k", 4, 4.0, "reset"), ("k", 5, 5.0, "check"), ("j", 0, 0.0, "check")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = {(r["key"], r["seq"]): (r["allowed"], r["retry_after"]) for r in drain(limiter.stream_rate_limit(stream, 3, 60.0), "limited")}
    assert len(out) == 7 and out["j", 0][0]
    refused = [k for k, v in out.items() if not v[0]]
    assert refused == [("k", 3)] and out["k", 3][1] == 58


def test_limiter_forgets_old_keys(spark, tmp_path):
    schema = "key string, seq bigint, t double, kind string"
    for i in range(6):
        spark.createDataFrame([(f"k{i}", i, 500.0 * i, "check")], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"n={i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = limiter.stream_rate_limit(stream, 3, 60.0).writeStream.format("memory").queryName("forgetting").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(kept) <= 3 and kept[-1] < 6 and spark.sql("select * from forgetting where allowed").count() == 6


def test_a_job_restarted_within_a_batch_is_watched(spark, tmp_path):
    schema = "job_id string, ts timestamp, status string"
    at = lambda m, s=0: datetime(2024, 1, 1, 0, m, s)
    batches = [[("a", at(0), "running"), ("a", at(1), "failed"), ("a", at(2), "running")], [("d", at(9), "running")], [("d", at(9, 30), "running")], [("d", at(9, 40), "running")]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"n={i}"))
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    assert [(r["job_id"], r["heartbeat_at"]) for r in drain(limiter.stream_reap(files, 300), "restarted")] == [("a", at(2))]


def test_silent_workers_are_reaped(spark, tmp_path):
    schema = "job_id string, ts timestamp, status string"
    at = lambda m, s=0: datetime(2024, 1, 1, 0, m, s)
    batches = [[("a", at(0), "running"), ("b", at(0), "running"), ("c", at(0), "running")], [("b", at(4), "running"), ("c", at(4), "succeeded")], [("d", at(8), "running")], [("d", at(8, 30), "running")], [("d", at(8, 40), "running")]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"n={i}"))
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    out = drain(limiter.stream_reap(files, 300), "reaped")
    assert [(r["job_id"], r["heartbeat_at"]) for r in out] == [("a", at(0))]


def test_files_become_chunks(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.md").write_text("# A\nfirst sentence. second sentence.\n## B\nthird.")
    (src / "empty.md").write_text("\n\n")
    (src / "b.txt").write_text("not read")
    args = (spark, str(src), str(tmp_path / "out"), str(tmp_path / "cp"), "alice")
    ingest.ingest_stream(*args).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out/chunks")).orderBy("chunk_index").collect()
    assert [(r["heading_path"], r["text"]) for r in rows] == [("A", "first sentence. second sentence."), ("A > B", "third.")]
    status = {r["path"].rsplit("/", 1)[1]: r["status"] for r in spark.read.parquet(str(tmp_path / "out/status")).collect()}
    assert status == {"a.md": "ready", "empty.md": "failed"}
    (src / "c.md").write_text("later.")
    ingest.ingest_stream(*args).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/chunks")).count() == 3
