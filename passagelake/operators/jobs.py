"""The ingestion queue as transitions of a job table.

One driver claims for all workers in a step, so claims are exclusive by construction; several drivers over one table would need a
transactional table format.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..conf import SETTINGS, Settings

STATUSES = ("queued", "running", "succeeded", "dead")
LIVE = ("queued", "running")


def backoff_seconds(attempts: Column, conf: Settings = SETTINGS) -> Column:
    return F.least(F.lit(float(conf.backoff_base)) * F.pow(F.lit(2.0), F.greatest(attempts, F.lit(1)) - 1), F.lit(float(conf.backoff_max))).cast("int")


def enqueue(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """Requests (document_id, job_id) that may be queued: one for each document that has no live job, the smallest job_id."""
    live = jobs.where(F.col("status").isin(*LIVE)).select("document_id")
    return requests.join(live, "document_id", "left_anti").groupBy("document_id").agg(F.min("job_id").alias("job_id"))


def claim(jobs: DataFrame, now: Column, workers: int = 1) -> DataFrame:
    """The oldest due jobs, one for each worker, as they are once claimed. Each task keeps its first ones, so no task sees all jobs."""
    due = jobs.where((F.col("status") == "queued") & (F.col("run_after") <= now))
    first = due.orderBy("run_after", "created_at", "job_id").limit(workers)
    number = F.row_number().over(Window.orderBy("run_after", "created_at", "job_id"))  # over ``workers`` rows
    claimed = first.withColumn("worker", number)
    return claimed.withColumns({"status": F.lit("running"), "attempts": F.col("attempts") + 1, "heartbeat_at": now, "updated_at": now})


def finish(jobs: DataFrame, outcome: Column, error: Column, now: Column, conf: Settings = SETTINGS) -> DataFrame:
    """Running jobs after an outcome: succeeded, failed or permanent. Adds the new status of the document and whether it is tried again."""
    retry = (outcome == "failed") & (F.col("attempts") < F.col("max_attempts"))
    status = F.when(outcome == "succeeded", "succeeded").when(retry, "queued").otherwise("dead")
    document = F.when(outcome == "succeeded", "ready").when(retry, "pending").otherwise("failed")
    later = F.when(retry, now + F.make_interval(secs=backoff_seconds(F.col("attempts"), conf))).otherwise(F.col("run_after"))
    return jobs.withColumns({
        "status": status, "document_status": document, "run_after": later, "will_retry": retry,
        "last_error": F.when(outcome != "succeeded", F.substring(F.trim(error), 1, 2000)),
        "locked_by": F.lit(None).cast("string"), "heartbeat_at": F.lit(None).cast("timestamp"), "updated_at": now,
    })


def stale(jobs: DataFrame, now: Column, conf: Settings = SETTINGS) -> DataFrame:
    """Running jobs whose heartbeat is older than the limit; a job without one isn't stale."""
    return jobs.where((F.col("status") == "running") & (F.col("heartbeat_at") < now - F.make_interval(secs=F.lit(conf.stale_seconds))))


def reap(jobs: DataFrame, now: Column, conf: Settings = SETTINGS) -> DataFrame:
    """Stale jobs after they were taken from their worker."""
    error = F.concat(F.lit("Worker "), F.coalesce("locked_by", F.lit("unknown")), F.lit(" stopped responding; requeued."))
    return finish(stale(jobs, now, conf), F.lit("failed"), error, now, conf)


def purge(jobs: DataFrame, now: Column, conf: Settings = SETTINGS) -> DataFrame:
    """Jobs that are kept: live ones, and ended ones that aren't too old."""
    old = F.col("status").isin("succeeded", "dead") & (F.col("updated_at") < now - F.make_interval(hours=F.lit(conf.retention_hours)))
    return jobs.where(~old)


def depth(jobs: DataFrame) -> DataFrame:
    """status and n for each status, zeros included."""
    named = jobs.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    counted = jobs.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return named.join(counted, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def last_heartbeat(beats: DataFrame) -> DataFrame:
    return beats.groupBy("job_id").agg(F.max("ts").alias("heartbeat_at"))


def requeue_all(documents: DataFrame, files: DataFrame) -> DataFrame:
    """A queued job for every document whose file is there."""
    there = documents.join(files.select("checksum"), "checksum", "left_semi")
    return there.select("document_id", "owner_id", F.lit("queued").alias("status"), F.lit(0).alias("attempts"))
