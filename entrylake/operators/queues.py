"""Rollups of the queue tables. All counts are combined before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import schemas as S


def job_state(now: int, retry_after: int = S.RETRY_AFTER_SECONDS) -> Column:
    """ready, delayed, reserved, or stale: reserved for longer than ``retry_after`` seconds."""
    return (F.when(F.col("reserved_at") < now - retry_after, "stale")
            .when(F.col("reserved_at").isNotNull(), "reserved")
            .when(F.col("available_at") > now, "delayed").otherwise("ready"))


def queue_backlog(jobs: DataFrame, now: int, retry_after: int = S.RETRY_AFTER_SECONDS) -> DataFrame:
    """Jobs per queue and state, and the age in seconds of the oldest job."""
    states = jobs.withColumn("_state", job_state(now, retry_after))
    counts = [F.count_if(F.col("_state") == s).alias(s) for s in ("ready", "delayed", "reserved", "stale")]
    return states.groupBy("queue").agg(*counts, (F.lit(now) - F.min("created_at")).alias("oldest_age"))


def oldest_waiting(jobs: DataFrame, now: int, k: int) -> DataFrame:
    """Report of the k longest-waiting ready jobs per queue, in order of id.

    Each task keeps only k rows per queue before the shuffle.
    """
    rank = F.row_number().over(Window.partitionBy("queue").orderBy("id"))
    return (jobs.where(job_state(now) == "ready").select("queue", "id", "created_at")
            .withColumn("rnk", rank).where(F.col("rnk") <= k))


def batch_progress(members: DataFrame) -> DataFrame:
    """Totals, percentage done and status of each batch (members: batch_id, job_id, status)."""
    status = (F.when(F.col("pending_jobs") > 0, "running")
              .when(F.col("failed_jobs") > 0, "failed").otherwise("finished"))
    done = F.col("total_jobs") - F.col("pending_jobs")
    return (members.groupBy("batch_id")
            .agg(F.count(F.lit(1)).alias("total_jobs"),
                 F.count_if(F.col("status") == "pending").alias("pending_jobs"),
                 F.count_if(F.col("status") == "failed").alias("failed_jobs"))
            .withColumn("percent", F.floor(done * 100 / F.col("total_jobs")))
            .withColumn("status", status))


def failed_members(members: DataFrame) -> DataFrame:
    """Failed jobs of each batch, one row each: a batch may have any number of them."""
    return members.where("status = 'failed'").select("batch_id", F.col("job_id").alias("failed_job_id"))


def failed_rollup(failed: DataFrame) -> DataFrame:
    """Failed jobs per queue and day."""
    return (failed.groupBy("queue", F.to_date("failed_at").alias("day"))
            .agg(F.count(F.lit(1)).alias("failures")))


def latest_failure(failed: DataFrame) -> DataFrame:
    """The last failed job of each queue."""
    last = F.max(F.struct("failed_at", "id", "uuid"))
    return (failed.groupBy("queue").agg(last.alias("_l"), F.count(F.lit(1)).alias("failures"))
            .select("queue", "failures", F.col("_l.uuid").alias("uuid"),
                    F.col("_l.failed_at").alias("failed_at")))
