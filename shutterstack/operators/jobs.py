"""The staged processing queue as transformations of a jobs table. One writer at a time commits their results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shutterstack.schemas import ENQUEUED, STAGES, STATUSES


def enqueue(candidates: DataFrame, jobs: DataFrame, stages: tuple[str, ...] = ENQUEUED) -> DataFrame:
    """New pending rows ``(file_hash, stage, status)``: every candidate hash in every stage, unless a job of both exists that hasn't failed."""
    wanted = candidates.where("file_hash is not null").select("file_hash").distinct().select("file_hash", F.explode(F.array(*map(F.lit, stages))).alias("stage"))
    held = jobs.where("status <> 'failed'").select("file_hash", "stage").distinct()
    return wanted.join(held, ["file_hash", "stage"], "left_anti").withColumn("status", F.lit("pending"))


def enqueue_changes(changes: DataFrame, jobs: DataFrame) -> DataFrame:
    """All stages for new and modified files, the index stage for deleted ones."""
    fresh = enqueue(changes.where("kind in ('new', 'modified')"), jobs)
    gone = enqueue(changes.where("kind = 'deleted'"), jobs, ("index",))
    return fresh.unionByName(gone).distinct()


def enqueue_reembed(files: DataFrame, jobs: DataFrame, model_id: str, model_version: str) -> DataFrame:
    """A re-embed job for every active file that has none waiting, running or done, tagged with the model."""
    rows = enqueue(files.where("status = 'active'"), jobs, ("re_embed",))
    return rows.withColumns({"model_id": F.lit(model_id), "model_version": F.lit(model_version)})


def claim(jobs: DataFrame, worker: str, per_stage: int = 1, max_attempts: int | None = None, now: Column | None = None) -> DataFrame:
    """The oldest pending jobs of each stage as claimed: running, one more attempt, owned by ``worker``, started ``now`` if that is given. Ties by id.

    A job that has had its own ``max_attempts``, or the given number, isn't claimed again.
    """
    open_jobs = jobs.where("status = 'pending'")
    open_jobs = open_jobs.where(F.col("attempts") < max_attempts) if max_attempts is not None else open_jobs
    if "max_attempts" in jobs.columns:
        open_jobs = open_jobs.where(F.col("max_attempts").isNull() | (F.coalesce("attempts", F.lit(0)) < F.col("max_attempts")))
    rank = F.row_number().over(Window.partitionBy("stage").orderBy("created_at", "id"))
    first = open_jobs.withColumn("_rank", rank).where(F.col("_rank") <= per_stage)
    started = [] if now is None else [now.alias("started_at")]
    return first.select("stage", "id", F.lit("running").alias("status"), (F.coalesce("attempts", F.lit(0)) + 1).alias("attempts"), F.lit(worker).alias("worker_id"), *started)


def claimed(jobs: DataFrame, claims: DataFrame) -> DataFrame:
    """Jobs with the columns of their claims."""
    columns = [c for c in claims.columns if c not in ("id", "stage")]
    side = claims.select("id", F.struct(*columns).alias("_claim"))
    return jobs.join(side, "id", "left").withColumns({c: F.when(F.col("_claim").isNotNull(), F.col("_claim")[c]).otherwise(F.col(c)) for c in columns}).drop("_claim")


def transition(jobs: DataFrame, outcomes: DataFrame, now: Column | None = None) -> DataFrame:
    """Jobs after ``outcomes(id, outcome, message)``: completed, skipped or failed, with the message of a failure, and completed at ``now`` if that is given. Other jobs stay."""
    done = outcomes.where(F.col("outcome").isin("completed", "skipped", "failed")).groupBy("id").agg(F.max(F.struct("outcome", "message")).alias("o"))
    rows = jobs.join(done, "id", "left")
    if now is not None:
        rows = rows.withColumn("completed_at", F.when(F.col("o").isNotNull(), now).otherwise(F.col("completed_at")))
    return rows.withColumn("status", F.coalesce("o.outcome", "status")).withColumn("error_message", F.when(F.col("o.outcome") == "failed", F.col("o.message")).otherwise(F.col("error_message"))).drop("o")


def reset_running(jobs: DataFrame) -> DataFrame:
    """Running jobs back to pending without worker and start; attempts stay."""
    running = F.col("status") == "running"

    def cleared(c: str) -> Column:
        return F.when(~running | running.isNull(), F.col(c))

    out = jobs.withColumns({c: cleared(c) for c in ("worker_id", "started_at") if c in jobs.columns})
    return out.withColumn("status", F.when(running, "pending").otherwise(F.col("status")))


def update_paths(jobs: DataFrame, changes: DataFrame) -> DataFrame:
    """Pending and running jobs of moved files with the new path."""
    moved = changes.where("kind = 'moved'").groupBy("file_hash").agg(F.max("file_path").alias("_path"))
    path = F.when(F.col("status").isin("pending", "running") & F.col("_path").isNotNull(), F.col("_path")).otherwise(F.col("file_path"))
    return jobs.join(moved, "file_hash", "left").withColumn("file_path", path).drop("_path")


def queue_stats(jobs: DataFrame) -> DataFrame:
    """Jobs per status; the five known statuses always appear, others never."""
    sums = jobs.agg(*(F.count_if(F.col("status") == s).alias(s) for s in STATUSES))
    return sums.unpivot([], list(STATUSES), "status", "n")


def queue_stats_by_stage(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("stage").isin(*STAGES)).groupBy("stage").agg(*(F.count_if(F.col("status") == s).alias(s) for s in STATUSES))


def queue_progress(jobs: DataFrame) -> DataFrame:
    """Finished jobs, and those together with the waiting and running ones."""
    done = F.count_if(F.col("status").isin("completed", "skipped", "failed"))
    return jobs.agg(done.alias("done"), (done + F.count_if(F.col("status").isin("pending", "running"))).alias("total"))
