"""Job tracking: task progress, batch rollups, stage weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quire.functions import values as V
from quire.operators.ordered import number_by_range


def latest_progress(events: DataFrame) -> DataFrame:
    """Last write per task by (ts, seq), as a partial aggregate."""
    row = F.struct("seq", "ts", "kind", "percent", "step_index", "total_steps")
    return events.groupBy("task_id").agg(F.max_by(row, F.struct("ts", "seq")).alias("r")).select("task_id", "r.*")


def step_percent(percent: Column, step: Column, total: Column) -> Column:
    """Explicit percent clamped to 0..100, else the share of steps, at most 95."""
    by_step = F.least(F.lit(95), (step / total * 100).cast("int"))
    return F.when(percent.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(100), percent))).otherwise(by_step)


KINDS = ["start", "update", "complete", "fail"]


def last_events(events: DataFrame) -> DataFrame:
    """The last event of each kind per task. Works on a batch or a stream; the state per
    task is four rows, combined on the map side."""
    row = F.struct("ts", "seq", "percent", "step_index", "total_steps")
    return events.groupBy("task_id").agg(
        *[F.max_by(row, F.when(F.col("kind") == k, F.struct("ts", "seq"))).alias(k) for k in KINDS]
    )


def task_states(last: DataFrame) -> DataFrame:
    """Task states from the last event of each kind. Events before a task's last start do
    not count (without a start the task is unknown), later ones overwrite a finished task."""

    def at(kind: str) -> Column:
        return F.struct(F.col(f"{kind}.ts"), F.col(f"{kind}.seq"))

    def after_start(kind: str) -> Column:
        return F.when(F.col(kind).isNotNull() & (at(kind) > at("start")), at(kind))

    update, done, failed = (after_start(k) for k in KINDS[1:])
    ended = F.greatest(done, failed)
    newest = F.greatest(at("start"), update, done, failed)
    moved = F.greatest(at("start"), update, done)
    percent = step_percent(F.col("update.percent"), F.col("update.step_index"), F.col("start.total_steps"))
    return last.filter(F.col("start").isNotNull()).select(
        "task_id",
        F.when(newest == failed, "failed").when(newest == done, "completed").when(newest == update, "processing")
        .otherwise("pending").alias("status"),
        F.when(moved == done, 100).when(moved == update, percent).otherwise(0).alias("progress_percent"),
        F.when(update.isNotNull(), F.col("update.step_index")).otherwise(0).alias("step_index"),
        F.col("start.ts").alias("start_ts"),
        ended["ts"].alias("end_ts"),
    )


def replay_tasks(events: DataFrame) -> DataFrame:
    """Task states after all events, without replaying them one by one."""
    return task_states(last_events(events))


def expire_tasks(tasks: DataFrame, now: Column, hours: float = 24) -> DataFrame:
    """Drop finished tasks whose end lies more than ``hours`` back."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("end_ts").cast("timestamp"))
    old = F.col("status").isin("completed", "failed") & (age > int(hours * 3_600_000_000))
    return tasks.filter(~F.coalesce(old, F.lit(False)))


def progress_view(tasks: DataFrame, now_s: float) -> DataFrame:
    """Elapsed and remaining seconds at the clock ``now_s``."""
    start, end, p = F.col("start_s"), F.col("end_s"), F.col("progress_percent")
    elapsed = F.when(start.isNotNull() & end.isNull(), F.lit(float(now_s)) - start).when(
        start.isNotNull(), end - start
    ).otherwise(0.0)
    left = F.when(
        (p > 0) & (F.col("status") == "processing"),
        F.greatest(F.lit(0.0), F.col("elapsed_time") * (F.lit(100.0) / p) - F.col("elapsed_time")),
    ).otherwise(0.0)
    return tasks.withColumn("elapsed_time", elapsed).withColumn("estimated_remaining", left)


def active_tasks(tasks: DataFrame, now_s: float) -> DataFrame:
    return progress_view(tasks.filter(F.col("status").isin("pending", "processing")), now_s)


def job_eta(jobs: DataFrame, now_s: float) -> DataFrame:
    """Duration only with both ends; remaining from the completed fraction."""
    start, fraction = F.col("start_s"), F.col("fraction")
    elapsed = F.lit(float(now_s)) - start
    return jobs.withColumns({
        "duration": F.col("end_s") - start,
        "estimated_remaining": F.when(fraction > 0, elapsed / fraction - elapsed),
    })


def batch_status(batches: DataFrame, tasks: DataFrame) -> DataFrame:
    """Totals, truncated percent and status per batch; empty batches stay."""
    counts = tasks.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("status") == "completed").alias("c"),
        F.count_if(F.col("status") == "failed").alias("f"),
    )
    n, c, f = (F.coalesce(F.col(x), F.lit(0)) for x in "ncf")
    return batches.join(counts, "batch_id", "left").select(
        "batch_id",
        n.alias("total_files"),
        c.alias("completed_files"),
        f.alias("failed_files"),
        F.when(n > 0, ((c + f) / n * 100).cast("int")).otherwise(0).alias("progress_percent"),
        F.when(c + f < n, "processing").when(f == 0, "completed").otherwise("completed_with_errors").alias("status"),
    )


def batch_status_v2(jobs: DataFrame) -> DataFrame:
    """Mean progress, longest remaining time of running jobs, partial completion."""
    status = F.col("status")
    running = (status == "processing") & (F.col("fraction") > 0)
    eta = F.col("elapsed_s") / F.col("fraction") - F.col("elapsed_s")
    done, failed = F.count_if(status == "completed"), F.count_if(status == "failed")
    total = F.count(F.lit(1))
    return jobs.groupBy("batch_id").agg(
        total.alias("total_jobs"),
        F.when(done == total, "completed").when(done + failed == total, "partially_completed")
        .otherwise("processing").alias("status"),
        F.round(F.avg("fraction"), 6).alias("overall_progress"),
        F.round(F.max(F.when(running, eta)), 6).alias("estimated_remaining"),
    )


def batch_nested(tasks: DataFrame, max_tasks: int = V.MAX_BATCH_FILES) -> DataFrame:
    """Batches with their tasks as nested arrays, in order of task id: parts of ``max_tasks`` tasks each, part 0 first.

    The last part of a batch may be shorter; a batch within the size limit has one part, and no row holds more. Tasks
    are numbered in ranges of (batch, task) of equal size, so a batch of any size spreads evenly.
    """
    numbered = number_by_range(tasks.select("batch_id", "task_id", "status"), ["batch_id"], ["task_id", "status"], "_no")
    return (
        numbered.withColumn("part", F.floor((F.col("_no") - 1) / max_tasks).cast("int"))
        .groupBy("batch_id", "part")
        .agg(F.sort_array(F.collect_list(F.struct("task_id", "status"))).alias("tasks"))
    )


def task_failures(nested: DataFrame, status: str = "failed") -> DataFrame:
    """The failed (or otherwise chosen) tasks inside nested batches."""
    chosen = F.filter("tasks", lambda t: t["status"] == status)
    return nested.select("batch_id", F.explode(chosen).alias("t")).select("batch_id", "t.*")


def stage_progress(events: DataFrame) -> DataFrame:
    """Sum of the weights of a task's completed stages (each counted once)."""
    share = sum(
        F.coalesce(F.max(F.when((F.col("stage") == s) & F.col("done"), w)), F.lit(0.0))
        for s, w in V.STAGE_WEIGHTS.items()
    )
    return events.groupBy("task_id").agg(F.round(share, 4).alias("progress"))
