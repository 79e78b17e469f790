"""Streaming forms of the job-tracking and metrics operators.

Windowed aggregates, joins and deduplication take a watermark, so their state ends. Tasks,
requests and batches are followed by the processors of ``state.py``, which hold live keys only.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quire.operators.catalogue import retention_report
from quire.operators.jobs import KINDS, task_states
from quire.session import work_path
from quire.streaming.state import LATENESS, batch_counts, last_events, request_changes


# --- sources and sinks -------------------------------------------------------

def read_stream(spark: SparkSession, path: str, schema, pattern: str = "*", files_per_batch: int | None = None) -> DataFrame:
    """Parquet files as a stream, by declared schema."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", str(files_per_batch))
    return reader.parquet(path)


def read_kafka(spark: SparkSession, servers: str, topic: str, schema) -> DataFrame:
    """JSON messages of a topic as rows (needs the Kafka connector on the class path)."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("r")).select("r.*")


def with_event_time(df: DataFrame, ts: str = "ts", lateness: str = LATENESS) -> DataFrame:
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)


def drain(stream: DataFrame, label: str, mode: str, transform=None, progress: list | None = None) -> DataFrame:
    """Run a stream over all it has now into a table in the shared folder and read it.

    Each micro-batch overwrites its own folder, so a replayed batch does not double rows.
    Rows carry their batch number in ``batch``; ``progress`` takes the reports of the micro-batches.
    """
    spark = stream.sparkSession
    table, checkpoint = work_path(spark, label), work_path(spark, label + "-offsets")
    written: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        written.append(number)
        out = transform(batch) if transform else batch
        out.write.mode("overwrite").parquet(f"{table}/batch={number}")

    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
        .foreachBatch(write).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    if progress is not None:
        progress += query.recentProgress
    if not written:  # nothing has arrived yet
        empty = spark.createDataFrame([], stream.schema)
        return (transform(empty) if transform else empty).limit(0).withColumn("batch", F.lit(0))
    return spark.read.parquet(table)


def newest(table: DataFrame, keys: list[str]) -> DataFrame:
    """Last published row per key of an update-mode table."""
    rest = [c for c in table.columns if c not in (*keys, "batch")]
    return table.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")


# --- jobs --------------------------------------------------------------------

def latest_progress(events: DataFrame, hours: float = 24, lateness: str = LATENESS) -> DataFrame:
    """Latest snapshot per task (update mode); finished tasks leave the state after ``hours``."""
    entry = ("at", "seq", "kind", "percent", "step_index")
    newest = F.array_max(F.transform("events", lambda e: F.struct(*(e[c].alias(c) for c in entry))))
    row = last_events(events, hours, lateness).select("task_id", newest.alias("r"))
    ts = F.timestamp_micros("r.at").cast(events.schema["ts"].dataType).alias("ts")
    return row.select("task_id", "r.seq", ts, "r.kind", "r.percent", "r.step_index")


def task_state(events: DataFrame, hours: float = 24, lateness: str = LATENESS) -> DataFrame:
    """Task state machine (update mode): the batch job's second step over the last event of each
    kind; finished tasks leave the state after ``hours``."""
    kind = events.schema["ts"].dataType

    def slot(name: str):
        one = F.get(F.filter("events", lambda e: e["kind"] == name), F.lit(0))
        fields = [one[c].alias(c) for c in ("seq", "percent", "step_index", "total_steps")]
        row = F.struct(F.timestamp_micros(one["at"]).cast(kind).alias("ts"), *fields)
        return F.when(one.isNotNull(), row).alias(name)

    return task_states(last_events(events, hours, lateness).select("task_id", *(slot(k) for k in KINDS)))


def batch_progress(tasks: DataFrame, totals: DataFrame) -> DataFrame:
    """Running completed + failed counts per batch (update mode); full batches leave the state."""
    share = (F.col("completed_files") + F.col("failed_files")) / F.col("total_files") * 100
    return batch_counts(tasks, totals).withColumn("progress_percent", share.cast("int"))


def request_windows(requests: DataFrame, size: str = "5 minutes", lateness: str = LATENESS) -> DataFrame:
    """Tumbling windows per endpoint (append mode: each window once, when it is final)."""
    return (
        with_event_time(requests, "end_ts", lateness)
        .groupBy(F.window("end_ts", size), "endpoint")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("status_code") >= 400).alias("errors"),
            F.round(F.avg("duration_s"), 6).alias("avg_s"),
            F.min("duration_s").alias("min_s"),
            F.max("duration_s").alias("max_s"),
        )
        .select(F.col("window.start").alias("window_start"), "endpoint", "n", "errors", "avg_s", "min_s", "max_s")
    )


def rate_sliding(calls: DataFrame, size: str = "60 seconds", slide: str = "10 seconds", lateness: str = LATENESS) -> DataFrame:
    """Calls per client in sliding windows (append mode)."""
    return (
        with_event_time(calls, "end_ts", lateness)
        .groupBy(F.window("end_ts", size, slide), "client")
        .agg(F.count(F.lit(1)).alias("calls"))
        .select(F.col("window.start").alias("window_start"), "client", "calls")
    )


def active_gauge(marks: DataFrame, label: str = "gauge", progress: list | None = None) -> DataFrame:
    """Active requests = starts without an end; ends without a start are ignored.

    The state holds active requests only; each micro-batch adds its changes up to one row, and
    the gauge is the sum of those rows.
    """
    names = ("started", "finished", "active")

    def total(rows: DataFrame) -> DataFrame:
        return rows.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names))

    return total(drain(request_changes(marks), label, "append", total, progress))


def conversion_pairs(starts: DataFrame, ends: DataFrame, within: str = "1 hour", lateness: str = LATENESS) -> DataFrame:
    """Start and end events of a request joined within a time bound -> duration (append mode)."""
    s = with_event_time(starts.select("operation_id", F.col("ts").alias("start_ts")), "start_ts", lateness)
    e = with_event_time(ends.select(F.col("operation_id").alias("end_id"), F.col("ts").alias("end_ts")), "end_ts", lateness)
    bound = (
        (F.col("operation_id") == F.col("end_id"))
        & (F.col("end_ts") >= F.col("start_ts"))
        & (F.col("end_ts") <= F.col("start_ts") + F.expr(f"INTERVAL {within}"))
    )
    micros = F.unix_micros("end_ts") - F.unix_micros("start_ts")
    return s.join(e, bound).select("operation_id", F.round(micros / 1e6, 6).alias("duration_s"))


def dedup_updates(updates: DataFrame, keys: list[str], lateness: str = LATENESS) -> DataFrame:
    """Drop repeats of an update that arrive within the lateness bound (append mode)."""
    return with_event_time(updates, "ts", lateness).dropDuplicatesWithinWatermark(keys)


def subscription_messages(updates: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """One JSON message per update and subscriber of its task; others are dropped."""
    body = F.struct(
        F.lit("progress_update").alias("type"), "task_id",
        F.struct("seq", "kind", "step_index").alias("data"),
    )
    return updates.join(subscriptions, "task_id").select("connection_id", "seq", F.to_json(body).alias("message"))


def publish_latest(events: DataFrame, subscriptions: DataFrame, label: str = "published") -> DataFrame:
    """Latest state per task sent to its subscribers, batch by batch."""
    return drain(
        latest_progress(events), label, "update",
        lambda batch: batch.join(subscriptions, "task_id").select("connection_id", "task_id", "seq", "kind", "percent"),
    )


class ExpireFinished(StatefulProcessor):
    """Keeps the newest status of a task and hands finished ones out once they are
    ``ttl_ms`` older than the watermark; their state then ends."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("last", "status string, end_ms long, at long, seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = self.state.get() if self.state.exists() else None
        for chunk in rows:
            top = chunk.sort_values(["at", "seq"]).iloc[-1]
            found = (str(top["status"]), int(top["end_ms"]), int(top["at"]), int(top["seq"]))
            if best is None or found[2:] > tuple(best)[2:]:
                best = found
        best = tuple(best)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer if isinstance(timer, int) else timer[0])
        self.state.update(best)
        if best[0] in ("completed", "failed"):
            self.handle.registerTimer(best[1] + self.ttl_ms)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, end_ms, _, _ = self.state.get()
        self.state.clear()
        yield pd.DataFrame({"task_id": [key[0]], "status": [status], "end_ms": [end_ms]})

    def close(self) -> None:
        pass


def expire_finished(events: DataFrame, hours: float = 24, lateness: str = LATENESS) -> DataFrame:
    """Finished tasks leaving the state store, by event time (append mode)."""
    status = (
        F.when(F.col("kind") == "complete", "completed").when(F.col("kind") == "fail", "failed").otherwise("live")
    )
    timed = with_event_time(events, "ts", lateness).select(
        "task_id", "ts", status.alias("status"), F.unix_millis("ts").alias("end_ms"),
        F.unix_micros("ts").alias("at"), "seq",
    )
    return timed.groupBy("task_id").transformWithStateInPandas(
        statefulProcessor=ExpireFinished(int(hours * 3_600_000)),
        outputStructType="task_id long, status string, end_ms long",
        outputMode="append", timeMode="eventTime",
    )


def retention_sweep(ticks: DataFrame, files: DataFrame, hours: float = 24, label: str = "sweep") -> DataFrame:
    """A retention report per tick batch, at the newest clock value of the batch."""

    def sweep(batch: DataFrame) -> DataFrame:
        now_s = batch.agg(F.max("now_s")).first()[0]
        report = retention_report(files, now_s if now_s is not None else 0, hours)
        return report.withColumn("now_s", F.lit(now_s).cast("bigint"))

    return drain(ticks, label, "append", sweep)


def start_sweeper(ticks: DataFrame, files: DataFrame, path: str, checkpoint: str, hours: float = 24,
                  every: str = "60 minutes"):
    """The long-running form: one report at once, then one per ``every``."""

    def write(batch: DataFrame, number: int) -> None:
        now_s = batch.agg(F.max("now_s")).first()[0]
        if now_s is not None:
            retention_report(files, now_s, hours).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        ticks.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
        .trigger(processingTime=every).start()
    )
