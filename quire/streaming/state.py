"""Stateful processors whose state ends: live tasks, open requests, open batches.

Rows are combined on the map side before they are shuffled to their key, so a hot key sends a few rows per Arrow
batch; a processor then makes one state read and one write per key and micro-batch. State rows fall when a task has
been finished for a while (event-time timer), a request has both its marks, or a batch its full count.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LATENESS = "10 minutes"
ENDED = ("complete", "fail")


def _last_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last event of each task and kind in a batch, by (at, seq)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [(c, "ascending") for c in ("task_id", "kind", "at", "seq")]
        rows = pa.Table.from_batches([batch]).take(pc.sort_indices(batch, sort_keys=keys)).combine_chunks()
        codes = [pc.dictionary_encode(rows.column(c).combine_chunks(), null_encoding="encode").indices.to_numpy() for c in ("task_id", "kind")]
        last = [True] * len(codes[0])
        if len(last) > 1:
            last[:-1] = ((codes[0][1:] != codes[0][:-1]) | (codes[1][1:] != codes[1][:-1])).tolist()
        yield from rows.filter(pa.array(last)).to_batches()


def _timers_of(handle: StatefulProcessorHandle) -> list[int]:
    return [t if isinstance(t, int) else t[0] for t in handle.listTimers()]


class LastEvents(StatefulProcessor):
    """Holds the last event of each kind of a task and hands them out whenever one changes.

    A task whose newest event is an end leaves the state once the watermark is `ttl_ms` past it; an event in the
    meantime keeps it.
    """

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        entry = "struct<kind:string,at:bigint,seq:bigint,percent:int,step_index:int,total_steps:int>"
        self.state = handle.getValueState("last", f"events array<{entry}>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self.state.get()
        last = {e[0]: tuple(e) for e in known[0]} if known else {}
        before = max(last.values(), key=lambda e: e[1:3]) if last else None
        for r in rows:
            e = (r["kind"], r["at"], r["seq"], r["percent"], r["step_index"], r["total_steps"])
            if e[0] not in last or e[1:3] > last[e[0]][1:3]:
                last[e[0]] = e
        newest = max(last.values(), key=lambda e: e[1:3])
        if newest != before:
            if before and before[0] in ENDED:
                for timer in _timers_of(self.handle):
                    self.handle.deleteTimer(timer)
            if newest[0] in ENDED:
                self.handle.registerTimer(newest[1] // 1000 + self.ttl_ms)
        events = list(last.values())
        self.state.update((events,))
        yield Row(task_id=key[0], events=events)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


def last_events(events: DataFrame, hours: float = 24, lateness: str = LATENESS) -> DataFrame:
    """task_id and an array of the last event of each kind, per task that changed (update mode).

    events: task_id, ts, seq, kind, percent, step_index, total_steps. Rows without time, seq or kind are left out. State
    holds the live tasks and those that ended less than `hours` before the watermark. An end that comes within that time
    after another row is kept is final; later rows of a task that has left begin it anew.
    """
    rows = events.filter("ts IS NOT NULL AND seq IS NOT NULL AND kind IS NOT NULL").select(
        F.col("task_id").cast("long").alias("task_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
        F.col("seq").cast("long").alias("seq"), "kind", *(F.col(c).cast("int").alias(c) for c in ("percent", "step_index", "total_steps")),
    )
    kinds = "task_id long, at long, seq long, kind string, percent int, step_index int, total_steps int"
    timed = rows.mapInArrow(_last_of_each, kinds).withColumn("ts", F.timestamp_micros("at")).withWatermark("ts", lateness)
    return timed.groupBy("task_id").transformWithState(
        statefulProcessor=LastEvents(int(hours * 3_600_000)),
        outputStructType="task_id long, events array<struct<kind:string,at:bigint,seq:bigint,percent:int,step_index:int,total_steps:int>>",
        outputMode="update", timeMode="eventTime",
    )


BUCKETS = 4096  # of requests and of batches: a bucket is one state row, read and written once per micro-batch
NEVER = 1 << 62


def bucket_of(key: str):
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).alias("bucket")


def _packed(rows: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.Table.from_pandas(rows, preserve_index=False)
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _held(state) -> list[pd.DataFrame]:
    known = state.get()
    return [pa.ipc.open_stream(bytes(known[0])).read_pandas()] if known else []


def _keep(state, rows: pd.DataFrame, held: bool) -> None:
    if len(rows):
        state.update((_packed(rows),))
    elif held:
        state.clear()


class OpenRequests(StatefulProcessor):
    """Holds the first mark of a bucket's requests until the second is in; hands out what changes in the counts."""

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("marks", "open binary")

    def _timed(self, rows: pd.DataFrame, held: bool) -> None:
        """One timer per bucket, for the end that has waited longest for its start."""
        if held:
            for timer in _timers_of(self.handle):
                self.handle.deleteTimer(timer)
        first = int(rows["until"].min()) if len(rows) else NEVER
        if first < NEVER:
            self.handle.registerTimer(first)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = _held(self.state)
        new = pd.concat([r[["request_id", "started", "ended", "at"]] for r in rows]).assign(begun=0, over=0, until=0)
        known = [h.assign(started=0, ended=0, at=0, over=1 - h["begun"]) for h in held]
        r = pd.concat([new, *known]).groupby("request_id", dropna=False, as_index=False).max()
        begun, over = r["begun"] > 0, r["over"] > 0
        new_start, new_end = (r["started"] > 0) & ~begun, (r["ended"] > 0) & ~over
        both = (begun | new_start) & (over | new_end)
        waits = (r["at"] // 1000 + self.wait_ms).mask(new_start, NEVER)  # an end without a start waits for it only so long
        left = pd.DataFrame({
            "request_id": r["request_id"], "begun": (begun | new_start & ~over).astype("int64"),
            "until": r["until"].where(begun | over, waits).astype("int64"),
        })[~both]
        _keep(self.state, left, bool(held))
        self._timed(left, bool(held))
        told = new_start | (begun & new_end)
        if told.any():
            started, finished = int(new_start[told].sum()), int(both[told].sum())
            yield pd.DataFrame({"started": [started], "finished": [finished], "active": [started - finished]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for held in _held(self.state):
            now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
            left = held[held["until"] > now]
            _keep(self.state, left, True)
            self._timed(left, False)
        return iter([])

    def close(self) -> None:
        pass


def request_changes(marks: DataFrame, wait: float = 1, lateness: str = LATENESS) -> DataFrame:
    """started, finished, active: by how much each count changes, a row per bucket of requests that change it (append mode).

    marks: request_id, ts, event ('start', or anything else for an end); rows without time are left out. A request has
    one start and one end; its state goes when both are in. An end whose start doesn't come within `wait` hours of
    event time is forgotten, so what stays in the state are the active requests.
    """
    start = (F.col("event") == "start").cast("int")
    rows = marks.filter("ts IS NOT NULL AND event IS NOT NULL").select(
        bucket_of("request_id"), F.col("request_id").cast("string").alias("request_id"), F.col("ts").cast("timestamp").alias("ts"),
        start.cast("long").alias("started"), (1 - start).cast("long").alias("ended"),
    )
    timed = rows.withColumn("at", F.unix_micros("ts")).withWatermark("ts", lateness)
    return timed.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=OpenRequests(int(wait * 3_600_000)),
        outputStructType="started long, finished long, active long", outputMode="append", timeMode="eventTime",
    )


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums per batch id within an Arrow batch."""
    for batch in batches:
        if batch.num_rows:
            sums = pa.Table.from_batches([batch]).group_by("batch_id").aggregate(
                [("total_files", "max"), ("completed", "sum"), ("failed", "sum")]
            )
            names = ["batch_id", "total_files", "completed", "failed"]
            order = ["batch_id", "total_files_max", "completed_sum", "failed_sum"]
            yield from sums.select(order).rename_columns(names).to_batches()


class OpenBatches(StatefulProcessor):
    """Counts the finished files of a bucket's batches until all are in; a full batch then leaves the state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("counts", "open binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = _held(self.state)
        new = pd.concat([r[["batch_id", "total_files", "completed", "failed"]] for r in rows]).assign(fresh=1)
        known = [h.assign(total_files=0, fresh=0) for h in held]
        r = pd.concat([new, *known]).groupby("batch_id", as_index=False).agg(
            {"completed": "sum", "failed": "sum", "total_files": "max", "fresh": "max"}
        )
        changed = r["fresh"] > 0
        full = changed & (r["completed"] + r["failed"] >= r["total_files"])
        _keep(self.state, r.loc[~full, ["batch_id", "completed", "failed"]], bool(held))
        yield r.loc[changed, ["batch_id", "completed", "failed", "total_files"]].set_axis(
            ["batch_id", "completed_files", "failed_files", "total_files"], axis=1
        )

    def close(self) -> None:
        pass


def batch_counts(tasks: DataFrame, totals: DataFrame) -> DataFrame:
    """batch_id, completed_files, failed_files, total_files of the batches that changed (update mode).

    tasks: batch_id, status of files as they finish, each once; totals: batch_id, total_files, a static table. A batch
    leaves the state with its last file; batches without a total are left out.
    """
    sizes = totals.filter("total_files IS NOT NULL").groupBy("batch_id").agg(F.max("total_files").cast("long").alias("total_files"))
    rows = tasks.filter("status IN ('completed', 'failed')").join(sizes, "batch_id").select(
        F.col("batch_id").cast("long").alias("batch_id"), "total_files",
        (F.col("status") == "completed").cast("long").alias("completed"), (F.col("status") == "failed").cast("long").alias("failed"),
    )
    kinds = "batch_id long, total_files long, completed long, failed long"
    return rows.mapInArrow(_counted, kinds).withColumn("bucket", bucket_of("batch_id")).groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=OpenBatches(),
        outputStructType="batch_id long, completed_files long, failed_files long, total_files long",
        outputMode="update", timeMode="none",
    )
