import datetime as dt
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from quire.operators import jobs as batch
from quire.session import shared_dir, work_path
from quire.streaming import jobs as ops
from test_jobs import EVENT, T0, events, replay

SECOND = dt.timedelta(seconds=1)


def stream_of(spark, path, chunks, schema):
    """One file per chunk, read one per micro-batch in writing order."""
    for rows in chunks:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))
        time.sleep(1.1)  # files are taken by modification time
    return ops.read_stream(spark, str(path), spark.createDataFrame([], schema).schema, "*.parquet", files_per_batch=1)


def test_task_state_over_micro_batches(spark, tmp_path):
    rows = events(seed=8, n=900)
    chunks = [rows[:300], rows[300:600], rows[600:]]
    stream = stream_of(spark, tmp_path / "in", chunks, EVENT)
    table = ops.drain(ops.task_state(stream), "t", "update")
    assert table.select("batch").distinct().count() >= 3
    got = {r.task_id: (r.status, r.progress_percent, r.step_index, r.start_ts, r.end_ts) for r in ops.newest(table, ["task_id"]).collect()}
    assert got == replay(rows)


REQ = "request_id long, endpoint string, end_ts timestamp_ntz, duration_s double, status_code int"


def test_late_rows_are_dropped_past_the_watermark(spark, tmp_path):
    def at(minutes, i):
        return (i, "e", T0 + dt.timedelta(minutes=minutes), 1.0, 500 if i % 2 else 200)

    # a batch filters late rows by the watermark of the batch before it, hence the third one
    chunks = [[at(1, 1), at(2, 2)], [at(60, 3)], [at(61, 7)], [at(3, 4), at(58, 5)], [at(120, 6)]]
    stream = stream_of(spark, tmp_path / "in", chunks, REQ)
    out = ops.drain(ops.request_windows(stream), "w", "append").collect()
    got = {r.window_start.replace(tzinfo=None): (r.n, r.errors) for r in out}
    # the row of minute 3 came after the watermark had passed 50 minutes; minute 58 was in time
    assert got == {T0: (2, 1), T0 + dt.timedelta(minutes=55): (1, 1), T0 + dt.timedelta(minutes=60): (2, 2)}


def test_repeats_within_the_bound_are_dropped(spark, tmp_path):
    row = lambda s, seq, pct: (1, T0 + s * SECOND, seq, "update", pct, 0, 5)
    stream = stream_of(spark, tmp_path / "in", [[row(0, 1, 10), row(1, 2, 20)], [row(2, 3, 10), row(3, 4, 30)]], EVENT)
    out = ops.drain(ops.dedup_updates(stream, ["task_id", "percent"]).select("seq", "percent"), "d", "append")
    assert sorted((r.percent, r.seq) for r in out.collect()) == [(10, 1), (20, 2), (30, 4)]


def test_finished_tasks_leave_the_state(spark, tmp_path):
    def row(task, hours, seq, kind):
        return (task, T0 + dt.timedelta(hours=hours), seq, kind, None, 0, 5)

    chunks = [
        [row(1, 0, 0, "start"), row(1, 1, 1, "complete"), row(2, 0, 2, "start"), row(3, 1, 3, "fail")],
        [row(3, 2, 4, "start"), row(4, 27, 5, "start")],
        [row(4, 60, 6, "complete")],
    ]
    stream = stream_of(spark, tmp_path / "in", chunks, EVENT)
    out = ops.drain(ops.expire_finished(stream, hours=24), "x", "append")
    assert [(r.task_id, r.status) for r in out.collect()] == [(1, "completed")]


def test_sweep_reports_per_tick(spark, tmp_path):
    files = spark.createDataFrame([("uploads", "a", 1048576, 0, None), ("outputs", "b", 5, 90_000, None)],
                                  "area string, rel_path string, size_bytes long, modified_s long, access_error string")
    ticks = stream_of(spark, tmp_path / "in", [[(90_000,)], [(200_000,)]], "now_s long")
    out = {(r.now_s, r.area): r.files_removed for r in ops.retention_sweep(ticks, files).collect()}
    assert out == {(90_000, "uploads"): 1, (90_000, "total"): 1, (200_000, "uploads"): 1, (200_000, "outputs"): 1, (200_000, "total"): 2}


def test_batch_progress(spark, tmp_path):
    chunks = [[(1, "a", "completed")], [(1, "b", "failed"), (2, "c", "completed")]]
    stream = stream_of(spark, tmp_path / "in", chunks, "batch_id int, task_id string, status string")
    totals = spark.createDataFrame([(1, 3), (2, 1)], "batch_id int, total_files int")
    got = {r.batch_id: r.progress_percent for r in ops.newest(ops.drain(ops.batch_progress(stream, totals), "b", "update"), ["batch_id"]).collect()}
    assert got == {1: 66, 2: 100}


def held(progress):
    """Keys in the state after each micro-batch."""
    return [p["stateOperators"][0]["numRowsTotal"] for p in progress]


def test_closed_batches_leave_the_state(spark, tmp_path):
    chunks = [
        [(b, f"{b}-{k}", "completed") for b in range(20) for k in range(2)] + [(50, "x", "failed"), (None, "n", "failed")],
        [(b, f"{b}-2", "failed") for b in range(17)], [(60, "no total", "completed")],
    ]
    stream = stream_of(spark, tmp_path / "in", chunks, "batch_id int, task_id string, status string")
    totals = spark.createDataFrame([(b, 3) for b in range(20)] + [(50, 1)], "batch_id int, total_files int")
    progress = []
    table = ops.drain(ops.batch_progress(stream, totals), "b", "update", progress=progress)
    got = {r.batch_id: (r.completed_files, r.failed_files, r.progress_percent) for r in ops.newest(table, ["batch_id"]).collect()}
    assert got == {b: (2, 1, 100) if b < 17 else (2, 0, 66) for b in range(20)} | {50: (0, 1, 100)}
    assert held(progress) == [20, 3, 3]  # batch 50 was full at once


def test_the_gauge_holds_active_requests_only(spark, tmp_path):
    minute = 60 * SECOND
    marks = [
        [(r, T0, "start") for r in range(10)] + [(r, T0 + minute, "end") for r in range(4)] + [(90, T0, "end"), (91, T0, "error")],
        [(r, T0 + 2 * minute, "end") for r in range(4, 8)] + [(91, T0, "start"), (20, T0 + 2 * minute, "start")],
        [(21, T0 + dt.timedelta(hours=3), "start")], [(22, T0 + dt.timedelta(hours=4), "start"), (22, T0 + dt.timedelta(hours=4), "end")],
    ]
    progress = []
    stream = stream_of(spark, tmp_path / "m", marks, "request_id int, ts timestamp_ntz, event string")
    r = ops.active_gauge(stream, progress=progress).first()
    # 0-9, 20, 21, 22 and 91 began; 0-7, 22 and 91 ended; 90 never began
    assert (r.started, r.finished, r.active) == (14, 10, 4)
    assert held(progress)[-1] == r.active


def test_many_open_keys_are_held_by_bucket(spark, tmp_path):
    from quire.streaming.state import BUCKETS

    n, progress = 3 * BUCKETS, []
    marks = [[(r, T0, "start") for r in range(n)], [(r, T0 + SECOND, "end") for r in range(0, n, 2)]]
    stream = stream_of(spark, tmp_path / "m", marks, "request_id long, ts timestamp_ntz, event string")
    assert tuple(ops.active_gauge(stream, progress=progress).first()) == (n, n // 2, n // 2)
    assert max(held(progress)) <= BUCKETS
    files = [[(b, "a", "completed") for b in range(n)], [(b, "b", "failed") for b in range(0, n, 3)]]
    stream = stream_of(spark, tmp_path / "b", files, "batch_id long, task_id string, status string")
    totals, progress = spark.range(n).select(F.col("id").alias("batch_id"), F.lit(2).alias("total_files")), []
    table = ops.newest(ops.drain(ops.batch_progress(stream, totals), "b", "update", progress=progress), ["batch_id"])
    assert {r.progress_percent: r["count"] for r in table.groupBy("progress_percent").count().collect()} == {50: n - n // 3, 100: n // 3}
    assert max(held(progress)) <= BUCKETS


def test_finished_tasks_leave_the_state_and_live_ones_stay(spark, tmp_path):
    def row(task, hours, seq, kind):
        return (task, T0 + dt.timedelta(hours=hours), seq, kind, None, 0, 5)

    chunks = [
        [row(t, 0, t, "start") for t in range(12)] + [row(t, 1, 100 + t, "complete") for t in range(8)],
        [row(0, 2, 200, "start"), row(1, 2, 201, "fail"), row(8, 3, 202, "update")],  # 0 begins again
        [row(9, 40, 300, "update")], [row(10, 41, 301, "fail")], [row(11, 42, 302, "update"), row(2, 1, 303, "start")],
    ]
    stream = stream_of(spark, tmp_path / "in", chunks, EVENT)
    progress = []
    table = ops.drain(ops.task_state(stream), "t", "update", progress=progress)
    got = {r.task_id: r.status for r in ops.newest(table, ["task_id"]).collect()}
    assert got == replayed([r for c in chunks for r in c][:-1])  # the last row is older than the watermark
    live = {t for t, s in got.items() if s not in ("completed", "failed")}
    assert live == {0, 8, 9, 11} and held(progress)[:2] == [12, 12]
    assert held(progress)[-1] == len(live) + 1  # and 10, which ended an hour ago
    table = ops.drain(ops.latest_progress(stream), "l", "update")
    assert {r.task_id: r.kind for r in ops.newest(table, ["task_id"]).collect()} == {
        0: "start", 1: "fail", 8: "update", 9: "update", 10: "fail", 11: "update"} | {t: "complete" for t in range(2, 8)}


def replayed(rows):
    return {t: s[0] for t, s in replay(rows).items()}


def test_rows_are_combined_before_the_shuffle(spark):
    import pyarrow as pa

    from quire.streaming.state import _last_of_each

    rows = [(k % 3, k // 7, k, ["start", "update"][k % 2], None, 0, 5) for k in range(1000)]
    names = ["task_id", "at", "seq", "kind", "percent", "step_index", "total_steps"]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)
    out = [r for b in _last_of_each([batch]) for r in b.to_pylist()]
    want = {}
    for r in rows:
        want[r[0], r[3]] = max(want.get((r[0], r[3]), (0, 0)), (r[1], r[2]))
    assert {(r["task_id"], r["kind"]): (r["at"], r["seq"]) for r in out} == want and len(out) == 6


def test_pairs_within_the_bound(spark, tmp_path):
    rows = [[(1, T0, "start"), (2, T0, "start")], [(1, T0 + 90 * SECOND, "end"), (2, T0 + dt.timedelta(hours=2), "end")]]
    schema = "operation_id int, ts timestamp_ntz, event string"
    stream = stream_of(spark, tmp_path / "in", rows, schema)
    out = ops.drain(ops.conversion_pairs(stream.filter("event = 'start'"), stream.filter("event = 'end'")), "p", "append")
    assert [(r.operation_id, r.duration_s) for r in out.collect()] == [(1, 90.0)]


def test_shared_folder_is_the_named_one(spark):
    assert work_path(spark, "x").startswith(shared_dir(spark).rstrip("/"))
    assert work_path(spark, "x") != work_path(spark, "x")


@pytest.mark.parametrize("hours, left", [(1, [2]), (100, [1, 2])])
def test_batch_twin_of_expiry(spark, hours, left):
    df = spark.createDataFrame([(1, "failed", T0), (2, "pending", None)], "task_id int, status string, end_ts timestamp_ntz")
    now = F.lit("2024-01-02 00:00:00").cast("timestamp_ntz")
    assert sorted(r.task_id for r in batch.expire_tasks(df, now, hours).collect()) == left


def test_a_stream_without_files_is_empty(spark, tmp_path):
    (tmp_path / "none").mkdir()
    schema = spark.createDataFrame([], EVENT).schema
    table = ops.drain(ops.read_stream(spark, str(tmp_path / "none"), schema).select("task_id", "seq"), "n", "append")
    assert table.columns == ["task_id", "seq", "batch"] and table.count() == 0


def test_jobs_on_empty_streams(spark, tmp_path):
    schema = spark.createDataFrame([], EVENT).schema
    for name in ("none", "nothing"):
        (tmp_path / name).mkdir()
    events = ops.read_stream(spark, str(tmp_path / "none"), schema)
    subscriptions = spark.createDataFrame([(1, 1)], "connection_id long, task_id long")
    assert ops.publish_latest(events, subscriptions).count() == 0
    ticks = ops.read_stream(spark, str(tmp_path / "nothing"), spark.createDataFrame([], "now_s long").schema)
    files = spark.createDataFrame([], "file_id long, area string, name string, modified_s double, size_bytes long, access_error string, rel_path string")
    assert ops.retention_sweep(ticks, files).count() == 0


def test_streams_read_tables_that_are_folders(spark, tmp_path):
    from quire.plans.registry import CHECKS, QUERIES

    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    documents.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = QUERIES["stream_retention_sweep"](spark, str(tmp_path)).collect()
    assert found and sorted(r.area for r in found) == sorted(r[0] for r in con.execute(CHECKS["stream_retention_sweep"]).fetchall())
    assert {r.now_s for r in found} == {con.execute("SELECT max(1704067200 + doc_id * 613) FROM documents").fetchone()[0]}
