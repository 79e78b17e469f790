import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quire.operators import jobs as ops, metrics

EVENT = "task_id int, ts timestamp_ntz, seq long, kind string, percent int, step_index int, total_steps int"
T0 = dt.datetime(2024, 1, 1)


def events(seed=1, n=2000):
    rnd = random.Random(seed)
    kinds = ["start", "update", "update", "update", "complete", "fail"]
    out = []
    for i in range(n):
        task = 0 if rnd.random() < 0.4 else rnd.randrange(1, 60)
        kind = rnd.choice(kinds)
        pct = rnd.choice([None, None, rnd.randrange(-20, 140)]) if kind == "update" else None
        out.append((task, T0 + dt.timedelta(seconds=rnd.randrange(300)), i, kind, pct, rnd.randrange(6), rnd.choice([5, 7])))
    return out


def replay(rows):
    state = {}
    for task, ts, seq, kind, pct, step, total in sorted(rows, key=lambda r: (r[1], r[2])):
        if kind == "start":
            state[task] = dict(status="pending", progress_percent=0, step_index=0, total=total, start_ts=ts, end_ts=None)
        elif task in state:
            s = state[task]
            if kind == "update":
                s["status"], s["step_index"] = "processing", step
                s["progress_percent"] = max(0, min(100, pct)) if pct is not None else min(95, int(step / s["total"] * 100))
            elif kind == "complete":
                s.update(status="completed", progress_percent=100, end_ts=ts)
            else:
                s.update(status="failed", end_ts=ts)
    return {k: tuple(v[x] for x in ("status", "progress_percent", "step_index", "start_ts", "end_ts")) for k, v in state.items()}


def test_replay_matches_a_step_by_step_one(spark):
    rows = events()
    got = ops.replay_tasks(spark.createDataFrame(rows, EVENT).repartition(5)).collect()
    assert {r.task_id: (r.status, r.progress_percent, r.step_index, r.start_ts, r.end_ts) for r in got} == replay(rows)


def test_update_before_start_is_ignored(spark):
    rows = [(1, T0, 0, "update", 50, 2, 5), (2, T0, 1, "complete", None, 0, 5), (2, T0 + dt.timedelta(1), 2, "start", None, 0, 5)]
    got = {r.task_id: (r.status, r.progress_percent, r.end_ts) for r in ops.replay_tasks(spark.createDataFrame(rows, EVENT)).collect()}
    assert got == {2: ("pending", 0, None)}


def test_expiry(spark):
    rows = [(1, "completed", T0), (2, "failed", T0 + dt.timedelta(hours=30)), (3, "processing", None)]
    df = spark.createDataFrame(rows, "task_id int, status string, end_ts timestamp_ntz")
    left = ops.expire_tasks(df, F.lit("2024-01-02 12:00:00").cast("timestamp_ntz"), 24)
    assert sorted(r.task_id for r in left.collect()) == [2, 3]


def test_batch_percent_truncates_and_statuses(spark):
    tasks = [(1, f"t{i}", "completed" if i < 29 else "processing") for i in range(50)]
    tasks += [(2, "a", "completed"), (2, "b", "failed"), (2, "c", "completed"), (3, "x", "failed")]
    df = spark.createDataFrame(tasks, "batch_id int, task_id string, status string")
    batches = spark.createDataFrame([(1,), (2,), (3,), (4,)], "batch_id int")
    got = {r.batch_id: (r.total_files, r.completed_files, r.failed_files, r.progress_percent, r.status) for r in ops.batch_status(batches, df).collect()}
    # 29 / 50 * 100 lies just below 58 in binary
    assert got[1] == (50, 29, 0, int(29 / 50 * 100), "processing") and got[1][3] == 57
    assert got[2] == (3, 2, 1, 100, "completed_with_errors")
    assert got[3] == (1, 0, 1, 100, "completed_with_errors")
    assert got[4][3] == 0


def test_oversized_batch_is_nested_in_parts(spark):
    df = spark.createDataFrame([(1, f"t{i:03d}", "failed" if i % 2 else "completed") for i in range(230)] + [(2, "z", "failed")],
                               "batch_id int, task_id string, status string")
    nested = ops.batch_nested(df, 50)
    parts = nested.filter("batch_id = 1").collect()
    assert len(parts) == 5 and [t.task_id for r in sorted(parts, key=lambda r: r.part) for t in r.tasks] == [f"t{i:03d}" for i in range(230)]
    assert max(len(r.tasks) for r in parts) == 50
    assert nested.filter("batch_id = 2").first().part == 0
    assert ops.task_failures(nested).count() == 116


def test_progress_view(spark):
    rows = [(1, "processing", 25, 0.0, None), (2, "completed", 100, 0.0, 30.0), (3, "pending", 0, None, None), (4, "processing", 0, 10.0, None)]
    df = spark.createDataFrame(rows, "task_id int, status string, progress_percent int, start_s double, end_s double")
    got = {r.task_id: (r.elapsed_time, r.estimated_remaining) for r in ops.progress_view(df, 100.0).collect()}
    assert got == {1: (100.0, 300.0), 2: (30.0, 0.0), 3: (0.0, 0.0), 4: (90.0, 0.0)}


REQ = "request_id long, endpoint string, end_ts timestamp_ntz, duration_s double, status_code int, ended boolean, raised boolean"


def test_only_the_last_hundred_durations_count(spark):
    rows = [(i, "GET /a", T0 + dt.timedelta(seconds=i), 1e6 if i == 0 else 1.0, 200, True, False) for i in range(101)]
    r = metrics.request_stats(spark.createDataFrame(rows, REQ)).first()
    assert (r.n, r.max_s, r.avg_s) == (100, 1.0, 1.0)


def test_totals_and_health(spark):
    rows = [(i, "GET /a", T0, 40.0, 500 if i < 3 else 200, i != 9, False) for i in range(10)] + [(10, "GET /b", T0, 0.0, 200, False, True)]
    df = spark.createDataFrame(rows, REQ)
    t = metrics.request_totals(df).first()
    assert (t.total_requests, t.total_errors, t.active_requests) == (11, 4, 1)
    issues = sorted(r.issue for r in metrics.health_verdict(metrics.request_totals(df), metrics.request_stats(df)).collect())
    assert issues == ["High error rate: 36.36%", "Slow endpoint GET /a: 40.00s avg"]
    calm = df.filter("request_id between 3 and 8").withColumn("duration_s", F.lit(1.0))
    rows = metrics.health_verdict(metrics.request_totals(calm), metrics.request_stats(calm)).collect()
    assert [(r.status, r.issue) for r in rows] == [("healthy", None)]


def test_rate_limit_against_brute_force(spark):
    rnd = random.Random(4)
    calls = [(i, "hot" if rnd.random() < 0.7 else f"c{rnd.randrange(4)}", T0 + dt.timedelta(microseconds=rnd.randrange(300_000_000))) for i in range(400)]
    df = spark.createDataFrame(calls, "id int, client string, ts timestamp_ntz")
    got = {r.id: r.recent_calls for r in metrics.rate_limit_flags(df, "client", "ts", 10, 60).collect()}
    want = {i: sum(1 for j, d, u in calls if d == c and j != i and u <= t and t - u < dt.timedelta(seconds=60)) for i, c, t in calls}
    assert got == want


@pytest.mark.parametrize("period", [1, 7, 60, 3600])
def test_rate_limit_of_busy_null_and_timeless_calls(spark, period):
    rnd = random.Random(period)
    at = lambda: T0 + dt.timedelta(microseconds=rnd.choice([0, 1, 15624, 15625, 999_999, 1_000_000]) + rnd.randrange(4 * period) * 250_000)
    calls = [(i, rnd.choice(["hot", "hot", "hot", None, "c"]), at() if i % 10 else None) for i in range(500)]
    calls += [(500 + i, "hot", T0 - dt.timedelta(days=30_000, microseconds=i)) for i in range(5)]
    df = spark.createDataFrame(calls, "id int, client string, ts timestamp_ntz")
    rows = metrics.rate_limit_flags(df, "client", "ts", 10, period).collect()
    limit = dt.timedelta(seconds=period)
    want = {i: sum(1 for j, d, u in calls if t and u and d == c and j != i and u <= t and t - u < limit) for i, c, t in calls}
    assert {r.id: (r.recent_calls, r.limited) for r in rows} == {i: (n, n >= 10) for i, n in want.items()}
    assert len(rows) == len(calls) and max(want.values()) > 50


def test_rate_limit_windows_hold_a_strip(spark):
    """A client that calls 50,000 times within one period: its rows spread over windows of a 64th of it."""
    df = spark.range(50_000).selectExpr("id", "'hot' AS client", "timestamp_micros(1600000000000000 + id * 1000) AS ts")
    out = metrics.rate_limit_flags(df, "client", "ts", 10, 60)
    assert out.agg({"recent_calls": "max"}).first()[0] == 49_999 and out.count() == 50_000
    plan = out._jdf.queryExecution().executedPlan().toString()
    windows = [x for x in plan.split("\n") if " Window [" in x]
    assert len(windows) == 2 and any("_strip" in x and "_step" in x for x in windows)
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_error_precedence(spark):
    rows = [(1, "RuntimeError", "Read TIMEOUT", "conversion"), (2, "RuntimeError", "x", "Conversion"), (3, "RuntimeError", "x", "email"),
            (4, "RuntimeError", "x", "list"), (5, "ConversionTimeoutError", "x", "x"), (6, "ValueError", "timeout", "x")]
    df = spark.createDataFrame(rows, "id int, exception_type string, message string, operation string")
    got = {r.id: (r.code, r.http_status) for r in metrics.classify_errors(df).collect()}
    assert got == {1: ("CONVERSION_TIMEOUT", 503), 2: ("CONVERSION_ERROR", 500), 3: ("AI_SERVICE_ERROR", 500),
                   4: ("OPERATION_ERROR", 500), 5: ("CONVERSION_TIMEOUT", 503), 6: ("VALIDATION_ERROR", 422)}


def test_log_routing(spark):
    rows = [("app", "INFO"), ("app.conversion.x", "INFO"), ("app.error", "WARNING"), ("app.error", "ERROR"), ("uvicorn", "INFO"), ("other", "DEBUG")]
    df = spark.createDataFrame(rows, "logger string, level string")
    got = sorted((r.logger, r.sink) for r in metrics.route_logs(df).collect())
    assert got == [("app", "app.log"), ("app", "console"), ("app.conversion.x", "console"), ("app.conversion.x", "conversion.log"),
                   ("app.error", "console"), ("app.error", "error.log"), ("uvicorn", "console")]
