"""Streams, sources and sinks: each runs over the given tables and is read back."""

from pyspark.sql import functions as F

from quire.operators import metrics, text as textops
from quire.plans.jobs import TASK_STATE_FINAL, TASK_STATE_STEPS
from quire.plans.registry import query
from quire.session import work_path
from quire.sources import files as src
from quire.sources.views import VIEWS, check_sql
from quire.streaming import jobs as ops

DELAY_US = 600_000_000


def _stream(t, view):
    """A view over its source table, a file or a folder of files, read as a stream (streams take no path of one file, but a
    pattern that finds it)."""
    table, exprs = VIEWS[view]
    schema = getattr(t, table).schema
    return ops.read_stream(t.spark, f"{t.dir}/{table}.parque[t]", schema).selectExpr(*exprs)


def _events(t):
    return _stream(t, "v_progress")


@query("stream_progress_source", check_sql("v_progress", "SELECT seq, task_id, kind, percent FROM v_progress"))
def stream_progress_source(t):
    return ops.drain(_events(t).select("seq", "task_id", "kind", "percent"), "source", "append").drop("batch")


@query("stream_latest_progress", check_sql(
    "v_progress", "SELECT task_id, seq, kind, percent, step_index FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY ts DESC, seq DESC) AS rn FROM v_progress) WHERE rn = 1"))
def stream_latest_progress(t):
    table = ops.drain(ops.latest_progress(_events(t)).drop("ts"), "latest", "update")
    return ops.newest(table, ["task_id"])


SUBS = "SELECT DISTINCT connection_id, CAST(substring(line ->> '$.task_id', 2) AS BIGINT) AS task_id FROM v_messages WHERE json_valid(line) AND line ->> '$.type' = 'subscribe' AND coalesce(line ->> '$.task_id', '') <> ''"


def _subscriptions(t):
    parsed = metrics.parse_subscriptions(t.v_messages).filter("kind = 'subscribe'")
    return parsed.select("connection_id", F.substr("task_id", F.lit(2)).cast("bigint").alias("task_id")).distinct()


@query("sink_progress_latest", check_sql(
    "v_progress v_messages",
    "SELECT connection_id, p.task_id, seq, kind, percent FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY ts DESC, seq DESC) AS rn FROM v_progress) p JOIN s ON s.task_id = p.task_id WHERE rn = 1", s=SUBS))
def sink_progress_latest(t):
    table = ops.publish_latest(_events(t), _subscriptions(t))
    return ops.newest(table, ["connection_id", "task_id"])


@query("subscription_join", check_sql(
    "v_progress v_messages",
    """SELECT connection_id, seq, concat('{"type":"progress_update","task_id":', p.task_id, ',"data":{"seq":', seq, ',"kind":"', kind, '","step_index":', step_index, '}}') AS message
    FROM v_progress p JOIN s ON s.task_id = p.task_id""", s=SUBS))
def subscription_join(t):
    return ops.drain(ops.subscription_messages(_events(t), _subscriptions(t)), "messages", "append").drop("batch")


@query("stream_task_state", check_sql("v_progress", TASK_STATE_FINAL, **TASK_STATE_STEPS))
def stream_task_state(t):
    return ops.newest(ops.drain(ops.task_state(_events(t)), "states", "update"), ["task_id"])


@query("stream_state_ttl", check_sql(
    "v_progress",
    f"""SELECT task_id, CASE kind WHEN 'complete' THEN 'completed' ELSE 'failed' END AS status, epoch_us(ts) // 1000 AS end_ms FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY ts DESC, seq DESC) AS rn FROM v_progress)
    WHERE rn = 1 AND kind IN ('complete', 'fail') AND epoch_us(ts) // 1000 + 7200000 < (SELECT max(epoch_us(ts) // 1000) FROM v_progress) - {DELAY_US // 1000}"""))
def stream_state_ttl(t):
    return ops.drain(ops.expire_finished(_events(t), 2), "ttl", "append").drop("batch")


@query("stream_batch_progress", check_sql(
    "v_batch_tasks",
    """SELECT batch_id, count_if(status = 'completed') AS completed_files, count_if(status = 'failed') AS failed_files, count(*) AS total_files,
    CAST(trunc(count_if(status <> 'processing') / count(*) * 100) AS INT) AS progress_percent FROM v_batch_tasks GROUP BY batch_id HAVING count_if(status <> 'processing') > 0"""))
def stream_batch_progress(t):
    finished = _stream(t, "v_batch_tasks").filter("status <> 'processing'")
    totals = t.v_batch_tasks.groupBy("batch_id").agg(F.count(F.lit(1)).alias("total_files"))
    return ops.newest(ops.drain(ops.batch_progress(finished, totals), "batches", "update"), ["batch_id"])


@query("stream_request_windows", check_sql(
    "v_requests",
    f"""SELECT * FROM (SELECT time_bucket(INTERVAL 5 MINUTES, end_ts) AS window_start, endpoint, count(*) AS n, count_if(status_code >= 400) AS errors, round(avg(duration_s), 6) AS avg_s, min(duration_s) AS min_s,
    max(duration_s) AS max_s FROM v_requests GROUP BY 1, 2) WHERE epoch_ms(window_start) + 300000 <= (SELECT max(epoch_ms(end_ts)) FROM v_requests) - {DELAY_US // 1000}"""))
def stream_request_windows(t):
    windows = ops.drain(ops.request_windows(_stream(t, "v_requests")), "windows", "append").drop("batch")
    return windows.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("stream_rate_sliding", check_sql(
    "v_requests",
    f"""SELECT * FROM (SELECT make_timestamp((b - k) * 10000000) AS window_start, endpoint AS client, count(*) AS calls FROM (SELECT endpoint, epoch_us(end_ts) // 10000000 AS b FROM v_requests), range(0, 6) AS r(k)
    GROUP BY 1, 2) WHERE epoch_ms(window_start) + 60000 <= (SELECT max(epoch_ms(end_ts)) FROM v_requests) - {DELAY_US // 1000}"""))
def stream_rate_sliding(t):
    calls = _stream(t, "v_requests").withColumnRenamed("endpoint", "client")
    windows = ops.drain(ops.rate_sliding(calls), "rates", "append").drop("batch")
    return windows.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("stream_active_gauge", check_sql(
    "v_op_logs",
    """SELECT count_if(s) AS started, count_if(s AND e) AS finished, count_if(s AND NOT e) AS active FROM (SELECT operation_id, bool_or(event = 'start') AS s, bool_or(event IN ('end', 'error')) AS e
    FROM v_op_logs WHERE event <> 'note' GROUP BY operation_id)"""))
def stream_active_gauge(t):
    marks = (
        _stream(t, "v_op_logs").filter("event <> 'note'")
        .select(F.col("operation_id").alias("request_id"), "ts", "event")
    )
    return ops.active_gauge(marks)


@query("stream_conversion_pairs", check_sql(
    "v_op_logs",
    """SELECT s.operation_id, round((epoch_us(e.ts) - epoch_us(s.ts)) / 1000000.0::DOUBLE, 6) AS duration_s FROM v_op_logs s JOIN v_op_logs e ON e.operation_id = s.operation_id
    WHERE s.event = 'start' AND e.event IN ('end', 'error') AND e.ts BETWEEN s.ts AND s.ts + INTERVAL 1 HOUR"""))
def stream_conversion_pairs(t):
    starts = _stream(t, "v_op_logs").filter("event = 'start'")
    ends = _stream(t, "v_op_logs").filter("event IN ('end', 'error')")
    return ops.drain(ops.conversion_pairs(starts, ends), "pairs", "append").drop("batch")


@query("stream_dedup_updates", check_sql("v_progress", "SELECT DISTINCT task_id, kind, step_index FROM v_progress"))
def stream_dedup_updates(t):
    keys = ["task_id", "kind", "step_index"]
    return ops.drain(ops.dedup_updates(_events(t), keys).select(*keys), "dedup", "append").drop("batch")


@query("stream_retention_sweep", check_sql(
    "v_tree",
    """SELECT CASE WHEN grouping(area) = 1 THEN 'total' ELSE area END AS area, count_if(access_error IS NULL) AS files_removed,
    round(CAST(coalesce(sum(size_bytes) FILTER (access_error IS NULL), 0) AS DOUBLE) / 1048576, 4) AS space_freed_mb, count_if(access_error IS NOT NULL) AS n_errors, max(now_s) AS now_s FROM (
    SELECT area, regexp_extract(rel_path, '^([^/]+)', 1) AS item, sum(size_bytes) AS size_bytes, max(access_error) AS access_error, max(modified_s) AS m, any_value(n.now_s) AS now_s
    FROM v_tree, (SELECT max(modified_s) AS now_s FROM v_tree) n GROUP BY 1, 2) WHERE m < now_s - 86400 GROUP BY ROLLUP (area)"""))
def stream_retention_sweep(t):
    ticks = _stream(t, "v_tree").select(F.col("modified_s").cast("bigint").alias("now_s"))
    return ops.retention_sweep(ticks, t.v_tree).drop("batch")


# --- files -------------------------------------------------------------------

@query("scan_text_robust", check_sql("v_raw_texts", "SELECT doc_id, CASE WHEN kind = 'gbk' THEN text || '你好' ELSE text END AS text FROM v_raw_texts"))
def scan_text_robust(t):
    utf8 = F.encode("text", "UTF-8")
    content = (
        F.when(F.col("kind") == "gbk", F.concat(utf8, F.unhex(F.lit("C4E3BAC3"))))
        .when(F.col("kind") == "broken", F.concat(utf8, F.unhex(F.lit("FF"))))
        .otherwise(utf8)
    )
    return src.read_text_robust(t.v_raw_texts.select("doc_id", content.alias("content")))


@query("sink_extracted_text", """SELECT doc_id, concat('book_', doc_id, '_', md5(CAST(doc_id AS VARCHAR)), '.', CASE WHEN doc_id % 2 = 0 THEN 'txt' ELSE 'html' END) AS file_name, text,
    CASE WHEN doc_id % 2 = 0 THEN 'txt' ELSE 'html' END AS target_format FROM documents""")
def sink_extracted_text(t):
    texts = t.documents.select(
        "doc_id", "text", F.concat(F.lit("book_"), "doc_id").alias("stem"), F.md5(F.col("doc_id").cast("string")).alias("task_id"),
        F.when(F.col("doc_id") % 2 == 0, "txt").otherwise("html").alias("target_format"),
    )
    path = work_path(t.spark, "texts")
    src.write_extracted_text(texts, path)
    return t.spark.read.parquet(path).select("doc_id", "file_name", "text", "target_format")


@query("sink_chapters", """SELECT doc_id, CAST(i AS INT) AS chapter_no, printf('chap_%03d.xhtml', i) AS file_name, length(c) AS n_chars FROM (SELECT doc_id, i, substring(text, (i - 1) * 5000 + 1, 5000) AS c
    FROM documents, unnest(range(1, CAST(ceil(length(text) / 5000) AS BIGINT) + 1)) AS u(i)) WHERE trim(c) <> ''""")
def sink_chapters(t):
    path = work_path(t.spark, "chapters")
    src.write_chapters(textops.chunk_chapters(t.documents), path)
    return t.spark.read.parquet(path).select("doc_id", "chapter_no", "file_name", F.length("content").alias("n_chars"))


@query("sink_routed_logs", check_sql(
    "v_logs",
    """SELECT sink, count(*) AS n FROM v_logs, unnest(['console', CASE logger WHEN 'app.conversion' THEN 'conversion.log' WHEN 'app.ai_service' THEN 'ai_service.log' WHEN 'app.error' THEN 'error.log' ELSE 'app.log' END]) AS u(sink)
    WHERE level <> 'DEBUG' AND (logger <> 'app.error' OR level = 'ERROR') GROUP BY sink"""))
def sink_routed_logs(t):
    path = work_path(t.spark, "logs")
    src.write_routed_logs(metrics.route_logs(t.v_logs), path)
    return t.spark.read.parquet(path).groupBy("sink").agg(F.count(F.lit(1)).alias("n"))
