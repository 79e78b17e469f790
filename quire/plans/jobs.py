"""Job tracking and operations metrics."""

from pyspark.sql import functions as F

from quire.operators import jobs as ops, metrics
from quire.plans.registry import query
from quire.session import work_path
from quire.sources import files as src
from quire.sources.views import check_sql

NOW = 700_000.0  # fixed clock of progress queries, seconds


@query("latest_progress", check_sql(
    "v_progress",
    """SELECT task_id, seq, ts, kind, percent, step_index, total_steps FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY ts DESC, seq DESC) AS rn
    FROM v_progress) WHERE rn = 1"""))
def latest_progress(t):
    return ops.latest_progress(t.v_progress)


TASK_STATE_STEPS = {
    "s": "SELECT task_id, max(ts) AS start_ts FROM v_progress WHERE kind = 'start' GROUP BY task_id",
    "s2": "SELECT s.task_id, s.start_ts, max(p.seq) AS start_seq FROM s JOIN v_progress p ON p.task_id = s.task_id AND p.ts = s.start_ts AND p.kind = 'start' GROUP BY 1, 2",
    "e": """SELECT p.*, s2.start_ts, CASE kind WHEN 'start' THEN 0 WHEN 'complete' THEN 100 WHEN 'update' THEN CASE WHEN percent IS NOT NULL
        THEN greatest(0, least(100, percent)) ELSE least(95, CAST(trunc(step_index / total_steps * 100) AS INT)) END END AS pct
        FROM v_progress p JOIN s2 ON p.task_id = s2.task_id AND (p.ts > s2.start_ts OR (p.ts = s2.start_ts AND p.seq >= s2.start_seq))""",
}
TASK_STATE_FINAL = """SELECT task_id, last(CASE kind WHEN 'start' THEN 'pending' WHEN 'update' THEN 'processing' WHEN 'complete' THEN 'completed' ELSE 'failed' END ORDER BY ts, seq) AS status,
    last(pct ORDER BY ts, seq) FILTER (kind <> 'fail') AS progress_percent, coalesce(last(step_index ORDER BY ts, seq) FILTER (kind = 'update'), 0) AS step_index,
    max(start_ts) AS start_ts, last(ts ORDER BY ts, seq) FILTER (kind IN ('complete', 'fail')) AS end_ts FROM e GROUP BY task_id"""


@query("task_state", check_sql("v_progress", TASK_STATE_FINAL, **TASK_STATE_STEPS))
def task_state(t):
    return ops.replay_tasks(t.v_progress)


@query("task_state_expiry", check_sql(
    "v_progress",
    "SELECT * FROM f WHERE NOT coalesce(status IN ('completed', 'failed') AND TIMESTAMP '2024-01-20 00:00:00' - end_ts > INTERVAL 48 HOURS, false)",
    **TASK_STATE_STEPS, f=TASK_STATE_FINAL))
def task_state_expiry(t):
    return ops.expire_tasks(ops.replay_tasks(t.v_progress), F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"), 48)


VIEW_SQL = f"""SELECT task_id, status, round(el, 6) AS elapsed_time, round(CASE WHEN progress_percent > 0 AND status = 'processing'
    THEN greatest(0.0, el * (100.0::DOUBLE / progress_percent) - el) ELSE 0.0 END, 6) AS estimated_remaining FROM (SELECT *, CASE WHEN start_s IS NOT NULL AND end_s IS NULL
    THEN CAST({NOW} AS DOUBLE) - start_s WHEN start_s IS NOT NULL THEN end_s - start_s ELSE 0.0 END AS el FROM v_task_state)"""


def _view(df):
    return df.select(
        "task_id", "status", F.round("elapsed_time", 6).alias("elapsed_time"),
        F.round("estimated_remaining", 6).alias("estimated_remaining"),
    )


@query("progress_view", check_sql("v_task_state", VIEW_SQL))
def progress_view(t):
    return _view(ops.progress_view(t.v_task_state, NOW))


@query("active_tasks", check_sql("v_task_state", f"SELECT * FROM ({VIEW_SQL}) WHERE status IN ('pending', 'processing')"))
def active_tasks(t):
    return _view(ops.active_tasks(t.v_task_state, NOW))


@query("job_eta", check_sql(
    "v_task_state",
    f"""SELECT task_id, end_s - start_s AS duration, round(CASE WHEN fraction > 0 THEN ({NOW}::DOUBLE - start_s) / CAST(fraction AS DOUBLE) - ({NOW}::DOUBLE - start_s) END, 4) AS estimated_remaining
    FROM v_task_state"""))
def job_eta(t):
    tasks = t.v_task_state.withColumn("fraction", F.col("fraction").cast("double"))
    return ops.job_eta(tasks, NOW).select("task_id", "duration", F.round("estimated_remaining", 4).alias("estimated_remaining"))


@query("batch_status", check_sql(
    "v_batches v_batch_tasks",
    """SELECT batch_id, n AS total_files, c AS completed_files, f AS failed_files, CASE WHEN n > 0 THEN CAST(trunc((c + f) / n * 100) AS INT) ELSE 0 END AS progress_percent,
    CASE WHEN c + f < n THEN 'processing' WHEN f = 0 THEN 'completed' ELSE 'completed_with_errors' END AS status FROM (
    SELECT b.batch_id, count(t.task_id) AS n, count(*) FILTER (t.status = 'completed') AS c, count(*) FILTER (t.status = 'failed') AS f
    FROM v_batches b LEFT JOIN v_batch_tasks t ON b.batch_id = t.batch_id GROUP BY b.batch_id)"""))
def batch_status(t):
    return ops.batch_status(t.v_batches, t.v_batch_tasks)


@query("batch_status_v2", check_sql(
    "v_batch_tasks",
    """SELECT batch_id, count(*) AS total_jobs, CASE WHEN count_if(status = 'completed') = count(*) THEN 'completed' WHEN count_if(status IN ('completed', 'failed')) = count(*)
    THEN 'partially_completed' ELSE 'processing' END AS status, round(avg(fraction), 6) AS overall_progress,
    round(max(elapsed_s / fraction - elapsed_s) FILTER (status = 'processing' AND fraction > 0), 6) AS estimated_remaining FROM v_batch_tasks GROUP BY batch_id"""))
def batch_status_v2(t):
    return ops.batch_status_v2(t.v_batch_tasks)


@query("batch_nested", check_sql(
    "v_batch_tasks",
    """SELECT batch_id, part, count(*) AS n_tasks, string_agg(concat(task_id, '=', status), ',' ORDER BY task_id, status) AS tasks FROM (SELECT *,
    CAST((row_number() OVER (PARTITION BY batch_id ORDER BY task_id, status) - 1) // 4 AS INT) AS part FROM v_batch_tasks) GROUP BY batch_id, part"""))
def batch_nested(t):
    return ops.batch_nested(t.v_batch_tasks, max_tasks=4).select(
        "batch_id", "part", F.size("tasks").alias("n_tasks"),
        F.array_join(F.transform("tasks", lambda x: F.concat(x["task_id"], F.lit("="), x["status"])), ",").alias("tasks"),
    )


@query("task_failures", check_sql("v_batch_tasks", "SELECT batch_id, task_id, status FROM v_batch_tasks WHERE status = 'failed'"))
def task_failures(t):
    return ops.task_failures(ops.batch_nested(t.v_batch_tasks))


# fixed values, written out for the check
_W = """
    WHEN 'pdf_analysis' THEN 0.1
    WHEN 'content_extraction' THEN 0.3
    WHEN 'structure_recognition' THEN 0.2
    WHEN 'ai_enhancement' THEN 0.2
    WHEN 'epub_generation' THEN 0.2"""


@query("stage_progress", check_sql(
    "v_stage_events",
    f"""SELECT task_id, round(CAST(coalesce(sum(w) FILTER (d), 0) AS DOUBLE), 4) AS progress FROM (SELECT task_id, CASE stage {_W} END AS w, bool_or(done) AS d
    FROM v_stage_events GROUP BY task_id, stage) GROUP BY task_id"""))
def stage_progress(t):
    return ops.stage_progress(t.v_stage_events)


LAST100 = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY endpoint ORDER BY end_ts DESC, request_id DESC) AS rn FROM v_requests WHERE ended) WHERE rn <= 100"
STATS = "SELECT endpoint, round(avg(duration_s), 6) AS avg_s, min(duration_s) AS min_s, max(duration_s) AS max_s, count(*) AS n FROM l GROUP BY endpoint"
TOTALS = """SELECT count(*) AS total_requests, count_if(ended AND status_code >= 400) + count_if(raised) AS total_errors,
    count_if(NOT ended AND NOT raised) AS active_requests, round((count_if(ended AND status_code >= 400) + count_if(raised)) / count(*), 6) AS error_rate FROM v_requests"""


@query("last_100_per_endpoint", check_sql("v_requests", "SELECT endpoint, request_id, duration_s FROM l", l=LAST100))
def last_100_per_endpoint(t):
    return metrics.last_n_per_endpoint(t.v_requests.filter("ended")).select("endpoint", "request_id", "duration_s")


@query("request_stats", check_sql("v_requests", STATS, l=LAST100))
def request_stats(t):
    return metrics.request_stats(t.v_requests)


@query("request_totals", check_sql("v_requests", TOTALS))
def request_totals(t):
    return metrics.request_totals(t.v_requests)


@query("health_verdict", check_sql(
    "v_requests",
    """SELECT 'degraded' AS status, issue FROM i UNION ALL SELECT 'healthy', NULL WHERE (SELECT count(*) FROM i) = 0""",
    l=LAST100, s=STATS, tt=TOTALS,
    i="""SELECT printf('High error rate: %.2f%%', error_rate * 100) AS issue FROM tt WHERE error_rate > 0.1 UNION ALL
    SELECT concat('High active requests: ', active_requests) FROM tt WHERE active_requests > 50 UNION ALL
    SELECT printf('Slow endpoint %s: %.2fs avg', endpoint, avg_s) FROM s WHERE avg_s > 1"""))
def health_verdict(t):
    return metrics.health_verdict(metrics.request_totals(t.v_requests), metrics.request_stats(t.v_requests), max_avg=1.0)


@query("ops_means", check_sql(
    "v_ops",
    """SELECT round(coalesce(avg(duration_s) FILTER (kind = 'conversion'), 0), 6) AS avg_conversion_time, round(coalesce(avg(duration_s) FILTER (kind = 'ai'), 0), 6) AS avg_ai_time,
    count_if(kind = 'error') AS total_errors, count_if(kind = 'conversion') AS total_conversions FROM v_ops"""))
def ops_means(t):
    return metrics.ops_means(t.v_ops)


@query("log_error_summary", check_sql(
    "v_logs",
    """SELECT count_if(level = 'ERROR') AS error_lines, count_if(contains(message, 'Conversion failed')) AS phrase_lines,
    round(avg(processing_time), 6) AS mean_processing_time FROM v_logs"""))
def log_error_summary(t):
    return metrics.log_error_summary(t.v_logs)


@query("operation_durations", check_sql(
    "v_op_logs",
    """SELECT operation_id, operation, CASE WHEN err THEN 'error' ELSE 'success' END AS status, error_type, round((b - a) / 1000000.0::DOUBLE, 6) AS duration_s FROM (
    SELECT operation_id, min(operation) AS operation, min(epoch_us(ts)) FILTER (event = 'start') AS a, max(epoch_us(ts)) FILTER (event IN ('end', 'error')) AS b,
    bool_or(event = 'error') AS err, max(error_type) AS error_type FROM v_op_logs GROUP BY operation_id) WHERE a IS NOT NULL AND b IS NOT NULL"""))
def operation_durations(t):
    return metrics.operation_durations(t.v_op_logs)


@query("rate_limit_flags", check_sql(
    "v_requests",
    """SELECT request_id, recent_calls, recent_calls >= 5 AS limited FROM (SELECT request_id, count(*) OVER (PARTITION BY endpoint ORDER BY epoch_us(end_ts)
    RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) - 1 AS recent_calls FROM v_requests)"""))
def rate_limit_flags(t):
    calls = t.v_requests.select("request_id", "endpoint", "end_ts")
    return metrics.rate_limit_flags(calls, "endpoint", "end_ts", 5, 3600).select("request_id", "recent_calls", "limited")


@query("scan_json_logs", check_sql(
    "v_json_logs",
    """SELECT CASE WHEN v THEN line ->> '$.level' END AS level, CASE WHEN v THEN line ->> '$.logger' END AS logger, CASE WHEN v THEN line ->> '$.message' END AS message,
    CASE WHEN v THEN CAST(line ->> '$.line' AS INT) END AS line, CASE WHEN v THEN line ->> '$.task_id' END AS task_id, CASE WHEN v THEN CAST(line ->> '$.duration' AS DOUBLE) END AS duration,
    CASE WHEN NOT v THEN line END AS corrupt FROM (SELECT line, json_valid(line) AS v FROM v_json_logs)"""))
def scan_json_logs(t):
    """Log files as they were written: one JSON object a line, some of them broken."""
    path = work_path(t.spark, "logs")
    t.v_json_logs.select("line").write.text(path)
    return src.read_json_logs(t.spark, path).select(
        "level", "logger", "message", "line", "task_id", "duration", F.col("_corrupt_record").alias("corrupt")
    )


@query("route_logs", check_sql(
    "v_logs",
    """SELECT log_id, sink FROM (SELECT log_id, logger, level, CASE logger WHEN 'app.conversion' THEN ['console', 'conversion.log'] WHEN 'app.ai_service' THEN ['console', 'ai_service.log']
    WHEN 'app.error' THEN ['console', 'error.log'] ELSE ['console', 'app.log'] END AS sinks FROM v_logs), unnest(sinks) AS u(sink)
    WHERE level <> 'DEBUG' AND (logger <> 'app.error' OR level = 'ERROR')"""))
def route_logs(t):
    return metrics.route_logs(t.v_logs).select("log_id", "sink")


@query("parse_subscriptions", check_sql(
    "v_messages",
    """SELECT message_id, connection_id, kind, CASE WHEN kind = 'subscribe' THEN line ->> '$.task_id' END AS task_id FROM (SELECT *, CASE WHEN NOT json_valid(line) THEN 'invalid'
    WHEN line ->> '$.type' = 'subscribe' AND coalesce(line ->> '$.task_id', '') <> '' THEN 'subscribe' WHEN line ->> '$.type' = 'ping' THEN 'ping' ELSE 'ignored' END AS kind FROM v_messages)"""))
def parse_subscriptions(t):
    return metrics.parse_subscriptions(t.v_messages)


CODES = """SELECT *, CASE WHEN exception_type IN ('ValidationError', 'ValueError') THEN 'VALIDATION_ERROR' WHEN exception_type IN ('ResourceNotFoundError', 'FileNotFoundError') THEN 'RESOURCE_NOT_FOUND'
    WHEN exception_type IN ('SecurityError', 'PermissionError') THEN 'SECURITY_ERROR' WHEN exception_type = 'FileProcessingError' THEN 'FILE_PROCESSING_ERROR'
    WHEN exception_type IN ('ConversionTimeoutError', 'TimeoutError') THEN 'CONVERSION_TIMEOUT' WHEN exception_type = 'BatchConversionError' THEN 'BATCH_CONVERSION_ERROR'
    WHEN exception_type = 'ConversionError' THEN 'CONVERSION_ERROR' WHEN exception_type = 'AIServiceError' THEN 'AI_SERVICE_ERROR' WHEN exception_type = 'ConfigurationError' THEN 'CONFIGURATION_ERROR' WHEN contains(lower(message), 'timeout') THEN 'CONVERSION_TIMEOUT'
    WHEN contains(lower(operation), 'conversion') THEN 'CONVERSION_ERROR' WHEN contains(lower(operation), 'ai') THEN 'AI_SERVICE_ERROR' ELSE 'OPERATION_ERROR' END AS code FROM v_errors"""
STATUSES = """SELECT *, CASE code WHEN 'VALIDATION_ERROR' THEN 422 WHEN 'RESOURCE_NOT_FOUND' THEN 404 WHEN 'SECURITY_ERROR' THEN 403 WHEN 'FILE_PROCESSING_ERROR' THEN 400
    WHEN 'CONVERSION_TIMEOUT' THEN 503 ELSE 500 END AS http_status FROM c"""


@query("classify_errors", check_sql("v_errors", "SELECT error_id, code, http_status FROM st", c=CODES, st=STATUSES))
def classify_errors(t):
    return metrics.classify_errors(t.v_errors).select("error_id", "code", "http_status")


@query("error_code_rollup", check_sql(
    "v_errors",
    """SELECT code, status_class, grouping_id(code, status_class) AS level, count(*) AS n_errors FROM (SELECT code, concat(http_status // 100, 'xx') AS status_class FROM st)
    GROUP BY CUBE (code, status_class)""", c=CODES, st=STATUSES))
def error_code_rollup(t):
    return metrics.error_code_rollup(metrics.classify_errors(t.v_errors))


# fixed values, written out for the check
_TEMPLATES = """
    ('FILE_NOT_FOUND', '文件未找到', '您指定的文件不存在，请检查文件路径是否正确。',
     '确认文件路径拼写正确|检查文件是否已被移动或删除|尝试重新上传文件'),
    ('FILE_PROCESSING_ERROR', '文件处理失败', '处理您的文件时出现问题，可能是文件格式不受支持或文件已损坏。',
     '确认文件格式是否受支持（EPUB、PDF、TXT）|检查文件是否完整且未损坏|尝试使用其他文件'),
    ('VALIDATION_ERROR', '输入验证失败', '您提供的信息格式不正确，请检查输入内容。',
     '检查必填字段是否完整|确认数据格式符合要求|参考API文档中的示例'),
    ('CONVERSION_ERROR', '格式转换失败', '无法将文件转换为目标格式，请检查文件内容和格式要求。',
     '确认源文件格式正确|检查目标格式是否受支持|如果是大文件，请稍后重试'),
    ('CONVERSION_TIMEOUT', '转换超时', '文件转换时间过长，可能是文件太大或服务器繁忙。',
     '尝试转换较小的文件|稍后重试|联系技术支持获取帮助'),
    ('AI_SERVICE_ERROR', 'AI服务暂时不可用', 'AI处理服务遇到问题，请稍后再试。',
     '等待几分钟后重试|检查网络连接|如问题持续存在，请联系支持团队'),
    ('CONFIGURATION_ERROR', '系统配置错误', '服务配置有误，请联系管理员。',
     '联系系统管理员|稍后重试|查看系统状态页面'),
    ('SECURITY_ERROR', '访问被拒绝', '您没有权限执行此操作。',
     '检查您的访问权限|联系管理员获取权限|确认您已正确登录'),
    ('INTERNAL_ERROR', '系统内部错误', '系统遇到了意外错误，我们正在调查此问题。',
     '稍后重试|如问题持续存在，请联系技术支持|记录错误ID以便技术支持定位问题'),
    ('HTTP_ERROR', '请求错误', '您的请求格式不正确或包含无效数据。',
     '检查请求参数|参考API文档|确认请求方法正确')"""


@query("error_messages", check_sql(
    "v_errors",
    f"""SELECT error_id, st.code, coalesce(m.title, d.title) AS title, CASE WHEN st.code = 'CONVERSION_TIMEOUT' THEN concat('文件转换超时（', timeout_seconds, '秒），请尝试较小的文件或稍后重试。')
    WHEN st.code = 'AI_SERVICE_ERROR' AND provider IS NOT NULL THEN concat(provider, ' AI服务暂时不可用，请稍后再试。') ELSE coalesce(m.message, d.message) END AS user_message,
    coalesce(m.tips, d.tips) AS suggestions, CASE WHEN st.code = 'VALIDATION_ERROR' THEN field END AS field, CASE WHEN st.code = 'VALIDATION_ERROR' THEN value END AS value,
    CASE WHEN st.code = 'CONVERSION_ERROR' THEN source_format END AS source_format, CASE WHEN st.code = 'CONVERSION_ERROR' THEN target_format END AS target_format, CASE WHEN st.code = 'FILE_PROCESSING_ERROR' THEN file_type END AS file_type
    FROM st LEFT JOIN m ON m.code = st.code JOIN m d ON d.code = 'INTERNAL_ERROR'""",
    c=CODES, st=STATUSES, m=f"SELECT * FROM (VALUES {_TEMPLATES}) x(code, title, message, tips)"))
def error_messages(t):
    out = metrics.error_messages(metrics.classify_errors(t.v_errors))
    return out.withColumn("suggestions", F.array_join("suggestions", "|"))
