"""Request metrics, health, logs and errors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from quire.functions import text as X, values as V
from quire.operators.ordered import top_rows

LOG_SCHEMA = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("level", T.StringType()),
    T.StructField("logger", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("module", T.StringType()),
    T.StructField("function", T.StringType()),
    T.StructField("line", T.IntegerType()),
    T.StructField("exception", T.StringType()),
    T.StructField("request_id", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("task_id", T.StringType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("operation", T.StringType()),
    T.StructField("duration", T.DoubleType()),
    T.StructField("_corrupt_record", T.StringType()),
])

MESSAGE_SCHEMA = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("task_id", T.StringType()),
    T.StructField("_corrupt_record", T.StringType()),
])

_PERMISSIVE = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def last_n_per_endpoint(requests: DataFrame, n: int = 100) -> DataFrame:
    return top_rows(requests, ["endpoint"], [F.desc("end_ts"), F.desc("request_id")], n)


def request_stats(requests: DataFrame, n: int = 100) -> DataFrame:
    """Mean, min, max and count over the newest ``n`` durations of each endpoint."""
    return last_n_per_endpoint(requests.filter("ended"), n).groupBy("endpoint").agg(
        F.round(F.avg("duration_s"), 6).alias("avg_s"),
        F.min("duration_s").alias("min_s"),
        F.max("duration_s").alias("max_s"),
        F.count(F.lit(1)).alias("n"),
    )


def request_totals(requests: DataFrame) -> DataFrame:
    """Started and active requests, errors and their share of the started ones."""
    ended = F.col("ended")
    errors = F.count_if(ended & (F.col("status_code") >= 400)) + F.count_if("raised")
    total = F.count(F.lit(1))
    return requests.agg(
        total.alias("total_requests"),
        errors.alias("total_errors"),
        F.count_if(~ended & ~F.col("raised")).alias("active_requests"),
        F.round(F.when(total > 0, errors / total).otherwise(0.0), 6).alias("error_rate"),
    )


def health_verdict(totals: DataFrame, endpoints: DataFrame, max_rate: float = 0.1, max_active: int = 50,
                   max_avg: float = 30.0) -> DataFrame:
    """One row per issue; a single row without an issue when all is well."""
    general = F.array_compact(F.array(
        F.when(F.col("error_rate") > max_rate, F.format_string("High error rate: %.2f%%", F.col("error_rate") * 100)),
        F.when(F.col("active_requests") > max_active, F.format_string("High active requests: %d", F.col("active_requests"))),
    ))
    slow = endpoints.filter(F.col("avg_s") > max_avg).select(
        F.format_string("Slow endpoint %s: %.2fs avg", F.col("endpoint"), F.col("avg_s")).alias("issue")
    )
    issues = totals.select(F.explode(general).alias("issue")).unionByName(slow)
    degraded = issues.select(F.lit("degraded").alias("status"), "issue")
    healthy = (
        issues.agg(F.count(F.lit(1)).alias("n")).filter("n = 0")
        .select(F.lit("healthy").alias("status"), F.lit(None).cast("string").alias("issue"))
    )
    return degraded.unionByName(healthy)


def ops_means(ops: DataFrame) -> DataFrame:
    def mean(kind: str) -> Column:
        return F.round(F.coalesce(F.avg(F.when(F.col("kind") == kind, F.col("duration_s"))), F.lit(0.0)), 6)

    return ops.agg(
        mean("conversion").alias("avg_conversion_time"),
        mean("ai").alias("avg_ai_time"),
        F.count_if(F.col("kind") == "error").alias("total_errors"),
        F.count_if(F.col("kind") == "conversion").alias("total_conversions"),
    )


def log_error_summary(logs: DataFrame, phrase: str = "Conversion failed") -> DataFrame:
    return logs.agg(
        F.count_if(F.col("level") == "ERROR").alias("error_lines"),
        F.count_if(F.col("message").contains(phrase)).alias("phrase_lines"),
        F.round(F.avg("processing_time"), 6).alias("mean_processing_time"),
    )


def operation_durations(logs: DataFrame) -> DataFrame:
    """Start and end (or error) records paired per operation by one aggregate, no self-join."""
    event = F.col("event")
    at = micros("ts")
    start = F.min(F.when(event == "start", at))
    end = F.max(F.when(event.isin("end", "error"), at))
    return (
        logs.groupBy("operation_id")
        .agg(
            F.min("operation").alias("operation"),
            start.alias("_a"),
            end.alias("_b"),
            F.when(F.bool_or(event == "error"), "error").otherwise("success").alias("status"),
            F.max("error_type").alias("error_type"),
        )
        .filter(F.col("_a").isNotNull() & F.col("_b").isNotNull())
        .withColumn("duration_s", F.round((F.col("_b") - F.col("_a")) / 1e6, 6))
        .drop("_a", "_b")
    )


#: Strips of a rate limit's period; divides a second's microseconds.
STRIPS = 64


def rate_limit_flags(calls: DataFrame, client: str, ts: str, max_calls: int = 10, period_s: int = 60) -> DataFrame:
    """Flag calls that follow ``max_calls`` or more others within ``period_s`` seconds.

    A client's time is cut into strips, a 64th of the period each. Every call counts +1 at its time and -1 a period
    later; a strip's running sum starts with the calls of the 64 strips before it, which are summed per strip first.
    So a window holds the calls of one strip and its forerunner, however busy the client. A null client is a client;
    calls without a time have no recent calls.
    """
    span = period_s * 1_000_000
    width = span // STRIPS
    timed = calls.withColumn("_at", micros(ts)).withColumn("_strip", F.col("_at") - F.pmod("_at", F.lit(width)))
    running = F.sum("_step").over(
        W.partitionBy(client, "_strip").orderBy("_place").rangeBetween(W.unboundedPreceding, W.currentRow)
    )

    counts = timed.filter("_at IS NOT NULL").groupBy(client, "_strip").agg(F.count(F.lit(1)).alias("_n"))
    period = F.col("_strip") - F.pmod("_strip", F.lit(span))
    before = W.partitionBy(client, "_period").orderBy("_strip").rangeBetween(-span, -width)
    starts = (
        counts.withColumn("_k", F.explode(F.array(
            F.struct(period.alias("p"), F.lit(True).alias("own")), F.struct((period + span).alias("p"), F.lit(False).alias("own"))
        )))
        .withColumn("_period", F.col("_k.p"))
        .withColumn("_step", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .filter("_k.own")
        .select(client, "_strip", (F.col("_strip") - 1).alias("_place"), "_step", F.lit(0).alias("_kind"))
    )
    marks = F.array(*(
        F.struct((F.col("_strip") + k).alias("strip"), (F.col("_at") + k).alias("place"),
                 F.lit(step).cast("long").alias("step"), F.lit(kind).alias("kind"))
        for k, step, kind in ((0, 1, 1), (span, -1, 2))
    ))
    events = timed.withColumn(
        "_m", F.explode(F.when(F.col("_at").isNull(), F.slice(marks, 1, 1)).otherwise(marks))
    ).withColumns({
        # calls without a time spread over strips of their own and count nothing
        "_strip": F.coalesce("_m.strip", F.monotonically_increasing_id()), "_place": F.col("_m.place"),
        "_step": F.when(F.col("_at").isNotNull(), F.col("_m.step")).otherwise(0), "_kind": F.col("_m.kind"),
    }).drop("_m")
    recent = F.when(F.col("_at").isNull(), F.lit(0).cast("long")).otherwise(F.col("_sum") - 1)
    return (
        events.unionByName(starts, allowMissingColumns=True)
        .withColumn("_sum", running)
        .filter("_kind = 1")
        .withColumn("recent_calls", recent)
        .withColumn("limited", F.col("recent_calls") >= max_calls)
        .select(*calls.columns, "recent_calls", "limited")
    )


def parse_logs(lines: DataFrame, line: str = "line") -> DataFrame:
    """JSON log lines to columns; a bad line keeps its text in ``_corrupt_record``."""
    keep = [c for c in lines.columns if c != line]
    return lines.select(*keep, F.from_json(line, LOG_SCHEMA, _PERMISSIVE).alias("r")).select(*keep, "r.*")


LEVELS = {"DEBUG": 10, "INFO": 20, "WARNING": 30, "ERROR": 40, "CRITICAL": 50}


def route_logs(logs: DataFrame, root: str = "app", level: str = "INFO") -> DataFrame:
    """One row per sink a record goes to, by its nearest configured logger and level."""
    name = F.col("logger")
    rank = X.lookup(F.col("level"), LEVELS)

    def under(prefix: str) -> Column:
        return (name == prefix) | name.startswith(prefix + ".")

    conversion, ai, error = (under(f"{root}.{x}") for x in ("conversion", "ai_service", "error"))
    server = under("uvicorn") | under("fastapi")
    enough = rank >= LEVELS[level]
    sinks = (
        F.when(conversion & enough, F.array(F.lit("console"), F.lit("conversion.log")))
        .when(conversion, F.array().cast("array<string>"))
        .when(ai & enough, F.array(F.lit("console"), F.lit("ai_service.log")))
        .when(ai, F.array().cast("array<string>"))
        .when(error & (rank >= LEVELS["ERROR"]), F.array(F.lit("console"), F.lit("error.log")))
        .when(error, F.array().cast("array<string>"))
        .when(server & (rank >= LEVELS["INFO"]), F.array(F.lit("console")))
        .when(server, F.array().cast("array<string>"))
        .when(enough, F.array(F.lit("console"), F.lit("app.log")))
        .otherwise(F.array().cast("array<string>"))
    )
    return logs.withColumn("sink", F.explode(sinks))


def parse_subscriptions(lines: DataFrame, line: str = "line") -> DataFrame:
    """Client messages as subscribe (with task), ping, ignored or invalid."""
    keep = [c for c in lines.columns if c != line]
    kind = (
        F.when(F.col("r._corrupt_record").isNotNull(), "invalid")
        .when((F.col("r.type") == "subscribe") & (F.coalesce(F.col("r.task_id"), F.lit("")) != ""), "subscribe")
        .when(F.col("r.type") == "ping", "ping")
        .otherwise("ignored")
    )
    parsed = lines.select(*keep, F.from_json(line, MESSAGE_SCHEMA, _PERMISSIVE).alias("r"))
    return parsed.select(*keep, kind.alias("kind"), F.when(kind == "subscribe", F.col("r.task_id")).alias("task_id"))


def classify_errors(errors: DataFrame) -> DataFrame:
    """Exception class, message and operation to an error code and an HTTP status."""
    kind, operation = F.col("exception_type"), F.lower("operation")
    known = {**V.APPLICATION_ERRORS, **V.BUILTIN_ERRORS}
    chain = reduce(
        lambda acc, item: acc.when(kind == item[0], F.struct(F.lit(item[1][0]).alias("code"), F.lit(item[1][1]).alias("status"))),
        list(known.items())[1:],
        F.when(kind == list(known)[0], F.struct(F.lit(known[list(known)[0]][0]).alias("code"), F.lit(known[list(known)[0]][1]).alias("status"))),
    )

    def pair(code: str, status: int) -> Column:
        return F.struct(F.lit(code).alias("code"), F.lit(status).alias("status"))

    chain = (
        chain.when(F.lower("message").contains("timeout"), pair("CONVERSION_TIMEOUT", 503))
        .when(operation.contains("conversion"), pair("CONVERSION_ERROR", 500))
        .when(operation.contains("ai"), pair("AI_SERVICE_ERROR", 500))
        .otherwise(pair("OPERATION_ERROR", 500))
    )
    return errors.withColumn("_e", chain).withColumns({
        "code": F.col("_e.code"), "http_status": F.col("_e.status"),
    }).drop("_e")


def error_messages(errors: DataFrame) -> DataFrame:
    """User-facing title, message and suggestions by code; unknown codes read as internal errors."""
    code = F.col("code")
    row = F.coalesce(
        F.create_map(*[
            x for c, (title, message, tips) in V.ERROR_TEMPLATES.items()
            for x in (F.lit(c), F.struct(F.lit(title).alias("title"), F.lit(message).alias("message"),
                                         F.array(*map(F.lit, tips)).alias("suggestions")))
        ])[code],
        F.struct(F.lit(V.ERROR_TEMPLATES["INTERNAL_ERROR"][0]).alias("title"),
                 F.lit(V.ERROR_TEMPLATES["INTERNAL_ERROR"][1]).alias("message"),
                 F.array(*map(F.lit, V.ERROR_TEMPLATES["INTERNAL_ERROR"][2])).alias("suggestions")),
    )
    message = (
        F.when(code == "CONVERSION_TIMEOUT", X.fill(V.TIMEOUT_MESSAGE, seconds=F.col("timeout_seconds").cast("string")))
        .when((code == "AI_SERVICE_ERROR") & F.col("provider").isNotNull(),
              X.fill(V.PROVIDER_MESSAGE, provider=F.col("provider")))
        .otherwise(F.col("_t.message"))
    )
    validation, conversion = code == "VALIDATION_ERROR", code == "CONVERSION_ERROR"
    return errors.withColumn("_t", row).select(
        *errors.columns[:1], "code", F.col("_t.title").alias("title"), message.alias("user_message"),
        F.col("_t.suggestions").alias("suggestions"),
        F.when(validation, F.col("field")).alias("field"),
        F.when(validation, F.col("value")).alias("value"),
        F.when(conversion, F.col("source_format")).alias("source_format"),
        F.when(conversion, F.col("target_format")).alias("target_format"),
        F.when(code == "FILE_PROCESSING_ERROR", F.col("file_type")).alias("file_type"),
    )


def error_code_rollup(classified: DataFrame) -> DataFrame:
    """Errors by code and status class, with all subtotals."""
    klass = F.concat((F.col("http_status") / 100).cast("int").cast("string"), F.lit("xx"))
    return classified.select("code", klass.alias("status_class")).cube("code", "status_class").agg(
        F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n_errors")
    )
