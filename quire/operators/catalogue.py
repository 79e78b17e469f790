"""File catalogue, validation, capability match, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quire.functions import text as T, values as V
from quire.operators.ordered import first_row

MB = 1024 * 1024
TASK_ID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}|[0-9a-fA-F]{32}"


def is_task_id(c: Column) -> Column:
    return c.rlike(rf"^({TASK_ID})\z")


def format_of(name: Column) -> Column:
    """Known format by extension, else null."""
    ext = F.replace(T.suffix(name), F.lit("."), F.lit(""))
    return F.when(ext.isin(V.FORMATS), ext)


def list_files(files: DataFrame, area: str) -> DataFrame:
    """Files of one area, newest first (a global range-partitioned sort)."""
    return files.filter(F.col("area") == area).orderBy(F.desc("modified_s"), F.asc("file_id"))


def file_totals(files: DataFrame, area: str) -> DataFrame:
    return files.filter(F.col("area") == area).agg(
        F.count(F.lit(1)).alias("total_files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes")
    )


def supported_files(files: DataFrame, path: str = "rel_path") -> DataFrame:
    """Visible files of the folder itself whose extension maps to a known format."""
    return (
        files.filter(~F.col(path).contains("/") & ~F.col(path).startswith("."))
        .withColumn("format", format_of(F.col(path)))
        .filter(F.col("format").isNotNull())
    )


def enrich(files: DataFrame) -> DataFrame:
    fmt = format_of(F.col("name"))
    return files.withColumns({
        "display_name": T.stem(F.col("name")),
        "extension": F.replace(T.suffix(F.col("name")), F.lit("."), F.lit("")),
        "format": fmt,
        "mime_type": T.lookup(fmt, V.MIME_TYPES),
        "size_text": T.human_size(F.col("size_bytes")),
    })


ORDERS = {
    "name": [F.asc, "name"],
    "size": [F.asc, "size_bytes"],
    "created": [F.desc, "created_s"],
    "modified": [F.desc, "modified_s"],
    "format": [F.asc, "format_name"],
}


def search(files: DataFrame, text: str = "", fmt: str | None = None, order: str = "name") -> DataFrame:
    """Case-insensitive substring of name or display name, optional format, one of five orders."""
    found = files.withColumn("format", format_of(F.col("name")))
    if text:
        needle = text.lower()
        found = found.filter(
            F.lower("name").contains(needle) | F.lower(T.stem(F.col("name"))).contains(needle)
        )
    if fmt:
        found = found.filter(F.col("format") == fmt)
    if order == "format":
        found = found.withColumn("format_name", T.lookup(F.col("format"), V.FORMAT_NAMES))
    direction, column = ORDERS[order]
    return found.orderBy(direction(column), F.asc("file_id"))


def validate_uploads(uploads: DataFrame, max_bytes: int = V.MAX_FILE_BYTES) -> DataFrame:
    """First failing rule per upload with its HTTP status; null reason means accepted.

    A null file name, target format or size fails like an empty one.
    """
    name = T.base_name(F.coalesce("filename", F.lit("")))
    ext = F.coalesce(T.suffix(name), F.lit(""))
    target = F.concat(F.lit("."), F.lower(F.coalesce("target_format", F.lit(""))))
    reason = (
        F.when(F.coalesce(F.col("filename"), F.lit("")) == "", "No filename provided")
        .when((name == "") | name.startswith("."), "Invalid filename")
        .when(~ext.isin(V.ALLOWED_EXTENSIONS), "Unsupported file format")
        .when(~target.isin(V.ALLOWED_EXTENSIONS), "Unsupported target format")
        .when(F.col("size_bytes") > max_bytes, f"File too large. Maximum size: {max_bytes // MB}MB")
        .when(F.coalesce("size_bytes", F.lit(0)) == 0, "Empty file uploaded")
    )
    return uploads.withColumn("reason", reason).withColumn(
        "http_status",
        F.when(F.col("reason").isNull(), 200).when(F.col("reason").startswith("File too large"), 413).otherwise(400),
    )


def enforce_batch_limit(batches: DataFrame, files: DataFrame, limit: int = V.MAX_BATCH_FILES) -> DataFrame:
    counts = files.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce(F.col("n"), F.lit(0))
    return batches.join(counts, "batch_id", "left").select(
        "batch_id",
        n.alias("n_files"),
        F.when(n == 0, "No files provided")
        .when(n > limit, f"Too many files. Maximum {limit} files allowed per batch.")
        .otherwise("accepted")
        .alias("verdict"),
    )


def validate_conversion(requests: DataFrame) -> DataFrame:
    source, target = F.coalesce("source_format", F.lit("")), F.coalesce("target_format", F.lit(""))
    dotted = F.concat(F.lit("."), target)
    return requests.withColumn(
        "reason",
        F.when(~source.isin(V.ALLOWED_EXTENSIONS), F.concat(F.lit("Unsupported source format: "), source))
        .when(~dotted.isin(V.ALLOWED_EXTENSIONS), F.concat(F.lit("Unsupported target format: "), target))
        .when(source == dotted, "Source and target formats cannot be the same"),
    )


def route_conversion(requests: DataFrame) -> DataFrame:
    """Handler of a (source, target) pair from the fixed route table."""
    given, target = F.coalesce("source_format", F.lit("")), F.coalesce("target_format", F.lit(""))
    source = F.replace(given, F.lit("."), F.lit(""))
    table = {f"{a}>{b}": r for (a, b), r in V.ROUTES.items()}
    route = T.lookup(F.concat(source, F.lit(">"), target), table)
    return requests.withColumns({
        "route": route,
        "error": F.when(
            route.isNull(),
            F.concat(F.lit("Conversion from "), given, F.lit(" to "), target, F.lit(" not supported")),
        ),
    })


def convertible_to(fmt: Column, target: str) -> Column:
    sources = [s for s, targets in V.CONVERTIBLE.items() if target in targets]
    return F.coalesce(fmt.isin(sources), F.lit(False))


def complexity(fmt: Column, target: str) -> Column:
    """Cost factor of a pair; the first matching rule wins."""
    factor = F.when(fmt == "txt", 0.5)
    if target == "txt":
        return factor.otherwise(0.3)
    pair = {"epub": ["pdf"], "pdf": ["epub"]}.get(target, [])
    if pair:
        factor = factor.when(fmt.isin(pair), 2.0)
    if target == "epub":
        factor = factor.when(fmt.isin("mobi", "azw3"), 1.5)
    return factor.when(fmt == "docx", 1.8).otherwise(1.0)


def capability_match(files: DataFrame, target: str, quality: str = "standard") -> DataFrame:
    fmt = F.col("format")
    base = V.QUALITY_SECONDS[quality]
    return (
        files.withColumn("format", format_of(F.col("name")))
        .withColumn("convertible", convertible_to(fmt, target))
        .withColumn("est_seconds", base * (1 + F.col("size_bytes") / MB * 0.1) * complexity(fmt, target))
    )


def capability_totals(matched: DataFrame) -> DataFrame:
    total = F.coalesce(F.sum(F.when(F.col("convertible"), F.col("est_seconds"))), F.lit(0.0))
    return matched.agg(
        F.count_if("convertible").alias("convertible_files"),
        F.count_if(~F.col("convertible")).alias("incompatible_files"),
        F.round(total, 4).alias("total_seconds"),
        T.human_duration(total).alias("total_text"),
    )


def task_ids_in(name: Column) -> Column:
    """Every task id a name contains (overlapping matches too)."""
    return F.array_distinct(F.regexp_extract_all(name, F.lit(f"(?=({TASK_ID}))"), F.lit(1)))


def _task_outputs(files: DataFrame) -> DataFrame:
    return files.filter(F.col("area") == "outputs").select(F.explode(task_ids_in(F.col("name"))).alias("task_id"), "name")


def _task_inputs(files: DataFrame) -> DataFrame:
    lead = F.regexp_extract("name", rf"^({TASK_ID})_", 1)
    return files.filter(F.col("area") == "uploads").select(lead.alias("task_id"), "name").filter(F.col("task_id") != "")


def task_file_status(tasks: DataFrame, files: DataFrame) -> DataFrame:
    """completed / failed / not_found from the presence of files named after the task."""
    outputs = _task_outputs(files).groupBy("task_id").agg(
        F.count(F.lit(1)).alias("n_outputs"), F.sort_array(F.collect_list("name")).alias("_names")  # a task's own files
    )
    inputs = _task_inputs(files).select("task_id").distinct().withColumn("_has_input", F.lit(True))
    joined = tasks.join(outputs, "task_id", "left").join(inputs, "task_id", "left")
    status = (
        F.when(~is_task_id(F.col("task_id")), "invalid")
        .when(F.col("n_outputs") > 0, "completed")
        .when(F.col("_has_input"), "failed")
        .otherwise("not_found")
    )
    return joined.withColumn("status", status).select(
        *tasks.columns,
        "status",
        F.when(F.col("status") == "completed", F.col("n_outputs")).otherwise(0).alias("n_outputs"),
        F.when(F.col("status") == "completed", F.col("_names")).otherwise(F.array().cast("array<string>")).alias("output_files"),
        F.when(F.col("status") == "invalid", "Invalid task ID format")
        .when(F.col("status") == "completed", "Conversion completed successfully")
        .when(F.col("status") == "failed", "Conversion failed or file not found")
        .otherwise("Task not found")
        .alias("message"),
    )


def task_file_cleanup(tasks: DataFrame, files: DataFrame) -> DataFrame:
    """Deletion plan: ``input/...`` and ``output/...`` names of the wanted tasks."""
    wanted = tasks.filter(is_task_id(F.col("task_id"))).select("task_id").distinct()
    named = _task_inputs(files).withColumn("name", F.concat(F.lit("input/"), "name")).unionByName(
        _task_outputs(files).withColumn("name", F.concat(F.lit("output/"), "name"))
    )
    return named.join(wanted, "task_id", "left_semi").withColumnRenamed("name", "cleaned_file")


def task_cleanup_counts(plan: DataFrame) -> DataFrame:
    return plan.groupBy("task_id").agg(F.count(F.lit(1)).alias("n")).select(
        "task_id", F.col("n").alias("n_files"), F.format_string("Cleaned up %d files", F.col("n")).alias("message")
    )


def file_statistics(files: DataFrame) -> DataFrame:
    """Per format and in total (null format): count, size, whole-number mean size."""
    fmt = files.select(format_of(F.col("name")).alias("format"), "size_bytes")
    return fmt.rollup("format").agg(
        F.grouping("format").alias("is_total"),
        F.count(F.lit(1)).alias("n_files"),
        F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_size"),
        F.coalesce(F.expr("sum(size_bytes) div count(*)"), F.lit(0)).alias("mean_size"),
    )


def disk_usage(files: DataFrame, alert_mb: float = 1000) -> DataFrame:
    return (
        files.rollup("area")
        .agg(F.grouping("area").alias("g"), F.count(F.lit(1)).alias("file_count"), F.sum("size_bytes").alias("b"))
        .select(
            F.when(F.col("g") == 1, "total").otherwise(F.col("area")).alias("area"),
            "file_count",
            F.round(F.col("b") / MB, 2).alias("size_mb"),
            ((F.col("g") == 1) & (F.col("b") / MB > alert_mb)).alias("alert"),
        )
    )


def expired_items(files: DataFrame, now_s: float, hours: float = 24) -> DataFrame:
    """Top-level items (a file, or a folder as one item of recursive size) last modified
    before ``now - hours``. A folder is as new as the newest file in it."""
    top = F.regexp_extract("rel_path", "^([^/]+)", 1)
    return (
        files.groupBy("area", top.alias("item"))
        .agg(
            F.sum("size_bytes").alias("size_bytes"),
            F.max("modified_s").alias("modified_s"),
            F.max("access_error").alias("access_error"),
        )
        .filter(F.col("modified_s") < now_s - hours * 3600)
    )


def retention_report(files: DataFrame, now_s: float, hours: float = 24) -> DataFrame:
    """Items to remove and space freed per area and in total; unreadable items are errors."""
    ok = F.col("access_error").isNull()
    return (
        expired_items(files, now_s, hours)
        .rollup("area")
        .agg(
            F.grouping("area").alias("g"),
            F.count_if(ok).alias("files_removed"),
            F.round(F.coalesce(F.sum(F.when(ok, F.col("size_bytes"))), F.lit(0)) / MB, 4).alias("space_freed_mb"),
            F.count_if(~ok).alias("n_errors"),
        )
        .select(
            F.when(F.col("g") == 1, "total").otherwise(F.col("area")).alias("area"),
            "files_removed", "space_freed_mb", "n_errors",
        )
    )


def cleanup_union(uploads: DataFrame, outputs: DataFrame, now_s: float, hours: float = 24) -> DataFrame:
    """One long report of both folders: removals and error messages."""
    def lines(files: DataFrame) -> DataFrame:
        items = expired_items(files, now_s, hours)
        failed = F.col("access_error").isNotNull()
        return items.select(
            "area",
            "item",
            F.when(failed, "error").otherwise("removed").alias("kind"),
            F.when(failed, F.concat(F.lit("Error removing "), "item", F.lit(": "), "access_error")).alias("error"),
            F.when(~failed, F.col("size_bytes")).alias("freed_bytes"),
        )

    return lines(uploads).unionByName(lines(outputs))


def add_files(files: DataFrame, new: DataFrame, key: str = "url") -> DataFrame:
    """Catalogue plus new files; the first file of each key stays."""
    both = files.withColumn("_src", F.lit(0)).unionByName(new.withColumn("_src", F.lit(1)))
    return first_row(both, [key], [F.col("_src"), F.col("file_id")]).drop("_src")


def remove_files(files: DataFrame, ids: DataFrame) -> DataFrame:
    return files.join(ids, "file_id", "left_anti")


def selected_files(files: DataFrame, ids: DataFrame) -> DataFrame:
    return files.join(ids, "file_id", "left_semi")


def incompatible_files(selected: DataFrame, target: str) -> DataFrame:
    return selected.filter(~convertible_to(format_of(F.col("name")), target))


def recent_history(history: DataFrame, n: int = 10) -> DataFrame:
    return history.orderBy(F.desc("ts"), F.desc("record_id")).limit(n)
