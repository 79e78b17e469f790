"""Catalogue family: listing, validation, capability, task files, retention."""

from pyspark.sql import functions as F

from quire.operators import catalogue as ops
from quire.plans.registry import query
from quire.session import work_path
from quire.sources import files as src
from quire.sources.views import NAME, VIEWS, check_sql

NOW = 1704067200 + 500_000  # fixed clock for retention
FMT = "CASE WHEN regexp_extract(name, '\\.([^.]+)$', 1) IN ('epub','pdf','txt','mobi','azw3','docx','html','md') THEN regexp_extract(name, '\\.([^.]+)$', 1) END"
UUID = "^([0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}|[0-9a-fA-F]{32})$"


FOLDERS = 60  # folders the document texts are written to, as files of their own names


def _written_files(t, view):
    """The texts of all documents as files, one for each of a view's first paths, and the folder they are in."""
    kept = {e.split(" AS ")[-1]: e for e in VIEWS[view][1]}
    names = [n for n in ("area", "rel_path", "name") if n in kept]
    exprs = [kept[n] for n in names]
    books = t.documents.select((F.col("doc_id") % FOLDERS).alias("doc_id"), "n_chars", "text").selectExpr(*exprs, "text")
    path = work_path(t.spark, "files")
    books.repartition(*names).write.partitionBy(*names).text(path)
    return path


def _value(name):
    """The value that a partition folder's name holds."""
    return F.url_decode(F.regexp_extract("rel_path", f"(?:^|/){name}=([^/]*)/", 1))


@query("scan_file_catalogue", f"""WITH f AS (SELECT doc_id % {FOLDERS} AS doc_id, text FROM documents)
    SELECT {NAME} AS name, CAST(sum(strlen(coalesce(text, '')) + 1) AS BIGINT) AS size_bytes FROM f WHERE doc_id % 3 = 0 GROUP BY 1""")
def scan_file_catalogue(t):
    """A listing of written files, by name pattern and time; no content is read."""
    path = _written_files(t, "v_files")
    files = src.read_file_catalogue(t.spark, f"{path}/area=outputs", "outputs", pattern="*.txt", after="2000-01-01T00:00:00")
    named = files.withColumns({"name": _value("name"), "file_id": F.col("rel_path")})
    return ops.list_files(named, "outputs").select("name", "size_bytes")


@query("catalogue_totals", check_sql("v_files", "SELECT count(*) AS total_files, CAST(sum(size_bytes) AS BIGINT) AS total_bytes FROM v_files WHERE area = 'outputs'"))
def catalogue_totals(t):
    return ops.file_totals(t.v_files, "outputs")


_PATH = next(e for e in VIEWS["v_paths"][1] if e.endswith(" AS rel_path")).removesuffix(" AS rel_path")


@query("scan_supported_files", f"""WITH f AS (SELECT doc_id % {FOLDERS} AS doc_id, text FROM documents), p AS (
    SELECT {_PATH} AS rel_path, CAST(sum(strlen(coalesce(text, '')) + 1) AS BIGINT) AS size_bytes FROM f GROUP BY 1)
    SELECT rel_path, size_bytes, lower(regexp_extract(rel_path, '\\.([^.]+)$', 1)) AS format FROM p WHERE NOT contains(rel_path, '/')
    AND rel_path NOT LIKE '.%' AND lower(rel_path) NOT LIKE '%.xyz'""")
def scan_supported_files(t):
    files = src.read_file_catalogue(t.spark, _written_files(t, "v_paths"), "uploads", pattern="*.txt")
    return ops.supported_files(files.withColumn("rel_path", _value("rel_path"))).select("rel_path", "size_bytes", "format")


@query("files_newest_first", check_sql("v_files", "SELECT file_id, name, modified_s FROM v_files WHERE area = 'uploads' ORDER BY modified_s DESC"))
def files_newest_first(t):
    return ops.list_files(t.v_files, "uploads").select("file_id", "name", "modified_s")


@query("file_search", check_sql("v_files", f"SELECT file_id, name, size_bytes, {FMT} AS format FROM v_files WHERE name ILIKE '%k_1%' AND {FMT} = 'epub' ORDER BY size_bytes"
       .replace("ILIKE '%k_1%'", "ILIKE '%k\\_1%' ESCAPE '\\'")))
def file_search(t):
    return ops.search(t.v_files, "K_1", "epub", "size").select("file_id", "name", "size_bytes", "format")


# fixed values, written out for the check
_MIME = """
    WHEN 'epub' THEN 'application/epub+zip'
    WHEN 'pdf' THEN 'application/pdf'
    WHEN 'txt' THEN 'text/plain'
    WHEN 'mobi' THEN 'application/x-mobipocket-ebook'
    WHEN 'azw3' THEN 'application/vnd.amazon.ebook'
    WHEN 'docx' THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document'
    WHEN 'html' THEN 'text/html'
    WHEN 'md' THEN 'text/markdown'"""


@query("file_enrich", check_sql(
    "v_files",
    f"""SELECT file_id, display_name, extension, format, CASE format {_MIME} END AS mime_type,
    CASE WHEN size_bytes = 0 THEN '0 Bytes' WHEN size_bytes < 1024 THEN concat(size_bytes, ' Bytes')
    WHEN size_bytes < 1048576 THEN concat(regexp_replace(printf('%.2f', round(size_bytes / 1024, 2)), '\\.?0+$', ''), ' KB')
    WHEN size_bytes < 1073741824 THEN concat(regexp_replace(printf('%.2f', round(size_bytes / 1048576, 2)), '\\.?0+$', ''), ' MB')
    ELSE concat(regexp_replace(printf('%.2f', round(size_bytes / 1073741824, 2)), '\\.?0+$', ''), ' GB') END AS size_text
    FROM (SELECT file_id, size_bytes, regexp_replace(name, '\\.[^.]+$', '') AS display_name, regexp_extract(name, '\\.([^.]+)$', 1) AS extension,
    {FMT} AS format FROM v_files)"""))
def file_enrich(t):
    return ops.enrich(t.v_files).select("file_id", "display_name", "extension", "format", "mime_type", "size_text")


@query("validate_uploads", check_sql(
    "v_uploads",
    """SELECT upload_id, reason, CASE WHEN reason IS NULL THEN 200 WHEN reason LIKE 'File too large%' THEN 413 ELSE 400 END AS http_status FROM (
    SELECT upload_id, CASE WHEN coalesce(filename, '') = '' THEN 'No filename provided' WHEN base LIKE '.%' THEN 'Invalid filename'
    WHEN ext NOT IN ('epub','pdf','txt','mobi','azw3') THEN 'Unsupported file format'
    WHEN target_format IS NULL OR lower(target_format) NOT IN ('epub','pdf','txt','mobi','azw3') THEN 'Unsupported target format'
    WHEN size_bytes > 52428800 THEN 'File too large. Maximum size: 50MB' WHEN size_bytes = 0 OR size_bytes IS NULL THEN 'Empty file uploaded' END AS reason
    FROM (SELECT *, regexp_extract(filename, '([^/]*)$', 1) AS base, lower(regexp_extract(filename, '\\.([^.]+)$', 1)) AS ext FROM v_uploads))"""))
def validate_uploads(t):
    return ops.validate_uploads(t.v_uploads).select("upload_id", "reason", "http_status")


@query("enforce_batch_limit", check_sql(
    "v_uploads",
    """SELECT b.doc_id AS batch_id, count(u.batch_id) AS n_files, CASE WHEN count(u.batch_id) = 0 THEN 'No files provided' WHEN count(u.batch_id) > 50
    THEN 'Too many files. Maximum 50 files allowed per batch.' ELSE 'accepted' END AS verdict
    FROM documents b LEFT JOIN v_uploads u ON u.batch_id = b.doc_id GROUP BY b.doc_id"""))
def enforce_batch_limit(t):
    return ops.enforce_batch_limit(t.documents.select(F.col("doc_id").alias("batch_id")), t.v_uploads)


@query("validate_conversion", check_sql(
    "v_conversions",
    """SELECT request_id, CASE WHEN source_format IS NULL OR source_format NOT IN ('.epub','.pdf','.txt','.mobi','.azw3') THEN concat('Unsupported source format: ', source_format)
    WHEN target_format IS NULL OR target_format NOT IN ('epub','pdf','txt','mobi','azw3') THEN concat('Unsupported target format: ', target_format)
    WHEN source_format = concat('.', target_format) THEN 'Source and target formats cannot be the same' END AS reason FROM v_conversions"""))
def validate_conversion(t):
    return ops.validate_conversion(t.v_conversions).select("request_id", "reason")


# fixed values, written out for the check
_ROUTES = """
    ('.epub', 'pdf', 'epub_to_pdf'),
    ('.pdf', 'epub', 'pdf_to_epub'),
    ('.txt', 'pdf', 'txt_to_pdf'),
    ('.txt', 'epub', 'txt_to_epub'),
    ('.epub', 'txt', 'epub_to_txt'),
    ('.pdf', 'txt', 'pdf_to_txt'),
    ('.mobi', 'txt', 'mobi_to_txt'),
    ('.mobi', 'pdf', 'mobi_to_pdf'),
    ('.azw3', 'txt', 'azw3_to_txt'),
    ('.azw3', 'pdf', 'azw3_to_pdf')"""


@query("route_conversion", check_sql(
    "v_conversions",
    f"""SELECT request_id, route, CASE WHEN route IS NULL THEN concat('Conversion from ', v.source_format, ' to ', v.target_format, ' not supported') END AS error
    FROM v_conversions v LEFT JOIN (VALUES {_ROUTES}) r(source_format, target_format, route)
    ON v.source_format = r.source_format AND v.target_format = r.target_format"""))
def route_conversion(t):
    return ops.route_conversion(t.v_conversions).select("request_id", "route", "error")


# fixed values, written out for the check
_PAIRS = """
    ('epub', 'pdf'), ('epub', 'txt'), ('epub', 'html'), ('epub', 'mobi'),
    ('pdf', 'txt'), ('pdf', 'html'), ('pdf', 'epub'),
    ('txt', 'pdf'), ('txt', 'epub'), ('txt', 'html'), ('txt', 'mobi'),
    ('mobi', 'epub'), ('mobi', 'pdf'), ('mobi', 'txt'), ('mobi', 'html'),
    ('azw3', 'epub'), ('azw3', 'pdf'), ('azw3', 'txt'), ('azw3', 'html'),
    ('docx', 'pdf'), ('docx', 'txt'), ('docx', 'html'), ('docx', 'epub'),
    ('html', 'pdf'), ('html', 'epub'), ('html', 'txt'), ('html', 'mobi'),
    ('md', 'pdf'), ('md', 'html'), ('md', 'epub'), ('md', 'txt')"""
_MATCH = f"""SELECT file_id, m.s IS NOT NULL AS convertible, 3.0 * (1 + size_bytes / 1048576 * 0.1) * CASE WHEN format = 'txt' THEN 0.5 WHEN format = 'pdf' THEN 2.0
    WHEN format IN ('mobi', 'azw3') THEN 1.5 WHEN format = 'docx' THEN 1.8 ELSE 1.0 END AS est_seconds
    FROM (SELECT *, {FMT} AS format FROM v_files) f LEFT JOIN (VALUES {_PAIRS}) m(s, d) ON f.format = m.s AND m.d = 'epub'"""


@query("capability_match", check_sql("v_files", f"SELECT file_id, convertible, round(CAST(est_seconds AS DOUBLE), 6) AS est_seconds FROM ({_MATCH})"))
def capability_match(t):
    return ops.capability_match(t.v_files, "epub").select(
        "file_id", "convertible", F.round("est_seconds", 6).alias("est_seconds")
    )


@query("capability_totals", check_sql(
    "v_files",
    """SELECT convertible_files, incompatible_files, round(s, 4) AS total_seconds, CASE WHEN s < 60 THEN concat(CAST(floor(s) AS BIGINT), '秒')
    WHEN s < 3600 THEN concat(CAST(floor(s / 60) AS BIGINT), '分钟') ELSE concat(CAST(floor(s / 3600) AS BIGINT), '小时',
    CAST(floor((s % 3600) / 60) AS BIGINT), '分钟') END AS total_text FROM (SELECT count_if(convertible) AS convertible_files,
    count_if(NOT convertible) AS incompatible_files, CAST(sum(est_seconds) FILTER (convertible) AS DOUBLE) AS s FROM m)""", m=_MATCH))
def capability_totals(t):
    return ops.capability_totals(ops.capability_match(t.v_files, "epub"))


_WANTED = f"SELECT DISTINCT task_id FROM v_tasks WHERE regexp_matches(task_id, '{UUID}')"
_NAMED = """SELECT regexp_extract(name, '^([0-9a-f]{32})_', 1) AS task_id, name, concat('input/', name) AS cleaned FROM v_task_files WHERE area = 'uploads'
    UNION ALL SELECT regexp_extract(name, '([0-9a-f]{32})', 1), name, concat('output/', name) FROM v_task_files WHERE area = 'outputs'"""


@query("task_file_status", check_sql(
    "v_tasks v_task_files",
    """SELECT request_id, task_id, status, CASE WHEN status = 'completed' THEN o ELSE 0 END AS n_outputs, CASE WHEN status = 'completed' THEN f ELSE '' END AS output_files, CASE status WHEN 'invalid' THEN 'Invalid task ID format'
    WHEN 'completed' THEN 'Conversion completed successfully' WHEN 'failed' THEN 'Conversion failed or file not found' ELSE 'Task not found' END AS message FROM (
    SELECT request_id, t.task_id, o, f, CASE WHEN length(t.task_id) <> 32 THEN 'invalid' WHEN o > 0 THEN 'completed' WHEN i > 0 THEN 'failed' ELSE 'not_found' END AS status
    FROM v_tasks t LEFT JOIN (SELECT task_id, count_if(cleaned LIKE 'output/%') AS o, count_if(cleaned LIKE 'input/%') AS i, string_agg(name, ',' ORDER BY name) FILTER (cleaned LIKE 'output/%') AS f FROM n GROUP BY task_id) n ON n.task_id = t.task_id)""",
    n=_NAMED))
def task_file_status(t):
    status = ops.task_file_status(t.v_tasks, t.v_task_files)
    return status.withColumn("output_files", F.array_join("output_files", ","))


@query("task_file_cleanup", check_sql("v_tasks v_task_files", "SELECT task_id, cleaned AS cleaned_file FROM n WHERE task_id IN (SELECT task_id FROM w)", n=_NAMED, w=_WANTED))
def task_file_cleanup(t):
    return ops.task_file_cleanup(t.v_tasks, t.v_task_files)


@query("task_cleanup_counts", check_sql(
    "v_tasks v_task_files",
    "SELECT task_id, count(*) AS n_files, concat('Cleaned up ', count(*), ' files') AS message FROM n WHERE task_id IN (SELECT task_id FROM w) GROUP BY task_id",
    n=_NAMED, w=_WANTED))
def task_cleanup_counts(t):
    return ops.task_cleanup_counts(ops.task_file_cleanup(t.v_tasks, t.v_task_files))


@query("file_statistics", check_sql(
    "v_files",
    f"""SELECT format, grouping(format) AS is_total, count(*) AS n_files, CAST(sum(size_bytes) AS BIGINT) AS total_size, CAST(sum(size_bytes) // count(*) AS BIGINT) AS mean_size
    FROM (SELECT {FMT} AS format, size_bytes FROM v_files) GROUP BY ROLLUP (format)"""))
def file_statistics(t):
    return ops.file_statistics(t.v_files)


@query("disk_usage", check_sql(
    "v_files",
    """SELECT CASE WHEN grouping(area) = 1 THEN 'total' ELSE area END AS area, count(*) AS file_count, round(CAST(sum(size_bytes) AS DOUBLE) / 1048576, 2) AS size_mb,
    grouping(area) = 1 AND sum(size_bytes) / 1048576 > 1000 AS alert FROM v_files GROUP BY ROLLUP (area)"""))
def disk_usage(t):
    return ops.disk_usage(t.v_files)


_EXPIRED = f"""SELECT area, regexp_extract(rel_path, '^([^/]+)', 1) AS item, CAST(sum(size_bytes) AS BIGINT) AS size_bytes, max(access_error) AS access_error
    FROM v_tree GROUP BY 1, 2 HAVING max(modified_s) < {NOW} - 86400"""


@query("retention_report", check_sql(
    "v_tree",
    """SELECT CASE WHEN grouping(area) = 1 THEN 'total' ELSE area END AS area, count_if(access_error IS NULL) AS files_removed,
    round(CAST(coalesce(sum(size_bytes) FILTER (access_error IS NULL), 0) AS DOUBLE) / 1048576, 4) AS space_freed_mb, count_if(access_error IS NOT NULL) AS n_errors
    FROM x GROUP BY ROLLUP (area)""", x=_EXPIRED))
def retention_report(t):
    return ops.retention_report(t.v_tree, NOW)


@query("cleanup_union", check_sql(
    "v_tree",
    """SELECT area, item, CASE WHEN access_error IS NULL THEN 'removed' ELSE 'error' END AS kind, CASE WHEN access_error IS NOT NULL THEN
    concat('Error removing ', item, ': ', access_error) END AS error, CASE WHEN access_error IS NULL THEN size_bytes END AS freed_bytes FROM x""", x=_EXPIRED))
def cleanup_union(t):
    tree = t.v_tree
    return ops.cleanup_union(tree.filter("area = 'uploads'"), tree.filter("area = 'outputs'"), NOW)


@query("add_files_dedup", check_sql(
    "v_files",
    """SELECT url, file_id, size_bytes FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY src, file_id) AS rn FROM (
    SELECT concat('file:///', file_id % 300) AS url, file_id, size_bytes, 0 AS src FROM v_files WHERE area = 'outputs'
    UNION ALL SELECT concat('file:///', file_id % 500), file_id, size_bytes, 1 FROM v_files WHERE area = 'uploads')) WHERE rn = 1"""))
def add_files_dedup(t):
    def with_url(area, n):
        return t.v_files.filter(F.col("area") == area).select(
            F.concat(F.lit("file:///"), F.col("file_id") % n).alias("url"), "file_id", "size_bytes"
        )

    return ops.add_files(with_url("outputs", 300), with_url("uploads", 500))


@query("remove_files", check_sql("v_files v_selection", "SELECT file_id, name FROM v_files WHERE file_id NOT IN (SELECT file_id * 3 FROM v_selection)"))
def remove_files(t):
    return ops.remove_files(t.v_files, t.v_selection.select((F.col("file_id") * 3).alias("file_id"))).select("file_id", "name")


@query("selected_files", check_sql("v_files v_selection", "SELECT file_id, name FROM v_files WHERE file_id IN (SELECT file_id * 2 FROM v_selection)"))
def selected_files(t):
    return ops.selected_files(t.v_files, t.v_selection.select((F.col("file_id") * 2).alias("file_id"))).select("file_id", "name")


@query("incompatible_files", check_sql(
    "v_files v_selection",
    f"SELECT file_id, name FROM v_files WHERE file_id IN (SELECT file_id * 2 FROM v_selection) AND NOT coalesce({FMT} IN ('epub','txt','html','mobi','azw3','docx'), false)"
    .replace("('epub','txt','html','mobi','azw3','docx'), false", "(SELECT s FROM m), false"),
    m=f"SELECT s FROM (VALUES {_PAIRS}) p(s, d) WHERE d = 'mobi'"))
def incompatible_files(t):
    chosen = ops.selected_files(t.v_files, t.v_selection.select((F.col("file_id") * 2).alias("file_id")))
    return ops.incompatible_files(chosen, "mobi").select("file_id", "name")


@query("recent_history", check_sql("v_history", "SELECT record_id, ts, status, file_size FROM v_history ORDER BY ts DESC, record_id DESC LIMIT 10"))
def recent_history(t):
    return ops.recent_history(t.v_history)
