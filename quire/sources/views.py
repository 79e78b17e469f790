"""Stand-in tables for the jobs, derived from the given tables by fixed formulas.

Each view is a source table plus projection expressions that mean the same in
Spark SQL and in the checking SQL, so both sides read equal rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.session import prepare

FORMAT_CASE = (
    "CASE doc_id % 8 WHEN 0 THEN 'epub' WHEN 1 THEN 'pdf' WHEN 2 THEN 'txt' WHEN 3 THEN 'mobi'"
    " WHEN 4 THEN 'azw3' WHEN 5 THEN 'docx' WHEN 6 THEN 'html' ELSE 'md' END"
)
NAME = f"concat('book_', doc_id, '.', {FORMAT_CASE})"
MD5 = "md5(CAST(doc_id AS VARCHAR(20)))"
EXT6 = (
    "CASE CAST(floor(doc_id / 8) AS INT) % 6 WHEN 0 THEN 'pdf' WHEN 1 THEN 'epub' WHEN 2 THEN 'txt'"
    " WHEN 3 THEN 'mobi' WHEN 4 THEN 'docx' ELSE 'html' END"
)

VIEWS: dict[str, tuple[str, list[str]]] = {
    "v_files": ("documents", [
        "doc_id AS file_id", f"{NAME} AS name",
        "CASE WHEN doc_id % 3 = 0 THEN 'outputs' ELSE 'uploads' END AS area",
        "n_chars * 9973 AS size_bytes", "1704067200 + doc_id * 613 AS modified_s",
        f"{MD5} AS task_id",
    ]),
    # paths with hidden files, sub-folders and unknown extensions
    "v_paths": ("documents", [
        "doc_id AS file_id",
        f"CASE WHEN doc_id % 13 = 0 THEN concat('.book_', doc_id, '.pdf') WHEN doc_id % 11 = 0 THEN"
        f" concat('sub/', {NAME}) WHEN doc_id % 7 = 0 THEN concat('book_', doc_id, '.xyz') WHEN doc_id % 5 = 0"
        f" THEN concat('Book_', doc_id, '.PDF') ELSE {NAME} END AS rel_path",
        "n_chars * 9973 AS size_bytes", "1704067200 + doc_id * 613 AS modified_s",
    ]),
    # area folders with nested items, some of them unreadable
    "v_tree": ("documents", [
        "doc_id AS file_id",
        "CASE WHEN doc_id % 3 = 0 THEN 'outputs' ELSE 'uploads' END AS area",
        f"CASE WHEN doc_id % 4 = 0 THEN concat('dir_', doc_id % 50, '/', {NAME}) ELSE {NAME} END AS rel_path",
        "n_chars * 9973 AS size_bytes", "1704067200 + doc_id * 613 AS modified_s",
        "CASE WHEN doc_id % 97 = 0 THEN 'permission denied' END AS access_error",
    ]),
    "v_uploads": ("documents", [
        "doc_id AS upload_id",
        f"CASE WHEN doc_id % 23 = 0 THEN NULL WHEN doc_id % 17 = 0 THEN '' WHEN doc_id % 13 = 0 THEN concat('.hidden', doc_id, '.pdf')"
        f" WHEN doc_id % 11 = 0 THEN concat('dir/book_', doc_id, '.PDF') ELSE {NAME} END AS filename",
        "CASE doc_id % 9 WHEN 0 THEN 'docx' WHEN 1 THEN 'EPUB' WHEN 2 THEN NULL ELSE 'pdf' END AS target_format",
        "CASE WHEN doc_id % 19 = 0 THEN 0 WHEN doc_id % 7 <> 3 THEN n_chars * 9973 END AS size_bytes",
        "CAST(floor(doc_id * doc_id / 100000) AS BIGINT) AS batch_id",
    ]),
    "v_conversions": ("documents", [
        "doc_id AS request_id", f"CASE WHEN doc_id % 29 <> 0 THEN concat('.', {FORMAT_CASE}) END AS source_format",
        f"CASE WHEN doc_id % 31 <> 0 THEN {EXT6} END AS target_format",
    ]),
    # input and output files named after their task
    "v_task_files": ("documents", [
        "doc_id AS file_id",
        "CASE WHEN doc_id % 3 = 0 THEN 'outputs' ELSE 'uploads' END AS area",
        f"CASE WHEN doc_id % 3 = 0 THEN concat('book_', doc_id, '_', {MD5}, '.pdf')"
        f" ELSE concat({MD5}, '_book_', doc_id, '.epub') END AS name",
    ]),
    "v_tasks": ("documents", [
        "doc_id AS request_id",
        f"CASE WHEN doc_id % 10 = 0 THEN concat('bad-', doc_id) WHEN doc_id % 10 = 1 THEN"
        f" md5(CAST(doc_id + 90000000 AS VARCHAR(20))) ELSE {MD5} END AS task_id",
    ]),
    "v_meta": ("documents", [
        "doc_id", "CASE WHEN doc_id % 5 <> 0 THEN concat('Title ', doc_id) END AS title",
        "CASE WHEN doc_id % 3 <> 0 THEN concat('Author ', source) END AS author",
        "CASE WHEN doc_id % 4 <> 0 THEN concat('Subject ', lang) END AS subject",
        "CAST(floor(n_chars / 1800) AS INT) AS page_count",
        "doc_id % 2 = 0 AS has_bookmarks", "doc_id % 23 = 0 AS is_encrypted",
        "doc_id % 29 = 0 AS has_drm", "doc_id % 31 = 0 AS complex_layout",
        "doc_id % 37 = 0 AS error_occurred", "doc_id % 41 = 0 AS user_requested",
        "doc_id % 43 <> 0 AS engine_available",
        "CAST(doc_id % 101 AS DOUBLE) AS score",
    ]),
    # two conversion outputs per document, either may be missing or failed
    "v_primary": ("documents", [
        "doc_id", "doc_id % 7 <> 0 AS success", "n_chars * 10 AS file_size",
        "CAST(doc_id % 101 AS DOUBLE) AS quality_score", "doc_id % 41 = 0 AS user_requested",
    ]),
    "v_alternate": ("documents", [
        "doc_id", "doc_id % 5 <> 0 AS success", "n_chars * 12 + doc_id AS file_size",
        "CAST(doc_id % 3 AS INT) AS images_extracted", "doc_id % 4 < 2 AS metadata_found",
    ]),
    "v_words": ("lineitem", [
        "l_orderkey AS page_id", "l_partkey AS word_id", "concat('w', l_partkey) AS text",
        "l_extendedprice / 100 AS x0", "l_extendedprice / 100 + l_quantity AS x1",
        "l_quantity * 3 AS top", "l_quantity * 3 + 10 AS bottom", "8 + l_tax * 100 AS size",
    ]),
    # the words of a page as if set in two text columns of a few lines
    "v_dense_words": ("lineitem", [
        "CAST(floor(l_orderkey / 8) AS BIGINT) AS page_id",
        "CAST(l_orderkey % 8 * 10 + l_linenumber AS BIGINT) * 1000000 + l_partkey AS word_id",
        "concat('w', l_partkey) AS text",
        "CAST(l_partkey % 8 * 12 + (l_suppkey % 2) * 200 AS DOUBLE) AS x0",
        "CAST(l_partkey % 8 * 12 + (l_suppkey % 2) * 200 + 10 AS DOUBLE) AS x1",
        "CAST(l_quantity * 2 AS DOUBLE) AS top", "CAST(l_quantity * 2 + 10 AS DOUBLE) AS bottom",
        "CASE WHEN l_linenumber <> 2 THEN 8 + CAST(l_tax * 100 AS INT) END AS size",
    ]),
    "v_batch_tasks": ("lineitem", [
        "l_orderkey AS batch_id",
        "concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) AS task_id",
        "CASE WHEN l_linestatus = 'O' AND l_returnflag = 'N' THEN 'processing'"
        " WHEN l_returnflag = 'R' THEN 'failed' ELSE 'completed' END AS status",
        "l_discount * 10 AS fraction", "l_quantity AS elapsed_s",
    ]),
    "v_batches": ("orders", ["o_orderkey AS batch_id"]),
    "v_requests": ("events", [
        "event_id AS request_id", "event_type AS endpoint", "ts AS end_ts", "value / 10 AS duration_s",
        "CASE WHEN event_id % 9 = 0 THEN 500 WHEN event_id % 11 = 0 THEN 404 ELSE 200 END AS status_code",
        "event_id % 50 <> 7 AS ended", "event_id % 100 = 57 AS raised",
    ]),
    "v_progress": ("events", [
        "event_id AS seq", "user_id AS task_id", "ts",
        "CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'fail'"
        " ELSE 'update' END AS kind",
        "CASE WHEN event_type = 'view' THEN CAST(floor(value) AS INT) END AS percent",
        "CAST(event_id % 6 AS INT) AS step_index", "5 AS total_steps",
    ]),
    "v_task_state": ("events", [
        "event_id AS task_id",
        "CASE event_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'processing' WHEN 2 THEN 'completed'"
        " ELSE 'failed' END AS status",
        "CAST(event_id % 101 AS INT) AS progress_percent",
        "CASE WHEN event_id % 13 <> 0 THEN CAST(event_id * 60 AS DOUBLE) END AS start_s",
        "CASE WHEN event_id % 4 >= 2 THEN CAST(event_id * 60 + event_id % 600 AS DOUBLE) END AS end_s",
        "event_id % 101 / 100.0 AS fraction",
    ]),
    "v_logs": ("events", [
        "event_id AS log_id", "ts", "user_id",
        "CASE event_id % 5 WHEN 0 THEN 'ERROR' WHEN 1 THEN 'DEBUG' WHEN 2 THEN 'WARNING' ELSE 'INFO' END AS level",
        "CASE event_id % 4 WHEN 0 THEN 'app.conversion' WHEN 1 THEN 'app.ai_service' WHEN 2 THEN 'app.error'"
        " ELSE 'app.files' END AS logger",
        "CASE event_id % 3 WHEN 0 THEN 'Conversion failed' ELSE 'ok' END AS message",
        "CASE WHEN event_id % 2 = 0 THEN value / 10 END AS processing_time",
        "CASE event_id % 3 WHEN 0 THEN 'conversion' WHEN 1 THEN 'ai' ELSE 'other' END AS operation",
    ]),
    # start and end records of an operation: three records out of four pair up
    "v_op_logs": ("events", [
        "CAST(floor(event_id / 2) AS BIGINT) AS operation_id", "ts",
        "CASE WHEN event_id % 2 = 0 THEN 'start' WHEN event_id % 10 = 3 THEN 'error'"
        " WHEN event_id % 8 = 5 THEN 'note' ELSE 'end' END AS event",
        "concat('op_', CAST(floor(event_id / 2) AS BIGINT) % 7) AS operation",
        "CASE WHEN event_id % 10 = 3 THEN 'TimeoutError' END AS error_type",
    ]),
    "v_json_logs": ("events", [
        "event_id AS line_no",
        "CASE WHEN event_id % 20 = 0 THEN concat('broken ', props) ELSE concat('{\"timestamp\": \"',"
        " substring(CAST(ts AS VARCHAR(40)), 1, 10), 'T00:00:00Z\", \"level\": \"INFO\", \"logger\": \"app.',"
        " event_type, '\", \"message\": \"m', event_id, '\", \"module\": \"m\", \"function\": \"f\", \"line\": ',"
        " event_id % 500, CASE WHEN event_id % 3 = 0 THEN concat(', \"task_id\": \"t', user_id, '\"') ELSE '' END,"
        " CASE WHEN event_id % 4 = 0 THEN concat(', \"duration\": ', event_id % 90) ELSE '' END, '}') END AS line",
    ]),
    "v_messages": ("events", [
        "event_id AS message_id", "user_id AS connection_id",
        "CASE event_id % 6 WHEN 0 THEN '{\"type\": \"ping\"}' WHEN 1 THEN '{\"type\": \"subscribe\"}'"
        " WHEN 2 THEN concat('{\"type\": \"subscribe\", \"task_id\"', props) WHEN 3 THEN '{\"type\": \"hello\"}'"
        " ELSE concat('{\"type\": \"subscribe\", \"task_id\": \"t', user_id % 40, '\"}') END AS line",
    ]),
    "v_errors": ("events", [
        "event_id AS error_id",
        "CASE event_id % 13 WHEN 0 THEN 'ValidationError' WHEN 1 THEN 'ResourceNotFoundError' WHEN 2 THEN"
        " 'SecurityError' WHEN 3 THEN 'FileProcessingError' WHEN 4 THEN 'ConversionTimeoutError' WHEN 5 THEN"
        " 'ConversionError' WHEN 6 THEN 'AIServiceError' WHEN 7 THEN 'ConfigurationError' WHEN 8 THEN"
        " 'FileNotFoundError' WHEN 9 THEN 'PermissionError' WHEN 10 THEN 'ValueError' WHEN 11 THEN"
        " CASE WHEN event_id % 2 = 0 THEN 'BatchConversionError' ELSE 'TimeoutError' END ELSE 'RuntimeError' END"
        " AS exception_type",
        "CASE WHEN event_id % 7 = 0 THEN 'Read Timeout' ELSE 'boom' END AS message",
        "CASE event_id % 5 WHEN 0 THEN 'Conversion of book' WHEN 1 THEN 'AI summary' ELSE 'listing' END AS operation",
        "CASE WHEN event_id % 2 = 0 THEN concat('prov', event_id % 3) END AS provider",
        "concat('field_', event_id % 4) AS field", "event_type AS value",
        "concat('.', event_type) AS source_format", "'pdf' AS target_format", "300 AS timeout_seconds", "concat('type', event_id % 3) AS file_type",
    ]),
    "v_ops": ("events", [
        "event_id AS op_id",
        "CASE event_type WHEN 'purchase' THEN 'conversion' WHEN 'view' THEN 'ai' WHEN 'error' THEN 'error'"
        " ELSE 'other' END AS kind",
        "value / 10 AS duration_s",
    ]),
    "v_stage_events": ("lineitem", [
        "l_orderkey AS task_id",
        "CASE l_linenumber % 5 WHEN 0 THEN 'pdf_analysis' WHEN 1 THEN 'content_extraction' WHEN 2 THEN"
        " 'structure_recognition' WHEN 3 THEN 'ai_enhancement' ELSE 'epub_generation' END AS stage",
        "l_returnflag <> 'N' AS done",
    ]),
    "v_images": ("part", [
        "p_partkey AS image_id", "CAST(floor(p_partkey / 2) AS BIGINT) AS doc_id", "CAST(p_partkey % 7 AS INT) AS page_num",
        "CAST(p_size * 30 AS INT) AS width", "CAST(p_size * 20 AS INT) AS height",
        "CASE WHEN p_size > 25 THEN 'jpeg' ELSE 'png' END AS final_format",
        "CASE p_partkey % 3 WHEN 0 THEN 'fast' WHEN 1 THEN 'standard' ELSE 'high' END AS quality_level",
        "CAST(floor(p_retailprice * 100) AS BIGINT) AS original_size",
        "CAST(floor(p_retailprice * p_size) AS BIGINT) AS final_size",
        "CAST(p_size * 12 AS DOUBLE) AS x0", "CAST(p_size * 15 AS DOUBLE) AS y0",
        "CASE p_partkey % 4 WHEN 0 THEN 'RGB' WHEN 1 THEN 'RGBA' WHEN 2 THEN 'L' ELSE 'P' END AS mode",
        "CASE WHEN p_partkey % 300 <= 256 THEN CAST(p_partkey % 300 AS INT) END AS n_colors",
        "CASE WHEN p_partkey % 2 = 0 THEN 'png' ELSE 'jpeg' END AS original_format",
        "CASE WHEN p_partkey % 6 = 0 THEN concat('Picture ', p_partkey) END AS alt_text",
    ]),
    "v_image_paths": ("part", [
        "p_partkey + CASE WHEN p_partkey % 10 = 0 THEN 90000000 ELSE 0 END AS image_id",
        "concat('/out/', CAST(floor(p_partkey / 2) AS BIGINT), '/', p_partkey, '.', CASE WHEN p_size > 25 THEN 'jpeg' ELSE 'png' END) AS path",
    ]),
    "v_ocr_words": ("lineitem", [
        "l_orderkey AS page_id", "l_partkey AS word_id",
        "CASE WHEN l_linenumber = 5 THEN ' ' ELSE concat('w', l_partkey) END AS word",
        "CAST(floor(l_quantity * 2) AS INT) AS conf",
    ]),
    "v_outline": ("conversations", [
        "conv_id AS doc_id", "turn AS ord", "turn * 3 + 1 AS page", "CAST(1 + turn % 4 AS INT) AS level",
        "CASE WHEN turn % 5 = 3 THEN CAST(turn AS VARCHAR(20)) WHEN turn % 5 = 0 THEN concat('Chapter ', turn + 1)"
        " ELSE text END AS title",
    ]),
    "v_responses": ("conversations", [
        "conv_id AS doc_id", "turn AS ord",
        "concat('Page ', turn % 5 + 1, ': ', CASE WHEN turn % 3 = 0 THEN 'Chapter' ELSE text END,"
        " chr(10), '  page', turn % 40 + 2, ':x', chr(10), chr(10), 'noise') AS response",
    ]),
    "v_history": ("orders", [
        "o_orderkey AS record_id", "o_orderdate AS ts", "o_orderstatus AS status", "o_totalprice AS file_size",
    ]),
    "v_ai_texts": ("documents", [
        "doc_id", "text",
        "CASE doc_id % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE 'gamma' END AS provider",
        "CASE doc_id % 7 WHEN 0 THEN 'improve_readability' WHEN 1 THEN 'fix_grammar' WHEN 2 THEN"
        " 'translate_to_chinese' WHEN 3 THEN 'translate_to_english' WHEN 4 THEN 'format_content' ELSE 'rhyme' END"
        " AS enhancement_type",
    ]),
    "v_ai_results": ("documents", [
        "doc_id", "n_chars AS original_length", "doc_id % 6 <> 0 AS success",
        "CASE WHEN doc_id % 6 <> 0 THEN replace(text, ' ', '') END AS content",
        "CASE doc_id % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE 'gamma' END AS provider",
        "concat('model-', doc_id % 2) AS model", "doc_id % 40 / 8.0 AS processing_time",
        "CASE WHEN doc_id % 2 = 0 THEN 'summary' ELSE 'enhance' END AS operation",
        "doc_id % 90 AS prompt_tokens", "doc_id % 70 AS completion_tokens",
    ]),
    "v_ai_cache": ("documents", [
        "md5(concat(text, ':', 'alpha')) AS cache_key", "concat('cached ', doc_id) AS content", "doc_id",
    ]),
    "v_selection": ("documents", ["doc_id AS file_id"]),
    # raw bytes as UTF-8, GBK tail on ASCII text, or a stray byte
    "v_raw_texts": ("documents", [
        "doc_id", "text",
        "CASE WHEN doc_id % 4 = 1 AND length(text) * 8 = bit_length(text) THEN 'gbk'"
        " WHEN doc_id % 2 = 0 THEN 'broken' ELSE 'utf8' END AS kind",
    ]),
    # layout summary of a page
    "v_toc": ("conversations", [
        "conv_id AS doc_id", "turn AS ord",
        "CASE WHEN turn % 4 = 3 THEN 'note' ELSE 'chapter' END AS type",
        "CASE WHEN turn % 3 = 0 THEN 'Chapter 1' ELSE text END AS title",
    ]),
    "v_page_texts": ("conversations", [
        "conv_id AS doc_id", "turn AS page_num",
        "CASE WHEN turn % 4 = 2 THEN '   ' ELSE text END AS text",
        "CASE WHEN turn % 3 <> 1 THEN concat('ocr ', text) END AS ocr_text",
    ]),
    # one output line of an external converter
    "v_engine_log": ("events", [
        "user_id AS run_id", "event_id AS line_no",
        "CASE event_type WHEN 'view' THEN concat('Rendered ', event_id % 300, ' pages') WHEN 'click' THEN"
        " 'Extracting Image' WHEN 'signup' THEN 'Building TOC' WHEN 'purchase' THEN 'Reading metadata' ELSE"
        " 'WARN: font missing' END AS line",
    ]),
}

BLOCKS_DUCK = (
    "SELECT doc_id, block_id, CAST(floor(block_id / 5) AS INT) AS page_num,"
    " CAST(72 + (block_id % 5) * 60 AS DOUBLE) AS y0, CAST(40 + (block_id % 3) * 90 AS DOUBLE) AS x0,"
    " CAST(10 + (length(line) * 7 + block_id) % 13 AS DOUBLE) AS font_size,"
    " (length(line) + block_id) % 2 = 0 AS is_bold,"
    " CASE WHEN block_id % 5 = 0 AND doc_id % 2 = 0 THEN concat('Chapter ', CAST(floor(block_id / 10) AS INT) + 1)"
    " ELSE line END AS text"
    " FROM (SELECT doc_id, CAST(i - 1 AS BIGINT) AS block_id, ls[i] AS line FROM"
    " (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents) d, unnest(range(1, len(ls) + 1)) AS u(i)) t"
)

# data cells of a page table: a row of cells per order line, some rows blank
TABLES_DUCK = (
    "SELECT l_orderkey AS page_id, list([CASE WHEN l_linenumber % 3 = 0 THEN ' ' ELSE l_returnflag END,"
    " CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE l_linestatus END] ORDER BY l_linenumber, l_partkey, l_suppkey)"
    " AS cells FROM lineitem GROUP BY l_orderkey"
)


class Tables:
    """The given tables and the views over them, as DataFrames: ``t.documents``, ``t.v_files``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = prepare(spark)
        self.dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name == "v_blocks":
            return self._blocks()
        if name == "v_tables":
            return self._tables()
        if name in VIEWS:
            source, exprs = VIEWS[name]
            return getattr(self, source).selectExpr(*exprs)
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def _blocks(self) -> DataFrame:
        lines = self.documents.select(
            "doc_id", F.posexplode(F.split("text", "\n")).alias("block_id", "line")
        ).withColumn("block_id", F.col("block_id").cast("bigint"))
        b = F.col("block_id")
        return lines.select(
            "doc_id",
            "block_id",
            F.floor(b / 5).cast("int").alias("page_num"),
            (72 + (b % 5) * 60).cast("double").alias("y0"),
            (40 + (b % 3) * 90).cast("double").alias("x0"),
            (10 + (F.length("line") * 7 + b) % 13).cast("double").alias("font_size"),
            ((F.length("line") + b) % 2 == 0).alias("is_bold"),
            F.when(
                (b % 5 == 0) & (F.col("doc_id") % 2 == 0),
                F.concat(F.lit("Chapter "), F.floor(b / 10).cast("int") + 1),
            )
            .otherwise(F.col("line"))
            .alias("text"),
        )

    def _tables(self) -> DataFrame:
        blank = F.col("l_linenumber") % 3 == 0
        cells = F.array(
            F.when(blank, " ").otherwise(F.col("l_returnflag")),
            F.when(blank, "").otherwise(F.col("l_linestatus")),
        )
        row = F.struct("l_linenumber", "l_partkey", "l_suppkey", cells.alias("cells"))
        return (
            self.lineitem.groupBy(F.col("l_orderkey").alias("page_id"))
            .agg(F.sort_array(F.collect_list(row)).alias("rows"))
            .select("page_id", F.transform("rows", lambda r: r["cells"]).alias("cells"))
        )


def duck_view(name: str) -> str:
    if name == "v_blocks":
        return BLOCKS_DUCK
    if name == "v_tables":
        return TABLES_DUCK
    source, exprs = VIEWS[name]
    return f"SELECT {', '.join(exprs)} FROM {source}"


def check_sql(views: str, final: str, **steps: str) -> str:
    """SQL over the given tables: views as CTEs, then the named steps, then ``final``."""
    ctes = [f"{v} AS ({duck_view(v)})" for v in views.split()]
    ctes += [f"{name} AS ({body})" for name, body in steps.items()]
    return f"WITH RECURSIVE {', '.join(ctes)} {final}" if ctes else final
