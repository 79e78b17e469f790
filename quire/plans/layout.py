"""Layout family."""

from pyspark.sql import functions as F

from quire.operators import layout as ops
from quire.plans.registry import query
from quire.sources.views import check_sql


def column_steps(view):
    return {
        "g": f"SELECT page_id, x0, x1, CASE WHEN x0 - lag(x0) OVER (PARTITION BY page_id ORDER BY x0) > 20 THEN 1 ELSE 0 END AS brk FROM {view}",
        "i": "SELECT page_id, x0, x1, sum(brk) OVER (PARTITION BY page_id ORDER BY x0 RANGE UNBOUNDED PRECEDING) AS column_number FROM g",
        "cols": "SELECT page_id, CAST(column_number AS BIGINT) AS column_number, min(x0) AS x_start, max(x1) AS x_end FROM i GROUP BY 1, 2",
    }


def line_steps(view):
    return {
        "tops": f"SELECT page_id, top, row_number() OVER (PARTITION BY page_id ORDER BY top) AS rn FROM (SELECT DISTINCT page_id, top FROM {view})",
        "scan(page_id, top, rn, anchor)": """SELECT page_id, top, rn, top FROM tops WHERE rn = 1 UNION ALL
            SELECT t.page_id, t.top, t.rn, CASE WHEN t.top - s.anchor > 5 THEN t.top ELSE s.anchor END FROM scan s JOIN tops t ON t.page_id = s.page_id AND t.rn = s.rn + 1""",
        "lines": "SELECT page_id, top, dense_rank() OVER (PARTITION BY page_id ORDER BY anchor) - 1 AS line_number FROM scan",
    }


PLACED = {
    **column_steps("v_dense_words"), **line_steps("v_dense_words"),
    "pl": """SELECT w.*, l.line_number, (SELECT min(c.column_number) FROM cols c WHERE c.page_id = w.page_id AND w.x0 BETWEEN c.x_start AND c.x_end) AS column_number
        FROM v_dense_words w JOIN lines l ON l.page_id = w.page_id AND l.top = w.top""",
}
STATS = {
    "gaps": """SELECT *, x0 - lag(x0) OVER (PARTITION BY page_id, line_number, column_number ORDER BY x0) AS gap FROM pl WHERE column_number IS NOT NULL""",
    "st": """SELECT page_id, line_number, column_number, count(*) AS n_words, avg(coalesce(size, 12)) AS mean_size, min(x0) AS x0, min(top) AS y0, max(x1) AS x1, max(bottom) AS y1,
        avg(gap) AS mean_gap, stddev_pop(gap) AS sd, string_agg(text, ' ' ORDER BY x0, top, word_id) AS text FROM gaps GROUP BY 1, 2, 3""",
    "ty": """SELECT *, CASE WHEN mean_size > 14 THEN 'heading' WHEN n_words > 3 AND sd < mean_gap * 0.3 THEN 'table' ELSE 'text' END AS region_type FROM st""",
}


def recursive(views, final, **steps):
    return check_sql(views, final, **steps)


@query("detect_columns", check_sql("v_words", "SELECT page_id, column_number, x_start, x_end, round(x_end - x_start, 6) AS width FROM cols", **column_steps("v_words")))
def detect_columns(t):
    return ops.detect_columns(t.v_words).withColumn("width", F.round("width", 6))


@query("word_to_column", check_sql(
    "v_words",
    """SELECT page_id, word_id, top, (SELECT min(c.column_number) FROM cols c WHERE c.page_id = w.page_id AND w.x0 BETWEEN c.x_start AND c.x_end) AS column_number FROM v_words w""",
    **column_steps("v_words")))
def word_to_column(t):
    return ops.word_to_column(t.v_words, ops.detect_columns(t.v_words)).select("page_id", "word_id", "top", "column_number")


@query("group_lines", recursive("v_words", "SELECT w.page_id, w.word_id, w.top, l.line_number FROM v_words w JOIN lines l ON l.page_id = w.page_id AND l.top = w.top", **line_steps("v_words")))
def group_lines(t):
    return ops.group_lines(t.v_words).select("page_id", "word_id", "top", "line_number")


@query("region_type", recursive("v_dense_words", "SELECT page_id, line_number, column_number, n_words, round(mean_size, 6) AS mean_size, region_type FROM ty", **PLACED, **STATS))
def region_type(t):
    kinds = ops.region_type(ops.region_stats(ops.place_words(t.v_dense_words)))
    return kinds.select(*ops.REGION, "n_words", F.round("mean_size", 6).alias("mean_size"), "region_type")


@query("line_regions", recursive(
    "v_dense_words",
    """SELECT page_id, line_number, column_number, 0 AS part, text, x0, y0, x1, y1, x1 - x0 AS width, y1 - y0 AS height, n_words, region_type FROM ty""", **PLACED, **STATS))
def line_regions(t):
    return ops.line_regions(ops.place_words(t.v_dense_words)).drop("mean_size", "n_columns")


@query("reading_order", recursive(
    "v_dense_words",
    """SELECT page_id, line_number, column_number, text, row_number() OVER (PARTITION BY page_id ORDER BY CASE WHEN n > 1 THEN column_number END, y0, x0, line_number) - 1 AS reading_order
    FROM (SELECT ty.*, (SELECT count(*) FROM cols c WHERE c.page_id = ty.page_id) AS n FROM ty)""", **PLACED, **STATS))
def reading_order(t):
    regions = ops.line_regions(ops.place_words(t.v_dense_words))
    return ops.reading_order(regions).select(*ops.REGION, "text", "reading_order")


PROFILE = {
    **column_steps("v_dense_words"),
    "wide": "SELECT page_id, count(*) AS n_columns FROM cols GROUP BY page_id",
    "held": """SELECT CAST(floor(page_id / 8) AS BIGINT) + 5 AS page_id, count(*) AS n_tables FROM v_tables
        WHERE len(list_filter(cells, lambda r: len(list_filter(r, lambda c: trim(c) <> '')) > 0)) >= 2 GROUP BY 1""",
    "profile": """SELECT coalesce(w.page_id, h.page_id) // 16 AS doc_id, coalesce(n_columns, 0) AS n_columns, coalesce(n_tables, 0) AS n_tables
        FROM wide w FULL OUTER JOIN held h ON h.page_id = w.page_id""",
}


@query("structure_analysis", check_sql(
    "v_dense_words v_tables",
    """SELECT doc_id, count(*) AS total_pages, count_if(n_columns > 1) AS multi_column_pages, count_if(n_columns <= 1) AS single_column_pages, count_if(n_tables > 0) AS pages_with_tables,
    CAST(sum(n_tables) AS BIGINT) AS total_tables, round(avg(n_columns), 6) AS average_columns, count(DISTINCT n_columns) <= 2 AS column_consistency FROM profile GROUP BY doc_id""", **PROFILE))
def structure_analysis(t):
    """Detected columns and filtered tables, whose pages overlap but differ, profiled per document of sixteen pages."""
    place = (F.floor(F.col("page_id") / 8) + 5).cast("bigint")
    tables = ops.table_rows_filter(t.v_tables).withColumn("page_id", place)
    pages = ops.page_profile(ops.detect_columns(t.v_dense_words), tables)
    return ops.structure_analysis(pages.withColumn("doc_id", F.floor(F.col("page_id") / 16).cast("bigint")))


@query("table_rows_filter", check_sql(
    "v_tables",
    """SELECT page_id, len(k) AS n_rows, len(k[1]) AS n_columns, list_aggregate(flatten(k), 'string_agg', '|') AS flat
    FROM (SELECT page_id, list_filter(cells, lambda r: len(list_filter(r, lambda c: trim(c) <> '')) > 0) AS k FROM v_tables) WHERE len(k) >= 2"""))
def table_rows_filter(t):
    return ops.table_rows_filter(t.v_tables).select(
        "page_id", "n_rows", "n_columns", F.array_join(F.flatten("cells"), "|").alias("flat")
    )
