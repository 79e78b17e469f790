"""Chapter structure family."""

from pyspark.sql import functions as F

from quire.operators import structure as ops
from quire.operators.pages import page_summary, saved
from quire.operators.text import render_chapter_html
from quire.plans import sql as S
from quire.plans.registry import query
from quire.plans.text import _HEAD, _TAIL, _esc
from quire.sources.views import check_sql

_T = S.ustrip("title")
OUTLINE = f"""SELECT doc_id, page - 1 AS page_num, title, greatest(0.0, least(100.0, 90.0 + CASE WHEN regexp_matches(title, '(?i)^(Chapter|第|章|Part|部分|Section|节)\\s*\\d+') THEN 5 ELSE 0 END
    - CASE WHEN length(title) < 5 THEN 10 ELSE 0 END - CASE WHEN level > 2 THEN 5 ELSE 0 END)) AS confidence, 'bookmark' AS method, level, ord AS seq
    FROM (SELECT * REPLACE ({_T} AS title) FROM v_outline) WHERE length(title) >= 2 AND NOT regexp_matches(title, '^\\d+$')"""
FONT_STATS = """SELECT doc_id, avg(font_size) FILTER (font_size > 0) AS avg_size, max(font_size) FILTER (font_size > 0) AS max_size,
    avg(font_size) FILTER (font_size > 0) + (max(font_size) FILTER (font_size > 0) - avg(font_size) FILTER (font_size > 0)) * 0.3 AS threshold FROM v_blocks GROUP BY doc_id"""
FONT = f"""SELECT doc_id, CAST(page_num AS BIGINT) AS page_num, {S.ustrip('text')} AS title, greatest(0, least(100, 50 + CASE WHEN max_size > avg_size THEN (font_size - avg_size) / (max_size - avg_size) ELSE 0 END * 40 + 10)) AS confidence,
    'font_analysis' AS method, 1 AS level, block_id AS seq FROM (SELECT b.*, avg_size, max_size, row_number() OVER (PARTITION BY b.doc_id, page_num ORDER BY font_size DESC, block_id) AS rn
    FROM v_blocks b JOIN fs ON fs.doc_id = b.doc_id WHERE font_size >= threshold AND is_bold AND length({S.ustrip('text')}) > 2 AND {S.heading('text')}) WHERE rn = 1"""
TOPS = f"""SELECT doc_id, CAST(page_num AS BIGINT) AS page_num, {S.ustrip('text')} AS title, 60.0 AS confidence, 'page_pattern' AS method, 1 AS level, CAST(page_num AS BIGINT) AS seq FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id, page_num ORDER BY font_size DESC, block_id) AS rn FROM v_blocks WHERE y0 < 200)
    WHERE rn = 1 AND font_size > 14 AND {S.heading('text')}"""
HEADS = "SELECT doc_id, CAST(page_num AS BIGINT) AS page_num, substring(string_agg(text, ' ' ORDER BY block_id), 1, 100) AS head FROM v_blocks GROUP BY doc_id, page_num"
AI = f"""SELECT doc_id, page_num, title, 70.0 AS confidence, 'ai_analysis' AS method, 1 AS level, seq FROM (SELECT p.doc_id, p.page_num, CASE WHEN length(t) < 3 OR lower(t) IN ('chapter', 'section', 'part')
    THEN {S.ustrip("split_part(head, '.', 1)")} ELSE t END AS title, seq FROM (SELECT doc_id, CAST(regexp_extract(line, '(?i)^Page\\s*(\\d+):\\s*(.+)', 1) AS BIGINT) - 1 AS page_num,
    {S.ustrip("regexp_extract(line, '(?i)^Page\\s*(\\d+):\\s*(.+)', 2)")} AS t, ord * 1000000 + i - 1 AS seq FROM (SELECT doc_id, ord, i, {S.ustrip('ls[i]')} AS line FROM (SELECT doc_id, ord,
    string_split(response, chr(10)) AS ls FROM v_responses), unnest(range(1, len(ls) + 1)) AS u(i)) WHERE regexp_matches(line, '(?i)^Page\\s*(\\d+):\\s*(.+)')) p
    JOIN heads h ON h.doc_id = p.doc_id AND h.page_num = p.page_num) WHERE length(title) > 2"""
COLS = "doc_id, page_num, title, round(CAST(confidence AS DOUBLE), 6) AS confidence, method, level, seq"
DETECTORS = {"fs": FONT_STATS, "ol": OUTLINE, "fo": FONT, "tp": TOPS, "heads": HEADS, "ai": AI}


def _show(df):
    return df.select("doc_id", "page_num", "title", F.round("confidence", 6).alias("confidence"), "method", "level", "seq")


@query("outline_filter", check_sql("v_outline", f"SELECT {COLS} FROM ol", ol=OUTLINE))
def outline_filter(t):
    return _show(ops.outline_filter(t.v_outline))


@query("font_stats", check_sql("v_blocks", "SELECT doc_id, round(avg_size, 6) AS avg_size, max_size, round(threshold, 6) AS threshold FROM fs", fs=FONT_STATS))
def font_stats(t):
    return ops.font_stats(t.v_blocks).select(
        "doc_id", F.round("avg_size", 6).alias("avg_size"), "max_size", F.round("threshold", 6).alias("threshold")
    )


@query("font_headings", check_sql("v_blocks", f"SELECT {COLS} FROM fo", fs=FONT_STATS, fo=FONT))
def font_headings(t):
    return _show(ops.font_headings(t.v_blocks, ops.font_stats(t.v_blocks)))


@query("page_top_headings", check_sql("v_blocks", f"SELECT {COLS} FROM tp", tp=TOPS))
def page_top_headings(t):
    return _show(ops.page_top_headings(t.v_blocks))


@query("ai_chapter_verify", check_sql("v_blocks v_responses", f"SELECT {COLS} FROM ai", heads=HEADS, ai=AI))
def ai_chapter_verify(t):
    return _show(ops.ai_chapter_verify(t.v_responses, ops.page_heads(t.v_blocks)))


def _pages(t):
    """Page summaries: the blocks are read once for all detectors."""
    return saved(page_summary(t.v_blocks), "pages")


def _candidates(t, pages=None):
    pages = _pages(t) if pages is None else pages
    heads = pages.select("doc_id", F.col("page_num").cast("bigint").alias("page_num"), F.col("start").alias("head"))
    return ops.merge_candidates(
        ops.outline_filter(t.v_outline), *ops.candidates_of_pages(pages), ops.ai_chapter_verify(t.v_responses, heads),
    )


MERGED = """SELECT *, 0 AS priority FROM ol UNION ALL SELECT *, 1 FROM fo UNION ALL SELECT *, 2 FROM tp UNION ALL SELECT *, 3 FROM ai"""
VIEWS = "v_blocks v_outline v_responses"


@query("merge_candidates", check_sql(VIEWS, f"SELECT {COLS}, priority FROM mc", **DETECTORS, mc=MERGED))
def merge_candidates(t):
    return _candidates(t).withColumn("confidence", F.round("confidence", 6))


@query("detector_counts", check_sql(
    VIEWS,
    """SELECT d.doc_id, count_if(method = 'bookmark') AS bookmark_count, count_if(method = 'font_analysis') AS font_analysis_count, count_if(method = 'page_pattern') AS page_pattern_count,
    count_if(method = 'ai_analysis') AS ai_analysis_count, array_to_string(list_filter([CASE WHEN count_if(method = 'bookmark') > 0 THEN 'bookmark' END, CASE WHEN count_if(method = 'font_analysis') > 0 THEN 'font_analysis' END,
    CASE WHEN count_if(method = 'page_pattern') > 0 THEN 'page_pattern' END, CASE WHEN count_if(method = 'ai_analysis') > 0 THEN 'ai_analysis' END], lambda x: x IS NOT NULL), ',') AS methods_used
    FROM documents d LEFT JOIN (SELECT doc_id, method FROM mc UNION ALL SELECT doc_id, '' FROM documents) m ON m.doc_id = d.doc_id GROUP BY d.doc_id""", **DETECTORS, mc=MERGED))
def detector_counts(t):
    counts = ops.detector_counts(t.documents, _candidates(t))
    return counts.withColumn("methods_used", F.array_join("methods_used", ","))


_SAME = """(CASE WHEN x.w = c.w THEN 1.0 ELSE len(list_intersect(x.w, c.w)) / (len(x.w) + len(c.w) - len(list_intersect(x.w, c.w))) END)"""


def _walk(rows: str, name: str, order: str, clash: str, kept: str) -> dict[str, str]:
    """Steps of greedy selection: candidates numbered per document, then one after the other with the list of those kept."""
    return {
        f"{name}_n": f"SELECT *, {S.title_words('title')} AS w, {S.title_words(S.clean_title('title'))} AS cw,"
        f" row_number() OVER (PARTITION BY doc_id ORDER BY {order}) AS n FROM {rows}",
        f"{name}_w": f"SELECT doc_id, n, true AS k, [{kept}] AS kept FROM {name}_n c WHERE n = 1 UNION ALL"
        f" SELECT doc_id, n, k, CASE WHEN k THEN list_append(kept, {kept}) ELSE kept END FROM ("
        f" SELECT c.*, kept, {clash} AS k FROM {name}_w v JOIN {name}_n c ON c.doc_id = v.doc_id AND c.n = v.n + 1) c",
        name: f"SELECT doc_id, page_num, title, confidence, method, level, seq, priority FROM {name}_n JOIN (SELECT doc_id, n, k FROM {name}_w) USING (doc_id, n) WHERE k",
    }


def _conflict_steps(rows: str) -> dict[str, str]:
    return _walk(
        rows, "kc", "priority, seq, page_num, title",
        f"(c.priority = 0 OR len(list_filter(kept, lambda x: abs(x.p - c.page_num) <= 2 AND {_SAME} >= 0.8)) = 0)",
        "{'p': c.page_num, 'w': c.w}",
    )


def _title_steps(rows: str) -> dict[str, str]:
    return _walk(
        rows, "kt", "page_num, priority, seq, title",
        f"(len(list_filter(kept, lambda x: {_SAME} >= 0.9)) = 0)", "{'w': c.cw}",
    )


CHAPTER_COLS = f"doc_id, page_num, {S.clean_title('title')} AS title, round(CAST(confidence AS DOUBLE), 6) AS confidence, method, level, seq, priority"
MERGE_STEPS = {**DETECTORS, "mc": MERGED}
CHAPTER_STEPS = {**MERGE_STEPS, **_conflict_steps("mc"), **_title_steps("kc")}


@query("chapter_conflicts", check_sql(VIEWS, f"SELECT {COLS}, priority FROM kc", **MERGE_STEPS, **_conflict_steps("mc")))
def chapter_conflicts(t):
    return ops.chapter_conflicts(_candidates(t)).withColumn("confidence", F.round("confidence", 6))


@query("dedupe_titles", check_sql(VIEWS, f"SELECT {CHAPTER_COLS} FROM kt", **MERGE_STEPS, **_title_steps("mc")))
def dedupe_titles(t):
    return ops.dedupe_titles(_candidates(t)).withColumn("confidence", F.round("confidence", 6))


def _chapters(t):
    return ops.dedupe_titles(ops.chapter_conflicts(_candidates(t)))


@query("detect_chapters", check_sql(VIEWS, f"SELECT {CHAPTER_COLS} FROM kt", **CHAPTER_STEPS))
def detect_chapters(t):
    return _chapters(t).withColumn("confidence", F.round("confidence", 6))


@query("title_similarity_join", check_sql(
    VIEWS,
    """SELECT a_id, b_id, round(c / (a.k + b.k - c), 6) AS similarity, a.n AS n_a, b.n AS n_b FROM (
    SELECT x.id AS a_id, y.id AS b_id, count(*) AS c FROM tok x JOIN tok y ON x.w = y.w AND x.id < y.id GROUP BY 1, 2) p
    JOIN s a ON a.id = a_id JOIN s b ON b.id = b_id WHERE c / (a.k + b.k - c) >= 0.5""", **DETECTORS, mc=MERGED,
    s=f"SELECT array_to_string(w, ' ') AS id, w, len(w) AS k, sum(n)::BIGINT AS n FROM (SELECT {S.title_words('title')} AS w, count(*) AS n FROM mc GROUP BY 1) GROUP BY 1, 2, 3",
    tok="SELECT id, unnest(w) AS w FROM s"))
def title_similarity_join(t):
    """Titles of all detected candidates."""
    return ops.title_similarity_join(_candidates(t).select("title"), 0.5).withColumn("similarity", F.round("similarity", 6))


# boundaries for the range jobs: outline entries and font headings
BOUNDS = "SELECT doc_id, page_num, title, level, seq, 1 AS priority FROM fo UNION ALL SELECT doc_id, page_num, title, level, seq, 0 FROM ol"
RANGES = """SELECT doc_id, chapter_no, title, level, page_num AS start_page, coalesce(nxt - 1, last_page) AS end_page FROM (SELECT b.*, m.last_page,
    row_number() OVER (PARTITION BY b.doc_id ORDER BY page_num, priority, seq) AS chapter_no, lead(page_num) OVER (PARTITION BY b.doc_id ORDER BY page_num, priority, seq) AS nxt
    FROM bo b JOIN (SELECT doc_id, max(page_num) AS last_page FROM v_blocks GROUP BY doc_id) m ON m.doc_id = b.doc_id)"""
RANGE_STEPS = {"fs": FONT_STATS, "ol": OUTLINE, "fo": FONT, "bo": BOUNDS, "ra": RANGES}


def _bounds(t):
    blocks = t.v_blocks
    found = ops.merge_candidates(ops.outline_filter(t.v_outline), ops.font_headings(blocks, ops.font_stats(blocks)))
    return found.select("doc_id", "page_num", "title", "level", "seq", "priority")


@query("chapter_ranges", check_sql("v_blocks v_outline", "SELECT doc_id, chapter_no, title, start_page, end_page FROM ra", **RANGE_STEPS))
def chapter_ranges(t):
    return ops.chapter_ranges(_bounds(t), t.v_blocks).select("doc_id", "chapter_no", "title", "start_page", "end_page")


@query("chapter_content", check_sql(
    "v_blocks v_outline",
    """SELECT r.doc_id, r.chapter_no, 0 AS part, printf('chapter_%03d', r.chapter_no) AS chapter_id, r.title, coalesce(string_agg(b.text, ' ' ORDER BY b.page_num, b.block_id), '') AS content,
    printf('chapter_%03d.xhtml', r.chapter_no) AS file_name, r.level, r.start_page, r.end_page FROM ra r LEFT JOIN v_blocks b ON b.doc_id = r.doc_id AND b.page_num BETWEEN r.start_page AND r.end_page
    GROUP BY r.doc_id, r.chapter_no, r.title, r.level, r.start_page, r.end_page""", **RANGE_STEPS))
def chapter_content(t):
    return ops.chapter_content(ops.chapter_ranges(_bounds(t), t.v_blocks), t.v_blocks)


@query("whole_document_chapter", check_sql(
    "v_blocks v_outline v_meta",
    """SELECT b.doc_id, 0 AS part, 'chapter_001' AS chapter_id, coalesce(any_value(m.title), 'Document') AS title, string_agg(text, ' ' ORDER BY page_num, block_id) AS content, 'chapter_001.xhtml' AS file_name
    FROM v_blocks b LEFT JOIN v_meta m ON m.doc_id = b.doc_id WHERE b.doc_id NOT IN (SELECT doc_id FROM bo) GROUP BY b.doc_id""", **RANGE_STEPS))
def whole_document_chapter(t):
    return ops.whole_document_chapter(t.v_blocks, _bounds(t), t.v_meta.select("doc_id", "title"))


# from blocks to chapters with their text: every detector, merging, ranges, content
BOOK_RANGES = RANGES.replace("FROM bo b", "FROM kt2 b")


@query("book_chapters", check_sql(
    VIEWS,
    """SELECT r.doc_id, r.chapter_no, 0 AS part, printf('chapter_%03d', r.chapter_no) AS chapter_id, r.title, coalesce(string_agg(b.text, ' ' ORDER BY b.page_num, b.block_id), '') AS content,
    printf('chapter_%03d.xhtml', r.chapter_no) AS file_name, r.level, r.start_page, r.end_page FROM ra r LEFT JOIN v_blocks b ON b.doc_id = r.doc_id AND b.page_num BETWEEN r.start_page AND r.end_page
    GROUP BY r.doc_id, r.chapter_no, r.title, r.level, r.start_page, r.end_page""",
    **CHAPTER_STEPS, kt2=f"SELECT * REPLACE ({S.clean_title('title')} AS title) FROM kt", ra=BOOK_RANGES))
def book_chapters(t):
    """The whole chain: detected chapters, their ranges, their content."""
    return ops.chapter_content(ops.chapter_ranges(_chapters(t), t.v_blocks), t.v_blocks)


@query("book_html", check_sql(
    VIEWS,
    f"""SELECT doc_id, chapter_no, 0 AS part, file_name, concat('{_HEAD[0]}', {_esc('title')}, '{_HEAD[1]}', {_esc('title')}, '{_HEAD[2]}', '<p>', {_esc('content')}, '</p>', '{_TAIL}') AS html
    FROM (SELECT r.doc_id, r.chapter_no, r.title, coalesce(string_agg(b.text, ' ' ORDER BY b.page_num, b.block_id), '') AS content, printf('chapter_%03d.xhtml', r.chapter_no) AS file_name
    FROM ra r LEFT JOIN v_blocks b ON b.doc_id = r.doc_id AND b.page_num BETWEEN r.start_page AND r.end_page GROUP BY r.doc_id, r.chapter_no, r.title)""",
    **CHAPTER_STEPS, kt2=f"SELECT * REPLACE ({S.clean_title('title')} AS title) FROM kt", ra=BOOK_RANGES))
def book_html(t):
    """The chain to its end: the detected chapters as pages of the book."""
    chapters = ops.chapter_content(ops.chapter_ranges(_chapters(t), t.v_blocks), t.v_blocks)
    pages = render_chapter_html(chapters.withColumn("has_images", F.lit(False)))
    return pages.select("doc_id", "chapter_no", "part", "file_name", "html")


CONFIDENCE = """SELECT d.doc_id, count(m.doc_id) AS n_chapters, round(CAST(coalesce(sum(confidence * w) / sum(w), 0) AS DOUBLE), 6) AS total_confidence FROM documents d
    LEFT JOIN (SELECT *, CASE method WHEN 'bookmark' THEN 1.0 WHEN 'font_analysis' THEN 0.8 WHEN 'page_pattern' THEN 0.6 WHEN 'ai_analysis' THEN 0.7 ELSE 0.5 END::DOUBLE AS w FROM mc) m
    ON m.doc_id = d.doc_id GROUP BY d.doc_id"""


@query("structure_confidence", check_sql(VIEWS, CONFIDENCE, **DETECTORS, mc=MERGED))
def structure_confidence(t):
    return ops.structure_confidence(t.documents, _candidates(t))


@query("sample_first_pages", check_sql(
    "v_blocks",
    """SELECT doc_id, string_agg(concat('Page ', page_num + 1, ':', chr(10), substring(tx, 1, 200), '...', chr(10), chr(10)), '' ORDER BY page_num) AS sample FROM (
    SELECT doc_id, page_num, string_agg(text, ' ' ORDER BY block_id) AS tx, row_number() OVER (PARTITION BY doc_id ORDER BY page_num) AS rn FROM v_blocks GROUP BY doc_id, page_num)
    WHERE rn <= 20 GROUP BY doc_id HAVING count(*) >= 3"""))
def sample_first_pages(t):
    return ops.sample_first_pages(t.v_blocks)


@query("toc_match", check_sql(
    "v_toc v_outline",
    """SELECT t.doc_id, t.ord, t.title, c.chapter_no FROM v_toc t JOIN (SELECT doc_id, title, min(ord) AS chapter_no FROM v_outline GROUP BY 1, 2) c ON c.doc_id = t.doc_id AND c.title = t.title
    WHERE t.type = 'chapter'"""))
def toc_match(t):
    return ops.toc_match(t.v_toc, t.v_outline.withColumnRenamed("ord", "chapter_no"))
