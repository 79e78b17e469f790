"""Quality, routing, image and metadata family."""

from pyspark.sql import functions as F

from quire.operators import quality as ops, structure, text as textops
from quire.plans.registry import query
from quire.plans.structure import CHAPTER_STEPS, CONFIDENCE, DETECTORS, MERGED, _candidates, _pages
from quire.sources.views import check_sql

SCAN = """SELECT m.doc_id, CASE WHEN page_count = 0 THEN 1.0 WHEN c / page_count < 50 THEN 0.9 WHEN c / page_count < 100 THEN 0.6 WHEN c / page_count < 200 THEN 0.3 ELSE 0.1 END::DOUBLE AS scan_probability
    FROM (SELECT m.doc_id, m.page_count, coalesce(b.c, 0) AS c FROM v_meta m LEFT JOIN (SELECT doc_id, sum(length(text)) AS c FROM v_blocks GROUP BY 1) b ON b.doc_id = m.doc_id) m"""
NEED = """SELECT d.doc_id, coalesce(m < 50, true) AS ocr_needed FROM documents d LEFT JOIN (SELECT doc_id, avg(length(text)) AS m FROM v_blocks GROUP BY 1) b ON b.doc_id = d.doc_id"""


@query("scan_probability", check_sql("v_blocks v_meta", SCAN))
def scan_probability(t):
    return ops.scan_probability(t.v_blocks, t.v_meta)


@query("ocr_need", check_sql("v_blocks", NEED))
def ocr_need(t):
    return ops.ocr_need(t.documents, t.v_blocks)


OCR = """SELECT page_id, count(*) FILTER (w <> '') AS n_words, coalesce(avg(conf) FILTER (w <> ''), 0) AS c, coalesce(string_agg(w, ' ' ORDER BY word_id, w) FILTER (w <> ''), '') AS text
    FROM (SELECT *, trim(word) AS w FROM v_ocr_words) GROUP BY page_id"""


@query("ocr_page_confidence", check_sql(
    "v_ocr_words", "SELECT page_id, n_words, round(c, 6) AS confidence, CASE WHEN c < 85 THEN printf('Low OCR confidence (%.1f%% < 85.0%%)', round(c, 1)) END AS warning FROM o", o=OCR))
def ocr_page_confidence(t):
    return ops.ocr_page_confidence(t.v_ocr_words)


@query("ocr_page_text", check_sql("v_ocr_words", "SELECT page_id, 0 AS part, text FROM o WHERE n_words > 0", o=OCR))
def ocr_page_text(t):
    return ops.ocr_page_text(t.v_ocr_words)


@query("low_confidence_segments", check_sql("v_ocr_words", "SELECT page_id, n_words, round(c, 6) AS confidence FROM o WHERE c < 40", o=OCR))
def low_confidence_segments(t):
    return ops.low_confidence_segments(ops.ocr_page_confidence(t.v_ocr_words), 40).select("page_id", "n_words", "confidence")


@query("text_vs_ocr", check_sql(
    "v_page_texts v_blocks",
    """SELECT doc_id, 0 AS part, CASE WHEN u THEN 'ocr' ELSE 'extracted' END AS source, CASE WHEN u THEN o ELSE x END AS text FROM (SELECT coalesce(e.doc_id, c.doc_id) AS doc_id, coalesce(e.text, '') AS x, coalesce(c.o, '') AS o,
    coalesce(n.ocr_needed, true) AND coalesce(c.o, '') <> '' AND length(coalesce(c.o, '')) > length(coalesce(e.text, '')) AS u
    FROM documents e FULL JOIN (SELECT doc_id, string_agg(text, ' ' ORDER BY page_num) AS o FROM v_page_texts WHERE trim(text) <> '' GROUP BY 1) c ON c.doc_id = e.doc_id
    LEFT JOIN n ON n.doc_id = coalesce(e.doc_id, c.doc_id))""", n=NEED))
def text_vs_ocr(t):
    extracted = t.documents.select("doc_id", F.lit(0).alias("part"), "text")
    seen = textops.extract_text_doc(t.v_page_texts.select("doc_id", "page_num", "text"), "doc_id", "page_num")
    return ops.text_vs_ocr(extracted, seen, ops.ocr_need(t.documents, t.v_blocks))


@query("page_source_select", check_sql(
    "v_page_texts",
    """SELECT doc_id, page_num, CASE WHEN trim(t) <> '' THEN t ELSE coalesce(o, '') END AS text, CASE WHEN trim(t) <> '' THEN 'digital' WHEN o IS NOT NULL THEN 'ocr' ELSE 'none' END AS source
    FROM (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.page_num, b.page_num) AS page_num, coalesce(a.text, '') AS t, b.ocr_text AS o
    FROM (SELECT doc_id, page_num + 1 AS page_num, text FROM v_page_texts) a FULL JOIN (SELECT doc_id, page_num, ocr_text FROM v_page_texts WHERE ocr_text IS NOT NULL) b
    ON a.doc_id = b.doc_id AND a.page_num = b.page_num)"""))
def page_source_select(t):
    pages = t.v_page_texts.select("doc_id", (F.col("page_num") + 1).alias("page_num"), "text")
    ocr = t.v_page_texts.filter("ocr_text IS NOT NULL").select("doc_id", "page_num", "ocr_text")
    return ops.page_source_select(pages, ocr)


@query("compare_engines", check_sql(
    "v_primary v_alternate",
    """SELECT p.doc_id, CASE WHEN ok THEN 85.0 ELSE 0.0 END AS text_score, CASE WHEN ok THEN 80.0 ELSE 0.0 END AS structure_score,
    CASE WHEN ok THEN img ELSE 0.0 END AS image_score, CASE WHEN ok THEN meta ELSE 0.0 END AS metadata_score, CASE WHEN ok THEN (165.0 + img + meta) / 4 ELSE 0.0 END AS overall_score,
    round(CASE WHEN ok AND file_size > 0 THEN alt_size / file_size ELSE 1.0 END, 6) AS file_size_ratio FROM v_primary p JOIN (SELECT doc_id, success AS ok, file_size AS alt_size,
    CASE WHEN images_extracted > 0 THEN 90.0 ELSE 50.0 END AS img, CASE WHEN metadata_found THEN 90.0 ELSE 60.0 END AS meta FROM v_alternate) a ON a.doc_id = p.doc_id"""))
def compare_engines(t):
    return ops.compare_engines(t.v_primary, t.v_alternate)


@query("best_output", check_sql(
    "v_primary v_alternate",
    """SELECT p.doc_id, CASE WHEN (NOT p.success OR p.quality_score < 60 OR p.user_requested) AND a.success THEN 'alternate' WHEN p.success THEN 'primary' ELSE 'failed' END AS method_used
    FROM v_primary p JOIN v_alternate a ON a.doc_id = p.doc_id"""))
def best_output(t):
    return ops.best_output(t.v_primary, t.v_alternate)


@query("engine_log_indicators", check_sql(
    "v_engine_log",
    """SELECT run_id, coalesce(last(TRY_CAST(regexp_extract(line, '(\\d+)\\s+pages?', 1) AS INT) ORDER BY line_no) FILTER (line LIKE '%pages%'), 0) AS pages_processed,
    count_if(lower(line) LIKE '%image%' OR lower(line) LIKE '%extracting%') AS images_extracted, bool_or(lower(line) LIKE '%toc%') AS toc_generated, bool_or(line LIKE '%metadata%') AS metadata_found,
    count_if(lower(line) LIKE '%warn%') AS warnings_count FROM v_engine_log GROUP BY run_id"""))
def engine_log_indicators(t):
    return ops.engine_log_indicators(t.v_engine_log)


SCORE = """SELECT m.doc_id, round(least(100.0, 50.0 + CASE WHEN m.title IS NOT NULL AND m.author IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN has_bookmarks THEN 15 ELSE 0 END + total_confidence * 0.2::DOUBLE
    + least(2 * coalesce(i.n, 0), 15) + CASE WHEN scan_probability < 0.3 THEN 10 WHEN scan_probability < 0.7 THEN 5 ELSE 0 END), 6) AS quality_score FROM v_meta m JOIN sc ON sc.doc_id = m.doc_id
    JOIN cf ON cf.doc_id = m.doc_id LEFT JOIN (SELECT doc_id, count(*) AS n FROM v_images GROUP BY 1) i ON i.doc_id = m.doc_id"""


@query("quality_score", check_sql(
    "v_blocks v_outline v_responses v_meta v_images", SCORE, **DETECTORS, mc=MERGED, cf=CONFIDENCE, sc=SCAN))
def quality_score(t):
    pages = _pages(t)
    confidence = structure.structure_confidence(t.documents, _candidates(t, pages))
    return ops.quality_score(t.v_meta, ops.scan_probability(pages, t.v_meta), confidence, t.v_images)


@query("document_quality", check_sql(
    "v_blocks v_outline v_responses v_meta v_images", f"SELECT s.*, cf.n_chapters, cf.total_confidence FROM ({SCORE}) s JOIN cf ON cf.doc_id = s.doc_id",
    **CHAPTER_STEPS, cf=CONFIDENCE.replace("FROM mc)", "FROM kt)"), sc=SCAN))
def document_quality(t):
    """Flagship: blocks and outline -> detectors -> greedy merge -> confidence -> score."""
    pages = _pages(t)
    chapters = structure.dedupe_titles(structure.chapter_conflicts(_candidates(t, pages)))
    confidence = structure.structure_confidence(t.documents, chapters)
    scores = ops.quality_score(t.v_meta, ops.scan_probability(pages, t.v_meta), confidence, t.v_images)
    return scores.join(confidence, "doc_id")


@query("fallback_decision", check_sql(
    "v_meta",
    """SELECT doc_id, reason, reason NOT IN ('alternate engine not available', 'Custom conversion quality acceptable') AS fallback FROM (SELECT doc_id, CASE WHEN NOT engine_available THEN 'alternate engine not available'
    WHEN user_requested THEN 'User explicitly requested alternate engine conversion' WHEN error_occurred THEN 'Custom pipeline encountered unrecoverable error'
    WHEN score < 60 THEN printf('Custom quality score (%.1f) below threshold (60.0)', score) WHEN is_encrypted THEN 'PDF is encrypted' WHEN has_drm THEN 'PDF has DRM protection'
    WHEN complex_layout THEN 'PDF has complex layout requiring specialized handling' ELSE 'Custom conversion quality acceptable' END AS reason FROM v_meta)"""))
def fallback_decision(t):
    return ops.fallback_decision(t.v_meta)


@query("build_metadata", check_sql(
    "v_meta",
    """SELECT doc_id, coalesce(title, 'Unknown Title') AS title, coalesce(author, 'Unknown Author') AS author, 'en' AS language, 'converter' AS publisher, coalesce(subject, 'Converted from PDF') AS description,
    'enhanced_pdf_to_epub' AS conversion_method, CAST(page_count AS VARCHAR) AS original_pages FROM v_meta"""))
def build_metadata(t):
    info = F.col("source_info")
    return ops.build_metadata(t.v_meta).withColumns({
        "conversion_method": info["conversion_method"], "original_pages": info["original_pages"],
    }).drop("source_info")


@query("image_format_choice", check_sql(
    "v_images",
    """SELECT image_id, CASE WHEN original_format = 'png' AND mode IN ('RGBA', 'LA') THEN 'png' WHEN mode IN ('RGB', 'RGBA') AND (width > 500 OR height > 500 OR coalesce(n_colors > 100, false)) THEN 'jpeg'
    WHEN (width <= 500 AND height <= 500) OR coalesce(n_colors <= 16, false) THEN 'png' ELSE 'jpeg' END AS chosen_format, least(width, lim) AS target_width,
    CASE WHEN width > lim THEN CAST(floor(height * (lim / width)) AS INT) ELSE height END AS target_height
    FROM (SELECT *, CASE quality_level WHEN 'fast' THEN 600 WHEN 'high' THEN 1200 ELSE 800 END AS lim FROM v_images)"""))
def image_format_choice(t):
    return ops.image_format_choice(t.v_images).select("image_id", "chosen_format", "target_width", "target_height")


@query("image_numbering", check_sql(
    "v_images", "SELECT image_id, doc_id, printf('img_%04d', row_number() OVER (PARTITION BY doc_id ORDER BY page_num, image_id)) AS img_id FROM v_images"))
def image_numbering(t):
    return ops.image_numbering(t.v_images.select("image_id", "doc_id", "page_num")).select("image_id", "doc_id", "img_id")


@query("image_stats", check_sql(
    "v_images",
    """SELECT final_format, quality_level, count(*) AS n_images, sum(original_size)::BIGINT AS total_original, sum(final_size)::BIGINT AS total_final,
    round(avg(CASE WHEN original_size > 0 THEN final_size / original_size ELSE 1.0 END), 6) AS mean_ratio, round(CASE WHEN sum(original_size) > 0 THEN sum(final_size)::DOUBLE / sum(original_size)::DOUBLE ELSE 1.0 END, 6) AS overall_ratio
    FROM v_images GROUP BY GROUPING SETS ((final_format), (quality_level), ())"""))
def image_stats(t):
    return ops.image_stats(t.v_images)


@query("image_manifest", check_sql(
    "v_images v_image_paths",
    """SELECT p.image_id, concat('images/', regexp_extract(path, '([^/]*)$', 1)) AS href, concat('image/', final_format) AS media_type, CASE WHEN alt_text IS NOT NULL THEN 'alt-text-available' ELSE '' END AS properties
    FROM v_image_paths p JOIN v_images i ON i.image_id = p.image_id"""))
def image_manifest(t):
    return ops.image_manifest(t.v_image_paths, t.v_images).withColumn("properties", F.array_join("properties", ","))


@query("image_nearest_text", check_sql(
    "v_images v_blocks",
    """SELECT i.image_id, coalesce(associated_text, NULL) AS associated_text, suggested_caption, position FROM v_images i LEFT JOIN (
    SELECT image_id, string_agg(text, ' ' ORDER BY rn) AS associated_text, substring(max(text) FILTER (rn = 1), 1, 100) AS suggested_caption, max(CASE WHEN by0 < iy THEN 'after' ELSE 'before' END) FILTER (rn = 1) AS position
    FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY d, bp, block_id) AS rn FROM (
      SELECT i.image_id, i.y0 AS iy, b.y0 AS by0, b.text, b.block_id, b.page_num AS bp, CASE WHEN b.page_num = i.page_num THEN abs(b.y0 - i.y0) + abs(b.x0 - i.x0) ELSE 1000 + abs(b.page_num - i.page_num) * 100 END AS d
      FROM v_images i JOIN v_blocks b ON b.doc_id = i.doc_id AND abs(b.page_num - i.page_num) <= 1)) WHERE rn <= 3 GROUP BY image_id) x ON x.image_id = i.image_id"""))
def image_nearest_text(t):
    return ops.image_nearest_text(t.v_images, t.v_blocks)
