"""Extraction quality, output choice, images and metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quire.functions import text as T, values as V
from quire.operators.ordered import assemble_text, number_rows, top_rows

WORDS_PER_SLICE = 50_000


def scan_probability_of(chars: Column, pages: Column) -> Column:
    """Likelihood of a scan by characters per page."""
    mean = chars / pages
    return (
        F.when(pages == 0, 1.0).when(mean < 50, 0.9).when(mean < 100, 0.6).when(mean < 200, 0.3).otherwise(0.1)
    )


def scan_probability(blocks: DataFrame, meta: DataFrame) -> DataFrame:
    """From text blocks, or from page summaries with their counts of characters."""
    length = F.col("n_chars") if "n_chars" in blocks.columns else F.length("text")
    chars = blocks.groupBy("doc_id").agg(F.sum(length).alias("chars"))
    return meta.join(chars, "doc_id", "left").select(
        "doc_id", scan_probability_of(F.coalesce("chars", F.lit(0)), F.col("page_count")).alias("scan_probability")
    )


def ocr_need(docs: DataFrame, blocks: DataFrame, minimum: float = 50) -> DataFrame:
    """Documents without blocks, or with little text per block."""
    means = blocks.groupBy("doc_id").agg(F.avg(F.length("text")).alias("m"))
    return docs.select("doc_id").join(means, "doc_id", "left").select(
        "doc_id", (F.col("m").isNull() | (F.col("m") < minimum)).alias("ocr_needed")
    )


def ocr_page_confidence(words: DataFrame, threshold: float = V.OCR_CONFIDENCE_THRESHOLD) -> DataFrame:
    """Mean confidence of a page's non-blank words and a warning below the threshold;
    0 for pages without words."""
    conf = F.when(~T.is_blank("word"), F.col("conf"))
    return (
        words.groupBy("page_id")
        .agg(F.count(conf).alias("n_words"), F.coalesce(F.avg(conf), F.lit(0.0)).alias("c"))
        .select(
            "page_id", "n_words", F.round("c", 6).alias("confidence"),
            F.when(F.col("c") < threshold,
                   F.format_string("Low OCR confidence (%.1f%% < %.1f%%)", F.col("c"), F.lit(threshold))).alias("warning"),
        )
    )


def ocr_page_text(words: DataFrame) -> DataFrame:
    """Stripped non-blank words of a page joined by spaces in word order."""
    kept = words.withColumn("word", T.ustrip("word")).filter(F.col("word") != "")
    return assemble_text(kept, ["page_id"], ["word_id"], "word", [F.floor(F.col("word_id") / WORDS_PER_SLICE)])


def low_confidence_segments(pages: DataFrame, threshold: float = V.OCR_CONFIDENCE_THRESHOLD) -> DataFrame:
    return pages.filter(F.col("confidence") < threshold)


def text_vs_ocr(extracted: DataFrame, ocr: DataFrame, need: DataFrame) -> DataFrame:
    """Recognised text where recognition was needed and gave more text than extraction.

    Both sides are text parts (doc_id, part, text). The choice is made on summed lengths,
    then all parts of the chosen side are returned.
    """
    def size(parts: DataFrame, name: str) -> DataFrame:
        # parts are joined by one space, so each part after the first adds a character
        return parts.groupBy("doc_id").agg((F.sum(F.length("text")) + F.count(F.lit(1)) - 1).alias(name))

    sizes = size(extracted, "n_text").join(size(ocr, "n_ocr"), "doc_id", "full_outer").join(need, "doc_id", "left")
    n_text, n_ocr = F.coalesce("n_text", F.lit(0)), F.coalesce("n_ocr", F.lit(0))
    use = F.coalesce("ocr_needed", F.lit(True)) & (n_ocr > n_text)
    chosen = sizes.select("doc_id", F.when(use, "ocr").otherwise("extracted").alias("source"))
    parts = extracted.select("doc_id", "part", "text", F.lit("extracted").alias("source")).unionByName(
        ocr.select("doc_id", "part", "text", F.lit("ocr").alias("source"))
    )
    return chosen.join(parts, ["doc_id", "source"], "left").select(
        "doc_id", "source", F.coalesce("part", F.lit(0)).alias("part"), F.coalesce("text", F.lit("")).alias("text")
    )


def page_source_select(pages: DataFrame, ocr_pages: DataFrame) -> DataFrame:
    """Digital text of a page where present, else its recognised text."""
    digital = F.when(~T.is_blank("text"), F.col("text"))
    return pages.join(ocr_pages, ["doc_id", "page_num"], "full_outer").select(
        "doc_id", "page_num",
        F.coalesce(digital, F.col("ocr_text"), F.lit("")).alias("text"),
        F.when(digital.isNotNull(), "digital").when(F.col("ocr_text").isNotNull(), "ocr").otherwise("none").alias("source"),
    )


def compare_engines(primary: DataFrame, alternate: DataFrame) -> DataFrame:
    """Component scores of the alternate output and its size next to the primary one."""
    a = alternate.select("doc_id", F.col("success").alias("ok"), F.col("file_size").alias("alt_size"),
                         "images_extracted", "metadata_found")
    ok = F.coalesce("ok", F.lit(False))
    size = F.coalesce("file_size", F.lit(0))

    def score(value) -> Column:
        return F.when(ok, value).otherwise(0.0)

    image, meta = F.when(F.col("images_extracted") > 0, 90.0).otherwise(50.0), F.when(F.col("metadata_found"), 90.0).otherwise(60.0)
    return primary.join(a, "doc_id", "left").select(
        "doc_id",
        score(F.lit(85.0)).alias("text_score"), score(F.lit(80.0)).alias("structure_score"),
        score(image).alias("image_score"), score(meta).alias("metadata_score"),
        score((F.lit(165.0) + image + meta) / 4).alias("overall_score"),
        F.round(F.when(ok & (size > 0), F.col("alt_size") / size).otherwise(1.0), 6).alias("file_size_ratio"),
    )


def best_output(primary: DataFrame, alternate: DataFrame, threshold: float = V.QUALITY_THRESHOLD) -> DataFrame:
    """Which output to keep: the alternate when the primary failed, scored low or the user
    asked for it; the primary when the alternate failed; else none."""
    a = alternate.select("doc_id", F.col("success").alias("alt_ok"))
    alt = F.coalesce("alt_ok", F.lit(False))
    fallback = ~F.col("success") | (F.col("quality_score") < threshold) | F.col("user_requested")
    return primary.join(a, "doc_id", "left").select(
        "doc_id",
        F.when(fallback & alt, "alternate").when(F.col("success"), "primary").otherwise("failed").alias("method_used"),
    )


def engine_log_indicators(lines: DataFrame) -> DataFrame:
    """Quality hints from converter output, per run."""
    low = F.lower("line")
    number = F.when(low.contains("pages"), F.regexp_extract(low, r"(\d+)\s+pages?", 1))
    pages = F.when(number != "", number.cast("int"))
    return lines.groupBy("run_id").agg(
        F.coalesce(F.max_by(pages, F.when(pages.isNotNull(), F.col("line_no"))), F.lit(0)).alias("pages_processed"),
        F.count_if(low.contains("image") | low.contains("extracting")).alias("images_extracted"),
        F.bool_or(low.contains("toc") | low.contains("table of contents")).alias("toc_generated"),
        F.bool_or(low.contains("metadata")).alias("metadata_found"),
        F.count_if(low.contains("warn")).alias("warnings_count"),
    )


def quality_score(meta: DataFrame, scans: DataFrame, confidences: DataFrame, images: DataFrame) -> DataFrame:
    """Overall score of a conversion from metadata, structure, images and scan likelihood."""
    counts = images.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_images"))
    n = F.coalesce("n_images", F.lit(0))
    scan = F.col("scan_probability")
    named = (F.coalesce("title", F.lit("")) != "") & (F.coalesce("author", F.lit("")) != "")
    score = (
        F.lit(50.0)
        + F.when(named, 10).otherwise(0)
        + F.when(F.col("has_bookmarks"), 15).otherwise(0)
        + F.coalesce("total_confidence", F.lit(0.0)) * 0.2
        + F.least(n * 2, F.lit(15))
        + F.when(scan < 0.3, 10).when(scan < 0.7, 5).otherwise(0)
    )
    return (
        meta.join(scans, "doc_id").join(confidences, "doc_id", "left").join(counts, "doc_id", "left")
        .select("doc_id", F.round(F.least(F.lit(100.0), score), 6).alias("quality_score"))
    )


def fallback_decision(docs: DataFrame, engine: str = "alternate engine", threshold: float = V.QUALITY_THRESHOLD) -> DataFrame:
    """First trigger that asks for the alternate engine, with its reason."""
    reason = (
        F.when(~F.col("engine_available"), f"{engine} not available")
        .when(F.col("user_requested"), f"User explicitly requested {engine} conversion")
        .when(F.col("error_occurred"), "Custom pipeline encountered unrecoverable error")
        .when(F.col("score") < threshold,
              F.format_string("Custom quality score (%.1f) below threshold (%.1f)", F.col("score"), F.lit(threshold)))
        .when(F.col("is_encrypted"), "PDF is encrypted")
        .when(F.col("has_drm"), "PDF has DRM protection")
        .when(F.col("complex_layout"), "PDF has complex layout requiring specialized handling")
        .otherwise("Custom conversion quality acceptable")
    )
    return docs.select("doc_id", reason.alias("reason")).withColumn(
        "fallback", ~F.col("reason").isin(f"{engine} not available", "Custom conversion quality acceptable")
    )


def build_metadata(meta: DataFrame, publisher: str = "converter") -> DataFrame:
    """Output metadata with defaults for missing values and a source map."""
    both = F.concat_ws(" ", "title", "author")
    return meta.select(
        "doc_id",
        F.coalesce("title", F.lit("Unknown Title")).alias("title"),
        F.coalesce("author", F.lit("Unknown Author")).alias("author"),
        F.when(T.has_cjk(both), "zh").otherwise("en").alias("language"),
        F.lit(publisher).alias("publisher"),
        F.coalesce("subject", F.lit("Converted from PDF")).alias("description"),
        F.create_map(
            F.lit("conversion_method"), F.lit("enhanced_pdf_to_epub"),
            F.lit("original_pages"), F.coalesce("page_count", F.lit(0)).cast("string"),
        ).alias("source_info"),
    )


# --- images ------------------------------------------------------------------

def image_format_choice(images: DataFrame) -> DataFrame:
    """Output format and size of an image from its metadata."""
    w, h, colors = F.col("width"), F.col("height"), F.col("n_colors")
    alpha = (F.col("original_format") == "png") & F.col("mode").isin("RGBA", "LA")
    photo = F.col("mode").isin("RGB", "RGBA") & ((w > 500) | (h > 500) | F.coalesce(colors > 100, F.lit(False)))
    diagram = ((w <= 500) & (h <= 500)) | F.coalesce(colors <= 16, F.lit(False))
    limit = F.coalesce(T.lookup(F.col("quality_level"), V.IMAGE_WIDTHS), F.lit(V.IMAGE_WIDTHS["standard"]))
    return images.withColumns({
        "chosen_format": F.when(alpha, "png").when(photo, "jpeg").when(diagram, "png").otherwise("jpeg"),
        "target_width": F.least(w, limit),
        "target_height": F.when(w > limit, F.floor(h * (limit / w)).cast("int")).otherwise(h),
    })


def image_numbering(images: DataFrame) -> DataFrame:
    """``img_0001`` ids in page order within a document."""
    numbered = number_rows(
        images, ["doc_id"], [F.col("page_num"), F.col("image_id")],
        [F.col("page_num"), F.floor(F.col("image_id") / WORDS_PER_SLICE)], "number",
    )
    return numbered.withColumn("img_id", F.format_string("img_%04d", F.col("number")))


def image_stats(images: DataFrame) -> DataFrame:
    """Totals and compression by format, by quality level and overall, in one pass."""
    ratio = F.when(F.col("original_size") > 0, F.col("final_size") / F.col("original_size")).otherwise(1.0)
    sizes = images.select("final_format", "quality_level", "original_size", "final_size", ratio.alias("ratio"))
    levels = sizes.groupingSets([["final_format"], ["quality_level"], []], "final_format", "quality_level").agg(
        F.count(F.lit(1)).alias("n_images"),
        F.sum("original_size").alias("total_original"),
        F.sum("final_size").alias("total_final"),
        F.round(F.avg("ratio"), 6).alias("mean_ratio"),
    )
    return levels.withColumn(
        "overall_ratio",
        F.round(F.when(F.col("total_original") > 0, F.col("total_final") / F.col("total_original")).otherwise(1.0), 6),
    )


def image_manifest(paths: DataFrame, images: DataFrame) -> DataFrame:
    """Manifest rows of saved images; paths without an image are dropped."""
    fmt = F.when(F.col("final_format") == "jpg", "jpeg").otherwise(F.col("final_format"))
    return paths.join(images.select("image_id", "final_format", "alt_text"), "image_id").select(
        "image_id",
        F.concat(F.lit("images/"), T.base_name(F.col("path"))).alias("href"),
        F.concat(F.lit("image/"), fmt).alias("media_type"),
        F.array_compact(F.array(F.when(F.coalesce("alt_text", F.lit("")) != "", "alt-text-available"))).alias("properties"),
    )


def image_nearest_text(images: DataFrame, blocks: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` nearest text blocks of each image on its own and the neighbouring pages.

    Images at one spot share their answer and only the first ``k`` blocks at one spot can
    be in it, so both sides are cut to distinct positions before they meet on
    (document, page); from a neighbouring page, where all distances are equal, only the
    first ``k`` blocks count.
    """
    spots = images.select("doc_id", "page_num", "x0", "y0").distinct()
    around = spots.select(
        "doc_id", F.col("page_num").alias("img_page"), F.col("x0").alias("ix"), F.col("y0").alias("iy"),
        F.explode(F.array(F.col("page_num") - 1, F.col("page_num"), F.col("page_num") + 1)).alias("page_num"),
    )
    text = blocks.select("doc_id", "page_num", "block_id", "x0", "y0", "text")
    near = top_rows(text, ["doc_id", "page_num", "x0", "y0"], [F.col("block_id")], k)
    far = top_rows(text, ["doc_id", "page_num"], [F.col("block_id")], k)
    same_page = around.filter(F.col("page_num") == F.col("img_page")).join(near, ["doc_id", "page_num"]).withColumn(
        "distance", F.abs(F.col("y0") - F.col("iy")) + F.abs(F.col("x0") - F.col("ix"))
    )
    next_page = around.filter(F.col("page_num") != F.col("img_page")).join(far, ["doc_id", "page_num"]).withColumn(
        "distance", F.lit(1100.0)
    )
    spot = ["doc_id", "img_page", "ix", "iy"]
    best = top_rows(
        same_page.unionByName(next_page), spot,
        [F.col("distance"), F.col("page_num"), F.col("block_id")], k,
    )
    row = F.struct("distance", "page_num", "block_id", "y0", "text")
    found = (
        best.groupBy(*spot).agg(F.sort_array(F.collect_list(row)).alias("near"))
        .select(
            "doc_id", F.col("img_page").alias("page_num"), F.col("ix").alias("x0"), F.col("iy").alias("y0"),
            F.transform("near", lambda r: r["text"]).alias("texts"),
            F.when(F.col("near")[0]["y0"] < F.col("iy"), "after").otherwise("before").alias("position"),
        )
    )
    return images.join(found, ["doc_id", "page_num", "x0", "y0"], "left").select(
        "image_id",
        F.array_join("texts", " ").alias("associated_text"),
        F.substring(F.col("texts")[0], 1, 100).alias("suggested_caption"),
        "position",
    )
