"""Chapter structure: detectors, merging, ranges, content, confidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quire.functions import text as T, values as V
from quire.operators.greedy import DocumentTitles, PageTitles, select
from quire.operators.ordered import assemble_text, first_row, number_rows, top_rows
from quire.operators.pages import BLOCKS_PER_SLICE, page_starts, page_summary, saved
from quire.operators.similarity import similar_pairs

PAGES_PER_SLICE = 64
CANDIDATE = ["doc_id", "page_num", "title", "confidence", "method", "level"]


def outline_filter(outline: DataFrame) -> DataFrame:
    """Usable outline entries as candidates: no blank, one-character or all-digit titles."""
    title = T.ustrip("title")
    return (
        outline.withColumn("title", title)
        .filter((F.length("title") >= 2) & ~F.col("title").rlike(r"^\p{Nd}+\z"))
        .select(
            "doc_id",
            (F.col("page") - 1).cast("bigint").alias("page_num"),
            "title",
            T.bookmark_confidence(F.col("title"), F.col("level")).alias("confidence"),
            F.lit("bookmark").alias("method"),
            F.col("level").cast("int").alias("level"),
            F.col("ord").alias("seq"),
        )
    )


def font_stats(blocks: DataFrame) -> DataFrame:
    """Mean and largest positive font size of a document and its heading threshold."""
    size = F.when(F.col("font_size") > 0, F.col("font_size"))
    return _with_threshold(blocks.groupBy("doc_id").agg(F.avg(size).alias("avg_size"), F.max(size).alias("max_size")))


def _with_threshold(sizes: DataFrame) -> DataFrame:
    return sizes.filter(F.col("avg_size").isNotNull()).withColumn(
        "threshold", F.col("avg_size") + (F.col("max_size") - F.col("avg_size")) * 0.3
    )


def _largest_per_page(blocks: DataFrame) -> DataFrame:
    """Largest font per page, the first block on ties: a partial aggregate, no sort."""
    return first_row(blocks, ["doc_id", "page_num"], [-F.col("font_size"), F.col("block_id")])


def font_headings(blocks: DataFrame, stats: DataFrame) -> DataFrame:
    """Best bold heading above the document's threshold on each page."""
    likely = blocks.filter(
        F.col("is_bold") & (F.length(T.ustrip("text")) > 2) & T.heading_likely("text")
    ).join(stats, "doc_id").filter(F.col("font_size") >= F.col("threshold"))
    best = _largest_per_page(likely.select("doc_id", "page_num", "block_id", "text", "font_size", "avg_size", "max_size"))
    return _font_candidates(best)


def _font_candidates(best: DataFrame) -> DataFrame:
    return best.select(
        "doc_id",
        F.col("page_num").cast("bigint").alias("page_num"),
        T.ustrip("text").alias("title"),
        T.font_confidence(F.col("font_size"), F.col("avg_size"), F.col("max_size"), F.lit(True)).alias("confidence"),
        F.lit("font_analysis").alias("method"),
        F.lit(1).alias("level"),
        F.col("block_id").alias("seq"),
    )


def page_top_headings(blocks: DataFrame, top: float = 200, size: float = 14) -> DataFrame:
    """Largest block near the top of each page, kept only if it then looks like a heading."""
    best = _largest_per_page(
        blocks.filter(F.col("y0") < top).select("doc_id", "page_num", "block_id", "text", "font_size")
    )
    return _top_candidates(best, size)


def _top_candidates(best: DataFrame, size: float) -> DataFrame:
    return best.filter((F.col("font_size") > size) & T.heading_likely("text")).select(
        "doc_id",
        F.col("page_num").cast("bigint").alias("page_num"),
        T.ustrip("text").alias("title"),
        F.lit(60.0).alias("confidence"),
        F.lit("page_pattern").alias("method"),
        F.lit(1).alias("level"),
        F.col("page_num").cast("bigint").alias("seq"),
    )


def candidates_of_pages(pages: DataFrame, size: float = 14) -> list[DataFrame]:
    """The candidates that font_headings and page_top_headings find, from a table of page summaries."""
    sizes = pages.groupBy("doc_id").agg(
        (F.sum("size_sum") / F.sum("n_sizes")).alias("avg_size"), F.max("max_size").alias("max_size"), F.sum("n_sizes").alias("n")
    )
    stats = _with_threshold(sizes.filter("n > 0").drop("n"))
    headings = pages.filter("heading IS NOT NULL").select("doc_id", "page_num", "heading.*")
    above = headings.join(stats, "doc_id").filter(F.col("font_size") >= F.col("threshold"))
    tops = pages.filter("top_block IS NOT NULL").select("doc_id", "page_num", "top_block.*")
    return [_font_candidates(above), _top_candidates(tops, size)]


def merge_candidates(*detected: DataFrame) -> DataFrame:
    """All candidates of all detectors with their priority (bookmark first)."""
    rank = {m: i for i, m in enumerate(V.DETECTORS)}
    both = reduce(DataFrame.unionByName, detected)
    return both.withColumn("priority", T.lookup(F.col("method"), rank))


def detector_counts(docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates per detector and the detectors that found any."""
    counts = candidates.groupBy("doc_id").agg(
        *[F.count_if(F.col("method") == m).alias(f"{m}_count") for m in V.DETECTORS]
    )
    filled = docs.select("doc_id").join(counts, "doc_id", "left").na.fill(0)
    used = F.array_compact(F.array(*[F.when(F.col(f"{m}_count") > 0, m) for m in V.DETECTORS]))
    return filled.withColumn("methods_used", used)


# --- greedy selection --------------------------------------------------------

def _prepared(candidates: DataFrame) -> DataFrame:
    key = T.title_key("title")
    clean = T.clean_title("title")
    return candidates.withColumns({
        "words": T.title_words(key), "clean": clean, "clean_words": T.title_words(T.title_key(clean)),
    })


def chapter_conflicts(candidates: DataFrame, near: int = 2, t: float = 0.8) -> DataFrame:
    """Drop a candidate when an accepted one before it (by detector, then detector order)
    lies within ``near`` pages under a similar title. Outline entries are all accepted; so are rows without page or title.

    A document is cut where no candidate stands on more than ``near`` pages; the stretches are decided apart.
    """
    work = candidates.withColumn("words", T.title_words(T.title_key("title")))
    in_order = W.partitionBy("doc_id").orderBy("page_num")
    gap = F.coalesce(F.col("page_num") - F.lag("page_num").over(in_order) > near, F.lit(True))
    begun = work.withColumn("_begin", F.when(gap, F.col("page_num")))
    cut = begun.withColumn("_stretch", F.max("_begin").over(in_order)).drop("_begin")
    order = ["priority", "seq", "page_num", "title"]
    return select(cut, ["doc_id", "_stretch"], order, lambda: PageTitles(near, t)).drop("words", "_stretch")


def dedupe_titles(candidates: DataFrame, t: float = 0.9) -> DataFrame:
    """In page order, drop a title similar to one kept before; kept titles are cleaned.

    A kept title counts in its cleaned form, a new one in its raw form.
    """
    kept = select(
        _prepared(candidates), ["doc_id"], ["page_num", "priority", "seq", "title"], lambda: DocumentTitles(t)
    )
    return kept.withColumn("title", F.col("clean")).drop("words", "clean", "clean_words")


def detect_chapters(outline: DataFrame, blocks: DataFrame, proposals: DataFrame | None = None) -> DataFrame:
    """Chapters of every document from all detectors, merged and de-duplicated. Blocks are read once, for a table of
    page summaries in the shared folder."""
    found = [outline_filter(outline), *candidates_of_pages(saved(page_summary(blocks), "pages"))]
    if proposals is not None:
        found.append(proposals)
    return dedupe_titles(chapter_conflicts(merge_candidates(*found)))


def title_similarity_join(titles: DataFrame, t: float = 0.5) -> DataFrame:
    """Pairs of distinct titles (word sets) with similarity >= t and how often each occurs.

    Titles with equal word sets are one entry with a count, so a title shared by very many
    rows pairs up once.
    """
    sets = saved(titles.select(T.title_words(T.title_key("title")).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")), "titles")
    key = F.array_join("w", " ")
    a = sets.select(key.alias("a_id"), F.col("w").alias("a_words"))
    pairs = similar_pairs(a, None, [], t)
    counts = sets.select(key.alias("k"), "n")
    return (
        pairs.join(counts.select(F.col("k").alias("a_id"), F.col("n").alias("n_a")), "a_id")
        .join(counts.select(F.col("k").alias("b_id"), F.col("n").alias("n_b")), "b_id")
        .select("a_id", "b_id", "similarity", "n_a", "n_b")
    )


# --- ranges and content ------------------------------------------------------

def chapter_ranges(boundaries: DataFrame, blocks: DataFrame) -> DataFrame:
    """Numbered chapters with first and last page: up to the page before the next
    boundary, the last one to the document's last page. Two boundaries on a page leave
    the first with an empty range; they follow in order of their detectors' priority."""
    order = [F.col("page_num"), F.col("priority"), F.col("seq")]
    slices = [F.floor(F.col("page_num") / PAGES_PER_SLICE)]
    ahead = number_rows(boundaries, ["doc_id"], order, slices, "chapter_no", ahead=("page_num", "next_page"))
    last = blocks.groupBy("doc_id").agg(F.max("page_num").alias("last_page"))
    return (
        ahead.join(last, "doc_id")
        .withColumn("start_page", F.col("page_num"))
        .withColumn("end_page", F.coalesce(F.col("next_page") - 1, F.col("last_page").cast("bigint")))
        .drop("next_page", "last_page")
    )


def chapter_content(ranges: DataFrame, blocks: DataFrame) -> DataFrame:
    """Text of each chapter's pages in page and block order, in parts.

    Ranges of a document do not overlap, so they are written out as pages and joined on
    (document, page): no range join, and a long book spreads over its pages.
    """
    pages = ranges.filter(F.col("start_page") <= F.col("end_page")).select(
        "doc_id", "chapter_no", F.explode(F.sequence("start_page", "end_page")).alias("page_num")
    )
    placed = blocks.select("doc_id", F.col("page_num").cast("bigint").alias("page_num"), "block_id", "text").join(
        pages, ["doc_id", "page_num"]
    )
    slices = [F.floor(F.col("page_num") / PAGES_PER_SLICE), F.floor(F.col("block_id") / BLOCKS_PER_SLICE)]
    texts = assemble_text(placed, ["doc_id", "chapter_no"], ["page_num", "block_id"], "text", slices, out="content")
    label = F.format_string("chapter_%03d", F.col("chapter_no"))
    return ranges.join(texts, ["doc_id", "chapter_no"], "left").select(
        "doc_id", "chapter_no", F.coalesce("part", F.lit(0)).alias("part"), label.alias("chapter_id"), "title",
        F.coalesce("content", F.lit("")).alias("content"),
        F.concat(label, F.lit(".xhtml")).alias("file_name"), "level", "start_page", "end_page",
    )


def whole_document_chapter(blocks: DataFrame, boundaries: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """Documents without any boundary: one chapter with all their text, under the document's title (doc_id, title) or,
    without one, ``Document``."""
    rest = blocks.join(boundaries.select("doc_id").distinct(), "doc_id", "left_anti")
    slices = [F.floor(F.col("page_num") / PAGES_PER_SLICE), F.floor(F.col("block_id") / BLOCKS_PER_SLICE)]
    texts = assemble_text(rest, ["doc_id"], ["page_num", "block_id"], "text", slices, out="content")
    title = F.lit("Document")
    if titles is not None:
        texts = texts.join(titles.select("doc_id", F.col("title").alias("_title")), "doc_id", "left")
        title = F.coalesce(F.col("_title"), title)
    return texts.select(
        "doc_id", "part", F.lit("chapter_001").alias("chapter_id"), title.alias("title"), "content",
        F.lit("chapter_001.xhtml").alias("file_name"),
    )


def structure_confidence(docs: DataFrame, chapters: DataFrame) -> DataFrame:
    """Mean confidence weighted by detector; 0 for documents without chapters."""
    weight = F.coalesce(T.lookup(F.col("method"), V.DETECTOR_WEIGHTS), F.lit(V.OTHER_DETECTOR_WEIGHT))
    scored = (
        chapters.withColumn("w", weight)
        .groupBy("doc_id")
        .agg(F.count(F.lit(1)).alias("n"), (F.sum(F.col("confidence") * F.col("w")) / F.sum("w")).alias("c"))
    )
    return docs.select("doc_id").join(scored, "doc_id", "left").select(
        "doc_id", F.coalesce("n", F.lit(0)).alias("n_chapters"),
        F.round(F.coalesce("c", F.lit(0.0)), 6).alias("total_confidence"),
    )


def sample_first_pages(blocks: DataFrame, pages: int = 20, chars: int = 200, minimum: int = 3) -> DataFrame:
    """Start of the first ``pages`` pages as one prompt sample per document."""
    texts = top_rows(page_starts(blocks, chars), ["doc_id"], [F.col("page_num")], pages)
    line = F.concat(
        F.lit("Page "), (F.col("page_num") + 1).cast("string"), F.lit(":\n"), F.col("start"), F.lit("...\n\n")
    )
    return (
        texts.groupBy("doc_id")
        .agg(F.sort_array(F.collect_list(F.struct("page_num", line.alias("l")))).alias("ls"))
        .filter(F.size("ls") >= minimum)
        .select("doc_id", F.array_join(F.transform("ls", lambda x: x["l"]), "").alias("sample"))
    )


def page_heads(blocks: DataFrame, chars: int = 100) -> DataFrame:
    """First characters of each page's text."""
    return page_starts(blocks, chars).select("doc_id", F.col("page_num").cast("bigint").alias("page_num"), F.col("start").alias("head"))


def ai_chapter_verify(responses: DataFrame, heads: DataFrame) -> DataFrame:
    """``Page X: title`` lines of model responses whose page exists; titles that say
    nothing are replaced by the first sentence of the page's start."""
    pattern = "(?iu)" + T.uni(r"^Page\s*(\d+):\s*(.+)")
    proposed = (
        responses.select("doc_id", "ord", F.posexplode(F.split("response", "\n")).alias("line_no", "line"))
        .withColumn("line", T.ustrip("line"))
        .filter(F.col("line").rlike(pattern))
        .select(
            "doc_id", "ord", "line_no",
            (F.regexp_extract("line", pattern, 1).cast("bigint") - 1).alias("page_num"),
            T.ustrip(F.regexp_extract("line", pattern, 2)).alias("title"),
        )
    )
    generic = (F.length("title") < 3) | T.lower("title").isin(V.GENERIC_TITLES)
    return (
        proposed.join(heads, ["doc_id", "page_num"])
        .withColumn("title", F.when(generic, T.ustrip(F.substring_index("head", ".", 1))).otherwise(F.col("title")))
        .filter(F.length("title") > 2)
        .select(
            "doc_id", "page_num", "title", F.lit(70.0).alias("confidence"), F.lit("ai_analysis").alias("method"),
            F.lit(1).alias("level"), (F.col("ord") * 1_000_000 + F.col("line_no")).alias("seq"),
        )
    )


def toc_match(toc: DataFrame, chapters: DataFrame) -> DataFrame:
    """Contents items of type chapter -> the first chapter of that title; others dropped."""
    firsts = chapters.groupBy("doc_id", "title").agg(F.min("chapter_no").alias("chapter_no"))
    return toc.filter(F.col("type") == "chapter").join(firsts, ["doc_id", "title"]).select(
        "doc_id", "ord", "title", "chapter_no"
    )
