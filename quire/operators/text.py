"""Text extraction, normalisation and rendering of a document corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quire.functions import text as T, values as V
from quire.operators.ordered import assemble_text, number_rows

PAGES_PER_SLICE = 256


def html_to_text(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """Tags removed, whitespace collapsed; pages without text are dropped.

    Dropping by explode computes the text once; a filter would compute it a second time.
    """
    keep = [c for c in pages.columns if c != html]
    return pages.select(*keep, F.explode(F.array_remove(F.array(T.strip_tags(html)), "")).alias(out))


def fragment_filter(fragments: DataFrame, text: str = "text", longer_than: int = 50) -> DataFrame:
    return fragments.filter(F.length(text) > longer_than)


def nonblank_pages(pages: DataFrame, text: str = "text") -> DataFrame:
    return pages.filter(~T.is_blank(text))


def extract_text_doc(
    pages: DataFrame, doc: str, page: str, text: str = "text", per_slice: int = PAGES_PER_SLICE
) -> DataFrame:
    """All non-blank page texts of a document joined by one space, in page order."""
    kept = nonblank_pages(pages, text)
    return assemble_text(kept, [doc], [page], text, [F.floor(F.col(page) / per_slice)])


def normalize_text(docs: DataFrame, text: str = "text", n: int = 2000) -> DataFrame:
    """Whitespace collapsed, cut to ``n`` characters and then back to a late full stop."""
    flat = T.collapse(text)
    head = F.substring(flat, 1, n)
    # 0-based index of the last full stop of the head
    last = F.length(head) - F.locate("。", F.reverse(head))
    cut = F.when(
        head.contains("。") & (last > n * 0.8), F.substr(head, F.lit(1), last + 1)
    ).otherwise(head)
    return docs.withColumn("normalized", F.when(F.length(flat) > n, cut).otherwise(flat))


def ascii_runs_text(
    files: DataFrame, content: str = "content", name: str = "name", kind: str = "MOBI", minimum: int = 100
) -> DataFrame:
    """Readable runs of a binary e-book joined by spaces, or a note if there are too few."""
    runs = F.array_join(
        F.regexp_extract_all(F.col(content), F.lit(V.BINARY_TEXT_PATTERN.replace(r"\s", T.BLANKS)), F.lit(0)), " "
    )
    note = T.fill(
        V.BINARY_TEXT_NOTE,
        kind=F.lit(kind), name=F.col(name), size=F.octet_length(content).cast("string"),
    )
    short = F.length(T.ustrip("_runs")) < minimum
    return files.withColumn("_runs", runs).withColumn("text", F.when(short, note).otherwise(F.col("_runs"))).drop("_runs")


def txt_paragraphs(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Blank-line paragraphs, stripped, with inner line ends deleted; empty ones dropped."""
    return (
        docs.select(doc, F.posexplode(F.split(text, "\n\n")).alias("para_no", "raw"))
        .select(doc, "para_no", F.replace(T.ustrip("raw"), F.lit("\n"), F.lit("")).alias("paragraph"))
        .filter(F.col("paragraph") != "")
    )


def chapter_html(title: Column, content: Column, has_images: Column) -> Column:
    paragraphs = F.filter(
        F.transform(F.split(content, "\n\n"), T.ustrip), lambda p: p != ""
    )
    many = F.array_join(
        F.transform(paragraphs, lambda p: F.concat(F.lit("<p>"), T.escape_html(p), F.lit("</p>"))), "\n"
    )
    one = F.concat(F.lit("<p>"), T.escape_html(content), F.lit("</p>"))
    head = T.fill(V.CHAPTER_HTML_HEAD, title=T.escape_html(title))
    return F.concat(head, F.when(has_images, many).otherwise(one), F.lit(V.CHAPTER_HTML_TAIL))


def render_chapter_html(chapters: DataFrame, title: str = "title", content: str = "content",
                        has_images: str = "has_images") -> DataFrame:
    """Escaped chapter pages: one paragraph, or one per blank-line paragraph where the
    document has images. The page is tagged ``zh`` only if its title holds "zh"."""
    return chapters.withColumns({
        "html": chapter_html(F.col(title), F.col(content), F.col(has_images)),
        "chapter_lang": F.when(F.col(title).contains("zh"), "zh").otherwise("en"),
    })


def render_plain_html(chapters: DataFrame, title: str = "title", content: str = "content") -> DataFrame:
    """Plain pages: a paragraph break at every line end, nothing escaped."""
    body = F.replace(F.col(content), F.lit("\n"), F.lit("</p><p>"))
    return chapters.withColumn("html", T.fill(V.PLAIN_HTML, title=F.col(title), body=body))


def language_tag(docs: DataFrame, title: str = "title", author: str = "author", text: str = "text") -> DataFrame:
    """Document language from title and author, from the first 1000 bytes, and the
    recognition language from the number of CJK characters."""
    both = F.concat_ws(" ", title, author)
    sample = F.substring(F.encode(F.col(text), "UTF-8"), 1, 1000).cast("string")
    return docs.withColumns({
        "meta_lang": F.when(T.has_cjk(both), "zh").otherwise("en"),
        "sample_has_cjk": T.has_cjk(sample),
        "ocr_lang": F.when(T.cjk_count(text) > 10, "chi_sim+chi_tra").otherwise("eng"),
    })


def heading_likelihood(blocks: DataFrame, text: str = "text") -> DataFrame:
    return blocks.withColumn("likely_heading", T.heading_likely(text))


def clean_titles(chapters: DataFrame, title: str = "title") -> DataFrame:
    return chapters.withColumn("clean_title", T.clean_title(title))


def chunk_chapters(docs: DataFrame, doc: str = "doc_id", text: str = "text", n: int = 5000) -> DataFrame:
    """Chapters of ``n`` characters; blank ones are dropped but keep their number.

    One pass over a text cuts it, and a row carries its own characters only.
    """
    pieces = F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{n}}}"), F.lit(0))
    number = F.col("at") + 1
    return (
        docs.filter(F.length(text) > 0)
        .select(doc, F.posexplode(pieces).alias("at", "content"))
        .select(
            doc,
            number.alias("chapter_no"),
            F.concat(F.lit("第"), number.cast("string"), F.lit("章")).alias("title"),
            F.format_string("chap_%03d.xhtml", number).alias("file_name"),
            "content",
        )
        .filter(~T.is_blank("content"))
    )


def page_chapters(pages: DataFrame, doc: str, page: str, text: str = "text",
                  per_slice: int = PAGES_PER_SLICE) -> DataFrame:
    """One chapter per non-blank page, numbered by position among them."""
    kept = nonblank_pages(pages, text)
    numbered = number_rows(
        kept, [doc], [F.col(page)], [F.floor(F.col(page) / per_slice)], "chapter_no"
    )
    return numbered.withColumn("title", F.concat(F.lit("Chapter "), F.col("chapter_no").cast("string")))


def fallback_page_chapters(pages: DataFrame, structured: DataFrame, doc: str, page: str, n: int = 20) -> DataFrame:
    """For documents without detected chapters: a chapter every ``n`` pages."""
    return (
        pages.join(structured.select(doc).distinct(), doc, "left_anti")
        .withColumn("chapter_no", F.floor(F.col(page) / n) + 1)
        .groupBy(doc, "chapter_no")
        .agg(F.min(page).alias("start_page"), F.max(page).alias("end_page"), F.count(F.lit(1)).alias("pages"))
    )


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn("word_count", F.size(T.words(text)))
