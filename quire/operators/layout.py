"""Page layout: words to columns, lines, regions and reading order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quire.functions import text as T
from quire.operators.ordered import PART_CHARS

GAP = 20.0
LINE_TOLERANCE = 5.0
SMALL = 64  # positions that are walked one by one; calls on short arrays would cost more


class _Frames:
    """Walks the sorted distinct positions of one page after the other and collects its columns and lines.

    What it holds is the open column, the last line opening and the columns and openings found on the page so far, of
    which a page has at most its width / gap and its height / tolerance.
    """

    def __init__(self, gap: float, tol: float):
        self.gap, self.tol = gap, tol
        self.pages: list = []
        self.spans: list[list[dict]] = []
        self.anchors: list[list[float]] = []
        self.last = 0.0

    def begin(self, page) -> None:
        self.pages.append(page)
        self.spans.append([])
        self.anchors.append([])

    def across(self, starts: np.ndarray, ends: np.ndarray) -> None:
        """Word starts in order and the furthest end at each: a start more than `gap` after the one before opens a column."""
        if len(starts) <= SMALL:
            spans, last = self.spans[-1], self.last
            for first, end in zip(starts.tolist(), ends.tolist(), strict=True):
                if not spans or first - last > self.gap:
                    spans.append({"column_number": len(spans), "x_start": first, "x_end": end})
                elif end > spans[-1]["x_end"] or spans[-1]["x_end"] != spans[-1]["x_end"]:  # as fmax, which passes over NaN
                    spans[-1]["x_end"] = end
                last = first
            self.last = last
            return
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(starts) > self.gap) + 1])
        furthest = np.fmax.reduceat(ends, cuts).tolist()
        spans = self.spans[-1]
        for k, (first, end) in enumerate(zip(starts[cuts].tolist(), furthest, strict=True)):
            if k == 0 and spans and not first - self.last > self.gap:
                end = float(np.fmax(spans[-1]["x_end"], end))
                spans[-1]["x_end"] = end
            else:
                spans.append({"column_number": len(spans), "x_start": first, "x_end": end})
        self.last = float(starts[-1])

    def down(self, tops: np.ndarray) -> None:
        """Distinct tops in order: one more than `tol` below the line's first opens the next line."""
        anchors, tol, n = self.anchors[-1], self.tol, len(tops)
        if n <= SMALL:
            for top in tops.tolist():
                if not anchors or top - anchors[-1] > tol:
                    anchors.append(top)
            return
        k = 0
        while k < n:
            if anchors:
                last = anchors[-1]
                low, k = k, max(k, int(np.searchsorted(tops, last + tol)))  # jumps over the line
                while k > low and tops[k - 1] - last > tol:  # the sum's rounding
                    k -= 1
                while k < n and not tops[k] - last > tol:
                    k += 1
                if k == n:
                    return
            anchors.append(float(tops[k]))
            k += 1

    def batch(self, whole: int) -> pa.RecordBatch:
        """The first `whole` pages as rows; the others stay."""
        out = pa.RecordBatch.from_arrays([
            pa.array(self.pages[:whole], pa.int64()), pa.array(self.spans[:whole], pa.list_(_SPAN)),
            pa.array(self.anchors[:whole], pa.list_(pa.float64())),
        ], names=["page_id", "spans", "anchors"])
        del self.pages[:whole], self.spans[:whole], self.anchors[:whole]
        return out


_SPAN = pa.struct([("column_number", pa.int64()), ("x_start", pa.float64()), ("x_end", pa.float64())])


def _walk(gap: float, tol: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frames = _Frames(gap, tol)
        for batch in batches:
            if not batch.num_rows:
                continue
            page, axis, v, end = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            cuts = np.flatnonzero((page[1:] != page[:-1]) | (axis[1:] != axis[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(page)], strict=True):
                own = int(page[a])
                if not frames.pages or frames.pages[-1] != own:
                    frames.begin(own)
                if axis[a]:
                    frames.down(v[a:b])
                else:
                    frames.across(v[a:b], end[a:b].astype(float))
            yield frames.batch(len(frames.pages) - 1)
        if frames.pages:
            yield frames.batch(len(frames.pages))

    return run


def page_frames(words: DataFrame, gap: float = GAP, tol: float = LINE_TOLERANCE, axes: str = "xy") -> DataFrame:
    """page_id, spans, anchors: the columns of each page and the tops that open its lines, from one scan of the words.

    A column begins at a word start more than ``gap`` points right of the one before and ends where its widest word
    ends; a word opens a line when it lies more than ``tol`` below the line's first word. Both depend on distinct
    positions only: repeats fall away on the map side, and a page's positions are then walked in order. ``axes`` leaves
    out what isn't wanted. page_id is a whole number; words without page or position open nothing.
    """
    page, end, none = F.col("page_id").cast("long").alias("page_id"), F.col("x1").cast("double"), F.lit(None).cast("double")
    spots = {
        "x": F.struct(F.lit(0).alias("axis"), F.col("x0").cast("double").alias("v"), end.alias("end")),
        "y": F.struct(F.lit(1).alias("axis"), F.col("top").cast("double").alias("v"), none.alias("end")),
    }
    spots = words.select(page, F.explode(F.array(*(spots[a] for a in axes))).alias("s")).select("page_id", "s.*")
    distinct = spots.filter("page_id IS NOT NULL AND v IS NOT NULL").groupBy("page_id", "axis", "v").agg(F.max("end").alias("end"))
    return distinct.repartition("page_id").sortWithinPartitions("page_id", "axis", "v").mapInArrow(
        _walk(gap, tol),
        "page_id long, spans array<struct<column_number:long,x_start:double,x_end:double>>, anchors array<double>",
    )


def detect_columns(words: DataFrame, gap: float = GAP) -> DataFrame:
    """Text columns per page; a column ends where its widest word ends."""
    spans = page_frames(words, gap, axes="x").select("page_id", F.explode("spans").alias("s")).select("page_id", "s.*")
    return spans.withColumn("width", F.col("x_end") - F.col("x_start"))


def column_spans(columns: DataFrame) -> DataFrame:
    """The few columns of a page as one short array."""
    return columns.groupBy("page_id").agg(
        F.sort_array(F.collect_list(F.struct("column_number", "x_start", "x_end"))).alias("spans")
    )


def _with_column(words: DataFrame) -> DataFrame:
    """The first spanning column of each word, looked up once; words in none fall away."""
    hit = F.filter("spans", lambda c: (c["x_start"] <= F.col("x0")) & (F.col("x0") <= c["x_end"]))
    keep = [c for c in words.columns if c != "spans"]
    return words.select(*keep, F.explode(F.slice(hit, 1, 1)).alias("_c")).select(
        *keep, F.col("_c.column_number").alias("column_number")
    )


def word_to_column(words: DataFrame, columns: DataFrame) -> DataFrame:
    """First column that spans the word's start; words in none are dropped. Columns travel
    as one array per page, so the join is on the page alone and no range join is needed."""
    return _with_column(words.join(column_spans(columns), "page_id"))


def _line_of_top() -> Column:
    return F.size(F.filter("anchors", lambda a: a <= F.col("top"))) - 1


def group_lines(words: DataFrame, tol: float = LINE_TOLERANCE) -> DataFrame:
    """Words with the 0-based number of their line, top to bottom."""
    lines = page_frames(words, tol=tol, axes="y").select("page_id", "anchors")
    return words.join(lines, "page_id").withColumn("line_number", _line_of_top()).drop("anchors")


def place_words(words: DataFrame, columns: DataFrame | None = None) -> DataFrame:
    """Words with their line, column and the number of columns of their page: one join to a per-page row."""
    if columns is None:
        frames = page_frames(words)
    else:
        frames = page_frames(words, axes="y").drop("spans").join(column_spans(columns), "page_id")
    lined = words.join(frames, "page_id").withColumns({"line_number": _line_of_top(), "n_columns": F.size("spans")})
    return _with_column(lined.drop("anchors"))


TEXT_STRIP = 16.0  # points of one line whose words are joined in one task
REGION = ["page_id", "line_number", "column_number"]


def _strips(placed: DataFrame, text: bool) -> DataFrame:
    """One row per strip of a region: counts, sums, box and spacing, and its words joined from left to right."""
    n_columns = [F.max("n_columns").alias("n_columns")] if "n_columns" in placed.columns else []
    item = F.struct("x0", "top", "word_id", "text") if text else F.struct("x0")
    strips = placed.groupBy(*REGION, F.floor(F.col("x0") / TEXT_STRIP).alias("_strip")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.coalesce(F.col("size"), F.lit(12)).cast("double")).alias("size"),
        F.min("x0").alias("x0"), F.max("x0").alias("_last"), F.min("top").alias("y0"),
        F.max("x1").alias("x1"), F.max("bottom").alias("y1"), *n_columns,
        F.sort_array(F.collect_list(item)).alias("_items"),
    )
    xs = F.transform("_items", lambda r: r["x0"])
    gaps = F.zip_with(F.slice(xs, 2, F.greatest(F.size(xs) - 1, F.lit(0))), F.slice(xs, 1, F.size(xs) - 1), lambda b, a: (b - a) * (b - a))
    squares = F.when(F.size("_items") < 2, 0.0).otherwise(F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g))
    out = strips.withColumn("_squares", squares)
    if text:
        words = F.transform("_items", lambda r: r["text"])
        chars = F.aggregate(words, F.lit(0), lambda s, w: s + F.coalesce(F.length(w), F.lit(0)) + 1)
        out = out.withColumns({"text": F.array_join(words, " "), "_chars": chars.cast("long")})
    return out.drop("_items")


def _summed() -> list[Column]:
    """Stats of a region from its strips."""
    n = F.sum("n")
    first, last = F.min("x0"), F.max("_last")
    return [
        n.alias("n_words"), (F.sum("size") / n).alias("mean_size"),
        first.alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        F.when(n > 1, (last - first) / (n - 1)).alias("mean_gap"),
        F.when(n > 1, F.sum(F.col("_squares") + F.col("_edge")) / (n - 1)).alias("mean_gap2"),
    ]


def _in_order():
    return W.partitionBy(*REGION).orderBy("_strip")


def _edged(strips: DataFrame) -> DataFrame:
    """With the squared gap between a strip's first word and the last one before it."""
    step = F.col("x0") - F.lag("_last").over(_in_order())
    return strips.withColumn("_edge", F.coalesce(step * step, F.lit(0.0)))


def region_stats(placed: DataFrame) -> DataFrame:
    """Word count, mean size, bounding box and spacing of each (line, column).

    Words are gathered in strips of ``TEXT_STRIP`` points, whose summaries are put in order per region; words of equal
    position count as zero gaps.
    """
    return _edged(_strips(placed, False)).groupBy(*REGION).agg(*_summed())


def region_type(stats: DataFrame) -> DataFrame:
    """``heading`` by mean word size, ``table`` by regular spacing, else ``text``."""
    variance = F.greatest(F.lit(0.0), F.col("mean_gap2") - F.col("mean_gap") * F.col("mean_gap"))
    regular = (F.col("n_words") > 3) & (F.sqrt(variance) < F.col("mean_gap") * 0.3)
    return stats.withColumn(
        "region_type",
        F.when(F.col("mean_size") > 14, "heading").when(F.coalesce(regular, F.lit(False)), "table").otherwise("text"),
    ).drop("mean_gap", "mean_gap2")


def line_regions(placed: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """Regions: the words of one column in one line, joined left to right, with bounding
    box and type. Text longer than ``part_chars`` continues in further parts.

    Stats and text come from one aggregate per strip; strips of a region are summed up and packed into parts in their
    order. Where words are dealt by page already (after the join of place_words), nothing is shuffled again.
    """
    n_columns = "n_columns" in placed.columns
    before = F.coalesce(F.sum("_chars").over(_in_order().rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    strips = _edged(_strips(placed, True)).withColumn("part", F.floor(before / part_chars).cast("int"))
    parts = strips.groupBy(*REGION, "part").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_strip", "text"))), lambda r: r["text"]), " ").alias("text"),
        F.sum("n").alias("n"), F.sum("size").alias("size"), F.min("x0").alias("x0"), F.max("_last").alias("_last"),
        F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.sum("_squares").alias("_squares"),
        F.sum("_edge").alias("_edge"), *([F.max("n_columns").alias("n_columns")] if n_columns else []),
    )
    whole = W.partitionBy(*REGION)
    n, first, last = F.sum("n").over(whole), F.min("x0").over(whole), F.max("_last").over(whole)
    sized = parts.select(
        *REGION, "part", "text", n.alias("n_words"), (F.sum("size").over(whole) / n).alias("mean_size"), first.alias("x0"),
        *(f.over(whole).alias(c) for c, f in (("y0", F.min("y0")), ("x1", F.max("x1")), ("y1", F.max("y1")))),
        F.when(n > 1, (last - first) / (n - 1)).alias("mean_gap"),
        F.when(n > 1, F.sum(F.col("_squares") + F.col("_edge")).over(whole) / (n - 1)).alias("mean_gap2"),
        *(["n_columns"] if n_columns else []),
    )
    return region_type(sized).withColumns({"width": F.col("x1") - F.col("x0"), "height": F.col("y1") - F.col("y0")})


def reading_order(regions: DataFrame, columns: DataFrame | None = None) -> DataFrame:
    """0-based order: top to bottom on one-column pages, else column by column.

    regions carry the ``n_columns`` of their page, or ``columns`` are counted for it. A page has at most as many regions
    as lines times columns; they are sorted in one task, which may spill.
    """
    if columns is not None:
        regions = regions.drop("n_columns").join(columns.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_columns")), "page_id")
    column = F.when(F.col("n_columns") <= 1, F.lit(0)).otherwise(F.col("column_number"))
    in_order = W.partitionBy("page_id").orderBy(column, "y0", "x0", "line_number", "part")
    return regions.withColumn("reading_order", F.row_number().over(in_order).cast("long") - 1).drop("n_columns")


def page_profile(columns: DataFrame, tables: DataFrame) -> DataFrame:
    """page_id, n_columns, n_tables of every page that has columns or tables; either may be missing."""
    wide = columns.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_columns"))
    held = tables.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_tables"))
    return wide.join(held, "page_id", "full_outer").na.fill(0, ["n_columns", "n_tables"])


def structure_analysis(pages: DataFrame) -> DataFrame:
    """Column and table profile of each document."""
    many = F.col("n_columns") > 1
    return pages.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("total_pages"),
        F.count_if(many).alias("multi_column_pages"),
        F.count_if(~many).alias("single_column_pages"),
        F.count_if(F.col("n_tables") > 0).alias("pages_with_tables"),
        F.sum("n_tables").alias("total_tables"),
        F.round(F.coalesce(F.avg("n_columns"), F.lit(0.0)), 6).alias("average_columns"),
        (F.size(F.collect_set("n_columns")) <= 2).alias("column_consistency"),
    )


def table_rows_filter(tables: DataFrame, min_rows: int = 2) -> DataFrame:
    """Rows with a non-blank cell, tables with enough of them, width of the first such row."""
    kept = F.filter("cells", lambda row: F.exists(row, lambda c: c.isNotNull() & ~T.is_blank(c)))
    return (
        tables.withColumn("cells", kept)
        .filter(F.size("cells") >= min_rows)
        .withColumns({"n_rows": F.size("cells"), "n_columns": F.size(F.col("cells")[0])})
    )
