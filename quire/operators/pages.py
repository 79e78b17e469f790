"""One summary row per page, from a single pass over its blocks, that all chapter detectors read.

The pass folds slices of a page first and slices into pages then, so a crowded page spreads over tasks. A row holds
counts, sums and three short texts, whatever the page's size; ``saved`` writes the rows to the shared folder, where
every detector reads the columns it needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quire.functions import text as T
from quire.session import work_path

BLOCKS_PER_SLICE = 1000
PAGE = ["doc_id", "page_num"]


def saved(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder, read back: computed once, and safe from lost executors."""
    path = work_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _start(items: Column, chars: int) -> Column:
    """The first characters of sorted (order, t) rows joined by blanks: each adds one at least, so as many rows suffice.
    Null without any text."""
    texts = F.filter(F.transform(items, lambda r: r["t"]), lambda t: t.isNotNull())
    return F.when(F.size(texts) > 0, F.substring(F.array_join(F.slice(texts, 1, chars), " "), 1, chars))


def page_starts(blocks: DataFrame, chars: int) -> DataFrame:
    """doc_id, page_num, start: the first ``chars`` characters of each page's blocks in order, joined by blanks.

    No block sends more than that many characters, and no slice of a page either.
    """
    cut = blocks.select(
        *PAGE, F.floor(F.col("block_id") / BLOCKS_PER_SLICE).alias("_slice"), "block_id", F.substring("text", 1, chars).alias("t")
    )
    slices = cut.repartition(*PAGE, "_slice").groupBy(*PAGE, "_slice").agg(
        F.sort_array(F.collect_list(F.struct("block_id", "t"))).alias("items")
    ).select(*PAGE, "_slice", _start(F.col("items"), chars).alias("t"))
    items = F.sort_array(F.collect_list(F.struct("_slice", "t")))
    return slices.groupBy(*PAGE).agg(items.alias("items")).select(
        *PAGE, F.coalesce(_start(F.col("items"), chars), F.lit("")).alias("start")
    )


def page_summary(blocks: DataFrame, top: float = 200, chars: int = 100) -> DataFrame:
    """doc_id, page_num and, per page:

    n_sizes, size_sum, max_size (of positive font sizes), n_chars, heading (the largest bold block that reads like a
    heading, the first of equals), top_block (the largest block above ``top``), start (the first ``chars`` characters).
    """
    likely = F.col("is_bold") & F.col("font_size").isNotNull() & (F.length(T.ustrip("text")) > 2) & T.heading_likely("text")
    size = F.when(F.col("font_size") > 0, F.col("font_size"))
    marked = blocks.select(
        *PAGE, F.floor(F.col("block_id") / BLOCKS_PER_SLICE).alias("_slice"), "block_id", "font_size", size.alias("size"),
        "text", F.length("text").alias("chars"), F.coalesce(likely, F.lit(False)).alias("likely"),
        F.coalesce(F.col("y0") < top, F.lit(False)).alias("high"),
    )
    # texts travel whole only where a detector may ask for them
    dealt = marked.withColumns({
        "t": F.substring("text", 1, chars), "text": F.when(F.col("likely") | F.col("high"), F.col("text")),
    }).repartition(*PAGE, "_slice")
    order = F.struct(-F.col("font_size"), F.col("block_id"))
    spot = F.struct("block_id", "text", "font_size")
    slices = dealt.groupBy(*PAGE, "_slice").agg(
        F.count("size").alias("n_sizes"), F.sum("size").alias("size_sum"), F.max("size").alias("max_size"),
        F.sum("chars").alias("n_chars"),
        F.min_by(spot, F.when(F.col("likely"), order)).alias("heading"),
        F.min_by(spot, F.when(F.col("high"), order)).alias("top_block"),
        F.sort_array(F.collect_list(F.struct("block_id", "t"))).alias("items"),
    ).withColumn("t", _start(F.col("items"), chars)).drop("items")

    def best(name: str) -> Column:
        order = F.struct(-F.col(f"{name}.font_size"), F.col(f"{name}.block_id"))
        return F.min_by(name, F.when(F.col(name).isNotNull(), order)).alias(name)

    return slices.groupBy(*PAGE).agg(
        F.sum("n_sizes").alias("n_sizes"), F.sum("size_sum").alias("size_sum"), F.max("max_size").alias("max_size"),
        F.sum("n_chars").alias("n_chars"), best("heading"), best("top_block"),
        F.sort_array(F.collect_list(F.struct("_slice", "t"))).alias("items"),
    ).withColumn("start", F.coalesce(_start(F.col("items"), chars), F.lit(""))).drop("items")
