"""Quality rules with cross-document line frequency, in DataFrame functions only.

Method. Lines are normalised and hashed; for every host the number of documents that hold a line is counted; lines
in more documents than the limits allow are removed; documents that keep too little are rejected. Besides, every
document has its own base counts.

The texts are read once: counts and line hashes per document go to a table of the shared folder. Line counts are
sums with map-side combine, so a line of very many documents costs one row per task; only lines above the limits
take part in the join back, which Spark splits where a line is hot. line_rules() gives counts and verdicts,
without_frequent_lines() the documents that stay, without those lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.store import written

#: A line is removed if more than LINE_DOCUMENTS documents of a host, and more than LINE_SHARE of them, hold it.
LINE_DOCUMENTS = 20
LINE_SHARE = 0.001
#: A document is depleted if fewer words than this, or a smaller share of its words than this, are left.
LEFT_WORDS = 10
LEFT_SHARE = 0.3

WINDOW = 5
_SPACE = " \t\n\x0b\x0c\r"
_SPACES = r"[\x20\x09-\x0D]+"
_SYMBOLS = "#*$%&|<>"


def let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, _SPACES), lambda w: w != "")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words covered by windows that occur twice or more in the array, the first occurrence included."""

    def windows(hashes: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(hashes) - window)
        return F.transform(starts, lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(window))))

    def covered(starts: Column) -> Column:
        last = F.size(starts) - 1
        return F.aggregate(
            F.sequence(F.lit(0), last), F.lit(0).cast("long"),
            lambda n, k: n + F.when(k == last, F.lit(window)).otherwise(
                F.least(F.lit(window), F.get(starts, k + 1) - F.get(starts, k))
            ).cast("long"),
        )

    def repeats(grams: Column) -> Column:
        ordered = F.array_sort(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(ordered, lambda s: let(F.array_sort(F.transform(
            F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: (
                F.coalesce(F.get(s, k)["h"] == F.get(s, k + 1)["h"], F.lit(False))
                | F.coalesce(F.get(s, k)["h"] == F.get(s, k - 1)["h"], F.lit(False))
            )),
            lambda k: F.get(s, k)["i"],
        )), covered))

    def count(grams: Column) -> Column:
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("long")).otherwise(repeats(grams))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return let(hashes, lambda h: F.when(F.size(h) < window, F.lit(0).cast("long")).otherwise(let(windows(h), count)))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def has_words(line: Column) -> Column:
    return F.translate(line, _SPACE, "") != ""


def line_hash(line: Column) -> Column:
    """Of the line in lower case, with white space collapsed."""
    return F.xxhash64(F.lower(F.regexp_replace(F.trim(F.translate(line, "\t\x0b\x0c\r", "    ")), " +", " ")))


def line_rows(text: Column) -> Column:
    """(h, words, first) of each line with a word: hash of the normalised line, words, first of its kind in the text."""
    hashed = F.array_sort(F.transform(F.filter(lines_of(text), has_words), lambda x: F.struct(
        line_hash(x).alias("h"), F.size(words_of(x)).alias("words"),
    )))
    return let(hashed, lambda s: F.transform(s, lambda x, i: F.struct(
        x["h"].alias("h"), x["words"].alias("words"),
        F.coalesce(F.get(s, i - 1)["h"] != x["h"], F.lit(True)).alias("first"),
    )))


def without_places(items: Column, places: Column) -> Column:
    """The array without the items at `places` (ascending, from 0), in one pass: what lies between them, put together."""
    last = F.size(places)

    def between(k: Column) -> Column:
        first = F.when(k == 0, F.lit(0)).otherwise(F.get(places, k - 1) + 1)
        stop = F.when(k == last, F.size(items)).otherwise(F.get(places, k))
        return F.slice(items, first + 1, stop - first)

    return F.flatten(F.transform(F.sequence(F.lit(0), last), between))


def _source(row: Column, doc_id: Column, host: Column, text: Column) -> list[Column]:
    return [
        row.alias("row"), doc_id.cast("long").alias("doc_id"), host.cast("string").alias("host"),
        F.coalesce(text.cast("string"), F.lit("")).alias("text"),
    ]


def base_counts(source: DataFrame) -> DataFrame:
    """row, doc_id, host, the base counts and lines of every row of row, doc_id, host, text."""
    text = F.col("text")
    plain = F.filter(lines_of(text), has_words)
    dup = let(F.transform(plain, lambda x: F.xxhash64(x)), lambda h: F.size(h) - F.size(F.array_distinct(h)))
    both = let(words_of(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")
    ))
    return source.select(
        "row", "doc_id", "host", both.alias("w"),
        F.length(F.translate(text, _SPACE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        dup.cast("long").alias("n_dup_lines"), line_rows(text).alias("lines"),
    ).select("row", "doc_id", "host", "w.*", "word_chars", "n_symbols", "n_dup_lines", "lines")


def lines_above(base: DataFrame, lines: DataFrame, line_documents: int, line_share: float) -> DataFrame:
    """host, h of the lines that more documents of the host hold than the limits allow."""
    hosts = base.groupBy("host").agg(F.count("*").alias("documents"))
    counts = lines.groupBy("host", "h").agg(F.sum(F.col("first").cast("long")).alias("n"))
    above = counts.filter(F.col("n") > line_documents).join(hosts, "host").filter(
        F.col("n") > line_share * F.col("documents")
    )
    return above.select("host", "h")


def _judged(base: DataFrame, lines: DataFrame, above: DataFrame, left_words: int, left_share: float) -> DataFrame:
    gone = lines.join(above, ["host", "h"]).groupBy("row").agg(
        F.sum(F.col("words").cast("long")).alias("n_removed_words")
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    left = F.col("n_words") - F.col("n_removed_words")
    depleted = (left < left_words) | (left < left_share * F.col("n_words"))
    return (
        base.drop("lines", "host").join(gone, "row", "left")
        .withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0).cast("long")))
        .select(
            "row", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_words",
            failed.alias("base_failed"), (~failed & ~depleted).alias("kept"),
        )
    )


def _counted(source: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The written base counts of source, and its lines: row, host, h, words, first."""
    base = written(base_counts(source), "line-counts").withColumn("host", F.coalesce("host", F.lit("")))
    lines = base.select("row", "host", F.explode("lines").alias("x"))
    return base, lines.select("row", "host", "x.h", "x.words", "x.first")


def line_rules(
    docs: DataFrame,
    line_documents: int = LINE_DOCUMENTS,
    line_share: float = LINE_SHARE,
    left_words: int = LEFT_WORDS,
    left_share: float = LEFT_SHARE,
) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_removed_words, base_failed, kept.

    docs: doc_id, text, source (the host); other columns are ignored. A null text has no words and fails the base
    rule. Lines are compared after lower-casing and with white space collapsed; a line counts once per document.
    Documents without a host form a host of their own. kept is false where base_failed, and where the lines above
    the limits leave fewer than left_words words or less than left_share of the words. Repeated rows count as
    documents of their own and all come out, as do rows without doc_id; an empty table gives no rows.
    """
    source = docs.select(*_source(F.monotonically_increasing_id(), F.col("doc_id"), F.col("source"), F.col("text")))
    base, lines = _counted(source)
    above = lines_above(base, lines, line_documents, line_share)
    return _judged(base, lines, above, left_words, left_share).drop("row")


def without_frequent_lines(
    docs: DataFrame,
    line_documents: int = LINE_DOCUMENTS,
    line_share: float = LINE_SHARE,
    left_words: int = LEFT_WORDS,
    left_share: float = LEFT_SHARE,
    kept_only: bool = True,
) -> DataFrame:
    """The rows of docs that line_rules() keeps, with the lines above the limits cut out of their texts.

    All columns of docs come back under their own names; text is a string, null where it was null, the other columns
    are as given. Lines that stay keep their characters and order, joined by \\n; blank lines stay. With kept_only
    false the rejected rows come too, cut alike. Repeated rows and rows without doc_id are rows of their own; an empty
    table gives no rows. The rows are written to the shared folder, under the numbers that their counts refer to;
    of a text only the places of its removed lines are gathered.
    """
    given = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    rows = written(docs.select(F.monotonically_increasing_id().alias("row"), given.alias("doc")), "line-rows")
    source = rows.select(*_source(F.col("row"), F.col("doc.doc_id"), F.col("doc.source"), F.col("doc.text")))
    base, lines = _counted(source)
    above = written(lines_above(base, lines, line_documents, line_share), "lines-above")
    placed = source.select(
        "row", F.coalesce("host", F.lit("")).alias("host"), F.posexplode(lines_of(F.col("text"))).alias("place", "line")
    ).filter(has_words(F.col("line"))).select("row", "host", "place", line_hash(F.col("line")).alias("h"))
    places = placed.join(above, ["host", "h"]).groupBy("row").agg(F.array_sort(F.collect_list("place")).alias("places"))
    out = rows.join(places, "row", "left")
    if kept_only:
        out = out.join(_judged(base, lines, above, left_words, left_share).filter("kept").select("row"), "row", "left_semi")
    text = F.col("doc.text").cast("string")
    cut = F.when(F.col("places").isNull(), text).otherwise(
        let(lines_of(text), lambda x: F.array_join(without_places(x, F.col("places")), "\n"))
    )
    return out.select(*(cut.alias(c) if c == "text" else F.col(f"doc.`{c}`") for c in docs.columns))
