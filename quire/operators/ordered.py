"""Ordered work over keys of any size.

A window or a ``collect_list`` over one hot key would put that key into one
task. The jobs here cut a key into *slices*: coarse expressions that rise with
the sort order (a block of pages, a strip of a page, an hour). Rows of a slice
stay together, slices of one key spread over tasks, and only one summary row per
slice is ever put in order per key.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quire.session import work_path

PART_CHARS = 16_000_000  # size of one assembled text part


def _slice_names(slices: Sequence[Column]) -> list[str]:
    return [f"_s{i}" for i in range(len(slices))]


def _same_keys(rows: DataFrame, other: DataFrame, names: Sequence[str]) -> DataFrame:
    """Inner join on equal names, where null equals null."""
    renamed = other.withColumnsRenamed({n: f"_o{i}" for i, n in enumerate(names)})
    same = [rows[n].eqNullSafe(renamed[f"_o{i}"]) for i, n in enumerate(names)]
    return rows.join(renamed, same).drop(*(f"_o{i}" for i in range(len(names))))


def number_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], slices: Sequence[Column], out: str,
    ahead: tuple[str, str] | None = None,
) -> DataFrame:
    """1-based position of each row within ``keys`` by ``order``; with ``ahead=(value, name)``
    also ``value`` of the following row (null on the last).

    ``slices`` must not fall when ``order`` rises. Counts per slice are pre-aggregated on
    the map side; a running sum over them gives each slice its offset, and row numbers are
    taken inside slices only. The row after a slice's end is the first of the next slice.
    """
    keys = list(keys)
    names = _slice_names(slices)
    cut = df.withColumns(dict(zip(names, slices)))
    per_key = W.partitionBy(*keys).orderBy(*names)
    summary = [F.count(F.lit(1)).alias("_n")]
    if ahead:
        summary.append(F.min_by(F.col(ahead[0]), F.struct(*order)).alias("_first"))
    offsets = cut.groupBy(*keys, *names).agg(*summary)
    before = F.sum("_n").over(per_key.rowsBetween(W.unboundedPreceding, -1))
    offsets = offsets.withColumn("_before", F.coalesce(before, F.lit(0)))
    if ahead:
        offsets = offsets.withColumn("_edge", F.lead("_first").over(per_key)).drop("_first")
    inner = W.partitionBy(*keys, *names).orderBy(*order)
    placed = _same_keys(cut, offsets.drop("_n"), [*keys, *names])
    numbered = placed.withColumn(out, F.col("_before") + F.row_number().over(inner))
    if ahead:
        numbered = numbered.withColumn(ahead[1], F.coalesce(F.lead(ahead[0]).over(inner), F.col("_edge"))).drop("_edge")
    return numbered.drop("_before", *names)


def _count_up(keys: int):
    """Adds the task's number and each row's position within its key to sorted rows, whose first columns are the keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        last, count = None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            begins = np.zeros(n, bool)
            for k in range(keys):
                code = pc.dictionary_encode(batch.column(k), null_encoding="encode").indices.to_numpy()
                begins[1:] |= code[1:] != code[:-1]
            first, final = (tuple(batch.column(k)[i].as_py() for k in range(keys)) for i in (0, n - 1))
            begins[0] = last is None or first != last
            at = np.arange(n)
            start = np.maximum.accumulate(np.where(begins, at, -1))
            position = np.where(start >= 0, at - start, at + count) + 1
            last, count = final, int(position[-1])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(n, task, np.int32)), pa.array(position)],
                names=[*batch.schema.names, "_task", "_k"],
            )

    return run


def number_by_range(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """1-based position of each row within ``keys`` by the columns ``order`` (nulls first).

    Rows are dealt by ranges of (keys, order), whose bounds Spark samples, so tasks get equal shares however the rows of a
    key are spread. Each task counts its rows in order; the counted rows are written to the shared folder. Only the first
    key of a task can have begun before it: what came before is one number per task, looked up on the driver.
    """
    spark, rest = df.sparkSession, [c for c in df.columns if c not in keys]
    rows = df.select(*keys, *rest).repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    path = work_path(spark, "numbered")
    rows.mapInArrow(_count_up(len(keys)), f"{fields}, _task int, _k long").write.parquet(path)
    counted = spark.read.schema(f"{fields}, _task int, _k long").parquet(path)
    key = F.struct(*keys)
    ends = counted.groupBy("_task").agg(
        F.min(key).alias("first"), F.max(key).alias("last"), F.max_by("_k", F.struct(key.alias("k"), "_k")).alias("n")
    )
    before, carried, running = [], 0, None
    for r in sorted(ends.collect(), key=lambda r: r["_task"]):  # a row per task
        own = carried if running is not None and running == r["first"] else 0
        if own:
            before.append((r["_task"], own))
        carried, running = r["n"] + (own if r["first"] == r["last"] else 0), r["last"]
    number = F.col("_k")
    if before:
        firsts = ends.select("_task", F.col("first").alias("_first"))
        known = F.broadcast(spark.createDataFrame(before, "_task int, _before long").join(firsts, "_task"))
        counted = counted.join(known, "_task", "left")
        number = number + F.when(key.eqNullSafe(F.col("_first")), F.col("_before")).otherwise(0)
    return counted.withColumn(out, number).select(*df.columns, out)


def assemble_text(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    text: str,
    slices: Sequence[Column],
    sep: str = " ",
    out: str = "text",
    part_chars: int = PART_CHARS,
) -> DataFrame:
    """Join the texts of a key in order, as ``keys, part, out``.

    The characters of each slice are summed first (numbers only), a running sum per key packs
    slices in order into parts of about ``part_chars`` characters, and texts are gathered once,
    by key and part. A key of ordinary size has the single part 0; the parts of a larger one,
    joined by ``sep``, are its whole text. A task holds ``part_chars`` characters and one slice
    at most, so slices must be small next to ``part_chars``.
    """
    keys = list(keys)
    names = _slice_names(slices)
    cut = df.withColumns(dict(zip(names, slices)))
    sizes = cut.groupBy(*keys, *names).agg(F.sum(F.coalesce(F.length(text), F.lit(0)) + len(sep)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*keys).orderBy(*names).rowsBetween(W.unboundedPreceding, -1))
    parts = sizes.withColumn("part", F.floor(F.coalesce(before, F.lit(0)) / part_chars).cast("int")).drop("_n")
    placed = _same_keys(cut, parts, [*keys, *names])
    rows = F.sort_array(F.collect_list(F.struct(*names, *order, F.col(text).alias("_t"))))
    return (
        placed.repartition(*keys, "part")  # gathering does not shrink the data: do it after the shuffle only
        .groupBy(*keys, "part")
        .agg(F.array_join(F.transform(rows, lambda r: r["_t"]), sep).alias(out))
    )


def whole_text(parts: DataFrame, keys: Sequence[str], sep: str = " ", text: str = "text") -> DataFrame:
    """The parts of assemble_text as one text per key; a row holds at most 2 GB, and a task holds the rows it makes."""
    rows = F.sort_array(F.collect_list(F.struct("part", F.col(text).alias("_t"))))
    whole = F.array_join(F.transform(rows, lambda r: r["_t"]), sep)
    return parts.repartition(*keys).groupBy(*keys).agg(F.lit(0).alias("part"), whole.alias(text))


def first_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The row that sorts first per key, as a partial aggregate (no sort, no window)."""
    rest = [c for c in df.columns if c not in keys]
    picked = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(picked).select(*keys, "_row.*").select(*df.columns)


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows per key. The rank filter is applied before the shuffle
    as well (window group limit), so a hot key sends at most ``n`` rows per task."""
    name = rank or "_rank"
    ranked = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= n)
    return ranked if rank else ranked.drop(name)
