import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.operators import layout as ops
from quire.session import prepare

WORD = "page_id long, word_id long, text string, x0 double, x1 double, top double, bottom double, size int"


def word(page, i, x0, top, width=5.0, size=None):
    return (page, i, f"w{i}", float(x0), float(x0 + width), float(top), float(top + 8), size)


def brute_columns(words):
    xs = sorted({w[3] for w in words})
    groups, start = [], 0
    for i in range(1, len(xs) + 1):
        if i == len(xs) or xs[i] - xs[i - 1] > 20:
            groups.append((xs[start], xs[i - 1]))
            start = i
    return [(a, max(w[4] for w in words if a <= w[3] <= b)) for a, b in groups]


def brute_lines(words):
    lines, anchor, n = {}, None, -1
    for w in sorted(words, key=lambda w: (w[5], w[3])):
        if anchor is None or abs(w[5] - anchor) > 5:
            anchor, n = w[5], n + 1
        lines[w[1]] = n
    return lines


def test_column_gap_of_exactly_twenty(spark):
    df = spark.createDataFrame([word(1, i, x, 0) for i, x in enumerate([0, 20, 41])], WORD)
    got = sorted((r.column_number, r.x_start, r.x_end) for r in ops.detect_columns(df).collect())
    assert got == [(0, 0.0, 25.0), (1, 41.0, 46.0)]


def test_wide_column_wins_the_overlap(spark):
    df = spark.createDataFrame([word(1, 0, 0, 0, 60), word(1, 1, 50, 0)], WORD)
    got = {r.word_id: r.column_number for r in ops.word_to_column(df, ops.detect_columns(df)).collect()}
    assert got == {0: 0, 1: 0}


def test_line_anchor_does_not_drift(spark):
    df = spark.createDataFrame([word(1, i, 0, t) for i, t in enumerate([0, 4, 8])], WORD)
    assert {r.word_id: r.line_number for r in ops.group_lines(df).collect()} == {0: 0, 1: 0, 2: 1}


def test_columns_and_lines_match_brute_force_with_one_crowded_page(spark):
    rnd = random.Random(2)
    words, i = [], 0
    for page, n in [(0, 1500), (1, 40), (2, 1), (3, 300)]:
        for _ in range(n):
            words.append(word(page, i, rnd.choice([rnd.randrange(0, 120), rnd.randrange(300, 900)]) / 1.5, rnd.randrange(0, 1500) / 2))
            i += 1
    df = spark.createDataFrame(words, WORD).repartition(6)
    cols, lines = {}, {}
    for r in ops.detect_columns(df).collect():
        cols.setdefault(r.page_id, []).append((r.column_number, r.x_start, r.x_end))
    for r in ops.group_lines(df).collect():
        lines[r.word_id] = r.line_number
    for page in range(4):
        mine = [w for w in words if w[0] == page]
        assert [x[1:] for x in sorted(cols[page])] == brute_columns(mine)
        want = brute_lines(mine)
        assert {k: lines[k] for k in want} == want


def regions(spark, words, **kw):
    df = spark.createDataFrame(words, WORD)
    return ops.line_regions(ops.place_words(df), **kw)


def test_region_types(spark):
    table = [word(1, i, x, 0) for i, x in enumerate([0, 10, 20, 30])]
    loose = [word(2, i, x, 0) for i, x in enumerate([0, 1, 12, 30])]
    three = [word(3, i, x, 0) for i, x in enumerate([0, 10, 20])]
    big = [word(4, i, x, 0, size=15) for i, x in enumerate([0, 10, 20, 30])]
    got = {r.page_id: (r.region_type, r.text) for r in regions(spark, table + loose + three + big).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "table", 2: "text", 3: "text", 4: "heading"}
    assert got[1][1] == "w0 w1 w2 w3"


def test_equal_positions_count_as_zero_gaps(spark):
    words = [word(1, i, x, 0) for i, x in enumerate([0, 0, 10, 10, 20])]
    r = regions(spark, words).first()
    assert (r.n_words, r.region_type, r.text) == (5, "text", "w0 w1 w2 w3 w4")


def test_long_region_text_continues_in_parts(spark):
    words = [word(1, i, i % 15 * 12, 0) for i in range(300)]
    parts = sorted((r.part, r.text) for r in regions(spark, words, part_chars=100).collect())
    want = " ".join(w[2] for w in sorted(words, key=lambda w: (w[3], w[5], w[1])))
    assert len(parts) > 3 and " ".join(t for _, t in parts) == want


def test_reading_order_by_column(spark):
    words = [word(1, 0, 0, 0), word(1, 1, 200, 0), word(1, 2, 0, 50), word(1, 3, 200, 50)]
    df = spark.createDataFrame(words, WORD)
    columns = ops.detect_columns(df)
    got = ops.reading_order(ops.line_regions(ops.place_words(df, columns)), columns).orderBy("reading_order").collect()
    assert [r.text for r in got] == ["w0", "w2", "w1", "w3"]
    assert [r.reading_order for r in got] == [0, 1, 2, 3]


def test_table_rows(spark):
    cells = [[["a", None], [" ", ""], ["b", "c"]], [["x"], ["　"]]]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "page_id int, cells array<array<string>>")
    got = [(r.page_id, r.n_rows, r.n_columns) for r in ops.table_rows_filter(df).collect()]
    assert got == [(0, 2, 2)]


def folded(tops, tol=5):
    anchors = []
    for t in tops:
        if not anchors or t - anchors[-1] > tol:
            anchors.append(t)
    return anchors


@pytest.mark.parametrize("batch", [1, 7, 1000])
def test_frames_do_not_depend_on_batches(batch):
    rnd = random.Random(batch)
    rows = []
    for page in range(12):
        for axis in (0, 1):
            size = rnd.choice([1, 3, 40, 200])
            if rnd.random() < 0.9:
                rows += [(page, axis, v / 10, v / 10 + 3 if rnd.random() < 0.9 else None) for v in sorted(rnd.sample(range(4000), size))]
    arrays = [pa.array([r[k] for r in rows], t) for k, t in enumerate([pa.int64(), pa.int32(), pa.float64(), pa.float64()])]
    table = pa.RecordBatch.from_arrays(arrays, names=["page_id", "axis", "v", "end"])
    out = [r for b in ops._walk(20.0, 5.0)(table.slice(k, batch) for k in range(0, len(rows), batch)) for r in b.to_pylist()]
    assert [r["page_id"] for r in out] == sorted({r[0] for r in rows})
    for r in out:
        assert r["anchors"] == folded([x[2] for x in rows if x[:2] == (r["page_id"], 1)])
        spans, last = [], None
        for _, _, v, end in (x for x in rows if x[:2] == (r["page_id"], 0)):
            if last is None or v - last > 20:
                spans.append([v, end])
            elif end is not None:
                spans[-1][1] = end if spans[-1][1] is None else max(spans[-1][1], end)
            last = v
        assert [[s["x_start"], None if s["x_end"] != s["x_end"] else s["x_end"]] for s in r["spans"]] == spans


def test_a_page_of_a_million_distinct_tops(spark):
    df = spark.range(1_000_000).selectExpr("7L as page_id", "id as word_id", "'w' as text", "0D as x0", "5D as x1", "id / 1000 as top", "id / 1000 + 8 as bottom", "10 as size")
    (row,) = ops.page_frames(df, axes="y").collect()
    assert row.anchors == folded([k / 1000 for k in range(1_000_000)])
    lines = {r.line_number: r.n for r in ops.group_lines(df).groupBy("line_number").agg(F.count("*").alias("n")).collect()}
    assert len(lines) == len(row.anchors) and sum(lines.values()) == 1_000_000


def test_one_crowded_region_spreads_over_strips(spark):
    words = [word(1, i, (i * 37) % 2000 / 2, 0) for i in range(4000)]  # 1,000 points wide, starts at half points
    parts = sorted(regions(spark, words, part_chars=3000).collect(), key=lambda r: r.part)
    ordered = sorted(words, key=lambda w: (w[3], w[5], w[1]))
    assert len(parts) > 3 and " ".join(r.text for r in parts) == " ".join(w[2] for w in ordered)
    starts = [w[3] for w in ordered]
    gaps = [b - a for a, b in zip(starts, starts[1:])]
    (s,) = ops.region_stats(ops.place_words(spark.createDataFrame(words, WORD))).collect()
    assert abs(s.mean_gap - sum(gaps) / len(gaps)) < 1e-9 and abs(s.mean_gap2 - sum(g * g for g in gaps) / len(gaps)) < 1e-9
    assert {(r.n_words, r.x0, r.x1, r.mean_size) for r in parts} == {(4000, 0.0, 1004.5, 12.0)}


def test_regions_and_order_take_two_scans(spark, tmp_path):
    spark.createDataFrame([word(p, i, i * 9, i * 7) for p in range(5) for i in range(9)], WORD).write.parquet(str(tmp_path / "w"))
    words = spark.read.parquet(str(tmp_path / "w"))
    plan = ops.reading_order(ops.line_regions(ops.place_words(words)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2


def test_page_profile_keeps_pages_of_either_side(spark):
    columns = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "page_id long, column_number int")
    tables = spark.createDataFrame([(2, 5), (3, 5), (3, 6)], "page_id long, n_rows int")
    got = sorted(tuple(r) for r in ops.page_profile(columns, tables).collect())
    assert got == [(1, 2, 0), (2, 1, 1), (3, 0, 2)]


@pytest.mark.parametrize("small", [0, 64])
def test_short_pages_walked_one_by_one_give_the_same_frames(monkeypatch, small):
    monkeypatch.setattr(ops, "SMALL", small)
    frames = ops._Frames(20.0, 5.0)
    frames.begin(1)
    nan = float("nan")
    frames.across(np.array([0.0, 10, 50, 60]), np.array([nan, 18, 58, 55]))
    frames.across(np.array([70.0, 100]), np.array([90.0, nan]))
    frames.down(np.array([0.0, 5, 6, 11]))
    frames.down(np.array([11.5, 20]))
    spans = [(s["column_number"], s["x_start"], s["x_end"]) for s in frames.spans[0]]
    assert spans[:2] == [(0, 0.0, 18.0), (1, 50.0, 90.0)] and spans[2][:2] == (2, 100.0) and np.isnan(spans[2][2])
    assert frames.anchors == [[0.0, 6.0, 11.5, 20.0]]


def test_shares_of_a_task_follow_sizes_not_the_partition_number(spark, tmp_path):
    """Shuffles begin with many partitions and scans with small splits, whatever number of partitions is set."""
    prepare(spark)
    rows = spark.range(0, 3_000_000, numPartitions=4).select((F.col("id") % 500_000).alias("page_id"), F.xxhash64("id").alias("x"))
    dealt = rows.repartition("page_id").sortWithinPartitions("page_id")
    sizes = dealt.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.coalesce(1).write.option("parquet.block.size", 2 << 20).parquet(str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).rdd.getNumPartitions() >= 3
