import random

import pytest
from pyspark.sql import functions as F

from quire.operators.ordered import assemble_text, first_row, number_by_range, number_rows, top_rows


def rows(n=3000):
    """Two thirds of all rows belong to one key."""
    rnd = random.Random(7)
    return [(0 if rnd.random() < 0.66 else rnd.randrange(1, 20), rnd.randrange(500), i) for i in range(n)]


def frame(spark, data):
    return spark.createDataFrame(data, "k int, v int, id int").repartition(7)


def by_key(data):
    out = {}
    for k, v, i in data:
        out.setdefault(k, []).append((v, i))
    return {k: sorted(x) for k, x in out.items()}


def test_number_rows_and_next_row(spark):
    data = rows()
    slices = [F.floor(F.col("v") / 16)]
    order = [F.col("v"), F.col("id")]
    got = number_rows(frame(spark, data), ["k"], order, slices, "n", ahead=("v", "nxt")).collect()
    want = {}
    for k, items in by_key(data).items():
        for n, (v, i) in enumerate(items):
            want[i] = (n + 1, items[n + 1][0] if n + 1 < len(items) else None)
    assert {r.id: (r.n, r.nxt) for r in got} == want


def test_first_and_top(spark):
    data = rows()
    firsts = {r.k: (r.v, r.id) for r in first_row(frame(spark, data), ["k"], [F.col("v"), F.col("id")]).collect()}
    assert firsts == {k: x[0] for k, x in by_key(data).items()}
    tops = {}
    for r in top_rows(frame(spark, data), ["k"], [F.col("v"), F.col("id")], 3, "rank").collect():
        tops.setdefault(r.k, []).append((r.rank, r.v, r.id))
    assert {k: [x[1:] for x in sorted(v)] for k, v in tops.items()} == {k: x[:3] for k, x in by_key(data).items()}


def test_top_rows_prune_before_the_shuffle(spark):
    plan = top_rows(frame(spark, rows(50)), ["k"], [F.col("v"), F.col("id")], 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.count("WindowGroupLimit") >= 2


def test_numbers_of_rows_with_null_keys(spark):
    data = [(None, 1, 0), (None, None, 1), (1, None, 2), (1, 4, 3), (1, 90, 4)]
    got = number_rows(frame(spark, data), ["k"], [F.col("v")], [F.floor(F.col("v") / 16)], "n", ahead=("v", "nxt")).collect()
    assert sorted((r.id, r.n, r.nxt) for r in got) == [(0, 2, None), (1, 1, 1), (2, 1, 4), (3, 2, 90), (4, 3, None)]


def test_parts_of_a_large_key_join_to_its_text(spark):
    data = rows()
    texts = frame(spark, data).withColumn("t", F.concat(F.lit("t"), "id"))
    got = {}
    slices = [F.floor(F.col("v") / 16)]
    for r in assemble_text(texts, ["k"], ["v", "id"], "t", slices, part_chars=500).collect():
        got.setdefault(r.k, []).append((r.part, r.text))
        assert len(r.text) < 1500
    assert {k: " ".join(t for _, t in sorted(v)) for k, v in got.items()} == {
        k: " ".join(f"t{i}" for _, i in x) for k, x in by_key(data).items()
    }
    assert len(got[0]) > 10


def test_no_key_wide_exchange_or_window_holds_text(spark):
    texts = frame(spark, rows(50)).withColumn("t", F.concat(F.lit("t"), "id"))
    plan = assemble_text(texts, ["k"], ["v", "id"], "t", [F.floor(F.col("v") / 16)])._jdf.queryExecution().optimizedPlan()
    lines = [x for x in plan.toString().splitlines() if "Window" in x]
    assert lines and all(" t#" not in x and "_t" not in x for x in lines)


@pytest.mark.parametrize("hot, parts", [(0.0, 4), (0.7, 16), (1.0, 16)])
def test_numbers_by_range_equal_a_window(spark, hot, parts):
    rnd = random.Random(parts)
    rows = [(None if rnd.random() < 0.02 else 7 if rnd.random() < hot else rnd.randrange(30), rnd.choice([None, f"task-0000{rnd.randrange(3000)}"]), i % 3) for i in range(6000)]
    df = spark.createDataFrame(rows, "k int, t string, s int").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted((tuple(r) for r in number_by_range(df, ["k"], ["t", "s"], "no").collect()), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = []
    for k in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is not None, r[1] or "", r[2]))
        want += [(*r, i + 1) for i, r in enumerate(mine)]
    assert got == sorted(want, key=str)


def test_a_hot_key_is_dealt_in_equal_shares(spark):
    df = spark.range(200_000).selectExpr("1 as k", "concat('task-0000-', lpad(id, 9, '0')) as t")
    rows = df.repartitionByRange(8, "k", "t").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(rows) == 8 and max(r["count"] for r in rows) < 60_000
    assert number_by_range(df, ["k"], ["t"], "no").filter("no <> cast(substr(t, 11) as long) + 1").count() == 0
    assert number_by_range(df.limit(0), ["k"], ["t"], "no").count() == 0
