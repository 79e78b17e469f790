import random
import time

import pyarrow as pa
import pytest

from quire.operators import greedy, pages
from quire.operators import structure as ops
from quire.operators.similarity import similar_pairs
from quire.session import prepare

SCHEMA = "doc_id int, page_num long, title string, confidence double, method string, level int, seq long, priority int"
METHODS = ["bookmark", "font_analysis", "page_pattern", "ai_analysis"]


def similar(a, b, t):
    a, b = a.lower().strip(), b.lower().strip()
    if a == b:
        return True
    x, y = set(a.split()), set(b.split())
    return bool(x and y) and len(x & y) / len(x | y) >= t


def clean(title):
    import re

    t = re.sub(r"^Page\s*\d+\s*[:\-]?\s*", "", title.strip(), flags=re.IGNORECASE)
    t = re.sub(r"\s+", " ", t).strip("•·-—–")
    return t[:1].upper() + t[1:]


def brute_conflicts(cands):
    kept = []
    for c in sorted(cands, key=lambda c: (c[7], c[6], c[1], c[2])):
        if c[7] == 0 or not any(abs(c[1] - k[1]) <= 2 and similar(c[2], k[2], 0.8) for k in kept):
            kept.append(c)
    return kept


def brute_dedupe(cands):
    kept, seen = [], []
    for c in sorted(cands, key=lambda c: (c[1], c[7], c[6], c[2])):
        if not any(similar(c[2], s, 0.9) for s in seen):
            title = clean(c[2])
            seen.append(title.lower())
            kept.append((*c[:2], title, *c[3:]))
    return kept


def candidates(n_docs, per_doc, seed):
    rnd = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "Page 3: intro", "•"]
    out = []
    for d in range(n_docs):
        for i in range(per_doc):
            p = rnd.randrange(4)
            title = " ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 6)))
            out.append((d, rnd.randrange(per_doc // 2 + 1), title, 50.0, METHODS[p], 1, i, p))
    return out


def shown(df):
    return sorted((r.doc_id, r.page_num, r.title, r.seq, r.priority) for r in df.collect())


def wanted(brute, data):
    out = []
    for d in {c[0] for c in data}:
        out += [(c[0], c[1], c[2], c[6], c[7]) for c in brute([c for c in data if c[0] == d])]
    return sorted(out)


@pytest.mark.parametrize("seed", [3, 4])
def test_greedy_selection_equals_brute_force(spark, seed):
    data = candidates(4, 30, seed) + [(9, 1, "Lonely", 1.0, "bookmark", 1, 0, 0)]
    data += data[:20]  # rows that an at-least-once feed repeats
    df = spark.createDataFrame(data, SCHEMA)
    assert shown(ops.chapter_conflicts(df)) == wanted(brute_conflicts, data)
    assert shown(ops.dedupe_titles(df)) == wanted(brute_dedupe, data)


def test_conflict_chain(spark):
    rows = [(1, p, "Same title", 60.0, "page_pattern", 1, p, 2) for p in (1, 3, 5)]
    merged = ops.chapter_conflicts(spark.createDataFrame(rows, SCHEMA))
    assert sorted(r.page_num for r in merged.collect()) == [1, 5]
    assert [r.page_num for r in ops.dedupe_titles(merged).collect()] == [1]


def test_a_running_head_on_many_pages(spark):
    rows = [(1, p, "The running head", 60.0, "page_pattern", 1, p, 2) for p in range(10_000)]
    merged = ops.chapter_conflicts(spark.createDataFrame(rows, SCHEMA))
    assert sorted(r.page_num for r in merged.collect()) == list(range(0, 10_000, 3))


def test_one_document_with_very_many_candidates(spark):
    df = spark.range(200_000).selectExpr(
        "1 as doc_id", "id as page_num", "concat('Chapter ', id div 2) as title", "60D as confidence",
        "'page_pattern' as method", "1 as level", "id as seq", "2 as priority",
    )
    assert ops.chapter_conflicts(df).count() == 100_000
    assert ops.dedupe_titles(df).count() == 100_000


def test_rows_without_page_or_title_stay(spark):
    rows = [(1, None, "Same", 1.0, "m", 1, 0, 2), (1, None, "Same", 1.0, "m", 1, 1, 2), (1, 3, None, 1.0, "m", 1, 2, 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert ops.chapter_conflicts(df).count() == 3


HEAD = "running head of this long book here about many things and others".split()


@pytest.mark.parametrize("common, own", [(5, 1), (9, 1), (8, 2)])
def test_one_document_with_many_titles_under_one_running_head(spark, common, own):
    """100,000 different titles that share most of their words, on one page after the other."""
    rows = [(1, p // 10, " ".join([*HEAD[:common], f"a{p % 331}", f"b{p}"][: common + own]), 60.0, "page_pattern", 1, p, 2) for p in range(100_000)]
    if own == 1:
        rows = [(*r[:2], " ".join([*HEAD[:common], f"b{r[6]}"]), *r[3:]) for r in rows]
    df = spark.createDataFrame(rows, SCHEMA)
    begun = time.time()
    assert ops.dedupe_titles(df).count() == 100_000
    assert ops.chapter_conflicts(df).count() > 1000
    assert time.time() - begun < 60


@pytest.mark.parametrize("t, words, longest", [(0.5, 8, 5), (0.6, 15, 14), (0.8, 40, 25), (0.8, 12, 9), (0.9, 15, 25), (0.9, 200, 4)])
def test_word_sets_equal_brute_force(t, words, longest):
    rnd = random.Random(words)
    sets = [frozenset(f"w{rnd.randrange(words)}" for _ in range(rnd.randint(0, longest))) for _ in range(600)]
    index, kept = greedy.WordSets(t), []
    for s in sets:
        clash = any(s == o or (len(s & o) and len(s & o) / len(s | o) >= t) for o in kept)
        assert index.has_similar(s) == clash
        if not clash:
            kept.append(s)
            index.add(s)
    assert len(kept) > greedy.FEW or words == 8


def test_stretches_of_pages_are_decided_apart(spark):
    rows = [(d, p, "One head", 60.0, "page_pattern", 1, p, 2) for d in (1, 2) for p in (1, 2, 3, 5, 8, 10, 13)]
    rows += [(1, None, "One head", 60.0, "page_pattern", 1, 99, 2), (None, 4, "One head", 60.0, "page_pattern", 1, 1, 2), (None, 5, "One head", 60.0, "page_pattern", 1, 2, 2)]
    got = sorted((r.doc_id or 0, r.page_num or 0) for r in ops.chapter_conflicts(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(0, 4), (1, 0), (1, 1), (1, 5), (1, 8), (1, 13), (2, 1), (2, 5), (2, 8), (2, 13)]


def test_hot_words_do_not_pair_up(spark):
    n = 20_000
    sets = spark.range(n).selectExpr("id as a_id", "array('chapter', cast(id as string)) as a_words")
    pairs = similar_pairs(sets, None, [], 0.5)
    pairs.filter("a_id <> b_id").write.format("noop").mode("overwrite").save()
    assert pairs.count() == 0
    plan = pairs._jdf.queryExecution()
    plan.toRdd().count()
    rows = [int(m) for m in __import__("re").findall(r"Join[^\n]*rows: (\d+)", plan.executedPlan().toString())]
    assert all(r <= 4 * n for r in rows)


def test_long_sets_meet_by_numbers(spark):
    from pyspark.sql import functions as F

    from quire.operators import similarity

    sets = [(i, [f"w{(i * 7 + k) % 1000}" for k in range(200)]) for i in range(60)]
    a = spark.createDataFrame(sets, "a_id int, a_words array<string>")
    near = {(x, y) for x, v in sets for y, w in sets if x < y and len({*v} & {*w}) / len({*v} | {*w}) >= 0.5}
    assert {(r.a_id, r.b_id) for r in similar_pairs(a, None, [], 0.5).collect()} == near
    ranked = similarity._ranked(
        a.select(F.col("a_id").alias("no"), F.col("a_words").alias("words")),
        a.select(F.explode("a_words").alias("_w")).groupBy("_w").agg(F.count(F.lit(1)).alias("_n")), [],
    )
    kinds = dict(similarity._postings(ranked, [], "p", similarity.prefix_length(F.size("words"), 0.5)).dtypes)
    assert kinds.pop("_w") == "string" and set(kinds.values()) <= {"int", "bigint"}


def test_similar_pairs_is_exact(spark):
    rnd = random.Random(5)
    sets = [(i % 2, i, sorted({f"w{min(rnd.randrange(12), rnd.randrange(12))}" for _ in range(rnd.randrange(1, 12))})) for i in range(120)]
    a = spark.createDataFrame(sets, "k int, a_id int, a_words array<string>")
    b = spark.createDataFrame(sets, "k int, b_id int, b_words array<string>")
    for t in (0.3, 0.5, 0.8, 0.9, 1.0):
        got = sorted((r.a_id, r.b_id) for r in similar_pairs(a, b, ["k"], t).collect())
        want = sorted(
            (i, j) for k, i, x in sets for m, j, y in sets if k == m and len(set(x) & set(y)) / len(set(x) | set(y)) >= t
        )
        assert got == want


def test_a_set_with_itself_gives_each_pair_once(spark):
    rnd = random.Random(8)
    sets = [(i, sorted({f"w{rnd.randrange(9)}" for _ in range(rnd.randint(1, 6))})) for i in range(80)]
    found = similar_pairs(spark.createDataFrame(sets, "a_id int, a_words array<string>"), None, [], 0.5)
    want = {
        (i, j): len(set(x) & set(y)) / len(set(x) | set(y)) for i, x in sets for j, y in sets
        if i < j and len(set(x) & set(y)) / len(set(x) | set(y)) >= 0.5
    }
    rows = found.collect()
    assert len(rows) == len(want) and all(abs(want[r.a_id, r.b_id] - r.similarity) < 1e-12 for r in rows)


BLOCK = "doc_id int, block_id long, page_num int, y0 double, x0 double, font_size double, is_bold boolean, text string"


def test_font_ties_take_the_first_block(spark):
    rows = [(1, i, 0, 100.0, 0.0, s, True, t) for i, (s, t) in enumerate([(10.0, "small"), (20.0, "First"), (20.0, "Second")])]
    blocks = spark.createDataFrame(rows, BLOCK)
    assert [r.title for r in ops.font_headings(blocks, ops.font_stats(blocks)).collect()] == ["First"]
    assert [r.title for r in ops.page_top_headings(blocks).collect()] == ["First"]


def test_page_top_filters_after_the_pick(spark):
    rows = [(1, 0, 0, 10.0, 0.0, 30.0, False, "this is the end."), (1, 1, 0, 20.0, 0.0, 20.0, False, "Intro")]
    assert ops.page_top_headings(spark.createDataFrame(rows, BLOCK)).count() == 0


def test_ranges_cover_and_keep_empty_chapters(spark):
    blocks = spark.createDataFrame([(1, i, i // 2, 0.0, 0.0, 10.0, False, f"b{i}") for i in range(20)], BLOCK)
    bounds = spark.createDataFrame(
        [(1, 3, "A", 1, 5, 0), (1, 3, "B", 1, 1, 1), (1, 7, "C", 1, 2, 1)], "doc_id int, page_num long, title string, level int, seq long, priority int"
    )
    ranges = ops.chapter_ranges(bounds, blocks)
    got = {r.title: (r.chapter_no, r.start_page, r.end_page) for r in ranges.collect()}
    assert got == {"A": (1, 3, 2), "B": (2, 3, 6), "C": (3, 7, 9)}
    texts = {r.chapter_id: r.content for r in ops.chapter_content(ranges, blocks).collect()}
    assert texts == {
        "chapter_001": "", "chapter_002": " ".join(f"b{i}" for i in range(6, 14)), "chapter_003": " ".join(f"b{i}" for i in range(14, 20)),
    }


def test_empty_input_has_zero_confidence(spark):
    docs = spark.createDataFrame([(1,)], "doc_id int")
    none = spark.createDataFrame([], SCHEMA)
    r = ops.structure_confidence(docs, none).first()
    assert (r.n_chapters, r.total_confidence) == (0, 0.0)


def test_ai_lines_need_a_page_and_a_title(spark):
    responses = spark.createDataFrame([(1, 0, "page 1: Chapter\nPage 2:x\nPage 9: Gone\nnoise\n Page 1: Real one ")], "doc_id int, ord long, response string")
    heads = spark.createDataFrame([(1, 0, "The start. More"), (1, 1, "No")], "doc_id int, page_num long, head string")
    assert sorted(r.title for r in ops.ai_chapter_verify(responses, heads).collect()) == ["Real one", "The start"]


def test_page_summaries_equal_the_detectors_over_blocks(spark):
    rnd = random.Random(12)
    rows = []
    for d in range(12):
        for i in range(rnd.choice([1, 30, 300])):
            text = rnd.choice([None, "", "  ", "Intro", "Part one", "this is the end.", "1. Start", "x" * 250, f"Chapter {i}"])
            rows.append((d, i * rnd.choice([1, 700]), rnd.randrange(6), rnd.choice([10.0, 150.0, 300.0]), 0.0, rnd.choice([8.0, 12.0, 20.0, 0.0, None]), rnd.random() < 0.5, text))
    blocks = spark.createDataFrame(rows, BLOCK).repartition(5).dropDuplicates(["doc_id", "block_id", "page_num"])
    blocks = pages.saved(blocks, "blocks")
    summary = pages.saved(pages.page_summary(blocks), "summary")
    fonts, tops = ops.candidates_of_pages(summary)
    shown = lambda df: sorted(tuple(r) for r in df.collect())
    assert shown(fonts) == shown(ops.font_headings(blocks, ops.font_stats(blocks))) and fonts.count() > 10
    assert shown(tops) == shown(ops.page_top_headings(blocks)) and tops.count() > 2
    held = {}
    for r in blocks.collect():
        held.setdefault((r.doc_id, r.page_num), []).append((r.block_id, r.text))
    joined = {k: " ".join(t for _, t in sorted(v, key=lambda x: x[0]) if t is not None) for k, v in held.items()}
    assert {(r.doc_id, r.page_num): r.start for r in summary.collect()} == {k: t[:100] for k, t in joined.items()}
    assert {(r.doc_id, r.page_num): r.head for r in ops.page_heads(blocks, 7).collect()} == {k: t[:7] for k, t in joined.items()}
    chars = {k: sum(len(t) for _, t in v if t is not None) for k, v in held.items()}
    assert {(r.doc_id, r.page_num): r.n_chars or 0 for r in summary.collect()} == chars


def test_page_summary_reads_blocks_once(spark, tmp_path):
    spark.createDataFrame([(1, 0, 0, 10.0, 0.0, 30.0, True, "Intro")], BLOCK).write.parquet(str(tmp_path / "b"))
    plan = pages.page_summary(spark.read.parquet(str(tmp_path / "b")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    empty = pages.page_summary(spark.createDataFrame([], BLOCK))
    assert empty.count() == 0


def test_python_workers_get_small_batches_and_the_greedy_pass_goes_on_over_slices(spark):
    prepare(spark)
    rows = spark.range(0, 3000, numPartitions=1).selectExpr("id % 2 AS doc_id", "id AS seq", "array(concat('w', id % 700)) AS words", "array(concat('w', id % 700)) AS clean_words")
    kept = greedy.select(rows, ["doc_id"], ["seq"], lambda: greedy.DocumentTitles(0.9))
    assert sorted(r.seq for r in kept.collect()) == list(range(700))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    assert max(r.n for r in rows.mapInArrow(sizes, "n long").collect()) <= 1000
