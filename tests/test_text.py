import hashlib
import random
import time

import pytest
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import text as ops
from quire.sources.files import read_text_robust


def values(spark, rows, expr):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(expr.alias("v")).collect()]


def test_unicode_blanks(spark):
    assert values(spark, ["　a b  c　", "\x1c x \x85", "　\t"], T.collapse("t")) == ["a b c", "x", ""]
    assert values(spark, ["　a b  c　", " \n "], T.ustrip("t")) == ["a b  c", ""]
    assert values(spark, ["　 ", " x", ""], T.is_blank("t")) == [True, False, True]


def test_blanks_agree_with_python(spark):
    odd = [chr(c) for c in range(1, 0x3100) if chr(c).isspace()]
    rows = [f"{c}a{c}{c}b{c}" for c in odd]
    assert values(spark, rows, T.collapse("t")) == [" ".join(r.split()) for r in rows]
    assert values(spark, rows, T.ustrip("t")) == [r.strip() for r in rows]
    assert values(spark, rows, F.array_join(T.words("t"), "|")) == ["|".join(r.split()) for r in rows]


@pytest.mark.parametrize(
    "title, likely",
    [
        ("第1章", True), ("章1", True), ("Theory", False), ("World", False), ("Chapter 12 and the rest.", True),
        ("1. The start.", True), ("iv. and", True), ("b. or", True), ("A small line", True), ("A short line", False), ("Ends here.", False),
        ("x" * 100, False), ("x" * 99, True), ("", True), ("完了。", False), ("PART 2 the", True), ("  Section 3 or ", True),
    ],
)
def test_heading_likely(spark, title, likely):
    assert values(spark, [title], T.heading_likely("t")) == [likely]


def test_titles_keep_their_length_in_upper_and_lower_case(spark):
    import duckdb

    letters = [*T.LONG_UPPER, "é", "σ", "ﬁ", "ǆ", "1"]
    want = duckdb.execute("SELECT list_transform(?::VARCHAR[], lambda x: concat(upper(x), 'heit'))", [letters]).fetchone()[0]
    assert values(spark, [c + "heit" for c in letters], T.clean_title("t")) == want and want[0] == "ẞheit"
    assert values(spark, ["İST", "ΟΔΟΣ"], T.title_key("t")) == ["ist", "οδοσ"]


def test_clean_title(spark):
    rows = ["Page 3: intro", "page12 - • a   b •", "•·—x", "  émile ", "Page 7", "—"]
    assert values(spark, rows, T.clean_title("t")) == ["Intro", " a b ", "X", "Émile", "", ""]


def test_jaccard_edges(spark):
    df = spark.createDataFrame([("a b c d", "a b c d e"), ("", ""), ("", "x"), ("B a", "a b")], "a string, b string")
    got = [r[0] for r in df.select(T.jaccard(T.title_words(T.title_key("a")), T.title_words(T.title_key("b")))).collect()]
    assert got == [0.8, 1.0, 0.0, 1.0]


def test_normalize_cuts_at_a_late_stop(spark):
    late, early = "x" * 1700 + "。" + "y" * 500, "x" * 1600 + "。" + "y" * 500
    df = spark.createDataFrame([(late,), (early,), ("a  b",), ("z" * 2000,)], "text string")
    got = [r[0] for r in ops.normalize_text(df).select("normalized").collect()]
    assert got == [late[:1701], early[:2000], "a b", "z" * 2000]


def test_paragraphs_and_chunks(spark):
    df = spark.createDataFrame([(1, "a\n\n\n b\nc")], "doc_id int, text string")
    assert [r.paragraph for r in ops.txt_paragraphs(df).orderBy("para_no").collect()] == ["a", "bc"]
    text = "x" * 5000 + " " * 5000 + "y"
    df = spark.createDataFrame([(1, text), (2, ""), (3, "　")], "doc_id int, text string")
    got = [(r.chapter_no, r.title, r.file_name) for r in ops.chunk_chapters(df).orderBy("chapter_no").collect()]
    assert got == [(1, "第1章", "chap_001.xhtml"), (3, "第3章", "chap_003.xhtml")]


def test_chunks_of_a_very_long_text(spark):
    df = spark.range(1).selectExpr("1 as doc_id", "repeat('añ★\n😀', 4000000) as text")  # 20 million characters, 44 MB
    start = time.time()
    rows = ops.chunk_chapters(df).select("chapter_no", F.length("content").alias("n"), F.substring("content", 1, 5).alias("head")).collect()
    assert time.time() - start < 60
    assert [r.chapter_no for r in sorted(rows)] == list(range(1, 4001)) and {(r.n, r.head) for r in rows} == {(5000, "añ★\n😀")}


def test_decoding_order(spark):
    rows = [(1, "你好 é".encode()), (2, bytes.fromhex("C4E3BAC3")), (3, bytes.fromhex("FFFF41")), (4, b"")]
    df = spark.createDataFrame(rows, "id int, content binary")
    got = {r.id: r.text for r in read_text_robust(df).collect()}
    assert got == {1: "你好 é", 2: "你好", 3: "A", 4: ""}


def test_html_keeps_script_bodies_and_entities(spark):
    df = spark.createDataFrame([(1, "<p>a&amp;b</p>\n<script>var x=1;</script>"), (2, "<br>")], "page_id int, html string")
    assert [(r.page_id, r.text) for r in ops.html_to_text(df).collect()] == [(1, "a&amp;b var x=1;")]


def test_ascii_runs_note(spark):
    rows = [("b.mobi", "abc" * 40), ("s.mobi", "短い hi")]
    df = spark.createDataFrame(rows, "name string, content string")
    got = {r.name: r.text for r in ops.ascii_runs_text(df).collect()}
    assert got["b.mobi"] == "abc" * 40
    assert got["s.mobi"].startswith("MOBI file: s.mobi\n\n") and got["s.mobi"].endswith("size: 9 bytes")


def test_language_looks_at_the_first_thousand_bytes(spark):
    rows = [(1, "x" * 997 + "中"), (2, "x" * 998 + "中"), (3, "中" * 11)]
    df = spark.createDataFrame(rows, "doc_id int, text string").selectExpr("*", "'' AS title", "'作者' AS author")
    got = {r.doc_id: (r.sample_has_cjk, r.ocr_lang, r.meta_lang) for r in ops.language_tag(df).collect()}
    assert got == {1: (True, "eng", "zh"), 2: (False, "eng", "zh"), 3: (True, "chi_sim+chi_tra", "zh")}


def test_render_escapes_ampersand_first(spark):
    df = spark.createDataFrame([("a<b & \"c\" 'd'", "p1\n\n  \n\np2 > 1", True)], "title string, content string, has_images boolean")
    html = ops.render_chapter_html(df).first().html
    assert "<title>a&lt;b &amp; &quot;c&quot; &#39;d&#39;</title>" in html
    assert "<p>p1</p>\n<p>p2 &gt; 1</p>" in html


def test_human_sizes(spark):
    sizes = [0, 1023, 1024, 1536, 1152, 1048576, 5 * 1024**3]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "i int, s long")
    got = [r[0] for r in df.orderBy("i").select(T.human_size(F.col("s"))).collect()]
    assert got == ["0 Bytes", "1023 Bytes", "1 KB", "1.5 KB", "1.13 KB", "1 MB", "5 GB"]
    secs = [59.9, 60.0, 3599.0, 3660.0]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(secs)], "i int, s double")
    got = [r[0] for r in df.orderBy("i").select(T.human_duration(F.col("s"))).collect()]
    assert got == ["59秒", "1分钟", "59分钟", "1小时1分钟"]


def test_long_text_continues_in_parts(spark):
    rnd = random.Random(1)
    rows = [(1, p, "".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 60)))) for p in range(400)] + [(2, 0, "only")]
    df = spark.createDataFrame(rows, "doc_id int, page int, text string").repartition(5)
    from quire.operators.ordered import assemble_text

    parts = assemble_text(df, ["doc_id"], ["page"], "text", [F.floor(F.col("page") / 16)], part_chars=1000).collect()
    whole = " ".join(r[2] for r in rows if r[0] == 1)
    mine = sorted((r.part, r.text) for r in parts if r.doc_id == 1)
    assert len(mine) > 5 and " ".join(x for _, x in mine) == whole
    assert [r.text for r in parts if r.doc_id == 2] == ["only"]


def test_a_large_host_is_one_row_as_in_its_sql(spark, tmp_path):
    from quire.plans.registry import QUERIES

    pages = spark.range(18).select(
        (F.col("id") * 300).alias("page_id"), F.lit("http://a.b/c").alias("url"), F.concat(F.lit("<p>"), "id", F.expr("repeat('x', 1000000)")).alias("html")
    )
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    found = QUERIES["extract_text_doc"](spark, str(tmp_path)).select("host", "part", F.md5("text").alias("text")).collect()
    whole = " ".join(f"{k}" + "x" * 1000000 for k in range(18))
    assert [tuple(r) for r in found] == [("a.b", 0, hashlib.md5(whole.encode()).hexdigest())]
