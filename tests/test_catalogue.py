import os

import pytest
from pyspark.sql import functions as F

from quire.operators import catalogue as ops
from quire.sources.files import read_file_catalogue, read_json_logs, write_chapters, write_extracted_text

TREE = "area string, rel_path string, size_bytes long, modified_s long, access_error string"


def test_read_catalogue_and_usage(spark, tmp_path):
    (tmp_path / "up" / "sub").mkdir(parents=True)
    for name, n in [("a.epub", 1024), ("b.pdf", 2048), ("sub/c.txt", 1000), (".h.pdf", 5)]:
        (tmp_path / "up" / name).write_bytes(b"x" * n)
    os.utime(tmp_path / "up" / "a.epub", (1000, 1000))
    files = read_file_catalogue(spark, str(tmp_path / "up"), "uploads")
    assert "content" not in files._jdf.queryExecution().executedPlan().toString()
    assert read_file_catalogue(spark, str(tmp_path / "up"), "uploads", after="2999-01-01T00:00:00").count() == 0
    assert read_file_catalogue(spark, str(tmp_path / "up"), "uploads", before="2999-01-01T00:00:00").count() == files.count()
    assert read_file_catalogue(spark, str(tmp_path / "up"), "uploads", pattern="*.nothing").count() == 0
    got = {r.rel_path: r.size_bytes for r in files.collect()}
    assert got["a.epub"] == 1024 and got["b.pdf"] == 2048 and got["sub/c.txt"] == 1000
    assert "content" not in files.columns
    assert [r.rel_path for r in ops.supported_files(files).orderBy("rel_path").collect()] == ["a.epub", "b.pdf"]
    expired = ops.expired_items(files, now_s=1000 + 7200, hours=1).collect()
    assert [(r.item, r.size_bytes) for r in expired] == [("a.epub", 1024)]


def test_retention_counts_a_folder_once(spark):
    rows = [("uploads", "d/one", 1000, 0, None), ("uploads", "d/two", 2000, 10, None), ("uploads", "new", 7, 10**6, None),
            ("outputs", "old", 1048576, 0, None), ("outputs", "bad", 5, 0, "locked")]
    got = {r.area: (r.files_removed, r.space_freed_mb, r.n_errors) for r in ops.retention_report(spark.createDataFrame(rows, TREE), 10**5, 24).collect()}
    assert got == {"uploads": (1, round(3000 / 1048576, 4), 0), "outputs": (1, 1.0, 1), "total": (2, round(1 + 3000 / 1048576, 4), 1)}


def test_disk_usage_totals_and_alert(spark):
    mb = 1048576
    rows = [("uploads", "a", 600 * mb, 0, None), ("outputs", "b", 500 * mb, 0, None)]
    got = {r.area: (r.size_mb, r.file_count, r.alert) for r in ops.disk_usage(spark.createDataFrame(rows, TREE)).collect()}
    assert got == {"uploads": (600.0, 1, False), "outputs": (500.0, 1, False), "total": (1100.0, 2, True)}


@pytest.mark.parametrize(
    "name, target, size, reason, status",
    [
        ("", "pdf", 1, "No filename provided", 400), ("a/.x.pdf", "pdf", 1, "Invalid filename", 400),
        ("a.doc", "pdf", 1, "Unsupported file format", 400), ("noext", "pdf", 1, "Unsupported file format", 400),
        ("a.PDF", "docx", 1, "Unsupported target format", 400), ("a.pdf", "EPUB", 50 * 1024 * 1024 + 1, "File too large. Maximum size: 50MB", 413),
        ("a.pdf", "epub", 50 * 1024 * 1024, None, 200), ("a.mobi", "txt", 0, "Empty file uploaded", 400),
    ],
)
def test_upload_rules(spark, name, target, size, reason, status):
    df = spark.createDataFrame([(name, target, size)], "filename string, target_format string, size_bytes long")
    r = ops.validate_uploads(df).first()
    assert (r.reason, r.http_status) == (reason, status)


def test_task_files_by_any_id_in_the_name(spark):
    a, b = "0" * 31 + "a", "123e4567-e89b-12d3-a456-426614174000"
    files = spark.createDataFrame(
        [("outputs", f"x_{a}_{b}.pdf"), ("uploads", f"{b}_in.epub"), ("uploads", "f" * 32 + "_in.epub"), ("uploads", f"late_{a}.epub")],
        "area string, name string",
    )
    tasks = spark.createDataFrame([(a,), (b,), ("f" * 32,), ("c" * 32,), ("nope",)], "task_id string")
    got = {r.task_id: r.status for r in ops.task_file_status(tasks, files).collect()}
    assert got == {a: "completed", b: "completed", "f" * 32: "failed", "c" * 32: "not_found", "nope": "invalid"}
    plan = sorted((r.task_id, r.cleaned_file) for r in ops.task_file_cleanup(tasks, files).collect())
    assert plan == sorted([(a, f"output/x_{a}_{b}.pdf"), (b, f"output/x_{a}_{b}.pdf"), (b, f"input/{b}_in.epub"), ("f" * 32, "input/" + "f" * 32 + "_in.epub")])


def test_batch_limits(spark):
    batches = spark.createDataFrame([(1,), (2,), (3,)], "batch_id int")
    files = spark.createDataFrame([(1, i) for i in range(50)] + [(2, i) for i in range(51)], "batch_id int, f int")
    got = {r.batch_id: r.verdict for r in ops.enforce_batch_limit(batches, files).collect()}
    assert got[1] == "accepted" and got[2].startswith("Too many files") and got[3] == "No files provided"


def test_first_file_of_a_url_stays(spark):
    old = spark.createDataFrame([("u1", 5), ("u2", 6)], "url string, file_id int")
    new = spark.createDataFrame([("u1", 1), ("u3", 9), ("u3", 8)], "url string, file_id int")
    assert sorted(tuple(r) for r in ops.add_files(old, new).collect()) == [("u1", 5), ("u2", 6), ("u3", 8)]


def test_search_orders(spark):
    rows = [(1, "Beta.pdf", 10, 5, 5), (2, "alphaBET.epub", 30, 9, 2), (3, "gamma.txt", 20, 7, 9)]
    df = spark.createDataFrame(rows, "file_id int, name string, size_bytes long, created_s long, modified_s long")
    assert [r.file_id for r in ops.search(df, "bet", order="size").collect()] == [1, 2]
    assert [r.file_id for r in ops.search(df, order="modified").collect()] == [3, 1, 2]
    assert [r.file_id for r in ops.search(df, order="created").collect()] == [2, 3, 1]
    assert [r.file_id for r in ops.search(df, fmt="txt").collect()] == [3]
    assert [r.file_id for r in ops.search(df, order="format").collect()] == [2, 1, 3]


def test_log_files(spark, tmp_path):
    (tmp_path / "app.log").write_text('{"timestamp": "2024-01-01T00:00:00Z", "level": "INFO", "line": 3, "duration": 1.5}\nbroken\n')
    rows = read_json_logs(spark, str(tmp_path)).cache().collect()
    assert sorted((r.level or "", r.line or 0, r._corrupt_record or "") for r in rows) == [("", 0, "broken"), ("INFO", 3, "")]


def test_sinks(spark, tmp_path):
    texts = spark.createDataFrame([("book", "t1", "txt", "hello"), ("web", "t2", "html", "x")], "stem string, task_id string, target_format string, text string")
    write_extracted_text(texts, str(tmp_path / "texts"))
    assert sorted(p.name for p in (tmp_path / "texts").iterdir() if p.is_dir()) == ["target_format=html", "target_format=txt"]
    assert {r.file_name for r in spark.read.parquet(str(tmp_path / "texts")).collect()} == {"book_t1.txt", "web_t2.html"}
    write_chapters(spark.createDataFrame([(d, 1, "c") for d in range(50)], "doc_id long, chapter_no int, content string"), str(tmp_path / "ch"), buckets=4)
    assert spark.read.parquet(str(tmp_path / "ch")).count() == 50
    assert len([p for p in (tmp_path / "ch").iterdir() if p.is_dir()]) <= 4


def test_capability_rules(spark):
    files = spark.createDataFrame([(1, "a.txt", 0), (2, "b.pdf", 10 * 1048576), (3, "c.epub", 0), (4, "d.zip", 0)], "file_id int, name string, size_bytes long")
    got = {r.file_id: (r.convertible, r.est_seconds) for r in ops.capability_match(files, "epub", "draft").collect()}
    assert got == {1: (True, 0.5), 2: (True, 4.0), 3: (False, 1.0), 4: (False, 1.0)}
    txt = {r.file_id: r.est_seconds for r in ops.capability_match(files, "txt", "draft").collect()}
    assert txt[1] == 0.5 and txt[3] == 0.3
    assert ops.file_totals(files.withColumn("area", F.lit("x")), "none").first().total_files == 0
