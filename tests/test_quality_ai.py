import random

import pytest
from pyspark.sql import functions as F

from quire.operators import inference as ai, quality as ops


def test_quality_score_by_hand(spark):
    meta = spark.createDataFrame([(1, "T", "A", True), (2, None, "A", False)], "doc_id int, title string, author string, has_bookmarks boolean")
    scans = spark.createDataFrame([(1, 0.1), (2, 0.3)], "doc_id int, scan_probability double")
    conf = spark.createDataFrame([(2, 50.0)], "doc_id int, total_confidence double")
    images = spark.createDataFrame([(2,)] * 9, "doc_id int")
    got = {r.doc_id: r.quality_score for r in ops.quality_score(meta, scans, conf, images).collect()}
    assert got == {1: 85.0, 2: 50 + 10 + 15 + 5}


def test_nearest_text_against_brute_force(spark):
    rnd = random.Random(3)
    blocks = [(rnd.randrange(3), i, rnd.randrange(4), float(rnd.randrange(5) * 90), float(rnd.randrange(8) * 60), f"b{i}") for i in range(200)]
    images = [(i, rnd.randrange(4), rnd.randrange(6), float(rnd.randrange(6) * 70), float(rnd.randrange(9) * 50)) for i in range(80)]
    b = spark.createDataFrame(blocks, "doc_id int, block_id int, page_num int, x0 double, y0 double, text string")
    im = spark.createDataFrame(images, "image_id int, doc_id int, page_num int, x0 double, y0 double")
    got = {r.image_id: (r.associated_text, r.suggested_caption, r.position) for r in ops.image_nearest_text(im, b).collect()}
    for i, d, p, x, y in images:
        near = []
        for bd, bid, bp, bx, by, text in sorted(blocks, key=lambda r: (r[2], r[1])):
            if bd == d and abs(bp - p) <= 1:
                near.append((abs(by - y) + abs(bx - x) if bp == p else 1000 + abs(bp - p) * 100, by, text))
        near.sort(key=lambda r: r[0])
        want = (" ".join(n[2] for n in near[:3]), near[0][2][:100], "after" if near[0][1] < y else "before") if near else (None, None, None)
        assert got[i] == want


@pytest.mark.parametrize("score, flags, reason", [
    (59.94, {}, "Custom quality score (59.9) below threshold (60.0)"), (60.0, {}, "Custom conversion quality acceptable"),
    (80.0, {"has_drm": True, "complex_layout": True}, "PDF has DRM protection"), (10.0, {"user_requested": True}, "User explicitly requested X conversion"),
])
def test_fallback_order(spark, score, flags, reason):
    base = dict(doc_id=1, score=score, engine_available=True, user_requested=False, error_occurred=False, is_encrypted=False, has_drm=False, complex_layout=False)
    df = spark.createDataFrame([tuple({**base, **flags}.values())], list(base))
    r = ops.fallback_decision(df, "X").first()
    assert r.reason == reason and r.fallback == (reason != "Custom conversion quality acceptable")


def test_ocr_warning_and_blank_words(spark):
    df = spark.createDataFrame([(1, 0, "a", 90), (1, 1, " ", 10), (1, 2, "b", 79), (2, 0, "", 99), (3, 0, "z", 85)], "page_id int, word_id int, word string, conf int")
    got = {r.page_id: (r.n_words, r.confidence, r.warning) for r in ops.ocr_page_confidence(df).collect()}
    assert got == {1: (2, 84.5, "Low OCR confidence (84.5% < 85.0%)"), 2: (0, 0.0, "Low OCR confidence (0.0% < 85.0%)"), 3: (1, 85.0, None)}
    assert {r.page_id: r.text for r in ops.ocr_page_text(df).collect()} == {1: "a b", 3: "z"}


def test_last_page_count_of_a_log_wins(spark):
    rows = [(1, 0, "Done 3 pages"), (1, 1, "12 PAGES, WARNING"), (1, 2, "many pages"), (2, 0, "1 page")]
    df = spark.createDataFrame(rows, "run_id int, line_no int, line string")
    got = {r.run_id: (r.pages_processed, r.warnings_count) for r in ops.engine_log_indicators(df).collect()}
    assert got == {1: (12, 1), 2: (0, 0)}


def test_format_choice(spark):
    rows = [(1, 100, 100, 5, "RGBA", "png", "fast"), (2, 501, 10, None, "RGB", "jpeg", "fast"), (3, 600, 10, 300, "L", "jpeg", "high"),
            (4, 900, 33, 16, "P", "jpeg", "fast"), (5, 100, 100, 101, "RGB", "jpeg", "x")]
    df = spark.createDataFrame(rows, "image_id int, width int, height int, n_colors int, mode string, original_format string, quality_level string")
    got = {r.image_id: (r.chosen_format, r.target_width, r.target_height) for r in ops.image_format_choice(df).collect()}
    assert got == {1: ("png", 100, 100), 2: ("jpeg", 501, 10), 3: ("jpeg", 600, 10), 4: ("png", 600, 22), 5: ("jpeg", 100, 100)}


def flaky():
    seen = {}

    def model(prompt, max_tokens):
        if prompt == "bad":
            raise ValueError("boom")
        seen[prompt] = seen.get(prompt, 0) + 1
        if prompt == "slow" and seen[prompt] < 3:
            raise ai.RateLimited("429")
        if prompt == "never":
            raise ai.RateLimited("429")
        return {"content": prompt.upper(), "model": "m", "token_usage": {"n": max_tokens}}

    return model


def test_each_row_carries_its_own_error(spark):
    rows = [(i, p, 7, None) for i, p in enumerate(["ok", "bad", "slow", "never", None])] + [(5, "x", 7, "earlier")]
    df = spark.createDataFrame(rows, "i int, prompt string, max_tokens int, error string")
    got = {r.i: (r.success, r.content, r.error, r.token_usage) for r in ai.ai_map(df, flaky(), backoff=0.01).collect()}
    assert got == {0: (True, "OK", None, {"n": 7}), 1: (False, None, "boom", None), 2: (True, "SLOW", None, {"n": 7}),
                   3: (False, None, "429", None), 4: (False, None, "no prompt", None), 5: (False, None, "earlier", None)}


def test_missing_cache_keys_are_inferred_once(spark):
    texts = spark.createDataFrame([(i, "same" if i < 50 else f"t{i}", "p") for i in range(60)], "doc_id int, text string, provider string")
    cache = texts.filter("doc_id = 55").select(F.md5(F.concat_ws(":", "text", "provider")).alias("cache_key"), F.lit("hit").alias("content"))
    asked = []

    def infer(missing):
        asked.append(missing.count())
        return missing.select("*", F.upper("text").alias("content"), F.lit(True).alias("success"), F.lit(None).cast("string").alias("error"))

    got = {r.doc_id: (r.content, r.from_cache) for r in ai.ai_cache_join(texts, cache, infer).collect()}
    assert asked == [10] and len(got) == 60
    assert got[0] == ("SAME", False) and got[55] == ("hit", True)


def test_prompts_cut_their_input(spark):
    df = spark.createDataFrame([("x" * 5000, "fix_grammar")], "text string, enhancement_type string")
    assert ai.summary_requests(df).first().prompt.count("x") == 2000
    assert ai.enhance_requests(df).first().prompt.count("x") == 3000


def test_title_lines(spark):
    df = spark.createDataFrame([(1, 0, " One \n\n\rTwo")], "doc_id int, ord int, response string")
    assert [r.label for r in ai.parse_title_lines(df).orderBy("number").collect()] == ["第1章: One", "第2章: Two"]


def test_text_choice_keeps_all_parts(spark):
    extracted = spark.createDataFrame([(1, 0, "abc"), (2, 0, "longer text"), (4, 0, "x")], "doc_id int, part int, text string")
    ocr = spark.createDataFrame([(1, 0, "ab"), (1, 1, "c"), (2, 0, "short"), (3, 0, "only"), (4, 0, "yyyy")], "doc_id int, part int, text string")
    need = spark.createDataFrame([(1, True), (2, True), (3, True), (4, False)], "doc_id int, ocr_needed boolean")
    got = sorted((r.doc_id, r.source, r.part, r.text) for r in ops.text_vs_ocr(extracted, ocr, need).collect())
    assert got == [(1, "ocr", 0, "ab"), (1, "ocr", 1, "c"), (2, "extracted", 0, "longer text"), (3, "ocr", 0, "only"), (4, "extracted", 0, "x")]


def test_never_more_calls_are_open_than_allowed(spark):
    import threading
    import time

    lock, state = threading.Lock(), {"open": 0, "most": 0, "order": []}

    def one(row, given_up):
        with lock:
            state["open"] += 1
            state["most"] = max(state["most"], state["open"])
            state["order"].append(row[0])
        time.sleep(1.0 if row[0] in ("p2", "p3", "p4") else 0.02)
        with lock:
            state["open"] -= 1
        return (True, row[0], None, None, 0.0, None, None)

    window = ai._Window(one, 3, 0.3)
    rows = [(f"p{i}", 5, None, None) for i in range(40)]
    rows[7] = (None, 5, None, None)
    got = window.answers(rows)
    assert state["most"] == 3 and state["order"] == sorted(state["order"], key=lambda p: int(p[1:]))
    assert [a[6] for a in got[2:5]] == ["no answer within 0.3 s"] * 3 and got[7][6] == "no prompt"
    # p2 to p4 fill the window beyond their limit: rows that would have begun meanwhile say so
    stuck = [i for i, a in enumerate(got) if a[6] == "no call came free within 0.3 s"]
    assert stuck and all(a[0] for i, a in enumerate(got) if i not in (2, 3, 4, 7, *stuck))
    time.sleep(1.2)
    assert all(a[0] for a in window.answers([(f"q{i}", 5, None, None) for i in range(9)]))  # and it is free again


def test_calls_run_side_by_side_and_end_in_time(spark):
    import time

    def model(prompt, max_tokens):
        time.sleep(30 if prompt == "slow" else 0.2)
        return {"content": prompt.upper()}

    rows = spark.createDataFrame([(i, "slow" if i == 4 else f"p{i}", 5) for i in range(9)], "id int, prompt string, max_tokens int")
    start = time.time()
    got = {r.id: (r.success, r.content, r.error) for r in ai.ai_map(rows.coalesce(1), model, limit_s=2.0).collect()}
    assert time.time() - start < 20
    assert got.pop(4) == (False, None, "no answer within 2 s")
    assert got == {i: (True, f"P{i}", None) for i in range(9) if i != 4}
