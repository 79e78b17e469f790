"""Batch model inference over text columns, with errors kept per row."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from quire.functions import text as T, values as V
from quire.operators.structure import ai_chapter_verify, page_heads, sample_first_pages

RESULT = (
    "success boolean, content string, provider string, model string, processing_time double,"
    " token_usage map<string,bigint>, error string"
)


class RateLimited(Exception):
    """Raised by a model callable to ask for a later retry."""


def summary_requests(texts: DataFrame, max_length: int = 300) -> DataFrame:
    """Summary prompt over the allowed number of input characters."""
    prompt = T.fill(
        V.SUMMARY_PROMPT, max_length=F.lit(str(max_length)), text=F.substring("text", 1, V.SUMMARY_INPUT_CHARS)
    )
    return texts.withColumns({"prompt": prompt, "max_tokens": F.lit(max_length)})


def enhance_requests(texts: DataFrame) -> DataFrame:
    """Prompt by enhancement type; an unknown type becomes an error row."""
    lead = T.lookup(F.col("enhancement_type"), V.ENHANCE_PROMPTS)
    return texts.withColumns({
        "prompt": F.concat(lead, F.lit("\n\n"), F.substring("text", 1, V.ENHANCE_INPUT_CHARS)),
        "max_tokens": F.when(lead.isNotNull(), V.ENHANCE_MAX_TOKENS),
        "error": F.when(lead.isNull(), F.concat(F.lit("Unsupported enhancement type: "), F.col("enhancement_type"))),
    })


def request_options(requests: DataFrame) -> DataFrame:
    """Token limit and temperature by kind of request."""
    return requests.withColumns({
        "max_tokens": T.lookup(F.col("kind"), {k: v[0] for k, v in V.REQUEST_OPTIONS.items()}),
        "temperature": T.lookup(F.col("kind"), {k: v[1] for k, v in V.REQUEST_OPTIONS.items()}),
    })


class _Window:
    """Calls in order, at most `at_once` open at a time, those that outlive their limit included."""

    def __init__(self, one: Callable[[tuple, threading.Event], tuple], at_once: int, limit_s: float):
        self.one, self.at_once, self.limit_s = one, at_once, limit_s
        self.changed = threading.Condition()
        self.open = 0

    def _work(self, k: int, row: tuple, answers: list, given_up: threading.Event) -> None:
        answer = self.one(row, given_up)
        with self.changed:
            if not given_up.is_set():
                answers[k] = answer
            self.open -= 1
            self.changed.notify()

    def answers(self, rows: list[tuple]) -> list[tuple]:
        answers: list[tuple | None] = [None] * len(rows)
        waiting: dict[int, tuple[float, threading.Event]] = {}  # calls with an answer to come: their deadline
        late, busy = f"no answer within {self.limit_s:g} s", f"no call came free within {self.limit_s:g} s"
        k, since = 0, time.monotonic()
        with self.changed:
            while k < len(rows) or waiting:
                now = time.monotonic()
                for i, (end, given_up) in list(waiting.items()):
                    if answers[i] is None and now >= end:
                        given_up.set()
                        answers[i] = (False, None, rows[i][2], None, None, None, late)
                    if answers[i] is not None:
                        del waiting[i]
                if k < len(rows):
                    prompt, _, provider, error = rows[k]
                    if isinstance(error, str) or not isinstance(prompt, str):
                        answers[k] = (False, None, provider, None, None, None, error if isinstance(error, str) else "no prompt")
                        k, since = k + 1, now
                        continue
                    if self.open < self.at_once:
                        given_up = threading.Event()
                        waiting[k] = (now + self.limit_s, given_up)
                        self.open += 1
                        threading.Thread(target=self._work, args=(k, rows[k], answers, given_up), daemon=True).start()
                        k, since = k + 1, now
                        continue
                    if not waiting and now >= since + self.limit_s:  # only calls that have outlived their limit are open
                        answers[k] = (False, None, provider, None, None, None, busy)
                        k += 1
                        continue
                if waiting or k < len(rows):
                    ends = [end for end, _ in waiting.values()] or [since + self.limit_s]
                    self.changed.wait(max(0.0, min(ends) - now))
        return answers


def ai_map(
    requests: DataFrame,
    model: Callable[[str, int], dict],
    parallelism: int | None = None,
    retries: int = 3,
    backoff: float = 2.0,
    at_once: int = 3,
    limit_s: float = 60.0,
) -> DataFrame:
    """Call ``model(prompt, max_tokens)`` for every row; a failing row carries its error.

    ``model`` returns a dict with content and optionally model and token_usage. One callable
    lives per partition and is called from at most ``at_once`` threads: the next row's call begins
    when one of them is free. A row without an answer after ``limit_s`` seconds, retries included,
    carries an error; its call can't be stopped, isn't repeated, and keeps its thread until it
    returns. A row for which no thread comes free within ``limit_s`` carries an error, too.
    ``parallelism`` bounds the partitions. Rows with an ``error`` or without a prompt are not sent.
    """
    keep = [c for c in requests.columns if c not in ("prompt", "max_tokens", "error", "provider")]
    full = requests
    for name, kind in (("error", "string"), ("provider", "string")):
        if name not in full.columns:
            full = full.withColumn(name, F.lit(None).cast(kind))
    full = full.select(*keep, "prompt", "max_tokens", "provider", "error")
    if parallelism:
        full = full.repartition(parallelism)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in full.select(*keep).schema.fields)

    def call(prompt, max_tokens, given_up: threading.Event) -> dict:
        for attempt in range(retries):
            try:
                return model(prompt, int(max_tokens))
            except RateLimited:
                if attempt == retries - 1 or given_up.wait(backoff**attempt):
                    raise
        raise RuntimeError("no attempt allowed")

    def one(row: tuple, given_up: threading.Event) -> tuple:
        prompt, max_tokens, provider, _ = row
        start = time.time()
        try:
            answer = call(prompt, max_tokens, given_up)
            found = answer["content"], provider, answer.get("model"), time.time() - start, answer.get("token_usage"), None
        except Exception as e:
            return (False, None, provider, None, None, None, str(e))
        return (True, *found)

    names = ["success", "content", "provider", "model", "processing_time", "token_usage", "error"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        window = _Window(one, at_once, limit_s)
        for batch in batches:
            asked = zip(batch["prompt"], batch["max_tokens"], batch["provider"], batch["error"], strict=True)
            rows = window.answers(list(asked))
            out = pd.DataFrame(rows, columns=names, index=batch.index)
            yield pd.concat([batch[keep], out], axis=1)

    return full.mapInPandas(run, f"{fields}, {RESULT}")


def extractive_summary(docs: DataFrame, n: int = 300) -> DataFrame:
    """Leading whole sentences within ``n`` characters, or the first ``n`` if none ends there."""
    head = F.substring("text", 1, n)
    whole = F.regexp_extract(head, r"(?s)^(.*[.!?。])", 1)
    return docs.withColumn("summary", F.when(whole != "", whole).otherwise(head))


def ai_cache_join(texts: DataFrame, cache: DataFrame, infer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Cached answers by md5 of ``text:provider``; each missing key is inferred once, and a failed one carries its error."""
    keyed = texts.withColumn("cache_key", F.md5(F.concat_ws(":", "text", "provider")))
    known = cache.groupBy("cache_key").agg(F.min("content").alias("content"))
    missing = (
        keyed.groupBy("cache_key").agg(F.min("text").alias("text"), F.min("provider").alias("provider"))
        .join(known, "cache_key", "left_anti")
    )
    answers = known.select(
        "*", F.lit(True).alias("from_cache"), F.lit(True).alias("success"), F.lit(None).cast("string").alias("error")
    ).unionByName(infer(missing).select("cache_key", "content", F.lit(False).alias("from_cache"), "success", "error"))
    return keyed.drop("text").join(answers, "cache_key")


def ai_batch_summary(results: DataFrame) -> DataFrame:
    return results.groupBy("operation").agg(
        F.count(F.lit(1)).alias("total_texts"),
        F.count_if("success").alias("successful"),
        F.count_if(~F.col("success")).alias("failed"),
        F.round(F.coalesce(F.sum(F.when(F.col("success"), F.col("processing_time"))), F.lit(0.0)), 6).alias("total_processing_time"),
    )


def ai_length_report(results: DataFrame) -> DataFrame:
    n = F.length("content")
    return results.filter("success").select(
        "doc_id", "original_length", n.alias("result_length"),
        F.round(F.when(F.col("original_length") > 0, n / F.col("original_length")), 6).alias("compression"),
    )


def token_usage_totals(results: DataFrame) -> DataFrame:
    """Token counts of the usage maps summed by provider and model."""
    return (
        results.select("provider", "model", F.explode("token_usage").alias("kind", "tokens"))
        .groupBy("provider", "model", "kind").agg(F.sum("tokens").alias("tokens"))
    )


def parse_title_lines(responses: DataFrame) -> DataFrame:
    """Non-blank response lines as numbered chapter titles."""
    lines = F.filter(F.transform(F.split("response", r"[\n\r\x0b\x0c\x85\x{2028}\x{2029}]"), T.ustrip), lambda x: x != "")
    number = (F.col("i") + 1).cast("string")
    return responses.select("doc_id", "ord", F.posexplode(lines).alias("i", "title")).select(
        "doc_id", "ord", (F.col("i") + 1).alias("number"), "title",
        F.concat(F.lit("第"), number, F.lit("章: "), F.col("title")).alias("label"),
    )


def ai_chapter_proposals(blocks: DataFrame, model: Callable[[str, int], dict]) -> DataFrame:
    """Sample of the first pages -> model -> ``Page X: title`` lines checked against the pages."""
    requests = sample_first_pages(blocks).withColumnRenamed("sample", "prompt").withColumn("max_tokens", F.lit(500))
    answers = ai_map(requests, model).filter("success")
    responses = answers.select("doc_id", F.lit(0).cast("bigint").alias("ord"), F.col("content").alias("response"))
    return ai_chapter_verify(responses, page_heads(blocks))


def ai_metadata_infer(meta: DataFrame, blocks: DataFrame, model: Callable[[str, int], dict]) -> DataFrame:
    """Missing titles and authors from the model's ``title|author`` answer on the first pages."""
    missing = meta.filter(F.col("title").isNull() | F.col("author").isNull()).select("doc_id")
    samples = sample_first_pages(blocks.join(missing, "doc_id", "left_semi"), minimum=1)
    answers = ai_map(
        samples.withColumnRenamed("sample", "prompt").withColumn("max_tokens", F.lit(100)), model
    ).filter("success")
    guess = answers.select(
        "doc_id", F.split_part("content", F.lit("|"), F.lit(1)).alias("t"), F.split_part("content", F.lit("|"), F.lit(2)).alias("a")
    )
    return meta.join(guess, "doc_id", "left").select(
        "doc_id", F.coalesce("title", "t").alias("title"), F.coalesce("author", "a").alias("author")
    )
