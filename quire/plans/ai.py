"""Batch inference family. The stand-in models are local and deterministic."""

import re

from pyspark.sql import functions as F

from quire.operators import inference as ops
from quire.plans import sql as S
from quire.plans.registry import query
from quire.plans.structure import HEADS
from quire.sources.views import check_sql


def length_model(prompt: str, max_tokens: int) -> dict:
    """Answers with the prompt's length; refuses prompts with '***' in them."""
    if "***" in prompt:
        raise ValueError("refused")
    return {"content": f"{len(prompt)} chars", "model": "length", "token_usage": {"prompt_tokens": len(prompt)}}


def outline_model(prompt: str, max_tokens: int) -> dict:
    """Proposes each sampled page under its first word."""
    pages = re.findall(r"Page (\d+):\n(\S+)", prompt)
    return {"content": "\n".join(f"Page {n}: {w}" for n, w in pages), "model": "outline"}


def title_model(prompt: str, max_tokens: int) -> dict:
    return {"content": f"Untitled {len(prompt)}|Anonymous", "model": "title"}


SUMMARY = "SELECT doc_id, provider, concat('请为以下文本生成一个简洁的摘要，长度约为300字符：', chr(10), chr(10), substring(text, 1, 2000)) AS prompt FROM v_ai_texts"


@query("ai_summary_requests", check_sql("v_ai_texts", "SELECT doc_id, provider, prompt, 300 AS max_tokens FROM s", s=SUMMARY))
def ai_summary_requests(t):
    return ops.summary_requests(t.v_ai_texts).select("doc_id", "provider", "prompt", "max_tokens")


# fixed values, written out for the check
_LEADS = """
    WHEN 'improve_readability' THEN '请改善以下文本的可读性，使其更易于理解，保持原意：'
    WHEN 'fix_grammar' THEN '请修正以下文本中的语法错误和拼写错误：'
    WHEN 'translate_to_chinese' THEN '请将以下文本翻译成中文：'
    WHEN 'translate_to_english' THEN '请将以下文本翻译成英文：'
    WHEN 'format_content' THEN '请对以下文本进行格式化，添加适当的段落分隔和标点符号：'"""
ENHANCE = f"""SELECT doc_id, lead || chr(10) || chr(10) || substring(text, 1, 3000) AS prompt, CASE WHEN lead IS NOT NULL THEN 1000 END AS max_tokens,
    CASE WHEN lead IS NULL THEN concat('Unsupported enhancement type: ', enhancement_type) END AS error FROM (SELECT *, CASE enhancement_type {_LEADS} END AS lead FROM v_ai_texts)"""


@query("ai_enhance_requests", check_sql("v_ai_texts", "SELECT * FROM e", e=ENHANCE))
def ai_enhance_requests(t):
    return ops.enhance_requests(t.v_ai_texts).select("doc_id", "prompt", "max_tokens", "error")


# fixed values, written out for the check
_OPTIONS = """
    ('summary', 300, 0.3),
    ('writing_improvement', 1000, 0.5),
    ('translation', 1500, 0.2),
    ('chapter_generation', 500, 0.7),
    ('formatting', 800, 0.3)"""
_KIND = "CASE doc_id % 6 WHEN 0 THEN 'summary' WHEN 1 THEN 'writing_improvement' WHEN 2 THEN 'translation' WHEN 3 THEN 'chapter_generation' WHEN 4 THEN 'formatting' ELSE 'other' END AS kind"


@query("ai_request_options", f"SELECT doc_id, d.kind, max_tokens, temperature FROM (SELECT doc_id, {_KIND} FROM documents) d LEFT JOIN (VALUES {_OPTIONS}) o(kind, max_tokens, temperature) ON o.kind = d.kind")
def ai_request_options(t):
    return ops.request_options(t.documents.selectExpr("doc_id", _KIND))


_ANSWER = "SELECT *, error IS NULL AND NOT contains(prompt, '***') AS ok FROM e"


@query("ai_map", check_sql(
    "v_ai_texts",
    """SELECT doc_id, ok AS success, CASE WHEN ok THEN concat(length(prompt), ' chars') END AS content, CASE WHEN ok THEN 'length' END AS model, CASE WHEN ok THEN length(prompt) END AS prompt_tokens,
    CASE WHEN NOT ok THEN coalesce(error, 'refused') END AS error FROM a""", e=ENHANCE, a=_ANSWER))
def ai_map(t):
    results = ops.ai_map(ops.enhance_requests(t.v_ai_texts).select("doc_id", "provider", "prompt", "max_tokens", "error"), length_model)
    return results.select("doc_id", "success", "content", "model", F.col("token_usage")["prompt_tokens"].alias("prompt_tokens"), "error")


@query("extractive_summary", """SELECT doc_id, CASE WHEN w <> '' THEN w ELSE h END AS summary FROM (SELECT doc_id, h, regexp_extract(h, '(?s)^(.*[.!?。])', 1) AS w
    FROM (SELECT doc_id, substring(text, 1, 300) AS h FROM documents))""")
def extractive_summary(t):
    return ops.extractive_summary(t.documents).select("doc_id", "summary")


@query("ai_cache_join", check_sql(
    "v_ai_texts v_ai_cache",
    """SELECT k.doc_id, k.provider, k.key AS cache_key, coalesce(c.content, CASE WHEN NOT contains(prompt, '***') THEN concat(length(prompt), ' chars') END) AS content,
    c.content IS NOT NULL AS from_cache, c.content IS NOT NULL OR NOT contains(prompt, '***') AS success, CASE WHEN c.content IS NULL AND contains(prompt, '***') THEN 'refused' END AS error FROM (SELECT doc_id, provider, md5(concat(text, ':', provider)) AS key FROM v_ai_texts) k JOIN s ON s.doc_id = k.doc_id
    LEFT JOIN (SELECT cache_key, min(content) AS content FROM v_ai_cache GROUP BY 1) c ON c.cache_key = k.key""", s=SUMMARY))
def ai_cache_join(t):
    def infer(missing):
        return ops.ai_map(ops.summary_requests(missing).select("cache_key", "provider", "prompt", "max_tokens"), length_model)

    return ops.ai_cache_join(t.v_ai_texts.select("doc_id", "text", "provider"), t.v_ai_cache, infer)


@query("ai_batch_summary", check_sql(
    "v_ai_results",
    """SELECT operation, count(*) AS total_texts, count_if(success) AS successful, count_if(NOT success) AS failed, round(coalesce(sum(processing_time::DOUBLE) FILTER (success), 0), 6) AS total_processing_time
    FROM v_ai_results GROUP BY operation"""))
def ai_batch_summary(t):
    results = t.v_ai_results.withColumn("processing_time", F.col("processing_time").cast("double"))
    return ops.ai_batch_summary(results)


@query("ai_length_report", check_sql(
    "v_ai_results",
    """SELECT doc_id, original_length, length(content) AS result_length, round(CASE WHEN original_length > 0 THEN length(content) / original_length END, 6) AS compression FROM v_ai_results WHERE success"""))
def ai_length_report(t):
    return ops.ai_length_report(t.v_ai_results)


@query("token_usage_totals", check_sql(
    "v_ai_results",
    """SELECT provider, model, kind, CAST(sum(tokens) AS BIGINT) AS tokens FROM (SELECT provider, model, 'prompt_tokens' AS kind, prompt_tokens AS tokens FROM v_ai_results UNION ALL
    SELECT provider, model, 'completion_tokens', completion_tokens FROM v_ai_results) GROUP BY ALL"""))
def token_usage_totals(t):
    usage = F.create_map(F.lit("prompt_tokens"), "prompt_tokens", F.lit("completion_tokens"), "completion_tokens")
    return ops.token_usage_totals(t.v_ai_results.withColumn("token_usage", usage))


@query("parse_title_lines", check_sql(
    "v_responses",
    f"""SELECT doc_id, ord, i AS number, ls[i] AS title, concat('第', i, '章: ', ls[i]) AS label FROM (SELECT doc_id, ord, list_filter(list_transform(string_split(response, chr(10)), lambda x: {S.ustrip('x')}), lambda x: x <> '') AS ls
    FROM v_responses), unnest(range(1, len(ls) + 1)) AS u(i)"""))
def parse_title_lines(t):
    return ops.parse_title_lines(t.v_responses)


_SAMPLED = """SELECT doc_id, page_num, tx, rn, count(*) OVER (PARTITION BY doc_id) AS n FROM (SELECT doc_id, page_num, string_agg(text, ' ' ORDER BY block_id) AS tx,
    row_number() OVER (PARTITION BY doc_id ORDER BY page_num) AS rn FROM v_blocks GROUP BY doc_id, page_num) WHERE rn <= 20"""


@query("ai_chapter_proposals", check_sql(
    "v_blocks",
    f"""SELECT doc_id, page_num, title FROM (SELECT s.doc_id, s.page_num, CASE WHEN length(w) < 3 OR lower(w) IN ('chapter', 'section', 'part') THEN {S.ustrip("split_part(head, '.', 1)")} ELSE w END AS title FROM (
    SELECT doc_id, page_num, regexp_extract(substring(tx, 1, 200) || '...', '^(\\S+)', 1) AS w FROM s WHERE n >= 3) s JOIN h ON h.doc_id = s.doc_id AND h.page_num = s.page_num WHERE w <> '') WHERE length(title) > 2""",
    s=_SAMPLED, h=HEADS))
def ai_chapter_proposals(t):
    return ops.ai_chapter_proposals(t.v_blocks, outline_model).select("doc_id", "page_num", "title")


@query("ai_metadata_infer", check_sql(
    "v_blocks v_meta",
    """SELECT m.doc_id, coalesce(title, concat('Untitled ', n)) AS title, coalesce(author, CASE WHEN n IS NOT NULL THEN 'Anonymous' END) AS author FROM v_meta m LEFT JOIN (
    SELECT doc_id, sum(length(concat('Page ', page_num + 1, ':x', substring(tx, 1, 200), '...xx')))::BIGINT AS n FROM s GROUP BY doc_id) g ON g.doc_id = m.doc_id""", s=_SAMPLED))
def ai_metadata_infer(t):
    return ops.ai_metadata_infer(t.v_meta, t.v_blocks, title_model)
