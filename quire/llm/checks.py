"""Checking SQL (DuckDB) of the queries that SQL can express. Values are written out, not shared with the operators."""

LINE_RULES = r"""
WITH d AS (
    SELECT doc_id, source AS host, coalesce(text, '') AS text,
        list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)),
            lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
    FROM documents
), starts AS (
    SELECT doc_id, i, list_slice(w, i, i + 4) AS gram
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
), twice AS (
    SELECT doc_id, i FROM starts QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1
), covered AS (
    SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id
), lines AS (
    SELECT doc_id, host, lower(regexp_replace(trim(translate(x, chr(9) || chr(11) || chr(12) || chr(13), '    ')), ' +', ' ', 'g')) AS line,
        len(list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS words
    FROM (SELECT doc_id, host, unnest(l) AS x FROM d)
), hosts AS (
    SELECT host, count(*) AS documents FROM d GROUP BY host
), above AS (
    SELECT host, line FROM lines JOIN hosts USING (host)
    GROUP BY host, line, documents
    HAVING count(DISTINCT doc_id) > 20 AND count(DISTINCT doc_id) > 0.001 * documents
), gone AS (
    SELECT doc_id, sum(words) AS n FROM lines JOIN above USING (host, line) GROUP BY doc_id
), counted AS (
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
        CAST(coalesce(gone.n, 0) AS BIGINT) AS n_removed_words
    FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN gone USING (doc_id)
)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
    AND n_words - n_removed_words >= 10 AND n_words - n_removed_words >= 0.3 * n_words AS kept
FROM counted
"""


def _round(n: int) -> str:
    return f"""r{n} AS (
    SELECT kind, host, CAST(sum(rank) AS BIGINT) AS rank FROM (
        SELECT kind, host, rank * 15 // 100 AS rank FROM r0
        UNION ALL
        SELECT kind, target, sum(CAST(rank * 85 // 100 AS HUGEINT) * weight // total) FROM r{n - 1} JOIN shares USING (kind, host) GROUP BY ALL
    ) GROUP BY ALL
)"""


LINK_GRAPH = r"""
WITH parts AS (
    SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM (SELECT page_id, html,
        CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)
), judged AS (
    SELECT *, CASE
        WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
    FROM parts
), ruled AS (
    SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS said FROM judged
), edges AS (
    SELECT source, target, count(*) AS weight FROM (
        SELECT host AS source, regexp_replace(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^.*@|:\d*$', '', 'g') AS target
        FROM (SELECT host, unnest(regexp_extract_all(html, '(?i)\shref\s*=\s*["'']?\s*(?:https?:)?//([^/?#"''\s<>]+)', 1)) AS t FROM ruled)
    ) WHERE source <> target AND source <> '' AND target <> '' GROUP BY ALL
), shares AS (
    SELECT 'trust' AS kind, source AS host, target, weight, CAST(sum(weight) OVER (PARTITION BY source) AS BIGINT) AS total FROM edges
    UNION ALL
    SELECT 'distrust', target, source, weight, CAST(sum(weight) OVER (PARTITION BY target) AS BIGINT) FROM edges
), hosts AS (
    SELECT host, count(*) AS weight, CASE WHEN 2 * count(*) FILTER (said = 'allow') > count(*) THEN 'trust'
        WHEN 2 * count(*) FILTER (said = 'block') > count(*) THEN 'distrust' END AS kind
    FROM ruled WHERE host <> '' GROUP BY host
), r0 AS (
    SELECT kind, host, CAST(CAST(weight AS HUGEINT) * 1000000000000 // CAST(sum(weight) OVER (PARTITION BY kind) AS BIGINT) AS BIGINT) AS rank FROM hosts WHERE kind IS NOT NULL
), """ + ", ".join(_round(n) for n in range(1, 11)) + r""", reached AS (
    SELECT host, CAST(sum(CASE WHEN kind = 'trust' THEN rank ELSE 0 END) AS BIGINT) AS trust,
        CAST(sum(CASE WHEN kind = 'distrust' THEN rank ELSE 0 END) AS BIGINT) AS distrust FROM r10 GROUP BY host
)
SELECT page_id, host, path, rule,
    coalesce(said, CASE WHEN 100 * distrust > 60 * (trust + distrust) THEN 'block' END, 'allow') AS verdict,
    coalesce(trust, 0) AS trust, coalesce(distrust, 0) AS distrust
FROM ruled LEFT JOIN reached USING (host)
"""


CHAT = r"""
WITH c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
    UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), e AS (
    SELECT *, length('<|im_start|>') + length(role) + 1 + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + length('<|im_end|>') + 1 AS n FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def _centroid_round(r: int) -> str:
    """Assignment of round r and the centroids that follow from it."""
    return f"""a{r} AS MATERIALIZED (
    SELECT row, vec_id, x, cluster, d FROM (
        SELECT v.*, c.cluster, CAST(list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d
        FROM v, c{r} c
    ) QUALIFY row_number() OVER (PARTITION BY row ORDER BY d, cluster) = 1
), c{r + 1} AS MATERIALIZED (
    SELECT c.cluster, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN (
        SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM (
            SELECT cluster, i, sum(e) AS s, count(*) AS n FROM (SELECT cluster, unnest(x) AS e, generate_subscripts(x, 1) AS i FROM a{r}) GROUP BY ALL
        ) GROUP BY cluster
    ) m USING (cluster)
)"""


NS_BOUNDS = r"""
WITH v AS MATERIALIZED (
    SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda e: CAST(floor(1024 * CAST(e AS DOUBLE)) AS BIGINT)) AS x
    FROM embeddings WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda e: e IS NOT NULL AND isfinite(e)))
), c0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY h) - 1 AS cluster, x FROM (SELECT sha256('3:' || vec_id) AS h, x FROM v ORDER BY h LIMIT 8)
), """ + ", ".join(_centroid_round(r) for r in range(11)) + r"""
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
    CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a10 JOIN c10 c USING (cluster)
"""
