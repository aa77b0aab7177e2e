"""SQL that the queries must agree with, for DuckDB over the same tables."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op2_url_filter"] = """
WITH rules(h, p, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
    ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
parts AS (
    SELECT row_number() OVER () AS r, page_id,
        CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
    FROM pages),
split AS (
    SELECT r, page_id,
        translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                  'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM parts),
fitting AS (
    SELECT r, h || p AS rule, verdict,
        row_number() OVER (PARTITION BY r ORDER BY length(h || p) DESC, length(h) DESC) AS n
    FROM split, rules
    WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM split LEFT JOIN (SELECT * FROM fitting WHERE n = 1) USING (r)
"""

ORACLES["op4_chat_format"] = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL
    SELECT -7, n, role, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) t(n, role)),
numbered AS (
    SELECT *, lag(role) OVER w AS before,
        row_number() OVER w AS n,
        length(replace(replace(text, '\', '\\'), '<|', '<\|'))
        + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n')) AS escaped,
        length(replace(replace(role, '\', '\\'), '<|', '<\|')) AS role_chars
    FROM turns
    WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(CASE WHEN before = role THEN 8 + escaped - role_chars ELSE 8 + 1 + 8 + escaped END)::BIGINT
        AS formatted_chars
FROM numbered GROUP BY conv_id
"""

ORACLES["op7_source_mix"] = """
WITH RECURSIVE numbered AS MATERIALIZED (SELECT *, row_number() OVER () AS r FROM documents),
sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
weighed AS (SELECT source, n, pow(n::DOUBLE, 0.5)::DECIMAL(38, 6) AS exact, pow(n::DOUBLE, 0.5) AS w FROM sizes),
rates AS (
    SELECT source, w * (SELECT sum(n) FROM sizes)::DOUBLE / ((SELECT sum(exact) FROM weighed)::DOUBLE * n) AS rate
    FROM weighed),
means AS (
    SELECT source, greatest(ceil(rate / 16.0)::INT, 1) AS parts, rate / greatest(ceil(rate / 16.0)::INT, 1) AS mean
    FROM rates),
steps AS (
    SELECT source, parts, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS cdf FROM means
    UNION ALL
    SELECT source, parts, mean, k + 1, p * mean / (k + 1), cdf + p * mean / (k + 1) FROM steps WHERE k < 96),
drawn AS (
    SELECT d.r, d.doc_id, d.source, part,
        (CAST('0x' || substr(md5('mix-1|' || coalesce(d.doc_id::VARCHAR, 'null') || '|' || part), 1, 13) AS BIGINT)
         + 0.5) / 4503599627370496 AS u
    FROM numbered d
    JOIN means m ON d.source IS NOT DISTINCT FROM m.source, unnest(generate_series(1, m.parts)) t(part)),
counts AS (
    SELECT r, count(*) AS copies
    FROM drawn d JOIN steps s ON d.source IS NOT DISTINCT FROM s.source AND s.cdf <= d.u
    GROUP BY r)
SELECT doc_id, text, lang, source, n_chars, (c - 1)::INT AS mix_copy,
    md5('mix-1/order|' || coalesce(doc_id::VARCHAR || '|', '') || (c - 1)) AS mix_order
FROM counts JOIN numbered USING (r), unnest(generate_series(1, copies)) t(c)
"""
