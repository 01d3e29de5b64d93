"""DuckDB statements for the operators' queries that SQL can express."""

from __future__ import annotations

import string

_LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"

DECONTAMINATION = rf"""
WITH doc_words AS (
    SELECT row_number() OVER () AS row_id, doc_id,
           regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM documents
), item_words AS (
    SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), sized AS (
    SELECT item_id, words, least(len(words), 10) AS size FROM item_words WHERE len(words) > 0
), item_windows AS (
    SELECT DISTINCT item_id, size, array_to_string(words[i:i + size - 1], ' ') AS shown
    FROM (SELECT item_id, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM sized)
), doc_windows AS (
    SELECT row_id, i, size, array_to_string(words[i:i + size - 1], ' ') AS shown
    FROM (
        SELECT row_id, words, size, unnest(range(1, len(words) - size + 2)) AS i
        FROM doc_words, (SELECT DISTINCT size FROM item_windows)
    )
), hits AS (
    SELECT row_id, i, size, item_id FROM doc_windows JOIN item_windows USING (size, shown)
), hit_words AS (
    SELECT row_id, count(DISTINCT w) AS n_hit
    FROM (SELECT row_id, unnest(range(i, i + size)) AS w FROM (SELECT DISTINCT row_id, i, size FROM hits))
    GROUP BY row_id
), hit_items AS (
    SELECT row_id, count(DISTINCT item_id) AS n_items,
           string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS listed
    FROM hits GROUP BY row_id
)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN hit_words USING (row_id) LEFT JOIN hit_items USING (row_id)
"""

_RATES = ["symbol_rate", "shout_rate", "dup_line_rate", "repeat_rate"]
_RULE_ROWS = " UNION ALL ".join(f"SELECT row_id, doc_id, lang, '{r}' AS rule, {r} AS rate FROM rated" for r in _RATES)

QUALITY_RULES = rf"""
WITH split AS (
    SELECT row_number() OVER () AS row_id, doc_id, lang, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
    FROM documents
), windows AS (
    SELECT row_id, i, array_to_string(words[i:i + 7], ' ') AS shown
    FROM (SELECT row_id, words, unnest(range(1, len(words) - 6)) AS i FROM split)
), repeated AS (
    SELECT row_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY row_id, shown) > 1
), repeat_words AS (
    SELECT row_id, count(DISTINCT w) AS n FROM (SELECT row_id, unnest(range(i, i + 8)) AS w FROM repeated) GROUP BY row_id
), counted AS (
    SELECT s.row_id, doc_id, lang, len(words)::BIGINT AS n_words,
           coalesce(length(array_to_string(words, '')), 0)::BIGINT AS word_chars,
           len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
           len(regexp_extract_all(text, '!'))::BIGINT AS n_shouts,
           (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines,
           coalesce(n, 0)::BIGINT AS n_repeat_words
    FROM split s LEFT JOIN repeat_words USING (row_id)
), rated AS (
    SELECT *, n_symbols::DOUBLE / greatest(word_chars, 1) AS symbol_rate,
           n_shouts::DOUBLE / greatest(word_chars, 1) AS shout_rate,
           n_dup_lines::DOUBLE / greatest(n_lines, 1) AS dup_line_rate,
           n_repeat_words::DOUBLE / greatest(n_words, 1) AS repeat_rate,
           n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed
    FROM counted
), by_rule AS ({_RULE_ROWS}
), good AS (
    SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1
), tests AS (
    SELECT lang, rule, cutoff, count(*) AS n, count(*) FILTER (rate > cutoff) AS k,
           CASE rule WHEN 'repeat_rate' THEN 0.008::DOUBLE WHEN 'dup_line_rate' THEN 0.006::DOUBLE ELSE 0.003::DOUBLE END AS share
    FROM by_rule SEMI JOIN good USING (doc_id),
         (SELECT unnest([0.002, 0.005, 0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.18, 0.25, 0.35, 0.5])::DOUBLE AS cutoff)
    GROUP BY ALL
), tails AS (
    SELECT *, CASE WHEN k >= n * share THEN 1 ELSE list_sum(list_transform(range(0, k + 1), lambda i: exp(
               lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(share) + (n - i) * ln(1 - share)))) END AS p
    FROM tests
), steps AS (
    SELECT *, bool_and(p * (SELECT count(*) FROM (SELECT DISTINCT lang FROM tests)) * 4 <= 0.05::DOUBLE)
        OVER (PARTITION BY lang, rule ORDER BY cutoff DESC ROWS UNBOUNDED PRECEDING) AS passed
    FROM tails
), cutoffs AS (
    SELECT lang, rule, min(cutoff) AS cutoff FROM steps WHERE passed GROUP BY ALL
), over AS (
    SELECT DISTINCT row_id FROM by_rule b JOIN cutoffs c ON b.lang IS NOT DISTINCT FROM c.lang AND b.rule = c.rule
    WHERE b.rate > c.cutoff
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND row_id NOT IN (SELECT row_id FROM over) AS kept
FROM rated
"""

SUBSTRING_DEDUP = r"""
WITH texts AS (
    SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
    FROM documents
), placed AS (
    SELECT row_id, doc_id, unnest(words) AS word, unnest(range(len(words))) AS i FROM texts
), windows AS (
    SELECT row_id, doc_id, i, word, count(*) OVER w AS n, string_agg(word, ' ') OVER w AS shown
    FROM placed
    WINDOW w AS (PARTITION BY row_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)
), first_ids AS (
    SELECT shown, min(doc_id) AS least FROM windows WHERE n = 13 GROUP BY shown
), hits AS (
    SELECT row_id, doc_id, i, word, n = 13 AND coalesce(least < windows.doc_id, FALSE) AS hit
    FROM windows LEFT JOIN first_ids USING (shown)
), covered AS (
    SELECT row_id, i, word, bool_or(hit) OVER (PARTITION BY row_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone
    FROM hits
), cut AS (
    SELECT row_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed,
           string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept
    FROM covered GROUP BY row_id
)
SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM texts LEFT JOIN cut USING (row_id)
"""


def statements() -> dict[str, str]:
    return {"op4_decontamination": DECONTAMINATION, "op6_quality_rules": QUALITY_RULES, "op13_substring_dedup": SUBSTRING_DEDUP}
