"""The queries that SQL can express, for another engine."""

from __future__ import annotations

W = r"[^\x20\x09-\x0D]+"

EXACT = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""

LEDGER = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{W}') AS ws FROM d),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 3)) AS i, ws FROM w WHERE len(ws) >= 5),
k AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS v FROM g),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, v) AS n FROM k),
c AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words
      FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM r WHERE n > 1) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines
      FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '{W}') GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(length(array_to_string(ws, '')), 0)::BIGINT AS word_chars,
             (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
             coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
             coalesce(n_lines, 0) AS n_lines, regexp_matches(t, '\p{{L}}') AS has_letter
      FROM w LEFT JOIN c USING (doc_id) LEFT JOIN l USING (doc_id)),
b AS (SELECT *, (n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT
             + 4 * (10 * n_symbols > 3 * n_words)::BIGINT + 8 * (n_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines)::BIGINT
             + 16 * (word_chars > 40 * n_words)::BIGINT + 32 * (n_words > 0 AND NOT has_letter)::BIGINT AS failed_bits
      FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_bits & 3) <> 0 AS base_failed,
       (failed_bits & 39) = 0 AS kept, failed_bits::BIGINT AS failed_bits
FROM b
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_duplicates": EXACT, "op4_quality_ledger": LEDGER}
