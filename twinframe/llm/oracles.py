"""DuckDB SQL of the registered text queries, where SQL can express them."""

from __future__ import annotations

LINE_DEDUP = """
WITH split AS (
    SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE length(text) > 0
), placed AS (
    SELECT doc_id, lines, unnest(range(0, greatest(len(lines) - 3, 0) + 1)) AS pos FROM split
), windows AS (
    SELECT doc_id, pos, array_to_string(list_transform(lines[pos + 1 : pos + 3], lambda x: trim(x, ' ')), chr(10)) AS win FROM placed
), full_windows AS (
    SELECT * FROM windows WHERE length(replace(win, chr(10), '')) > 0
), ranked AS (
    SELECT doc_id, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS nth FROM full_windows
), covered AS (
    SELECT doc_id, list(DISTINCT pos) AS starts FROM ranked WHERE nth > 1 GROUP BY doc_id
), marked AS (
    SELECT d.doc_id, d.text, string_split(d.text, chr(10)) AS lines, c.starts,
        list_distinct(list_filter(flatten(list_transform(c.starts, lambda x: [x, x + 1, x + 2])), lambda y: y < len(string_split(d.text, chr(10))))) AS gone
    FROM documents d LEFT JOIN covered c ON d.doc_id = c.doc_id
)
SELECT doc_id,
    CASE WHEN starts IS NULL THEN text ELSE coalesce(array_to_string(list_transform(list_filter(range(0, len(lines)), lambda x: NOT list_contains(gone, x)), lambda x: lines[x + 1]), chr(10)), '') END AS text,
    CASE WHEN coalesce(text, '') = '' THEN 0 ELSE len(lines) END AS n_lines,
    CASE WHEN starts IS NULL THEN 0 ELSE len(gone) END AS n_removed
FROM marked
"""

QUALITY = r"""
WITH texts AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
    FROM documents
), places AS (
    SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS pos FROM texts WHERE len(words) >= 3
), windows AS (
    SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, words[pos], words[pos + 1], words[pos + 2]) AS n FROM places
), covered AS (
    SELECT doc_id, count(DISTINCT word) AS n FROM (SELECT doc_id, unnest([pos, pos + 1, pos + 2]) AS word FROM windows WHERE n > 1) GROUP BY doc_id
), counts AS (
    SELECT t.doc_id, len(words)::BIGINT AS n_words, coalesce(length(array_to_string(words, '')), 0)::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
    FROM texts t LEFT JOIN covered c ON t.doc_id = c.doc_id
), judged AS (
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND NOT (10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 12 * n_words OR 10 * n_dup_lines > 6 * n_lines) AS kept
FROM judged
"""

RANKED_SEARCH = r"""
WITH words AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), counted AS (
    SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term
), sizes AS (
    SELECT doc_id, sum(tf)::BIGINT AS n FROM counted GROUP BY doc_id
), totals AS (
    SELECT count(*) AS docs, sum(n)::BIGINT AS length FROM sizes
), weights AS (
    SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM counted, totals GROUP BY term, docs
), asked AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), scored AS (
    SELECT item_id, c.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // length))))::BIGINT AS score
    FROM asked a JOIN counted c USING (term) JOIN weights USING (term) JOIN sizes s ON s.doc_id = c.doc_id, totals
    GROUP BY item_id, c.doc_id
), ranked AS (
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""

ORACLES: dict[str, str] = {
    "op6_quality_cascade": QUALITY,
    "op7_line_dedup": LINE_DEDUP,
    "op12_ranked_search": RANKED_SEARCH,
}
