"""DuckDB SQL for the queries that SQL can express."""

from tieline.llm.quality_rules import LANGUAGES, STOP_WORDS
from tieline.llm.text import LOWER, UPPER, WORD

ORACLES: dict[str, str] = {}

ORACLES["op3_ngram_join"] = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) >= 5 THEN array_to_string(w[i:i + 4], ' ') ELSE array_to_string(w, ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM d WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), steps AS (SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS node, doc_id AS other FROM documents
  UNION SELECT reach.node, steps.b FROM reach JOIN steps ON steps.a = reach.other
)
SELECT node AS doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id
FROM reach LEFT JOIN sizes ON sizes.doc_id = node GROUP BY node
"""

ORACLES["op4_quality_rules"] = f"""
WITH d AS (
  SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines
  FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)
), repeated AS (SELECT doc_id, s FROM windows GROUP BY doc_id, s HAVING count(*) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM windows JOIN repeated USING (doc_id, s), range(5) AS r(k) GROUP BY doc_id
), counts AS (
  SELECT d.doc_id, lang, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_capitals,
         len(list_filter(w, lambda x: translate(x, '{UPPER}', '{LOWER}') IN ({', '.join(repr(s) for s in sorted(set(STOP_WORDS)))})))::BIGINT AS n_stop_words,
         len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM d LEFT JOIN covered USING (doc_id)
), base AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counts)
SELECT * EXCLUDE (lang), NOT base_failed
       AND word_chars / greatest(n_words, 1) BETWEEN 2 AND 12
       AND n_symbols / greatest(n_words, 1) <= 0.1::DOUBLE
       AND (n_words < 20 OR n_capitals / greatest(word_chars, 1) <= 0.4::DOUBLE)
       AND (n_words < 50 OR coalesce(lang NOT IN ({', '.join(map(repr, LANGUAGES))}), true) OR n_stop_words / greatest(n_words, 1) >= 0.01::DOUBLE)
       AND (n_words < 20 OR n_dup_lines / greatest(n_lines, 1) <= 0.5::DOUBLE) AS kept
FROM base
"""

ORACLES["op10_exact_dedup"] = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""
