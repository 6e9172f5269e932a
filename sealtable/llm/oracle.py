"""The same results in DuckDB SQL, where SQL can express the operator over whole tables."""

from __future__ import annotations

from .quality_rules import RULES, STOP_WORDS

_SPACE = r"\x20\x09-\x0D"

LINE_DEDUP = """
WITH lines AS (
  SELECT doc_id,
         unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS spot
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), heavy AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT k.doc_id, k.line, k.spot, h.key IS NOT NULL AND k.doc_id <> h.keeper AS gone
  FROM keyed k LEFT JOIN heavy h ON k.key = h.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY spot) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
_HOLD = " AND ".join(
    f"{r.metric} {op} {bound!r}::double" for r in RULES for op, bound in ((">=", r.least), ("<=", r.most)) if bound is not None
)

QUALITY_RULES = rf"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^{_SPACE}]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^{_SPACE}]')) AS lines
  FROM documents
), windows AS (
  SELECT doc_id, spot, array_to_string(words[spot : spot + 7], ' ') AS run
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS spot FROM base WHERE len(words) >= 8)
), twice AS (
  SELECT doc_id, spot FROM (SELECT doc_id, spot, count(*) OVER (PARTITION BY doc_id, run) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT spot + step) AS n_repeat_words
  FROM (SELECT doc_id, spot, unnest(range(8)) AS step FROM twice) GROUP BY doc_id
), counts AS (
  SELECT b.doc_id, len(words)::bigint AS n_words,
         coalesce(length(array_to_string(words, '')), 0)::bigint AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::bigint AS n_dup_lines,
         coalesce(n_repeat_words, 0)::bigint AS n_repeat_words,
         len(lines) AS n_lines,
         len(list_filter(words, lambda w: lower(w) IN ({_STOPS}))) AS n_stop_words,
         len(regexp_extract_all(text, '[A-Z]')) AS n_upper, len(regexp_extract_all(text, '[a-z]')) AS n_lower
  FROM base b LEFT JOIN covered c ON b.doc_id = c.doc_id
), ratios AS (
  SELECT *, CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_word_chars,
         CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbol_ratio,
         CASE WHEN n_upper + n_lower > 0 THEN n_upper / (n_upper + n_lower) ELSE 0 END AS shout_ratio,
         CASE WHEN n_words > 0 THEN n_stop_words / n_words ELSE 0 END AS stop_word_ratio,
         CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_ratio,
         n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed
  FROM counts
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {_HOLD} AS kept
FROM ratios
"""

_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

DECONTAMINATION = f"""
WITH docs AS (SELECT doc_id, {_WORDS} AS words FROM documents),
items AS (SELECT item_id, words, least(8, len(words)) AS size FROM (SELECT item_id, {_WORDS} AS words FROM benchmark) WHERE len(words) > 0),
wanted AS (
  SELECT DISTINCT item_id, size, array_to_string(words[spot : spot + size - 1], ' ') AS run
  FROM (SELECT item_id, words, size, unnest(range(1, len(words) - size + 2)) AS spot FROM items)
), runs AS (
  SELECT doc_id, size, spot, array_to_string(words[spot : spot + size - 1], ' ') AS run
  FROM (SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS spot
        FROM docs, (SELECT DISTINCT size FROM items) WHERE len(words) >= size)
), hits AS (
  SELECT r.doc_id, r.spot, r.size, w.item_id FROM runs r JOIN wanted w ON r.size = w.size AND r.run = w.run
), words_hit AS (
  SELECT doc_id, count(DISTINCT spot + step) AS n_hit
  FROM (SELECT DISTINCT doc_id, spot, unnest(range(size)) AS step FROM hits) GROUP BY doc_id
), items_hit AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS named
  FROM (SELECT DISTINCT doc_id, item_id::varchar AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(words)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items,
       sha256(coalesce(named, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM docs d LEFT JOIN words_hit w ON d.doc_id = w.doc_id LEFT JOIN items_hit i ON d.doc_id = i.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_line_dedup": LINE_DEDUP,
        "op3_quality_rules": QUALITY_RULES,
        "op5_decontamination": DECONTAMINATION,
    }
