"""SQL for the operators on texts that SQL can express, for DuckDB. It shares the rules' patterns with the operators, nothing else."""

from __future__ import annotations

from alloyscreen.llm import line_rules

_SPACE = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def line_first(least_left: int = 50) -> str:
    """The query op3: words and lines as rows of their own, windows of five words counted by their text."""
    count = lambda pattern: f"len(regexp_extract_all(line, {_quoted(pattern)}))"
    has = lambda pattern: f"regexp_matches(line, {_quoted(pattern)})"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
cut AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d),
worded AS (
  SELECT rid, line, length(line) AS chars,
    (length(line) <= {line_rules.SHORT_LINE} AND ({has(line_rules.BOILERPLATE)} OR {has(line_rules.NAVIGATION)} OR {count(line_rules.MENU_MARK)} >= 3))
    OR (NOT {has(line_rules.SENTENCE_MARK)} AND {count(_WORD + '+')} >= {line_rules.UNMARKED_WORDS})
    OR {count(line_rules.SHOUT)} >= {line_rules.SHOUTS} AS fails
  FROM cut WHERE {has(_WORD)}),
by_line AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) FILTER (WHERE fails) AS n_failed_lines,
    sum(chars) AS chars, coalesce(sum(chars) FILTER (WHERE NOT fails), 0) AS chars_left
  FROM worded GROUP BY rid),
split AS (SELECT rid, regexp_extract_all(text, '{_WORD}+') AS ws FROM d),
word AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM split),
gram AS (
  SELECT rid, i, CASE WHEN lead(w, 4) OVER o IS NOT NULL
    THEN concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o) END AS g
  FROM word WINDOW o AS (PARTITION BY rid ORDER BY i)),
twice AS (SELECT rid, i, CASE WHEN g IS NOT NULL AND count(*) OVER (PARTITION BY rid, g) > 1 THEN 1 ELSE 0 END AS again FROM gram),
covered AS (SELECT rid, max(again) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS c FROM twice),
by_word AS (SELECT rid, count(*) AS n_words, sum(c) AS n_repeat_words FROM covered GROUP BY rid),
figures AS (
  SELECT doc_id, coalesce(n_words, 0) AS n_words, length(regexp_replace(text, '{_SPACE}', '', 'g')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_failed_lines, 0) AS n_failed_lines,
    coalesce(chars, 0) AS chars, coalesce(chars_left, 0) AS chars_left
  FROM d LEFT JOIN by_line USING (rid) LEFT JOIN by_word USING (rid)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM figures)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND 100 * chars_left >= {least_left} * chars AS kept,
  n_lines::BIGINT AS n_lines, n_failed_lines::BIGINT AS n_failed_lines
FROM judged"""


#: Name, pattern, group of the value and its least length, as asked for: shorter matches are dropped after matching (fixed values).
_KINDS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
)


def scanned(copied_owners: int = 3) -> str:
    """The query op5: matches placed by the gaps between them, values counted by distinct owners."""
    each = " UNION ALL ".join(
        f"SELECT rid, source, {k} AS kind, {least} AS least, regexp_extract_all(text, {_quoted(p)}) AS ms, regexp_extract_all(text, {_quoted(p)}, {group}) AS vs, "
        f"string_split_regex(text, {_quoted(p)}) AS gaps FROM d"
        for k, (_, p, group, least) in enumerate(_KINDS)
    )
    names = "['assign', 'access', 'hex', 'live', 'copied']"
    text = f"{names}[kind + 1] || ':' || s || ':' || e"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
matched AS ({each}),
one AS (SELECT rid, source, kind, least, unnest(ms) AS m, unnest(vs) AS v, unnest(gaps[:len(ms)]) AS g, generate_subscripts(ms, 1) AS i FROM matched WHERE len(ms) > 0),
placed AS (SELECT *, (sum(length(g) + length(m)) OVER (PARTITION BY rid, kind ORDER BY i))::BIGINT AS e FROM one),
base AS (SELECT rid, source, kind, e - length(m) AS s, e, e - length(v) AS f, v FROM placed WHERE length(v) >= least),
owners AS (SELECT v, count(DISTINCT source) >= {copied_owners} AS copied FROM base GROUP BY v),
spans AS (
  SELECT rid, s, kind, e FROM base
  UNION SELECT rid, f AS s, CASE WHEN copied THEN 4 ELSE 3 END AS kind, e FROM base JOIN owners USING (v)),
per AS (
  SELECT rid, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
    count(*) FILTER (WHERE kind = 3) AS n_live, count(*) FILTER (WHERE kind = 4) AS n_copied,
    string_agg({text}, ',' ORDER BY s, kind, e) AS spans, string_agg({text}, ',' ORDER BY s, kind, e) FILTER (WHERE kind < 3) AS base
  FROM spans GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM d LEFT JOIN per USING (rid)"""
