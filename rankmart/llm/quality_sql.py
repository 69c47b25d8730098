"""DuckDB twin of the quality rules."""

from rankmart.llm import quality as Q


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_WORDS = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"
_COUNTS = [f"length(regexp_replace(t, '[^{cls}]', '', 'g'))" for cls in (
    "a-z", r"\x20\x09-\x0D", "A-Z", "0-9", r"#*$%&|<>", r".,;:!?''\"()\-")]


def _js(p: str, q: str) -> str:
    """SQL text of the Jensen-Shannon distance of two list expressions of counts."""
    part = lambda a: f"CASE WHEN {a} > 0 THEN {a} * log2({a} / ((z.x + z.y) / 2)) ELSE 0 END"
    pairs = (f"list_transform(range(1, len({p}) + 1), lambda i: struct_pack(x := {p}[i]::DOUBLE / list_sum({p}), "
             f"y := {q}[i]::DOUBLE / list_sum({q})))")
    total = f"list_sum(list_transform({pairs}, lambda z: ({part('z.x')} + {part('z.y')}) / 2))"
    return f"CASE WHEN list_sum({p}) > 0 AND list_sum({q}) > 0 THEN sqrt(greatest({total}, 0.0)) END"


def quality_sql(docs: str = "documents", columns: str | None = None) -> str:
    """The rows of the quality query over the table ``docs``; ``columns``: the kept documents' columns instead."""
    result = ("SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged"
              if columns is None else f"SELECT {columns} FROM judged JOIN d USING (rid) WHERE kept")
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, * FROM {docs}),
src AS (SELECT rid, doc_id AS did, coalesce(lang, '') AS lg, coalesce(text, '') AS t FROM d),
w AS (SELECT rid, did, lg, t, {_WORDS} AS words, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines,
  [{', '.join(_COUNTS)}]::BIGINT[] AS six FROM src),
v AS (SELECT *, list_append(six, length(t) - list_sum(six)::BIGINT) AS classes FROM w),
win AS (SELECT rid, i, words[i:i + {Q.WINDOW - 1}] AS g FROM (SELECT rid, words, unnest(range(1, len(words) - {Q.WINDOW - 2})) AS i
  FROM v WHERE len(words) >= {Q.WINDOW})),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT rid, sum(least({Q.WINDOW}, coalesce(nxt - i, {Q.WINDOW})))::BIGINT AS n_rep
  FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM twice) GROUP BY rid),
cls AS (SELECT lg, [sum(classes[1]), sum(classes[2]), sum(classes[3]), sum(classes[4]), sum(classes[5]), sum(classes[6]), sum(classes[7])]
  AS ref_classes FROM v GROUP BY lg),
wc AS (SELECT lg, word, count(*) AS n FROM (SELECT lg, unnest(words) AS word FROM v) GROUP BY lg, word),
tops AS (SELECT lg, list(word ORDER BY n DESC, word) AS top, list(n ORDER BY n DESC, word) AS top_n FROM
  (SELECT *, row_number() OVER (PARTITION BY lg ORDER BY n DESC, word) AS k FROM wc) WHERE k <= {Q.COMMON_WORDS} GROUP BY lg),
refs AS (SELECT lg, ref_classes, top, list_append(top_n, ref_words - list_sum(top_n)::BIGINT) AS ref_n FROM cls JOIN tops USING (lg)
  JOIN (SELECT lg, sum(n)::BIGINT AS ref_words FROM wc GROUP BY lg) USING (lg) WHERE ref_words >= {Q.MIN_REFERENCE_WORDS}),
x AS (SELECT v.rid, did, len(words) AS nw, length(t) AS n_chars, classes, six[5] AS sym, length(t) - six[2] AS wch,
  len(lines) - len(list_distinct(lines)) AS dl, coalesce(n_rep, 0) AS n_rep, ref_classes, ref_n,
  list_transform(top, lambda z: len(list_filter(words, lambda y: y = z))) AS hits
  FROM v LEFT JOIN rep USING (rid) LEFT JOIN refs ON refs.lg = v.lg),
y AS (SELECT *, list_append(hits, nw - list_sum(hits)::BIGINT) AS word_hist, nw < {Q.MIN_WORDS} OR n_rep * 100 > nw * {Q.MAX_REPEAT_PCT} AS bad FROM x),
judged AS (SELECT rid{', did AS doc_id' if columns is None else ''}, nw AS n_words, wch AS word_chars, sym AS n_symbols, dl AS n_dup_lines, n_rep AS n_repeat_words,
  bad AS base_failed, NOT bad AND coalesce(CASE WHEN n_chars >= {Q.MIN_CHARS_JS} THEN {_js('classes', 'ref_classes')} END, 0) <= {Q.MAX_CHAR_JS}
  AND coalesce(CASE WHEN nw >= {Q.MIN_WORDS_JS} THEN {_js('word_hist', 'ref_n')} END, 0) <= {Q.MAX_WORD_JS} AS kept FROM y)
{result}"""


QUALITY_SQL = quality_sql()
