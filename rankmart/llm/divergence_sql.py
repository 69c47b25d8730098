"""DuckDB twin of the source divergence audit."""

from rankmart.llm.divergence import KEEP, SCALE, SMOOTH, TOP_TERMS

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

DIVERGENCE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
  w AS (SELECT k, lang, source, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'),
          '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
  kept AS (SELECT lang, term, count(*) AS lang_n FROM w GROUP BY lang, term HAVING count(DISTINCT k) >= {KEEP}),
  c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
  sizes AS (SELECT lang, count(*) AS v, sum(lang_n) AS total FROM kept GROUP BY lang),
  g AS (SELECT DISTINCT lang, source FROM d),
  t AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
  p AS (SELECT t.lang, t.source, kept.term, coalesce(c.n, 0) AS n,
               1 + ({SCALE}::HUGEINT * (coalesce(c.n, 0) + {SMOOTH})) // (t.total + {SMOOTH} * sizes.v) AS p,
               1 + ({SCALE}::HUGEINT * (kept.lang_n + {SMOOTH})) // (sizes.total + {SMOOTH} * sizes.v) AS q
        FROM t JOIN kept ON kept.lang = t.lang JOIN sizes ON sizes.lang = t.lang
        LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = kept.term),
  sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
           FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
  pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sums.value, 0) AS value
            FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source),
  terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p WHERE n > 0 AND p > q),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
             FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= {TOP_TERMS}"""
