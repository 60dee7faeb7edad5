"""SQL over the shared tables for the queries that SQL can express, by plain comparison of all
pairs that share anything."""

from __future__ import annotations

_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

NGRAM_JOIN = f"""
WITH RECURSIVE tokens AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LETTERS}),
                                    '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM tokens
        WHERE len(w) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY 1, 2
),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * k >= 75 * (x.n + y.n - k)
),
reach(a, b) AS (
  SELECT a, b FROM links
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id
FROM tokens LEFT JOIN sizes USING (doc_id)
LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a) USING (doc_id)"""

LINE_DEDUP = """
WITH lines AS (
  SELECT doc_id, unnest(range(0, len(l))) AS no, unnest(l) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
),
sets AS (
  SELECT doc_id, no, line,
         list_sort(list_distinct(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+'))) AS w
  FROM lines
),
classes AS (
  SELECT w, min((doc_id, no)) AS first, len(w) AS n, row_number() OVER () AS c
  FROM sets WHERE len(w) > 0 GROUP BY w
),
tokens AS (SELECT c, n, unnest(w) AS t FROM classes),
shared AS (
  SELECT a.c AS a, b.c AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k
  FROM tokens a JOIN tokens b ON a.t = b.t AND a.c <> b.c
       AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n
  GROUP BY 1, 2
),
matches AS (SELECT a, b FROM shared WHERE 100 * k >= 80 * (na + nb - k)),
earliest AS (
  SELECT x.w, least(x.first, coalesce(min(y.first), x.first)) AS first
  FROM classes x LEFT JOIN matches ON matches.a = x.c LEFT JOIN classes y ON y.c = matches.b
  GROUP BY x.w, x.first
),
marked AS (
  SELECT s.doc_id, s.no, s.line, len(s.w) > 0 AS counts,
         coalesce(e.first < (s.doc_id, s.no), false) AS goes
  FROM sets s LEFT JOIN earliest e ON e.w = s.w
)
SELECT doc_id, coalesce(n_token_lines, 0) AS n_token_lines, coalesce(n_removed, 0) AS n_removed,
       CASE WHEN n_removed > 0 THEN kept ELSE text END AS text
FROM documents LEFT JOIN (
  SELECT doc_id, count(*) FILTER (counts) AS n_token_lines, count(*) FILTER (goes) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (NOT goes), '') AS kept
  FROM marked GROUP BY doc_id
) USING (doc_id)"""


_TERMS = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"

LEXICAL_SEARCH = f"""
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), {_LETTERS}), '{_TERMS}') AS w
  FROM documents
),
sizes AS (
  SELECT count(*) FILTER (len(w) > 0) AS docs_with, sum(len(w))::BIGINT AS all_terms FROM docs
),
tf AS (
  SELECT r, doc_id, n, t, count(*) AS tf
  FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS t FROM docs) GROUP BY ALL
),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
items AS (
  SELECT DISTINCT item_id, text,
         unnest(regexp_extract_all(translate(text, {_LETTERS}), '{_TERMS}')) AS t
  FROM benchmark
),
scores AS (
  SELECT item_id, text, doc_id, r,
         sum(floor(1000 * ln((2 * docs_with + 2) / (2 * df + 1)))::BIGINT
             * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs_with) // all_terms)))
         )::BIGINT AS score
  FROM items JOIN tf USING (t) JOIN df USING (t) CROSS JOIN sizes
  GROUP BY ALL
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id, text
                               ORDER BY score DESC, doc_id NULLS FIRST) AS place
  FROM scores WHERE score > 0
)
SELECT item_id, place::INTEGER AS rank, doc_id, score FROM ranked WHERE place <= 10"""

SUBSTRING_DEDUP = """
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
),
windows AS (
  SELECT r, doc_id, i, array_to_string(w[i:i + 49], ' ') AS x
  FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM docs)
),
firsts AS (SELECT x, min(doc_id) AS least FROM windows GROUP BY x HAVING min(doc_id) < max(doc_id)),
gone AS (
  SELECT DISTINCT r, unnest(range(i, i + 50)) AS i
  FROM windows JOIN firsts USING (x) WHERE least < doc_id
),
words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM docs),
kept AS (
  SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text
  FROM words ANTI JOIN gone USING (r, i) GROUP BY r
),
runs AS (
  SELECT r, count(*) AS n FROM gone a
  WHERE NOT EXISTS (SELECT 1 FROM gone b WHERE b.r = a.r AND b.i = a.i - 1) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(kept.n, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256, coalesce(runs.n, 0) AS n_repeats
FROM docs LEFT JOIN kept USING (r) LEFT JOIN runs USING (r)"""
