"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

QUALITY = r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
windows AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS v
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, v) AS n FROM windows)
  WHERE n > 1),
covered AS (
  SELECT doc_id, count(DISTINCT j) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM again) GROUP BY doc_id),
figures AS (
  SELECT w.doc_id, source, len(words) AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN covered USING (doc_id)),
tests AS (
  SELECT *, n_words < 50 AS short, 100 * n_repeat_words > 50 * n_words AS repeated,
         100 * n_symbols > 10 * n_words AS symbols, 100 * n_dup_lines > 30 * n_lines AS copied
  FROM figures),
hosts AS (
  SELECT source, rule, count(*) AS n, count(*) FILTER (failed) AS f
  FROM (SELECT source, unnest([short, repeated, symbols, copied]) AS failed,
               unnest([1, 2, 3, 4]) AS rule FROM tests WHERE source IS NOT NULL)
  GROUP BY source, rule),
moments AS (
  SELECT rule, avg(f / n) AS m, var_pop(f / n) AS v FROM hosts GROUP BY rule),
prior AS (
  SELECT rule, m,
         CASE WHEN v > 0 THEN least(greatest(m * (1 - m) / v - 1, 1), 1e6) ELSE 1e6 END AS s
  FROM moments),
rejected AS (
  SELECT DISTINCT source FROM hosts JOIN prior USING (rule) WHERE (f + m * s) / (n + s) > 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       short OR repeated AS base_failed,
       NOT (short OR repeated OR r.source IS NOT NULL) AS kept,
       r.source IS NOT NULL AS host_failed
FROM tests LEFT JOIN rejected r ON tests.source = r.source
"""

LINES = r"""
WITH lines AS (
  SELECT doc_id, pos, line,
         translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))),
owners AS (
  SELECT key, min(doc_id) AS owner FROM lines WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) > 1)
SELECT doc_id, count(*) AS n_lines, count(owner) FILTER (doc_id <> owner) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos)
                         FILTER (owner IS NULL OR doc_id = owner), '')) AS kept_sha256
FROM lines LEFT JOIN owners USING (key) GROUP BY doc_id
"""

NEAR = r"""
WITH RECURSIVE words AS (
  SELECT doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                      'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n
  HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
reached AS (
  SELECT doc_id AS node, doc_id AS other FROM words
  UNION SELECT node, b FROM reached JOIN links ON a = other)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, min(other) AS component_id,
       min(other) = w.doc_id AS kept
FROM words w LEFT JOIN sizes USING (doc_id) JOIN reached ON node = w.doc_id
GROUP BY w.doc_id, n
"""

BACKOFF = r"""
WITH words AS (
  SELECT doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                      'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
tok AS (SELECT doc_id, i, w[i] AS b, CASE WHEN i > 1 THEN w[i - 1] END AS a
       FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words)),
one AS (SELECT b, count(*) AS n FROM tok GROUP BY b),
one_own AS (SELECT doc_id, b, count(*) AS n FROM tok GROUP BY doc_id, b),
two AS (SELECT a, b, count(*) AS n FROM tok WHERE a IS NOT NULL GROUP BY a, b),
two_own AS (SELECT doc_id, a, b, count(*) AS n FROM tok WHERE a IS NOT NULL GROUP BY doc_id, a, b),
sizes AS (SELECT doc_id, count(*) AS n FROM tok GROUP BY doc_id),
other AS (
  SELECT tok.doc_id, tok.a, y.n - yo.n AS cb, x.n - xo.n AS ca, t.n - tn.n AS cab,
         greatest((SELECT count(*) FROM tok) - s.n, 1) AS rest
  FROM tok JOIN one y ON y.b = tok.b JOIN one_own yo ON yo.doc_id = tok.doc_id AND yo.b = tok.b
  JOIN sizes s ON s.doc_id = tok.doc_id
  LEFT JOIN one x ON x.b = tok.a LEFT JOIN one_own xo ON xo.doc_id = tok.doc_id AND xo.b = tok.a
  LEFT JOIN two t ON t.a = tok.a AND t.b = tok.b
  LEFT JOIN two_own tn ON tn.doc_id = tok.doc_id AND tn.a = tok.a AND tn.b = tok.b),
scored AS (
  SELECT doc_id, coalesce(cab > 0, false) AS found,
         CASE WHEN cab > 0 THEN ln(cab / ca)
              ELSE ln(CASE WHEN cb > 0 THEN cb ELSE 0.5 END / rest)
                   + CASE WHEN a IS NOT NULL THEN ln(0.4) ELSE 0 END END AS s
  FROM other)
SELECT w.doc_id, count(s) AS n_words, count(*) FILTER (found) AS n_found,
       cast(coalesce(sum(cast(round(s * 1e6) AS BIGINT)), 0) AS BIGINT) AS score_micro,
       sum(cast(round(s * 1e6) AS BIGINT))::BIGINT / 1e6 / count(s) AS mean_score
FROM words w LEFT JOIN scored USING (doc_id) GROUP BY w.doc_id
"""

PHRASES = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                                'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
sizes AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i
        FROM words, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)),
counts AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
candidates AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE k > 1),
cuts AS (
  SELECT c.*, x.f AS l, y.f AS r, (2000000::HUGEINT * a // (x.f + y.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidates) c
  JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:cut], ' ')
  JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[cut + 1:], ' ')),
lowest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS o FROM cuts)
  WHERE o = 1),
inner_phrases AS (
  SELECT lang, a, array_to_string(w[i:i + m - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, k - m + 2)) AS i
        FROM (SELECT *, unnest(range(2, k)) AS m FROM candidates WHERE k > 2))),
covers AS (SELECT lang, phrase, max(a) AS cover FROM inner_phrases GROUP BY ALL),
ranked AS (
  SELECT lang, phrase, a, l, r, score,
         row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM lowest LEFT JOIN covers USING (lang, phrase)
  WHERE NOT coalesce(100::HUGEINT * cover >= 80::HUGEINT * a, false))
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000
"""

TOPK = r"""
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = len(embedding)),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM vectors q JOIN vectors c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
WHERE rank <= 10
"""

ORACLES: dict[str, str] = {
    "op4_stupid_backoff": BACKOFF,
    "op3_near_dedup": NEAR,
    "op2_line_dedup": LINES,
    "op8_host_quality": QUALITY,
    "op12_toivonen_phrases": PHRASES,
    "op13_exact_topk": TOPK,
}
