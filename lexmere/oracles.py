"""Equivalent SQL of the registered queries, for the correctness check.

Written independently of the Spark plans: plain joins and aggregates over all tokens.
"""

from __future__ import annotations

from lexmere.functions.fixed import (
    ABBR_THEN_LONG,
    BLOCK_SEPARATOR,
    CITATION,
    CONTENTS_KEYWORDS,
    DEFAULT_EXPANSIONS,
    DRAFT_OUTLINE,
    DRAFT_TAIL,
    EVIDENCE_HEADING,
    GENERIC_WORDS,
    LONG_THEN_ABBR,
    MINING_STOP_WORDS,
    OLDER_OUTLINE_HEAD,
    OLDER_OUTLINE_NOTE,
    PROMPTS,
    SUPPORT_HEADING,
    english_stop_words,
)


def _q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def _list(words) -> str:
    return ", ".join(_q(w) for w in words)


def _with(*parts: str, select: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n" + select


# ---- inputs ----

DOCS = """docs AS (
  SELECT 'doc' || doc_id || '::p' || (doc_id % 30 + 1) || '::c0' AS chunk_id, text,
         source AS topic, 'Notes in ' || lang AS title, doc_id % 30 + 1 AS page
  FROM documents)"""

# Two documents share an id; what else describes a row tells them apart.
REPEATED_DOCS = """docs AS (
  SELECT 'doc' || (doc_id // 2) || '::p1::c0' || chr(31) || '{"topic":["' || source || '"],"title":"Notes in '
         || lang || '","page":' || (doc_id % 30 + 1) || '}' AS chunk_id, text,
         source AS topic, 'Notes in ' || lang AS title, doc_id % 30 + 1 AS page
  FROM documents)"""

ASKED = "asked AS (SELECT item_id AS qid, text AS question, CAST(NULL AS VARCHAR) AS topic FROM benchmark)"
ASKED_BY_TOPIC = (
    "asked AS (SELECT item_id AS qid, text AS question, 'src' || (item_id % 20) AS topic FROM benchmark)"
)
PLAIN = "expanded AS (SELECT qid, topic, question AS text FROM asked)"


def _terms(source: str, key: str, text: str, out: str) -> str:
    """`out`(key, term, tf): uni- and bigrams over the words left by the stop list."""
    return f"""{out}_words AS (
  SELECT {key}, unnest(w) AS w, generate_subscripts(w, 1) AS pos
  FROM (SELECT {key}, regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS w FROM {source})),
{out}_kept AS (SELECT * FROM {out}_words WHERE w NOT IN ({_list(english_stop_words())})),
{out}_next AS (
  SELECT {key}, w, lead(w) OVER (PARTITION BY {key} ORDER BY pos) AS w2 FROM {out}_kept),
{out} AS (
  SELECT {key}, term, count(*) AS tf FROM (
    SELECT {key}, w AS term FROM {out}_next
    UNION ALL SELECT {key}, w || ' ' || w2 FROM {out}_next WHERE w2 IS NOT NULL)
  GROUP BY ALL)"""


STATS = (
    _terms("docs", "chunk_id", "text", "tf")
    + """,
total AS (SELECT count(*) AS n FROM docs),
vocab AS (
  SELECT term, count(*) AS df, sum(tf) AS cf FROM tf
  GROUP BY term HAVING count(*) >= 2 AND count(*) <= 0.95 * (SELECT n FROM total)),
held AS (SELECT tf.chunk_id, tf.term, tf.tf, vocab.df FROM tf JOIN vocab USING (term)),
lengths AS (
  SELECT docs.chunk_id, coalesce(sum(held.tf), 0) AS dl
  FROM docs LEFT JOIN held USING (chunk_id) GROUP BY docs.chunk_id),
mean AS (SELECT avg(dl) AS avgdl FROM lengths)"""
)

BM25_SCORES = (
    _terms("expanded", "qid", "text", "qtf")
    + """,
scores AS (
  SELECT qtf.qid, held.chunk_id,
         sum(ln((n - df + 0.5) / (df + 0.5) + 1)
             * held.tf * 2.5 / (held.tf + 1.5 * (0.25 + 0.75 * dl / (avgdl + 1e-12)) + 1e-12)) AS score
  FROM qtf JOIN held USING (term) JOIN lengths USING (chunk_id), total, mean
  GROUP BY qtf.qid, held.chunk_id)"""
)

TFIDF_SCORES = (
    _terms("expanded", "qid", "text", "qtf")
    + """,
dw AS (SELECT chunk_id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM held, total),
dn AS (SELECT chunk_id, sqrt(sum(w * w)) AS norm FROM dw GROUP BY chunk_id),
qw AS (SELECT qid, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM qtf JOIN vocab USING (term), total),
qn AS (SELECT qid, sqrt(sum(w * w)) AS norm FROM qw GROUP BY qid),
scores AS (
  SELECT qw.qid, dw.chunk_id, sum(qw.w * dw.w / (qn.norm * dn.norm)) AS score
  FROM qw JOIN dw USING (term) JOIN qn USING (qid) JOIN dn USING (chunk_id)
  GROUP BY qw.qid, dw.chunk_id)"""
)


def _ranked(k: int, topic: str = "docs.topic") -> str:
    return f"""ranked AS (
  SELECT * FROM (
    SELECT scores.qid, scores.chunk_id, scores.score,
           CAST(row_number() OVER (PARTITION BY scores.qid
                ORDER BY round(scores.score, 9) DESC, scores.chunk_id) AS INTEGER) AS rank
    FROM scores JOIN docs USING (chunk_id) JOIN asked USING (qid)
    WHERE asked.topic IS NULL OR asked.topic = docs.topic)
  WHERE rank <= {k})"""


TOP = "SELECT qid, rank, chunk_id, round(score, 6) AS score FROM ranked"
BM25 = [DOCS, ASKED, PLAIN, STATS, BM25_SCORES]
RESULTS = [*BM25, _ranked(8)]

def _fixed(whole: str, parts: int, digits: int) -> str:
    """whole / parts with `digits` decimals, half to even, in whole numbers."""
    top = f"({whole} * {10**digits})"
    n = f"({top} // {parts} + CASE WHEN 2 * ({top} % {parts}) > {parts} OR (2 * ({top} % {parts}) = {parts} AND {top} // {parts} % 2 = 1) THEN 1 ELSE 0 END)"
    return f"({n} // {10**digits} || '.' || lpad(CAST({n} % {10**digits} AS VARCHAR), {digits}, '0'))"


# ---- expansion ----

_ENTRIES = ", ".join(
    f"({i}, {_q(k)}, {j}, {_q(v)})"
    for i, (k, vs) in enumerate(DEFAULT_EXPANSIONS.items())
    for j, v in enumerate(vs)
)
EXPANSION = f"""default_words(key_pos, key, val_pos, value) AS (VALUES {_ENTRIES}),
ranked_words AS (
  SELECT term, row_number() OVER (ORDER BY df DESC, term) AS r FROM vocab
  WHERE NOT contains(term, ' ') ORDER BY r LIMIT 120),
dictionary AS (
  SELECT * FROM default_words
  UNION ALL SELECT k.r + 15, k.term, 0, v.term FROM ranked_words k JOIN ranked_words v ON v.r = k.r + 40
    WHERE k.r <= 40
  UNION ALL SELECT k.r + 15, k.term, 1, upper(v.term) FROM ranked_words k
    JOIN ranked_words v ON v.r = 80 + (k.r + 1) // 2 WHERE k.r <= 40),
matched AS (
  SELECT qid, key_pos, val_pos, value,
         row_number() OVER (PARTITION BY qid, lower(value) ORDER BY key_pos, val_pos) AS rn
  FROM asked JOIN dictionary ON contains(lower(question), key)),
extra AS (
  SELECT qid, string_agg(value, ' ' ORDER BY key_pos, val_pos) AS words
  FROM matched WHERE rn = 1 GROUP BY qid),
expanded AS (
  SELECT qid, topic, CASE WHEN words IS NULL THEN question ELSE question || ' ' || words END AS text
  FROM asked LEFT JOIN extra USING (qid))"""

# ---- pages and chunks ----

PAGES = r"""pages_in AS (
  SELECT 'corpus/papers/' || source || '/doc' || doc_id || '.pdf' AS path, 'doc' || doc_id AS stem,
         CASE WHEN lang = 'en' THEN 'Notes ' || doc_id ELSE 'doc' || doc_id END AS title,
         source AS topic, side, CAST(doc_id % 40 + 1 + side AS INTEGER) AS page,
         CASE WHEN side = 0 THEN replace(text, chr(10), chr(10) || ' ' || chr(10))
              ELSE CASE WHEN lang = 'de' THEN 'Contents' || chr(10) ELSE '' END
                   || regexp_replace(text, '([^\n]{1,40})[^\n]*', '\1 .... 12', 'g') END AS text_raw
  FROM documents, (VALUES (0), (1)) AS s(side)),
held_pages AS (SELECT * FROM pages_in WHERE length(regexp_replace(text_raw, '\s', '', 'g')) > 0),
paras AS (
  SELECT stem, page, paragraph, CAST(row_number() OVER (PARTITION BY stem, page ORDER BY i) - 1 AS INTEGER) AS pos
  FROM (
    SELECT stem, page, i, trim(regexp_replace(p, '\s+', ' ', 'g')) AS paragraph
    FROM (SELECT stem, page, unnest(ps) AS p, generate_subscripts(ps, 1) AS i
          FROM (SELECT stem, page, regexp_split_to_array(text_raw, '\n\s*\n') AS ps FROM held_pages)))
  WHERE length(paragraph) >= 80)"""

_NUMBER = r"\b\d{1,4}\s*$"
FLAGS = rf"""page_lines AS (
  SELECT path, stem, page, list_filter(
           list_transform(string_split(text_raw, chr(10)),
                          lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))),
           lambda x: length(x) > 0) AS ls
  FROM held_pages),
flags AS (
  SELECT path, stem, page,
         regexp_matches(lower(array_to_string(ls, chr(10))), {_q("|".join(CONTENTS_KEYWORDS))})
         OR (page <= 25 AND len(ls) >= 8 AND (
              (len(list_filter(ls[1:80], lambda x: regexp_matches(x, '\.\s*\.\s*\.\s*\.'))) >= 3
               AND len(list_filter(ls[1:80], lambda x: regexp_matches(x, '{_NUMBER}'))) >= 8)
              OR len(list_filter(ls[1:80], lambda x: length(x) <= 80 AND regexp_matches(x, '{_NUMBER}'))) >= 12
            )) AS skip
  FROM page_lines)"""

CHUNKS = """packing(stem, page, pos, size, grp) AS (
  SELECT stem, page, pos, CASE WHEN length(paragraph) + 1 <= 1800 THEN length(paragraph) + 1
                               ELSE length(paragraph) END, 0
  FROM paras WHERE pos = 0
  UNION ALL
  SELECT p.stem, p.page, p.pos,
         CASE WHEN k.size + length(p.paragraph) + 1 <= 1800 THEN k.size + length(p.paragraph) + 1
              ELSE length(p.paragraph) END,
         CASE WHEN k.size + length(p.paragraph) + 1 <= 1800 THEN k.grp ELSE k.grp + 1 END
  FROM packing k JOIN paras p ON p.stem = k.stem AND p.page = k.page AND p.pos = k.pos + 1),
pieces AS (
  SELECT stem, page, grp, string_agg(paragraph, ' ' ORDER BY pos) AS piece
  FROM packing JOIN paras USING (stem, page, pos) GROUP BY stem, page, grp),
chunks AS (
  SELECT stem || '::p' || page || '::c' || grp AS chunk_id,
         CASE WHEN grp = 0 THEN piece
              ELSE trim(right(lag(piece) OVER (PARTITION BY stem, page ORDER BY grp), 400) || ' ' || piece)
         END AS text,
         'paper' AS source_type, topic, title, page, path, skip
  FROM pieces JOIN held_pages USING (stem, page) JOIN flags USING (path, stem, page))"""
PAGE_PARTS = [PAGES, FLAGS, CHUNKS]

# ---- results to prompts ----

WEIGHED = """weighed AS (
  SELECT ranked.*, CASE WHEN max(score) OVER (PARTITION BY qid) > 0
                        THEN score / max(score) OVER (PARTITION BY qid) ELSE score END AS w
  FROM ranked)"""


def _line(text: str) -> str:
    return rf"replace(regexp_replace({text}, '^\s+|\s+$', '', 'g'), chr(10), ' ')"


BLOCKS = f"""blocks AS (
  SELECT qid, rank, CASE WHEN rank <= 3 THEN 'evidence' ELSE 'support' END AS section,
         printf('[#%d | w=%.2f | score=%.4f | %s | p%d | %s | topic=[''%s'']]',
                rank, w, score, chunk_id, page, title, topic)
         || chr(10) || substring({_line("text")}, 1, CASE WHEN rank <= 3 THEN 1400 ELSE 489 END) AS block
  FROM weighed JOIN docs USING (chunk_id))"""
_SEP = _q(BLOCK_SEPARATOR)
CONTEXTS = f"""contexts AS (
  SELECT qid, {_q(EVIDENCE_HEADING)} || {_SEP}
         || string_agg(CASE WHEN rank = 4 THEN {_q(SUPPORT_HEADING)} || {_SEP} ELSE '' END || block,
                       {_SEP} ORDER BY rank) AS context
  FROM blocks GROUP BY qid)"""
FLAT = f"""flat AS (
  SELECT qid, string_agg(
           printf('[%s | p%d | %s | topic=[''%s''] | score=%.4f]', chunk_id, page, title, topic, score)
           || chr(10) || substring({_line("text")}, 1, 1400), {_SEP} ORDER BY rank) AS context
  FROM ranked JOIN docs USING (chunk_id) GROUP BY qid)"""
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def _prompt(mode: str) -> str:
    """The template as a SQL expression over question and context."""
    head, rest = PROMPTS[mode].split("{question}")
    middle, tail = rest.split("{context}")
    return (
        f"{_q(head)} || {_STRIP.format('question')} || {_q(middle)} || "
        f"{_STRIP.format('coalesce(context, {})'.format(_q('')))} || {_q(tail)}"
    )


OUTLINES = r"""outlines AS (
  SELECT qid, string_agg('Relevant evidence line ' || rank || ' (' || chunk_id || ', p'
           || regexp_extract(chunk_id, '::p(\d+)::', 1) || ')', chr(10) ORDER BY rank) AS answer
  FROM ranked GROUP BY qid)"""


def _draft() -> str:
    text = DRAFT_OUTLINE.replace("{tail}", DRAFT_TAIL)
    head, rest = text.split("{question}")
    middle, tail = rest.split("{bullets}")
    return f"""drafts AS (
  SELECT asked.qid, {_q(head)} || question || {_q(middle)} || coalesce(bullets, '') || {_q(tail)} AS draft
  FROM asked LEFT JOIN (
    SELECT qid, string_agg('- ' || substring({_line("text")}, 1, 260) || ' (' || chunk_id || ', p' || page || ')',
                           chr(10) ORDER BY rank) AS bullets
    FROM ranked JOIN docs USING (chunk_id) WHERE rank <= 6 GROUP BY qid) b USING (qid))"""


EVIDENCE = """evidence AS (
  SELECT qid, string_agg(printf('- %.4f %s (p%d, title=%s)', score, chunk_id, page, title),
                         chr(10) ORDER BY rank) AS evidence
  FROM ranked JOIN docs USING (chunk_id) GROUP BY qid)"""


def _mmr(picks: int) -> str:
    """Greedy picks unrolled: step j keeps the chosen slot and the running largest similarity."""
    parts = [
        "slots AS (SELECT qid, rank AS slot, text FROM ranked JOIN docs USING (chunk_id) "
        "UNION ALL SELECT qid, 0, question FROM asked)",
        _terms("slots", "qid, slot", "text", "st"),
        """sn AS (SELECT qid, count(*) AS n FROM slots GROUP BY qid),
sdf AS (SELECT qid, term, count(*) AS df FROM st GROUP BY qid, term),
sw AS (SELECT qid, slot, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w
       FROM st JOIN sdf USING (qid, term) JOIN sn USING (qid)),
snorm AS (SELECT qid, slot, sqrt(sum(w * w)) AS norm FROM sw GROUP BY qid, slot),
unit AS (SELECT qid, slot, term, w / norm AS w FROM sw JOIN snorm USING (qid, slot)),
sims AS (SELECT a.qid, a.slot AS a, b.slot AS b, round(sum(a.w * b.w), 12) AS sim
         FROM unit a JOIN unit b USING (qid, term) WHERE a.slot <> b.slot AND b.slot > 0
         GROUP BY a.qid, a.slot, b.slot),
cand AS (SELECT ranked.qid, rank AS slot, coalesce(sim, 0) AS rel
         FROM ranked LEFT JOIN sims ON sims.qid = ranked.qid AND a = 0 AND b = rank),
left_1 AS (SELECT qid, slot, rel, CAST(-1e300 AS DOUBLE) AS near, rel AS gain FROM cand)""",
    ]
    for j in range(1, picks + 1):
        parts.append(
            f"""pick_{j} AS (
  SELECT qid, slot FROM (
    SELECT qid, slot, row_number() OVER (PARTITION BY qid ORDER BY gain DESC, slot) AS rn FROM left_{j})
  WHERE rn = 1),
left_{j + 1} AS (
  SELECT qid, slot, rel, near, round(0.7 * rel - (1.0 - 0.7) * near, 12) AS gain FROM (
    SELECT l.qid, l.slot, l.rel, greatest(l.near, coalesce(sim, 0)) AS near
    FROM left_{j} l JOIN pick_{j} p ON p.qid = l.qid AND p.slot <> l.slot
    LEFT JOIN sims ON sims.qid = l.qid AND sims.a = p.slot AND sims.b = l.slot))"""
        )
    union = " UNION ALL ".join(f"SELECT qid, slot, {j} AS pick FROM pick_{j}" for j in range(1, picks + 1))
    parts.append(f"picked AS ({union})")
    return ",\n".join(parts)


# ---- evaluation ----

_TF_PART = TFIDF_SCORES.replace("qtf", "gtf").replace("scores", "gold_scores")
EVAL_SET = (
    _TF_PART
    + r""",
gold_ids AS (
  SELECT qid, chunk_id FROM (
    SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id) AS rn
    FROM gold_scores) JOIN asked USING (qid) WHERE rn <= 3 AND length(question) > 180),
outlines AS (
  SELECT qid, string_agg('Relevant evidence line ' || rank || ' (' || chunk_id || ', p'
           || regexp_extract(chunk_id, '::p(\d+)::', 1) || ')', chr(10) ORDER BY rank) AS lines
  FROM ranked GROUP BY qid),
answers AS (
  SELECT qid, concat_ws(chr(10), lines, question, 'As noted (unknown::p1::c0, p1). See below.') AS answer
  FROM asked LEFT JOIN outlines USING (qid)),
retrieved AS (SELECT qid, chunk_id FROM ranked WHERE rank <= 8)"""
)


def _sentence_list(text: str) -> str:
    stripped = _STRIP.format(text)
    return (
        rf"list_filter(string_split(regexp_replace({stripped}, '([。．.!?])\s+', '\1' || chr(1), 'g'), chr(1)),"
        r" lambda x: length(trim(x)) > 0)"
    )


def _line_list(text: str) -> str:
    return rf"list_filter(list_transform(string_split({text}, chr(10)), lambda x: {_STRIP.format('x')}), lambda x: length(x) > 0)"


def _units(source: str, keys: str, text: str) -> str:
    return f"""unit_lists AS (
  SELECT {keys}, 'sentence' AS unit, {_sentence_list(text)} AS l FROM {source}
  UNION ALL SELECT {keys}, 'line', {_line_list(text)} FROM {source}),
parts AS (
  SELECT {keys}, unit, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS pos, unnest(l) AS part FROM unit_lists)"""


FAITH = (
    _units("answers", "qid", "answer")
    + f""",
cited AS (SELECT qid, unit, pos, regexp_extract_all(part, {_q(CITATION)}, 1) AS ids FROM parts),
cites AS (SELECT qid, unit, trim(id) AS chunk_id FROM (SELECT qid, unit, unnest(ids) AS id FROM cited)),
faith AS (
  SELECT unit, units, cited, cites, bad, round(cited / units, 6) AS citation_sentence_rate,
         round(1 - cited / units, 6) AS uncited_sentence_rate, round(bad / cites, 6) AS bad_citation_rate
  FROM (SELECT unit, count(*) AS units, count(*) FILTER (len(ids) > 0) AS cited FROM cited GROUP BY unit)
  JOIN (SELECT unit, count(*) AS cites, count(*) FILTER (r.chunk_id IS NULL) AS bad
        FROM cites LEFT JOIN retrieved r ON r.qid = cites.qid AND r.chunk_id = cites.chunk_id GROUP BY unit)
  USING (unit)),
recalled AS (
  SELECT count(*) AS n_with_gold, round(avg(hit), 6) AS recall_at_k FROM (
    SELECT g.qid, max(CASE WHEN r.chunk_id IS NULL THEN 0 ELSE 1 END) AS hit
    FROM gold_ids g LEFT JOIN retrieved r ON r.qid = g.qid AND r.chunk_id = g.chunk_id GROUP BY g.qid))"""
)
EVAL = [*BM25, _ranked(10), EVAL_SET, FAITH]

# ---- mining ----

NGRAMS = f"""mined_words AS (
  SELECT doc_id, lang AS topic, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM (
    SELECT doc_id, lang, list_filter(
      list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x)),
      lambda x: x NOT IN ({_list(MINING_STOP_WORDS)}) AND length(x) >= 2
                AND NOT regexp_matches(x, '^[0-9]+$')) AS ws
    FROM documents) WHERE len(ws) >= 3),
runs AS (
  SELECT topic, w, lead(w) OVER (PARTITION BY doc_id ORDER BY pos) AS w2,
         lead(w, 2) OVER (PARTITION BY doc_id ORDER BY pos) AS w3 FROM mined_words),
grams AS (
  SELECT topic, 2 AS n, w || ' ' || w2 AS ngram FROM runs
  WHERE w2 IS NOT NULL AND w NOT IN ({_list(GENERIC_WORDS)}) AND w2 NOT IN ({_list(GENERIC_WORDS)})
  UNION ALL SELECT topic, 3, w || ' ' || w2 || ' ' || w3 FROM runs
  WHERE w3 IS NOT NULL AND w NOT IN ({_list(GENERIC_WORDS)}) AND w2 NOT IN ({_list(GENERIC_WORDS)})
        AND w3 NOT IN ({_list(GENERIC_WORDS)})),
gram_counts AS (SELECT topic, n, ngram, count(*) AS count FROM grams GROUP BY ALL),
gram_top AS (
  SELECT topic, CAST(n AS INTEGER) AS n, ngram, count,
         CAST(row_number() OVER (PARTITION BY topic ORDER BY count DESC, n DESC, ngram DESC) AS INTEGER) AS rank
  FROM gram_counts)"""

MARKED = r"""marked AS (
  SELECT doc_id, lang AS topic,
         regexp_replace(text, '([a-z]+ [a-z]+), ([a-z]+ [a-z]+)',
           '\1 (' || upper(lang) || '), ' || upper(source) || ' (\2)', 'g') AS text
  FROM documents)"""


def _matches(turn: int, pattern: str, abbr: int, long: int) -> str:
    p = _q(pattern)
    return f"""found_{turn} AS (
  SELECT doc_id, topic, text, {turn} AS turn, generate_subscripts(ms, 1) AS i, unnest(ms) AS m,
         unnest(bs) AS between
  FROM (SELECT doc_id, topic, text, regexp_extract_all(text, {p}) AS ms,
               regexp_split_to_array(text, {p})[1:len(regexp_extract_all(text, {p}))] AS bs FROM marked)),
placed_{turn} AS (
  SELECT doc_id, topic, text, turn, i, m,
         sum(length(between) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) - length(m) + 1 AS start,
         regexp_extract(m, {p}, {abbr}) AS abbr,
         trim(regexp_replace(regexp_extract(m, {p}, {long}), '\\s+', ' ', 'g'), ' ,.;:') AS long
  FROM found_{turn})"""


ABBREVS = (
    ",\n".join([MARKED, _matches(0, LONG_THEN_ABBR, 2, 1), _matches(1, ABBR_THEN_LONG, 1, 2)])
    + r""",
pairs AS (
  SELECT *, row_number() OVER (ORDER BY doc_id, turn, i) AS place,
         regexp_replace(substring(text, CAST(greatest(start - 60, 1) AS BIGINT),
                   CAST(start + length(m) + 60 - greatest(start - 60, 1) AS BIGINT)), '^\s+|\s+$', '', 'g') AS snippet
  FROM (SELECT * FROM placed_0 UNION ALL SELECT * FROM placed_1)
  WHERE len(string_split(long, ' ')) >= 2
    AND length(regexp_replace(long, '[^A-Z]', '', 'g')) <= 0.6 * greatest(length(long), 1)),
pair_counts AS (
  SELECT topic, abbr, long, count(*) AS count, min(place) AS first FROM pairs GROUP BY ALL),
pair_top AS (
  SELECT topic, abbr, long, count,
         CAST(row_number() OVER (PARTITION BY topic ORDER BY count DESC, first) AS INTEGER) AS rank
  FROM pair_counts),
examples AS (
  SELECT topic, abbr, long, example,
         CAST(row_number() OVER (PARTITION BY topic, abbr, long ORDER BY place) AS INTEGER) AS rank
  FROM (SELECT topic, abbr, long, place, snippet, left(snippet, 220) AS example,
               row_number() OVER (PARTITION BY topic, abbr, long, left(snippet, 220) ORDER BY place) AS again
        FROM pairs WHERE snippet <> '')
  WHERE length(snippet) > 220 OR again = 1)"""
)

DECISIONS = rf"""decisions AS (
  SELECT (ascii(topic) * 256 + ascii(substring(topic, 2, 1))) * 1000 + rank AS seq, 'abbr' AS kind,
         abbr AS trigger, long AS target, count >= 2 AS accept,
         CASE WHEN count >= 3 THEN [topic, upper(topic)] ELSE CAST([] AS VARCHAR[]) END AS extra
  FROM pair_top WHERE rank <= 60
  UNION ALL
  SELECT 100000000 + (ascii(topic) * 256 + ascii(substring(topic, 2, 1))) * 1000 + rank, 'ngram', ngram, NULL,
         regexp_matches(ngram, '^[aeiou]'), string_split(ngram, ' ')
  FROM gram_top WHERE rank <= 40),
taken AS (SELECT * FROM decisions WHERE accept),
default_words(key_pos, key, val_pos, value) AS (VALUES {_ENTRIES}),
entries AS (
  SELECT lower(key) AS norm, key, 0 AS late, key_pos AS a, 0 AS b, val_pos AS c, value FROM default_words
  UNION ALL SELECT lower(trigger), NULL, 1, seq, 0, 0, target FROM taken WHERE kind = 'abbr'
  UNION ALL SELECT lower(target), NULL, 1, seq, 1, 0, trigger FROM taken WHERE kind = 'abbr'
  UNION ALL SELECT lower(trigger), NULL, 1, seq, 2, i, v FROM (
    SELECT trigger, seq, unnest(extra) AS v, generate_subscripts(extra, 1) - 1 AS i FROM taken)),
merged AS (
  SELECT coalesce(first_value(key) OVER w, norm) AS key,
         CASE WHEN first_value(late) OVER w = 0 THEN first_value(a) OVER w
              ELSE 16 + 2 * first_value(a) OVER w + first_value(b) OVER w % 2 END AS key_pos,
         row_number() OVER w - 1 AS val_pos, value
  FROM (SELECT *, row_number() OVER (PARTITION BY norm, lower(value) ORDER BY late, a, b, c) AS rn FROM entries)
  WHERE rn = 1 WINDOW w AS (PARTITION BY norm ORDER BY late, a, b, c))"""
CURATION = [NGRAMS, ABBREVS, DECISIONS]

_META = (
    '{"retriever":"bm25","rerank":"none","top_k":8,"pool_k":30,"max_chars":1400,"mode":"cite_strict"}'
)

ORACLES: dict[str, str] = {
    "term_frequency": _with(
        DOCS, _terms("docs", "chunk_id", "text", "tf"), select="SELECT chunk_id, term, tf FROM tf"
    ),
    "term_statistics": _with(
        DOCS,
        STATS,
        select="""SELECT term, df, CAST(cf AS BIGINT) AS cf,
  round(ln((n - df + 0.5) / (df + 0.5) + 1), 6) AS bm25_idf,
  round(ln((1 + n) / (1 + df)) + 1, 6) AS tfidf_idf FROM vocab, total""",
    ),
    "chunk_lengths": _with(
        DOCS,
        STATS,
        select="SELECT chunk_id, CAST(dl AS BIGINT) AS dl, round(avgdl, 6) AS avgdl FROM lengths, mean",
    ),
    "bm25_topk": _with(*RESULTS, select=TOP),
    "bm25_saved_index": _with(*RESULTS, select=TOP),
    "bm25_topk_bounded": _with(
        DOCS,
        """asked AS (
  SELECT 'all-' || item_id AS qid, text AS question, CAST(NULL AS VARCHAR) AS topic FROM benchmark
  UNION ALL SELECT 'topic-' || item_id, text, 'src' || (item_id % 20) FROM benchmark)""",
        PLAIN,
        STATS,
        BM25_SCORES,
        _ranked(8),
        select=TOP,
    ),
    "bm25_after_appends": _with(
        DOCS.replace("FROM documents)", "FROM documents WHERE NOT (doc_id % 4 < 2 AND doc_id % 7 = 3))"),
        *RESULTS[1:],
        select=TOP,
    ),
    "tfidf_saved_index": _with(DOCS, ASKED, PLAIN, STATS, TFIDF_SCORES, _ranked(8), select=TOP),
    "bm25_repeated_ids": _with(
        REPEATED_DOCS,
        *RESULTS[1:],
        select="""SELECT qid, rank, split_part(chunk_id, chr(31), 1) AS chunk_id,
  CAST(page AS INTEGER) AS page, round(score, 6) AS score FROM ranked JOIN docs USING (chunk_id)""",
    ),
    "bm25_topk_by_topic": _with(
        DOCS, ASKED_BY_TOPIC, PLAIN, STATS, BM25_SCORES, _ranked(8), select=TOP
    ),
    "tfidf_topk": _with(DOCS, ASKED, PLAIN, STATS, TFIDF_SCORES, _ranked(8), select=TOP),
    "tfidf_topk_by_topic": _with(
        DOCS, ASKED_BY_TOPIC, PLAIN, STATS, TFIDF_SCORES, _ranked(8), select=TOP
    ),
    "query_expansion": _with(
        DOCS, ASKED, STATS, EXPANSION, select="SELECT qid, text AS expanded FROM expanded"
    ),
    "query_expansion_large": _with(
        DOCS,
        ASKED,
        STATS,
        """pairs AS (SELECT term, row_number() OVER (ORDER BY term) AS pos FROM vocab WHERE contains(term, ' ')),
extra AS (
  SELECT qid, string_agg(replace(term, ' ', '_'), ' ' ORDER BY pos) AS words
  FROM asked JOIN pairs ON contains(lower(question), term) GROUP BY qid)""",
        select="SELECT qid, concat_ws(' ', question, words) AS expanded FROM asked LEFT JOIN extra USING (qid)",
    ),
    "bm25_other_settings": r"""
WITH docs AS (SELECT 'doc' || doc_id || '::p' || (doc_id % 30 + 1) || '::c0' AS chunk_id, text FROM documents),
tf AS (
  SELECT chunk_id, term, count(*) AS tf
  FROM (SELECT chunk_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM docs) GROUP BY ALL),
total AS (SELECT count(*) AS n FROM docs),
vocab AS (
  SELECT term, count(*) AS df FROM tf GROUP BY term
  HAVING count(*) >= 3 AND count(*) <= 0.95 * (SELECT n FROM total)),
held AS (SELECT tf.*, df FROM tf JOIN vocab USING (term)),
lengths AS (SELECT chunk_id, coalesce(sum(held.tf), 0) AS dl FROM docs LEFT JOIN held USING (chunk_id) GROUP BY chunk_id),
mean AS (SELECT avg(dl) AS avgdl FROM lengths),
qtf AS (SELECT DISTINCT qid, term FROM (
  SELECT item_id AS qid, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM benchmark)),
scores AS (
  SELECT qid, chunk_id,
         sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 1.9
             / (tf + 0.9 * (0.6 + 0.4 * dl / (avgdl + 1e-12)) + 1e-12)) AS score
  FROM qtf JOIN held USING (term) JOIN lengths USING (chunk_id), total, mean GROUP BY qid, chunk_id)
SELECT qid, rank, chunk_id, round(score, 6) AS score FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id) AS INTEGER) AS rank FROM scores)
WHERE rank <= 8""".replace("\\\\", "\\"),
    "bm25_expanded": _with(DOCS, ASKED, STATS, EXPANSION, BM25_SCORES, _ranked(8), select=TOP),
    "tfidf_expanded": _with(DOCS, ASKED, STATS, EXPANSION, TFIDF_SCORES, _ranked(8), select=TOP),
    "page_paragraphs": _with(PAGES, select="SELECT stem, page, pos, paragraph FROM paras"),
    "page_flags": _with(PAGES, FLAGS, select="SELECT path, page, skip FROM flags"),
    "page_chunks": _with(*PAGE_PARTS, select="SELECT * FROM chunks", recursive=True),
    "skip_ratio": _with(
        *PAGE_PARTS,
        select="""SELECT count(*) AS chunks, count(*) FILTER (skip) AS skip,
  round(count(*) FILTER (skip) / count(*), 6) AS skip_ratio FROM chunks""",
        recursive=True,
    ),
    "chunk_counts": _with(
        *PAGE_PARTS,
        select="SELECT count(DISTINCT path) AS n_files, count(*) AS n_chunks FROM chunks",
        recursive=True,
    ),
    "chunk_preview": _with(
        *PAGE_PARTS,
        select="""SELECT chunk_id, topic, page, replace(substring(text, 1, 200), chr(10), ' ') AS preview
FROM chunks ORDER BY chunk_id LIMIT 10""",
        recursive=True,
    ),
    "bm25_over_chunks": _with(
        *PAGE_PARTS,
        "docs AS (SELECT chunk_id, text, topic FROM chunks WHERE NOT skip)",
        ASKED_BY_TOPIC,
        PLAIN,
        STATS,
        BM25_SCORES,
        _ranked(8),
        select=TOP,
        recursive=True,
    ),
    "bm25_equal_question_ids": _with(
        *RESULTS,
        select="""SELECT qid AS item_id, CASE WHEN qid % 5 <> 4 THEN 'q' || (qid // 3) END AS id, rank, chunk_id,
  round(score, 6) AS score FROM ranked""",
    ),
    "chunk_variants": """
SELECT 'c' || doc_id AS chunk_id, text,
       CASE doc_id % 6 WHEN 0 THEN source || ',x' WHEN 1 THEN source ELSE '' END AS topic,
       CASE doc_id % 6 WHEN 2 THEN source WHEN 3 THEN '7' END AS title,
       CASE doc_id % 6 WHEN 0 THEN '12' WHEN 1 THEN '12' WHEN 2 THEN '3.5' END AS page,
       CASE doc_id % 6 WHEN 3 THEN source END AS path, doc_id % 6 IN (1, 3) AS skip
FROM documents""",
    "header_numbers": f"""
WITH parts AS (
  SELECT doc_id, {_fixed("n_chars", 8, 2)} AS eighths, {_fixed("n_chars", 16, 2)} AS sixteenths,
         '-' || {_fixed("n_chars", 32, 4)} AS fourths, printf('%.2f', n_chars / 1000) AS thousandths
  FROM documents)
SELECT * FROM parts""",
    "record_variants": """
SELECT doc_id, text,
       CASE doc_id % 7 WHEN 0 THEN source WHEN 1 THEN source || ',x' ELSE '__unknown__' END AS topics
FROM documents WHERE doc_id % 7 <> 6""",
    "topic_normalise": """SELECT doc_id, CASE lang WHEN 'en' THEN source || ',' || lang WHEN 'de' THEN source
  ELSE '__unknown__' END AS topics FROM documents""",
    "result_weights": _with(
        *RESULTS,
        """tops AS (SELECT *, max(score) OVER (PARTITION BY qid) AS best FROM ranked),
heats AS (SELECT *, exp((score - best) / 2.0) AS e FROM tops)""",
        select="""SELECT qid, rank, chunk_id, round(score / best, 6) AS w_ratio,
  round(e / sum(e) OVER (PARTITION BY qid), 6) AS w_softmax FROM heats""",
    ),
    "context_blocks": _with(
        *RESULTS, WEIGHED, BLOCKS, select="SELECT qid, rank, section, block FROM blocks"
    ),
    "contexts": _with(
        *RESULTS, WEIGHED, BLOCKS, CONTEXTS, select="SELECT qid, context FROM contexts"
    ),
    "flat_contexts": _with(*RESULTS, FLAT, select="SELECT qid, context FROM flat"),
    "prompt_records": _with(
        DOCS,
        ASKED_BY_TOPIC,
        PLAIN,
        STATS,
        BM25_SCORES,
        _ranked(8),
        WEIGHED,
        BLOCKS,
        CONTEXTS,
        select=f"""SELECT qid, topic, {_prompt("cite_strict")} AS prompt, {_q(_META)} AS prompt_meta
FROM asked LEFT JOIN contexts USING (qid)""",
    ),
    "explore_prompts": _with(
        *RESULTS,
        WEIGHED,
        BLOCKS,
        CONTEXTS,
        select=f"SELECT qid, {_prompt('explore')} AS prompt FROM asked LEFT JOIN contexts USING (qid)",
    ),
    "older_prompts": _with(
        *RESULTS,
        FLAT,
        select=f"""SELECT qid, {_prompt("strict")} AS strict, {_prompt("english")} AS english
FROM asked LEFT JOIN flat USING (qid)""",
    ),
    "outline_answers": _with(
        *RESULTS,
        OUTLINES,
        select="SELECT qid, coalesce(answer, '') AS answer FROM asked LEFT JOIN outlines USING (qid)",
    ),
    "older_outline_answers": _with(
        *RESULTS,
        f"""listed AS (
  SELECT qid, string_agg(printf('Evidence #%d: This chunk is relevant to the question. (%s, p%d)', rank, chunk_id, page),
                         chr(10) ORDER BY rank) AS lines
  FROM ranked JOIN docs USING (chunk_id) WHERE rank <= 6 GROUP BY qid)""",
        select=f"""SELECT qid, concat_ws(chr(10), {_q(OLDER_OUTLINE_HEAD)}, '', lines, '', {_q(OLDER_OUTLINE_NOTE)}) AS answer
FROM asked LEFT JOIN listed USING (qid)""",
    ),
    "files_read": _with(
        *PAGE_PARTS,
        select="""SELECT (SELECT count(*) FROM documents) AS n_files, count(*) FILTER (
  CAST(regexp_extract(chunk_id, '^doc(\\d+)', 1) AS BIGINT) % 3 <> 0) AS n_chunks FROM chunks""",
        recursive=True,
    ),
    "draft_outlines": _with(*RESULTS, _draft(), select="SELECT qid, draft FROM drafts"),
    "run_reports": _with(
        *RESULTS,
        WEIGHED,
        BLOCKS,
        CONTEXTS,
        EVIDENCE,
        _draft(),
        select=f"""SELECT qid, evidence, draft, {_prompt("explore")} AS prompt
FROM asked LEFT JOIN evidence USING (qid) LEFT JOIN drafts USING (qid) LEFT JOIN contexts USING (qid)""",
    ),
    "rerank_identity": _with(*BM25, _ranked(30), select=TOP + " WHERE rank <= 8"),
    "rerank_mmr": _with(
        *BM25,
        _ranked(30),
        _mmr(8),
        select="""SELECT qid, CAST(pick AS INTEGER) AS rank, chunk_id, round(score, 6) AS score
FROM picked JOIN (SELECT qid, rank AS slot, chunk_id, score FROM ranked) USING (qid, slot)""",
    ),
    "recall_at_k": _with(*EVAL, select="SELECT n_with_gold, recall_at_k FROM recalled"),
    "citation_metrics": _with(*EVAL, select="SELECT * FROM faith"),
    "evaluation_metrics": _with(
        *EVAL,
        select="""SELECT (SELECT count(*) FROM asked) AS n_total, n_with_gold,
  (SELECT count(*) FROM answers WHERE answer <> '') AS n_with_answer, recall_at_k,
  citation_sentence_rate, uncited_sentence_rate, bad_citation_rate
FROM recalled, faith WHERE unit = 'sentence'""",
    ),
    "answer_units": _with(
        _units("conversations", "conv_id, turn", "text"),
        select="SELECT conv_id, turn, unit, pos, part FROM parts",
    ),
    "ngram_top": _with(
        NGRAMS, select="SELECT topic, n, ngram, count, rank FROM gram_top WHERE rank <= 200"
    ),
    "review_numbering": _with(
        NGRAMS,
        select="""SELECT row_number() OVER (ORDER BY topic, count DESC, n DESC, ngram DESC) - 1 AS seq, topic, n, ngram, count
FROM gram_top""",
    ),
    "abbrev_top": _with(
        ABBREVS, select="SELECT topic, rank, abbr, long, count FROM pair_top WHERE rank <= 80"
    ),
    "abbrev_examples": _with(
        ABBREVS, select="SELECT topic, abbr, long, rank, example FROM examples WHERE rank <= 3"
    ),
    "suggestion_review": _with(
        ABBREVS,
        NGRAMS.replace("FROM documents)", "FROM (SELECT doc_id, topic AS lang, text FROM marked))"),
        select="""SELECT topic, 'abbr' AS kind, rank, abbr AS trigger, long AS target, count,
  CAST((SELECT least(count(*), 2) FROM examples e
        WHERE e.topic = p.topic AND e.abbr = p.abbr AND e.long = p.long AND e.rank <= 3) AS INTEGER) AS n_examples
FROM pair_top p WHERE rank <= 60
UNION ALL SELECT topic, 'ngram', rank, ngram, NULL, count, CAST(0 AS INTEGER) FROM gram_top WHERE rank <= 40""",
    ),
    "suggestions_json": _with(
        ABBREVS,
        NGRAMS.replace("FROM documents)", "FROM (SELECT doc_id, topic AS lang, text FROM marked))"),
        select="""SELECT 'documents' AS source_chunks, topic, 'abbrev_pairs_by_topic' AS part,
  CAST(rank - 1 AS INTEGER) AS position, abbr AS name, long AS target, CAST(NULL AS INTEGER) AS n, count,
  coalesce((SELECT string_agg(example, '|' ORDER BY e.rank) FROM examples e
            WHERE e.topic = p.topic AND e.abbr = p.abbr AND e.long = p.long AND e.rank <= 3), '') AS examples
FROM pair_top p WHERE rank <= 80
UNION ALL SELECT 'documents', topic, 'ngrams_by_topic', CAST(rank - 1 AS INTEGER), ngram, NULL,
  CAST(n AS INTEGER), count, NULL FROM gram_top WHERE rank <= 200""",
    ),
    "dictionary_merge": _with(
        *CURATION,
        select="SELECT CAST(key_pos AS BIGINT) AS key_pos, key, val_pos, value FROM merged",
    ),
    "dictionary_changes": _with(
        *CURATION,
        select="SELECT CAST(sum(CASE kind WHEN 'abbr' THEN 2 ELSE 1 END) AS BIGINT) AS changes FROM taken",
    ),
    "dictionary_diff": _with(
        *CURATION,
        """new AS (SELECT key, string_agg(value, '|' ORDER BY val_pos) AS vs FROM merged GROUP BY key),
old AS (SELECT key, string_agg(value, '|' ORDER BY val_pos) AS vs FROM default_words GROUP BY key),
lines AS (
  SELECT *, o IS DISTINCT FROM n AS changed, row_number() OVER (ORDER BY starts_with(key, '__'), key) - 1 AS pos
  FROM (SELECT coalesce(old.key, new.key) AS key, old.vs AS o, new.vs AS n FROM old FULL JOIN new ON old.key = new.key)),
shown AS (
  SELECT *, bool_or(changed) OVER (ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near FROM lines)""",
        select="""SELECT pos, mark, key, vs AS "values" FROM (
  SELECT pos, '-' AS mark, key, o AS vs FROM shown WHERE changed AND o IS NOT NULL
  UNION ALL SELECT pos, '+', key, n FROM shown WHERE changed AND n IS NOT NULL
  UNION ALL SELECT pos, ' ', key, o FROM shown WHERE near AND NOT changed)""",
    ),
    "dictionary_view": _with(
        *CURATION,
        select="""SELECT starts_with(key, '__') AS last, key, string_agg(value, '|' ORDER BY val_pos) AS "values"
FROM merged GROUP BY key""",
    ),
}
