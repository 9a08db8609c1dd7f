"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from lexmesh.llm.decontaminate import ERRORS, LEAST, WINDOW
from lexmesh.llm.secrets import KINDS, LEAST_ASSIGNED, PATTERNS

_WORD = r"[^\x20\x09-\x0D]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TRIM = "trim({}, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def _matches(number: int, kind: str) -> str:
    pattern = PATTERNS[kind].replace("'", "''")
    found = f"regexp_extract_all(text, '{pattern}', 0)"
    second = f"regexp_extract_all(text, '{pattern}', 2)" if kind == "assign" else found
    return f"""
SELECT doc_id, {number} AS k, '{kind}' AS kind, unnest(range(1, len(found) + 1)) AS i, unnest(found) AS m, unnest(second) AS v,
       unnest(list_slice(gaps, 1, len(found))) AS gap
FROM (SELECT doc_id, {found} AS found, {second} AS second, string_split_regex(text, '{pattern}') AS gaps FROM texts) WHERE len(found) > 0"""


SECRETS = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
matches AS ({" UNION ALL ".join(_matches(i, k) for i, k in enumerate(KINDS))}),
placed AS (SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, k ORDER BY i) AS finish FROM matches),
kept AS (SELECT doc_id, k, kind, (finish - length(m))::BIGINT AS start, finish::BIGINT AS finish FROM placed WHERE k > 0 OR length(v) >= {LEAST_ASSIGNED}),
found AS (
  SELECT doc_id, {", ".join(f"count(*) FILTER (k = {i}) AS n_{k}" for i, k in enumerate(KINDS))},
         string_agg(kind || ':' || start || ':' || finish, ',' ORDER BY start, k) AS spans
  FROM kept GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in KINDS)}, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN found USING (doc_id)"""

DECONTAMINATION = f"""
WITH w AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS p, len(ws) AS size
  FROM (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS ws FROM documents)),
t AS (
  SELECT item_id, unnest(ws) AS word, unnest(range(len(ws))) AS q, len(ws) AS n
  FROM (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS ws FROM benchmark)),
same AS (SELECT doc_id, item_id, p - q AS g, p, size, n, least(n, {WINDOW}) AS span, CASE WHEN n >= {WINDOW} THEN {WINDOW - ERRORS} ELSE n END AS need
  FROM w JOIN t USING (word) WHERE n >= {LEAST}),
dense AS (SELECT * FROM same QUALIFY count(*) OVER (PARTITION BY doc_id, item_id, g) >= need),
starts AS (SELECT DISTINCT doc_id, item_id, g, p - k AS st, span, need FROM dense, (SELECT unnest(range({ERRORS + 1})) AS k)
  WHERE p - k >= greatest(0, g) AND p - k + span <= least(size, g + n)),
good AS (SELECT s.doc_id, s.item_id, s.g, s.st, any_value(s.span) AS span FROM starts s JOIN dense d
  ON s.doc_id = d.doc_id AND s.item_id = d.item_id AND s.g = d.g AND d.p BETWEEN s.st AND s.st + s.span - 1
  GROUP BY ALL HAVING count(*) >= any_value(s.need)),
covered AS (SELECT DISTINCT doc_id, item_id, unnest(range(st, st + span)) AS word FROM good)
SELECT doc_id, item_id, min(word)::BIGINT AS first_word, count(*) AS n_words FROM covered GROUP BY doc_id, item_id"""

LINES = f"""
WITH lines AS (
  SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS n
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
keyed AS (SELECT *, {_LOWER.format(_TRIM.format("line"))} AS key FROM lines),
firsts AS (SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT k.doc_id, k.line, k.n, coalesce(f.first <> k.doc_id, false) AS gone FROM keyed k LEFT JOIN firsts f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""

WINDOWS = f"""
WITH w AS (
  SELECT doc_id, ws, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents)),
windows AS (SELECT doc_id, p, word, CASE WHEN p + 19 <= len(ws) THEN array_to_string(list_slice(ws, p, p + 19), ' ') END AS win FROM w),
judged AS (SELECT doc_id, p, word, win IS NOT NULL AND row_number() OVER (PARTITION BY win ORDER BY doc_id, p) > 1 AS again FROM windows),
marked AS (SELECT doc_id, p, word, max(again::INT) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) = 1 AS gone FROM judged),
kept AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (NOT gone) AS text FROM marked GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM documents LEFT JOIN kept USING (doc_id)"""

_DIGIT = "(strpos('0123456789abcdef', substr(h, {}, 1)) - 1)"
# five hexadecimal digits are four of base 32
_VALUE = "(" + " + ".join(f"{_DIGIT.format(f'5 * (i // 4) + {j + 1}')} * {16 ** (4 - j)}" for j in range(5)) + ")"
_BASE32 = f"array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (({_VALUE}) // (32 ** (3 - i % 4))::BIGINT) % 32, 1)), '')"

ARCHIVES = f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, url, strlen(html)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN last = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN last <> page_id THEN last END AS refers_to
FROM q"""

JACCARD = f"""
WITH RECURSIVE ws AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(ws) - 3, 2)), lambda i: list_slice(ws, i, i + 4))) AS s FROM ws WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON r.other = e.a)
SELECT doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(other) AS component_id FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id"""

# every page of the tables marks its article, which holds headings, paragraphs, bold type and line breaks alone
MAIN_TEXT = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS body FROM pages),
b AS (SELECT page_id, url, unnest(bs) AS block, unnest(range(len(bs))) AS n FROM (SELECT page_id, url, string_split_regex(body, '</?(?:p|h1)>') AS bs FROM a)),
c AS (SELECT page_id, url, n, replace(replace(regexp_replace(replace(block, '<br>', ' '), '</?b>', '', 'g'), '&quot;', '"'), '&amp;', '&') AS block FROM b),
d AS (SELECT page_id, url, n, trim(regexp_replace(block, '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS block FROM c),
e AS (SELECT page_id, any_value(url) AS url, coalesce(string_agg(block, chr(10) ORDER BY n) FILTER (block <> ''), '') AS text FROM d GROUP BY page_id)
SELECT page_id, url, text, length(text) AS n_chars FROM e"""

COLLOCATIONS = f"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
sizes AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM pieces GROUP BY lang),
grams AS (SELECT lang, size, array_to_string(list_slice(ws, i, i + size - 1), ' ') AS phrase
  FROM (SELECT lang, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM pieces, range(1, 5) s(size))),
f AS MATERIALIZED (SELECT lang, phrase, any_value(size) AS size, count(*) AS a FROM grams GROUP BY lang, phrase HAVING count(*) >= 30),
candidates AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE size >= 2),
parts AS (SELECT lang, phrase, a, k, array_to_string(ws[:k], ' ') AS x, array_to_string(ws[k + 1:], ' ') AS y
  FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates)),
cuts AS (SELECT c.lang, c.phrase, c.a, k, f.a AS l, g.a AS r, (2000000::HUGEINT * c.a) // (f.a + g.a) AS score
  FROM parts c JOIN f ON f.lang = c.lang AND f.phrase = c.x JOIN f g ON g.lang = c.lang AND g.phrase = c.y),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_parts AS (SELECT lang, a, array_to_string(ws[i:i + part - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, size - part + 2)) AS i FROM candidates, range(2, 4) p(part) WHERE part < size)),
longer AS (SELECT lang, phrase, max(a) AS most FROM inner_parts GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN longer g ON g.lang = b.lang AND g.phrase = b.phrase WHERE g.most IS NULL OR 100 * g.most < 80 * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM kept JOIN sizes USING (lang) QUALIFY rank <= 2000"""

DIVERGENCE = f"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_LOWER.format("coalesce(text, '')")} AS text FROM documents),
t AS (SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS everywhere FROM t GROUP BY ALL HAVING count(DISTINCT doc) >= 3),
v AS (SELECT lang, (SELECT count(*) FROM kept k WHERE k.lang = d.lang) AS v FROM (SELECT DISTINCT lang FROM d) d),
c AS (SELECT lang, source, term, count(*) AS c FROM t JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT g.lang, g.source, coalesce(sum(c.c), 0)::BIGINT AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS MATERIALIZED (SELECT n.lang, n.source, k.term, coalesce(c.c, 0) AS c, (1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 1)) // (n.n + v.v))::BIGINT AS p
  FROM n JOIN v USING (lang) JOIN kept k USING (lang) LEFT JOIN c ON c.lang = n.lang AND c.source = n.source AND c.term = k.term),
q AS (SELECT lang, term, (1 + (1000000000::HUGEINT * (everywhere + 1)) // (sum(everywhere) OVER (PARTITION BY lang) + v))::BIGINT AS q FROM kept JOIN v USING (lang)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
QUALIFY part = 'pair' OR rank <= 200"""

ORACLES: dict[str, str] = {
    "op3_secret_scan": SECRETS,
    "op4_decontamination": DECONTAMINATION,
    "op5_line_dedup": LINES,
    "op7_substring_dedup": WINDOWS,
    "op8_warc": ARCHIVES,
    "op9_jaccard_join": JACCARD,
    "op10_html_text": MAIN_TEXT,
    "op11_collocations": COLLOCATIONS,
    "op13_source_divergence": DIVERGENCE,
}
