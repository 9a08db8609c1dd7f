"""SQL fragments shared by the comparison queries."""

from __future__ import annotations

from lexmesh.operators.tagged import NER_LABELS, POS_LABELS
from lexmesh.operators.vocabulary import UNIGRAM_RESERVED

# Unicode white space as an RE2 class, plus the separators a Unicode-aware strip also removes.
WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip(text: str) -> str:
    return f"regexp_replace({text}, '^{WS}+|{WS}+$', '', 'g')"


def split_words(line: str) -> str:
    return f"string_split_regex({line}, '{WS}+')"


def digest(seed, *keys: str) -> str:
    return f"md5(concat_ws(':', '{seed}', {', '.join(keys)}))"


def unit(hexdigest: str, start: int = 1) -> str:
    return f"(('0x' || substr({hexdigest}, {start}, 13))::BIGINT / 4503599627370496.0)"


def uniform(seed, *keys: str) -> str:
    return unit(digest(seed, *keys))


def normal(seed, *keys: str) -> str:
    h = digest(seed, *keys)
    return f"(sqrt(-2.0 * ln(1.0 - {unit(h)})) * cos(2.0 * pi() * {unit(h, 14)}))"


def pieces(word: str, size: int) -> str:
    return (f"list_transform(range(0, ceil(length({word}) / {float(size)})::BIGINT), "
            f"lambda i: (CASE WHEN i = 0 THEN '▁' ELSE '' END) || substr({word}, i * {size} + 1, {size}))")


def script(ch: str) -> str:
    names = ("Latin", "Common", "Inherited", "Greek", "Cyrillic", "Arabic", "Hebrew", "Devanagari", "Han", "Hiragana", "Katakana", "Thai")
    cases = " ".join(f"WHEN regexp_matches({ch}, '^\\p{{{n}}}$') THEN '{n}'" for n in names)
    return f"CASE {cases} ELSE 'UNK' END"


# documents -> the stripped non-blank lines of each document, as a list
DOCLINES = f"""doclines AS (
  SELECT doc_id, coalesce(lang, 'und') AS lang, source,
         list_filter(list_transform(string_split_regex(text, '\\r\\n|\\r|\\n'), lambda l: {strip('l')}), lambda l: l <> '') AS ls
  FROM documents)"""

LINES = f"""lines AS (
  SELECT doc_id, lang, source, line_no, line FROM (
    SELECT doc_id, coalesce(lang, 'und') AS lang, source, unnest(range(1, len(p) + 1)) AS line_no,
           {strip('unnest(p)')} AS line
    FROM (SELECT *, string_split_regex(text, '\\r\\n|\\r|\\n') AS p FROM documents))
  WHERE line <> '')"""

TOKENS = f"""tokens AS (
  SELECT doc_id, lang, source, line_no, unnest(range(1, len(w) + 1)) AS word_no, unnest(w) AS word
  FROM (SELECT *, {split_words('line')} AS w FROM lines))"""

# labels, predictions and BIO tags made from the words by rule
POS = str(list(POS_LABELS))
_HIT = f"(CASE WHEN substr({digest('pred', 'doc_id', 'line_no', 'word_no')}, 1, 1) = '0' THEN 1 ELSE 0 END)"
LABELLED = f"""labelled AS (
  SELECT *, CASE WHEN length(word) = 13 THEN '_' ELSE {POS}[length(word) % 17 + 1] END AS label,
         CASE WHEN length(word) = 13 THEN -100 ELSE length(word) % 17 END AS label_id,
         (length(word) + {_HIT}) % 17 AS prediction,
         CASE WHEN {uniform('split', 'doc_id')} < 0.8 THEN 'train' ELSE 'test' END AS part
  FROM tokens)"""
KINDS = "['PER','ORG','LOC']"
BIO = f"""capital AS (
  SELECT *, regexp_matches(word, '^\\p{{Lu}}') AS cap,
         coalesce(lag(regexp_matches(word, '^\\p{{Lu}}')) OVER (PARTITION BY doc_id, line_no ORDER BY word_no), false) AS cap_before,
         {KINDS}[length(word) % 3 + 1] AS kind, {KINDS}[(length(word) + {_HIT}) % 3 + 1] AS pred_kind
  FROM tokens),
bio AS (
  SELECT *, CASE WHEN NOT cap THEN 'O' WHEN cap_before THEN 'I-' || kind ELSE 'B-' || kind END AS tag,
         CASE WHEN NOT cap THEN 'O' WHEN cap_before THEN 'I-' || pred_kind ELSE 'B-' || pred_kind END AS pred_tag
  FROM capital)"""
NER = str(list(NER_LABELS))

# old and new vocabulary, each with the reserved tokens on ids 0-4
RESERVED = f"reserved(token, id) AS (VALUES {str(list(zip(UNIGRAM_RESERVED, range(9))))[1:-1]})"
VOCABS = f"""{RESERVED},
old_tokens AS (SELECT unnest({pieces('word', 3)}) AS token FROM tokens),
old_ranked AS (
  SELECT token, row_number() OVER (ORDER BY n DESC, token) + 4 AS id
  FROM (SELECT token, count(*) AS n FROM old_tokens GROUP BY token)),
old_vocab AS (
  SELECT token, id FROM reserved UNION ALL
  SELECT token, id FROM old_ranked WHERE id < (SELECT count(*) FROM embeddings)),
turn_words AS (
  SELECT unnest({split_words('line')}) AS word FROM (
    SELECT {strip('unnest(string_split_regex(text, chr(10)))')} AS line FROM conversations) WHERE line <> ''),
new_ranked AS (
  SELECT token, row_number() OVER (ORDER BY n DESC, token) + 4 AS id
  FROM (SELECT token, count(*) AS n FROM (SELECT unnest({pieces('word', 4)}) AS token FROM turn_words) GROUP BY token)),
new_vocab AS (
  SELECT token, id FROM reserved UNION ALL
  SELECT token, id FROM new_ranked WHERE id < (SELECT count(*) FROM embeddings)),
vectors AS (
  SELECT vec_id AS id, unnest(range(0, len(embedding))) AS dim, unnest(embedding)::DOUBLE AS value FROM embeddings)"""


def categories(vocab: str, name: str, position: bool) -> str:
    """Top script per token (ties to the first seen), reserved tokens also in their own category."""
    suffix = " || CASE WHEN token LIKE '▁%' THEN '_initial' ELSE '_medial' END" if position else ""
    return f"""{name}_chars AS (
  SELECT token, id, unnest(range(1, len(c) + 1)) AS pos, unnest(c) AS ch FROM (
    SELECT token, id, string_split(CASE WHEN token LIKE '▁%' AND length(token) > 1 THEN substr(token, 2) ELSE token END, '') AS c
    FROM {vocab})),
{name}_counts AS (
  SELECT token, id, script, count(*) AS n, min(pos) AS seen
  FROM (SELECT token, id, pos, {script('ch')} AS script FROM {name}_chars) GROUP BY ALL),
{name}_top AS (
  SELECT token, id, script{suffix} AS category FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, seen) AS r FROM {name}_counts) WHERE r = 1),
{name} AS (
  SELECT token, id, category FROM {name}_top UNION ALL
  SELECT token, id, 'xlmr_special' FROM {vocab} WHERE token IN ('<s>', '<pad>', '</s>', '<unk>', '<mask>'))"""


def with_(*parts: str) -> str:
    """CTE parts followed by the final SELECT."""
    return "WITH RECURSIVE " + ",\n".join(parts[:-1]) + "\n" + parts[-1]
