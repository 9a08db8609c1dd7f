"""Tokenisation, vocabularies and training examples over `documents` and `conversations`."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmesh.functions.text import words
from lexmesh.operators import bpe, examples, unigram, vocabulary
from lexmesh.operators.split import head_per_language
from lexmesh.operators.tagged import NER_LABELS, index_of
from lexmesh.plans import sqltext as q
from lexmesh.plans.bindings import LINE_KEY, lines, tokens
from lexmesh.plans.inputs import hashed_pieces
from lexmesh.plans.registry import Tables, query
from lexmesh.plans.tagged_queries import sequences
from lexmesh.session import stored

_SPLIT = "[\\p{L}\\p{M}\\p{Nd}\\p{Nl}\\p{Pc}]+|[^\\p{L}\\p{M}\\p{Nd}\\p{Nl}\\p{Pc}\\s\\p{Z}]+"


@query("normalize_nfd_lower_strip", q.with_(q.LINES, "SELECT doc_id, line_no, lower(strip_accents(line)) AS line FROM lines"))
def normalize_nfd_lower_strip(t: Tables):
    return lines(t).select("doc_id", "line_no", vocabulary.normalize_nfd_lower_strip(F.col("line")).alias("line"))


_PRETOKENS = f"pretokens AS (SELECT doc_id, line_no, lang, unnest(regexp_extract_all(line, '{_SPLIT}')) AS word FROM lines)"


def _pretokens(t: Tables):
    return lines(t).select("doc_id", "line_no", "lang", F.explode(vocabulary.pretokenize(F.col("line"))).alias("word"))


@query("pretokenize", q.with_(q.LINES, f"SELECT doc_id, line_no, array_to_string(regexp_extract_all(line, '{_SPLIT}'), ' ') AS words FROM lines"))
def pretokenize(t: Tables):
    return lines(t).select("doc_id", "line_no", F.array_join(vocabulary.pretokenize(F.col("line")), " ").alias("words"))


@query("word_frequencies", q.with_(q.LINES, _PRETOKENS, "SELECT word, count(*) AS n FROM pretokens GROUP BY word"))
def word_frequencies(t: Tables):
    return vocabulary.word_frequencies(_pretokens(t))


def frequencies(t: Tables):
    return vocabulary.word_frequencies(tokens(t))


_FREQUENCIES = "frequencies AS (SELECT word, count(*) AS n FROM tokens GROUP BY word)"
_CHARS = """chars AS (
  SELECT ch, sum(n)::BIGINT AS n FROM (SELECT unnest(string_split('▁' || word, '')) AS ch, n FROM frequencies) GROUP BY ch),
ranked_chars AS (
  SELECT ch, n, row_number() OVER (ORDER BY n DESC, ch) AS rank,
         coalesce(sum(n) OVER (ORDER BY n DESC, ch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(n) OVER () AS before
  FROM chars)"""


@query("alphabet_by_coverage", q.with_(q.LINES, q.TOKENS, _FREQUENCIES, _CHARS, "SELECT ch, n, rank FROM ranked_chars WHERE before < 0.999"))
def alphabet_by_coverage(t: Tables):
    return vocabulary.alphabet_by_coverage(frequencies(t))


@query("train_bpe")
def train_bpe(t: Tables):
    return bpe.train_bpe(frequencies(t), vocab_size=32_768)


@query("bpe_first_merges", q.with_(q.LINES, q.TOKENS, _FREQUENCIES, """
spelled AS (SELECT list_reduce(list_transform(string_split(word, ''), lambda c: chr(1) || c || chr(1)), lambda a, b: a || b) AS seq, n FROM frequencies WHERE word <> '')""", """
learned AS (
  SELECT 0 AS rank, ''::VARCHAR AS "left", ''::VARCHAR AS "right", 0::BIGINT AS c, list({'s': seq, 'n': n}) AS words FROM spelled
  UNION ALL
  SELECT rank + 1, best.l, best.r, best.c, list_transform(words, lambda x: {'s': replace(x.s, chr(1) || best.l || chr(1) || chr(1) || best.r || chr(1), chr(1) || best.l || best.r || chr(1)), 'n': x.n})
  FROM learned, LATERAL (
    SELECT l, r, sum(n)::BIGINT AS c FROM (
      SELECT n, unnest(p[:-2]) AS l, unnest(p[2:]) AS r FROM (SELECT w.n AS n, string_split(w.s[2:-2], chr(1) || chr(1)) AS p FROM (SELECT unnest(learned.words) AS w)) WHERE len(p) > 1)
    GROUP BY l, r ORDER BY c DESC, length(l || r), l, r LIMIT 1) best
  WHERE rank < 300)""", """SELECT rank::BIGINT AS rank, "left", "right", c AS n FROM learned WHERE rank > 0"""))
def bpe_first_merges(t: Tables):
    """The first 300 rules, which SQL can learn one merge at a time."""
    return bpe.train_bpe(frequencies(t), merges=300)


_SEEDS = """seeds AS (
  SELECT piece, sum(n)::BIGINT AS n FROM (
    SELECT substr(w, i, l) AS piece, n FROM (
      SELECT w, n, i, unnest(range(1, least(16, length(w) - i + 1) + 1)) AS l FROM (
        SELECT '▁' || word AS w, n, unnest(range(1, length('▁' || word) + 1)) AS i FROM frequencies))) GROUP BY piece)"""


@query("unigram_seed_pieces", q.with_(q.LINES, q.TOKENS, _FREQUENCIES, _SEEDS, "SELECT piece, n FROM seeds"))
def unigram_seed_pieces(t: Tables):
    return unigram.seed_pieces(frequencies(t))


def first_pairs(t: Tables):
    """Frequencies of adjacent character pairs: the first round of merge learning."""
    chars = vocabulary.characters(F.col("word"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("c") - 1), lambda i: F.struct(F.element_at("c", i).alias("left"), F.element_at("c", i + 1).alias("right")))
    split = frequencies(t).select(chars.alias("c"), "n").filter(F.size("c") > 1)
    return split.select(F.explode(pairs).alias("p"), "n").groupBy("p.left", "p.right").agg(F.sum("n").alias("n"))


@query("bpe_pair_counts", q.with_(q.LINES, q.TOKENS, _FREQUENCIES, """
SELECT substr(word, i, 1) AS "left", substr(word, i + 1, 1) AS "right", sum(n)::BIGINT AS n FROM (
  SELECT word, n, unnest(range(1, length(word))) AS i FROM frequencies) GROUP BY ALL"""))
def bpe_pair_counts(t: Tables):
    return first_pairs(t)


@query("train_unigram")
def train_unigram(t: Tables):
    pieces = unigram.train_unigram(frequencies(t), vocab_size=32_768)
    return pieces.withColumn("score", F.round("score", 6))


_PIECES = 32_768


def one_round(t: Tables):
    """All single characters and the seeds of largest weight after one round of expectation and maximisation: what SQL can repeat."""
    return unigram.train_unigram(frequencies(t), vocab_size=1 << 40, seed_size=_PIECES, em_rounds=1)


def _digamma(x: str) -> str:
    y = f"({x} + 7)"
    shift = " + ".join(f"1 / ({x} + {k})" for k in range(7))
    return f"(ln({y}) - 0.5 / {y} - (1 / ({y} * {y})) * (1.0::DOUBLE / 12 - (1 / ({y} * {y})) * (1.0::DOUBLE / 120 - (1 / ({y} * {y})) / 252)) - ({shift}))"


# forward and backward sums of every word by position; log(sum(exp)) is taken from the largest term
_LOG_SUM = "list_max({0}) + ln(list_sum(list_transform({0}, lambda x: exp(x - list_max({0})))))"
_ROUND = f"""
weighted AS MATERIALIZED (
  SELECT piece, (n * length(piece))::DOUBLE AS weight FROM seeds WHERE length(piece) = 1
  UNION ALL (SELECT piece, (n * length(piece))::DOUBLE FROM seeds WHERE n > 1 AND length(piece) > 1 ORDER BY n * length(piece) DESC, piece LIMIT {_PIECES})),
priors AS MATERIALIZED (SELECT piece, ln(weight) - ln((SELECT sum(weight) FROM weighted)) AS score FROM weighted),
marked AS (SELECT '▁' || word AS w, n FROM frequencies),
spans AS MATERIALIZED (
  SELECT w, n, length(w) AS size, s, s + l AS e, substr(w, s + 1, l) AS piece FROM (
    SELECT w, n, s, unnest(range(1, least(16, length(w) - s) + 1)) AS l FROM (SELECT w, n, unnest(range(length(w))) AS s FROM marked))),
arcs AS MATERIALIZED (SELECT * FROM spans JOIN priors USING (piece)),
entering AS MATERIALIZED (SELECT w, e, list(s) AS ss, list(score) AS scores FROM arcs GROUP BY w, e),
leaving AS MATERIALIZED (SELECT w, size - s AS r, list(size - e) AS rs, list(score) AS scores FROM arcs GROUP BY w, size, s),
before AS (
  SELECT w, length(w) AS size, 0::BIGINT AS e, [0::DOUBLE] AS f FROM marked
  UNION ALL
  SELECT w, size, e, list_append(f, {_LOG_SUM.format('v')}) FROM (
    SELECT b.w, b.size, a.e, b.f, list_transform(range(1, len(a.ss) + 1), lambda i: b.f[a.ss[i] + 1] + a.scores[i]) AS v
    FROM before b JOIN entering a ON a.w = b.w AND a.e = b.e + 1)),
behind AS (
  SELECT w, length(w) AS size, 0::BIGINT AS r, [0::DOUBLE] AS f FROM marked
  UNION ALL
  SELECT w, size, r, list_append(f, {_LOG_SUM.format('v')}) FROM (
    SELECT b.w, b.size, a.r, b.f, list_transform(range(1, len(a.rs) + 1), lambda i: b.f[a.rs[i] + 1] + a.scores[i]) AS v
    FROM behind b JOIN leaving a ON a.w = b.w AND a.r = b.r + 1)),
uses AS (
  SELECT a.piece, sum(a.n * exp(x.f[a.s + 1] + a.score + y.f[a.size - a.e + 1] - x.f[a.size + 1])) AS expected
  FROM arcs a JOIN before x ON x.w = a.w AND x.e = x.size JOIN behind y ON y.w = a.w AND y.r = y.size GROUP BY a.piece),
counted AS MATERIALIZED (
  SELECT piece, coalesce(expected, 0) AS expected FROM priors LEFT JOIN uses USING (piece) WHERE coalesce(expected, 0) >= 0.5 OR length(piece) = 1),
learned AS MATERIALIZED (
  SELECT piece, {_digamma('greatest(expected, 1e-6)')} - (SELECT {_digamma('sum(expected)')} FROM counted) AS score FROM counted)"""


@query("unigram_em_round", q.with_(q.LINES, q.TOKENS, _FREQUENCIES, _SEEDS, _ROUND, "SELECT piece, round(score, 5) AS score FROM learned"))
def unigram_em_round(t: Tables):
    return one_round(t).withColumn("score", F.round("score", 5))


@query("assemble_vocab", q.with_(q.LINES, q.TOKENS, _FREQUENCIES, q.RESERVED, f"""
weighted AS (SELECT word AS piece, n FROM frequencies),
ranked AS (SELECT piece, row_number() OVER (ORDER BY n DESC, piece) + 4 AS id FROM weighted)""", f"""
SELECT token, id::BIGINT AS id FROM reserved UNION ALL SELECT piece, id FROM ranked WHERE id < {_PIECES}"""))
def assemble_vocab(t: Tables):
    pieces = frequencies(t).select(F.col("word").alias("piece"), F.col("n").cast("double").alias("score"))
    return vocabulary.assemble_vocab(pieces, _PIECES).select("token", "id")


# best splits by position: the higher score, then the longer last piece; characters beyond the vocabulary are unknown (3)
_ENCODED = """
ranked AS (SELECT piece, score, row_number() OVER (ORDER BY score DESC, piece) + 4 AS id FROM (SELECT piece, round(score * 1000) AS score FROM learned)),
vocab AS MATERIALIZED (SELECT * FROM ranked WHERE id < {size}),
known AS MATERIALIZED (
  SELECT w, s, e, coalesce(v.score, (SELECT min(score) - 10 FROM vocab)) AS score, coalesce(v.id, 3) AS id
  FROM spans LEFT JOIN vocab v USING (piece) WHERE v.id IS NOT NULL OR e = s + 1),
options AS MATERIALIZED (SELECT w, e, list(s) AS ss, list(score) AS scores, list(id) AS ids FROM known GROUP BY w, e),
best AS (
  SELECT w, length(w) AS size, 0::BIGINT AS e, [0::DOUBLE] AS f, [[]::BIGINT[]] AS paths FROM marked
  UNION ALL
  SELECT w, size, e, list_append(f, top.v), list_append(paths, CASE WHEN top.id = 3 AND paths[top.s + 1][-1] = 3 THEN paths[top.s + 1] ELSE list_append(paths[top.s + 1], top.id) END)
  FROM (
    SELECT b.w, b.size, o.e, b.f, b.paths, list_max(list_transform(range(1, len(o.ss) + 1), lambda i: {{'v': b.f[o.ss[i] + 1] + o.scores[i], 'k': -o.ss[i], 's': o.ss[i], 'id': o.ids[i]}})) AS top
    FROM best b JOIN options o ON o.w = b.w AND o.e = b.e + 1)),
encoded AS MATERIALIZED (SELECT substr(w, 2) AS word, paths[size + 1] AS ids FROM best WHERE e = size)""".format(size=_PIECES)


@query("encode_corpus", q.with_(q.LINES, q.TOKENS, _FREQUENCIES, _SEEDS, _ROUND, _ENCODED, """
SELECT doc_id, line_no, lang, sum(len(ids))::BIGINT AS n_ids, string_agg(array_to_string(ids, ' '), ' ' ORDER BY word_no) AS ids
FROM tokens JOIN encoded USING (word) GROUP BY doc_id, line_no, lang"""))
def encode_corpus(t: Tables):
    """Scores in whole thousandths, so that equal sums are equal in any order of addition."""
    learned = one_round(t).withColumn("score", F.round(F.col("score") * 1000))
    vocab = stored(vocabulary.assemble_vocab(learned, _PIECES))
    encoded = unigram.encode_lines(lines(t).select("doc_id", "line_no", "lang", "line"), vocab)
    return encoded.select("doc_id", "line_no", "lang", F.size("ids").alias("n_ids"), F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids"))


@query("token_language_counts", q.with_(
    q.LINES, "heads AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id, line_no) AS r FROM lines) WHERE r <= 100000)",
    f"seen AS (SELECT lang, unnest(list_prepend('<s>', list_append({q.split_words('line')}, '</s>'))) AS token FROM heads)",
    "counted AS (SELECT token, lang, count(*) AS n FROM seen GROUP BY token, lang)",
    f"words AS (SELECT unnest({q.split_words('line')}) AS token FROM lines)",
    "vocab AS (SELECT DISTINCT token FROM words UNION SELECT unnest(['<s>', '<pad>', '</s>', '<unk>', '<mask>']))",
    """grid AS (SELECT token, lang FROM vocab, (SELECT DISTINCT lang FROM heads))""",
    "SELECT g.token, g.lang, coalesce(c.n, 0) AS n FROM grid g LEFT JOIN counted c USING (token, lang)"))
def token_language_counts(t: Tables):
    heads = head_per_language(lines(t).select("doc_id", "lang", "line_no", "line"), 100_000, LINE_KEY)
    found = heads.select("lang", F.explode(F.concat(F.array(F.lit("<s>")), words(F.col("line")), F.array(F.lit("</s>")))).alias("token"))
    reserved = t.spark.createDataFrame([(x,) for x in vocabulary.UNIGRAM_RESERVED], "token string")
    vocab = tokens(t).select(F.col("word").alias("token")).unionByName(reserved).distinct()
    return vocabulary.token_language_counts(found, vocab)


# --- examples -------------------------------------------------------------------------------------
# piece ids are a fixed function of the piece, so both sides agree without a trained vocabulary

_PIECE_ID = "(('0x' || substr(md5(x), 1, 7))::BIGINT % 32763 + 5)"


def encoded_words(t: Tables):
    """Lines with an array of piece id arrays, one per word; words of 10 letters have no piece."""
    return hashed_pieces(lines(t).select("doc_id", "line_no", "lang", "line"), "line", 3, without=10)


_ENCODED = f"""word_ids AS (
  SELECT doc_id, line_no, lang, word_no, word, CASE WHEN length(word) = 10 THEN [] ELSE list_transform({q.pieces('word', 3)}, lambda x: {_PIECE_ID}) END AS ids
  FROM tokens)"""
_LINE_IDS = """line_ids AS (
  SELECT doc_id, line_no, flatten(list(ids ORDER BY word_no)) AS ids FROM word_ids GROUP BY doc_id, line_no)"""


def _text(column: str):
    return F.array_join(F.col(column).cast("array<string>"), " ")


def line_ids(t: Tables):
    return encoded_words(t).select("doc_id", "line_no", F.flatten("ids").alias("ids"))


@query("add_special_template", q.with_(q.LINES, q.TOKENS, _ENCODED, _LINE_IDS, """
pairs AS (SELECT a.doc_id, a.line_no, a.ids AS a, b.ids AS b FROM line_ids a JOIN line_ids b ON a.doc_id = b.doc_id AND a.line_no + 1 = b.line_no)""", """
SELECT doc_id, line_no, array_to_string([1] || a || [2] || b || [2], ' ') AS ids,
       array_to_string(list_transform(range(0, len(a) + 2), lambda x: 0) || list_transform(range(0, len(b) + 1), lambda x: 1), ' ') AS type_ids FROM pairs"""))
def add_special_template(t: Tables):
    first = stored(line_ids(t))  # both sides of the join read it
    second = first.select("doc_id", (F.col("line_no") - 1).alias("line_no"), F.col("ids").alias("next"))
    ids, types = vocabulary.add_special_template(F.col("ids"), F.col("next"))
    both = first.join(second, LINE_KEY).select(*LINE_KEY, ids.alias("ids"), types.alias("type_ids"))
    return both.select(*LINE_KEY, _text("ids").alias("ids"), _text("type_ids").alias("type_ids"))


@query("truncate_encode", q.with_(q.LINES, q.TOKENS, _ENCODED, _LINE_IDS, "SELECT doc_id, line_no, array_to_string([0] || ids[1:62] || [2], ' ') AS input_ids FROM line_ids"))
def truncate_encode(t: Tables):
    return line_ids(t).select(*LINE_KEY, examples.truncate_encode(F.col("ids"), 64).alias("x")).select(*LINE_KEY, _text("x").alias("input_ids"))


@query("dataset_length", q.with_(q.LINES, "SELECT count(*) AS examples FROM lines"))
def dataset_length(t: Tables):
    return examples.dataset_length(lines(t))


_EPOCH = f"""shards AS (
  SELECT source, shard_rows, row_number() OVER (ORDER BY {q.digest(1, 'source')}, source) AS shard_no,
         coalesce(sum(shard_rows) OVER (ORDER BY {q.digest(1, 'source')}, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM (SELECT source, count(*) AS shard_rows FROM lines GROUP BY source)),
epoch AS (
  SELECT doc_id, line_no, source, shard_no, shard_rows, before,
         row_number() OVER (PARTITION BY source ORDER BY {q.digest(1, 'doc_id', 'line_no')}, doc_id, line_no) - 1 AS index_in_shard
  FROM lines JOIN shards USING (source))"""


def _epoch(t: Tables, **options):
    return examples.epoch_order(lines(t).select("doc_id", "line_no", "source", "line"), "source", LINE_KEY, **options)


@query("epoch_order", q.with_(q.LINES, _EPOCH, "SELECT doc_id, line_no, source, shard_no, index_in_shard, before + index_in_shard AS position FROM epoch"))
def epoch_order(t: Tables):
    return _epoch(t).select("doc_id", "line_no", "source", "shard_no", "index_in_shard", "position")


@query("epoch_order_by_length", q.with_(q.LINES, """
shards AS (SELECT source, row_number() OVER (ORDER BY source) AS shard_no,
  coalesce(sum(count(*)) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM lines GROUP BY source),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY length(line) DESC, doc_id, line_no) - 1 AS i FROM lines)""",
    "SELECT doc_id, line_no, source, shard_no, i AS index_in_shard, before + i AS position FROM ranked JOIN shards USING (source)"))
def epoch_order_by_length(t: Tables):
    return _epoch(t, shuffle_shards=False, shuffle_within=False, sort_by_length=True).select("doc_id", "line_no", "source", "shard_no", "index_in_shard", "position")


@query("resume_epoch", q.with_(q.LINES, _EPOCH, """
SELECT doc_id, line_no, source, request FROM (
  SELECT *, before + ((index_in_shard - before) % shard_rows + shard_rows) % shard_rows AS request FROM epoch) WHERE request >= 1000"""))
def resume_epoch(t: Tables):
    return examples.resume_epoch(_epoch(t), 1000).select("doc_id", "line_no", "source", "request")


@query("align_words", q.with_(q.LINES, q.TOKENS, _ENCODED, """
SELECT doc_id, line_no, word_no, n AS n_pieces, upto - n + 1 AS "first", upto AS "last" FROM (
  SELECT *, sum(n) OVER (PARTITION BY doc_id, line_no ORDER BY word_no)::BIGINT AS upto
  FROM (SELECT doc_id, line_no, word_no, len(ids) AS n FROM word_ids WHERE len(ids) > 0))"""))
def align_words(t: Tables):
    return examples.align_words(encoded_words(t).drop("lang"), "ids")


MAX_LENGTH = 48
_ROOM = MAX_LENGTH - 2
_CHUNKS = f"""kept AS (
  SELECT doc_id, line_no, word_no, ids, len(ids) AS n, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY word_no) AS k,
         sum(len(ids)) OVER (PARTITION BY doc_id, line_no ORDER BY word_no)::BIGINT AS upto FROM word_ids WHERE len(ids) > 0),
sizes AS (SELECT doc_id, line_no, count(k.k) AS words FROM (SELECT DISTINCT doc_id, line_no FROM word_ids) l LEFT JOIN kept k USING (doc_id, line_no) GROUP BY ALL),
jump AS (
  SELECT a.doc_id, a.line_no, a.k, a.n, greatest(b.k, a.k) AS last FROM kept a ASOF LEFT JOIN kept b
  ON a.doc_id = b.doc_id AND a.line_no = b.line_no AND a.upto - a.n + {_ROOM} >= b.upto),
bins AS (
  SELECT doc_id, line_no, 1 + (CASE WHEN n > {_ROOM} THEN 1 ELSE 0 END) AS example_no, k AS first, coalesce(last, k) AS last FROM jump WHERE k = 1
  UNION ALL
  SELECT b.doc_id, b.line_no, b.example_no + 1, j.k, coalesce(j.last, j.k) FROM bins b JOIN jump j ON j.doc_id = b.doc_id AND j.line_no = b.line_no AND j.k = b.last + 1),
all_bins AS (
  SELECT * FROM bins UNION ALL
  SELECT doc_id, line_no, 1, 1, 0 FROM jump WHERE k = 1 AND n > {_ROOM} UNION ALL
  SELECT doc_id, line_no, 1, 1, 0 FROM sizes WHERE words = 0),
examples AS (
  SELECT b.doc_id, b.line_no, b.example_no, any_value(b.last - b.first + 1) AS n_words,
         [0] || coalesce(flatten(list(k.ids ORDER BY k.k) FILTER (k.k IS NOT NULL)), []) || [2] AS input_ids
  FROM all_bins b LEFT JOIN kept k ON k.doc_id = b.doc_id AND k.line_no = b.line_no AND k.k BETWEEN b.first AND b.last
  GROUP BY b.doc_id, b.line_no, b.example_no)"""


def chunked(t: Tables):
    return examples.chunk_by_length(encoded_words(t), MAX_LENGTH)


@query("chunk_by_length", q.with_(q.LINES, q.TOKENS, _ENCODED, _CHUNKS, """
SELECT doc_id, line_no, example_no, n_words, array_to_string(input_ids, ' ') AS input_ids FROM examples"""))
def chunk_by_length(t: Tables):
    return chunked(t).select(*LINE_KEY, "example_no", "n_words", _text("input_ids").alias("input_ids"))


@query("fertility", q.with_(q.LINES, q.TOKENS, _ENCODED, """
SELECT lang, sum(len(ids))::BIGINT AS subwords, count(*) AS words, round(sum(len(ids)) / count(*), 9) + 0.0 AS fertility FROM word_ids WHERE len(ids) > 0 GROUP BY lang"""))
def fertility(t: Tables):
    per_word = encoded_words(t).select("lang", F.explode("ids").alias("p")).select("lang", F.size("p").alias("n_pieces"))
    return examples.fertility(per_word).withColumn("fertility", F.round("fertility", 9))


_EXAMPLE_KEY = [*LINE_KEY, "example_no"]
_BATCHES = """batched AS (
  SELECT *, (row_number() OVER (ORDER BY doc_id, line_no, example_no) - 1) // 8 AS batch,
         (row_number() OVER (ORDER BY doc_id, line_no, example_no) - 1) % 8 + 1 AS row_in_batch FROM examples)"""


def batched(t: Tables, *others: str):
    return examples.assign_batches(chunked(t).select(*_EXAMPLE_KEY, *others), _EXAMPLE_KEY, 8)


@query("assign_batches", q.with_(q.LINES, q.TOKENS, _ENCODED, _CHUNKS, _BATCHES, "SELECT doc_id, line_no, example_no, batch, row_in_batch FROM batched"))
def assign_batches(t: Tables):
    return batched(t).select(*_EXAMPLE_KEY, "batch", "row_in_batch")


@query("pad_batches", q.with_(q.LINES, q.TOKENS, _ENCODED, _CHUNKS, _BATCHES, """
SELECT batch, row_in_batch, array_to_string(input_ids || list_transform(range(0, longest - len(input_ids)), lambda x: 1), ' ') AS input_ids FROM (
  SELECT *, max(len(input_ids)) OVER (PARTITION BY batch) AS longest FROM batched)"""))
def pad_batches(t: Tables):
    return examples.pad_batches(batched(t, "input_ids")).select("batch", "row_in_batch", _text("input_ids").alias("input_ids"))


@query("mask_tokens", q.with_(q.LINES, q.TOKENS, _ENCODED, _LINE_IDS, f"""
places AS (SELECT doc_id, line_no, unnest(range(0, len(ids) + 2)) AS i, unnest([0] || ids || [2]) AS x FROM line_ids),
drawn AS (SELECT *, x > 4 AND {q.uniform(1, "'pick'", 'doc_id', 'line_no', 'i')} < 0.15 AS chosen,
  {q.uniform(1, "'how'", 'doc_id', 'line_no', 'i')} AS how, floor({q.uniform(1, "'other'", 'doc_id', 'line_no', 'i')} * 32768)::BIGINT AS other FROM places)""", """
SELECT doc_id, line_no, string_agg((CASE WHEN NOT chosen THEN x WHEN how < 0.8 THEN 4 WHEN how < 0.9 THEN other ELSE x END)::VARCHAR, ' ' ORDER BY i) AS masked_ids,
       string_agg((CASE WHEN chosen THEN x ELSE -100 END)::VARCHAR, ' ' ORDER BY i) AS mask_labels FROM drawn GROUP BY doc_id, line_no"""))
def mask_tokens(t: Tables):
    whole = line_ids(t).select(*LINE_KEY, F.concat(F.array(F.lit(0)), "ids", F.array(F.lit(2))).alias("input_ids"))
    masked = examples.mask_tokens(whole, LINE_KEY)
    return masked.select(*LINE_KEY, _text("masked_ids").alias("masked_ids"), _text("mask_labels").alias("mask_labels"))


@query("batch_class_weight", q.with_(q.LINES, q.TOKENS, q.BIO, f"""
batched AS (SELECT *, (dense_rank() OVER (ORDER BY doc_id, line_no) - 1) // 8 AS batch, list_position({q.NER}, tag) - 1 AS label_id FROM bio),
counted AS (SELECT batch, count(*) FILTER (label_id <> 0) AS entity_words, count(*) FILTER (label_id = 0) AS outside_words FROM batched GROUP BY batch)""", """
SELECT batch, entity_words, outside_words, round(CASE WHEN entity_words > 0 AND outside_words > entity_words THEN entity_words / outside_words ELSE 1.0 END, 9) + 0.0 AS outside_weight
FROM counted"""))
def batch_class_weight(t: Tables):
    rows = sequences(t).withColumn("label_id", index_of(F.col("tag"), NER_LABELS))
    return examples.batch_class_weight(rows).withColumn("outside_weight", F.round("outside_weight", 9))
