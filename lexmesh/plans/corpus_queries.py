"""Sources, cleaning, splitting and sampling over `documents`, `benchmark` and `conversations`."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmesh.operators import clean, language_id, sampling, split
from lexmesh.plans import sqltext as q
from lexmesh.plans.bindings import LINE_KEY, doc_lines, lines
from lexmesh.plans.registry import Tables, query
from lexmesh.session import scratch_folder
from lexmesh.sources import corpus

ALPHA = 0.2
_COLUMNS = "doc_id, lang, line_no, line"


@query("scan_lines", q.with_(q.LINES, "SELECT doc_id, line_no, line FROM lines"))
def scan_lines(t: Tables):
    return lines(t).select("doc_id", "line_no", "line")


@query("explode_records", """
SELECT doc_id, unnest(range(1, len(p) + 1)) AS line_no, unnest(p) AS line
FROM (SELECT doc_id, string_split_regex(text, '\\r\\n|\\r|\\n') AS p FROM documents)""")
def explode_records(t: Tables):
    return corpus.explode_records(t.documents.select("doc_id", "text"))


@query("scan_language_files", q.with_(q.LINES, """
SELECT lang, line, count(*) AS n FROM lines GROUP BY lang, line"""))
def scan_language_files(t: Tables):
    """The lines of each language written to files of its own and read back as a collection."""
    path = scratch_folder(t.spark, "languages")
    written = lines(t).select("lang", "line")
    languages = [r["lang"] for r in written.select("lang").distinct().collect()]  # one entry per language
    written.write.partitionBy("lang").text(path)
    found = corpus.scan_language_files(t.spark, {lang: [f"{path}/lang={lang}"] for lang in languages})
    return found.groupBy("lang", "line").agg(F.count(F.lit(1)).alias("n"))


def merged(t: Tables):
    parts = [lines(t).select(F.lit("documents").alias("corpus"), "doc_id", "line_no", "line")]
    bench = t.benchmark.select(F.lit("benchmark").alias("corpus"), F.col("item_id").alias("doc_id"), "text")
    parts.append(corpus.record_lines(bench))
    return clean.merge_corpora(*parts)


_BENCH = f"""bench AS (
  SELECT doc_id, line_no, line FROM (
    SELECT item_id AS doc_id, unnest(range(1, len(p) + 1)) AS line_no, {q.strip('unnest(p)')} AS line
    FROM (SELECT *, string_split_regex(text, '\\r\\n|\\r|\\n') AS p FROM benchmark)) WHERE line <> '')"""
_MERGED = """merged AS (
  SELECT 'documents' AS corpus, doc_id, line_no, line FROM lines
  UNION ALL SELECT 'benchmark', doc_id, line_no, line FROM bench)"""


@query("merge_corpora", q.with_(q.LINES, _BENCH, _MERGED, "SELECT corpus, doc_id, line_no, line FROM merged"))
def merge_corpora(t: Tables):
    return merged(t)


@query("dedup_exact", q.with_(q.LINES, "SELECT DISTINCT line FROM lines"))
def dedup_exact(t: Tables):
    return clean.dedup_exact(lines(t))


_KEY = "lower(regexp_replace(line, '[^\\p{L}]', '', 'g'))"
_DEDUP = f"""deduped AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {_KEY} ORDER BY doc_id, line_no) AS r FROM lines) WHERE r = 1)"""


@query("dedup_normalized", q.with_(q.LINES, _DEDUP, f"SELECT {_COLUMNS} FROM deduped"))
def dedup_normalized(t: Tables):
    return clean.dedup_normalized(lines(t).select("doc_id", "lang", "line_no", "line"), LINE_KEY)


_W = q.split_words("line")
_LENGTH = f"len({_W}) BETWEEN 2 AND 100"
_AVERAGE = f"length(array_to_string({_W}, '')) / len({_W}) BETWEEN 2 AND 16"
_LONG = f"list_max(list_transform({_W}, lambda w: length(w))) < 32"
_ALPHABET = "length(regexp_replace(line, '[^\\p{L}]', '', 'g')) / length(line) >= 0.5"


@query("filter_word_count", q.with_(q.LINES, f"SELECT doc_id, line_no, line FROM lines WHERE {_LENGTH}"))
def filter_word_count(t: Tables):
    return clean.filter_word_count(lines(t)).select("doc_id", "line_no", "line")


@query("filter_avg_word_length", q.with_(q.LINES, f"SELECT doc_id, line_no, line FROM lines WHERE {_AVERAGE}"))
def filter_avg_word_length(t: Tables):
    return clean.filter_avg_word_length(lines(t)).select("doc_id", "line_no", "line")


@query("filter_long_word", q.with_(q.LINES, f"SELECT doc_id, line_no, line FROM lines WHERE {_LONG}"))
def filter_long_word(t: Tables):
    return clean.filter_long_word(lines(t)).select("doc_id", "line_no", "line")


@query("filter_alphabet_ratio", q.with_(q.LINES, f"SELECT doc_id, line_no, line FROM lines WHERE {_ALPHABET}"))
def filter_alphabet_ratio(t: Tables):
    return clean.filter_alphabet_ratio(lines(t)).select("doc_id", "line_no", "line")


@query("clean_corpus", q.with_(
    q.LINES, _BENCH, _MERGED,
    f"SELECT corpus, doc_id, line_no, line FROM (SELECT *, row_number() OVER (PARTITION BY {_KEY} "
    f"ORDER BY corpus, doc_id, line_no) AS r FROM merged) WHERE r = 1 AND {_LENGTH} AND {_AVERAGE} AND {_LONG} AND {_ALPHABET}"))
def clean_corpus(t: Tables):
    return clean.filter_quality(clean.dedup_normalized(merged(t), ["corpus", "doc_id", "line_no"]))


def _trigram_sql(table: str, key: str) -> str:
    """Relation ``english``: the rows of ``table`` that the model of ``lines`` takes for English with 0.9 or more."""
    grams = """SELECT *, unnest(list_transform(range(1, len(c) - 1), lambda i: (c[i] * 961 + c[i + 1] * 31 + c[i + 2]) % 16384)) AS bucket
  FROM (SELECT *, list_transform(string_split(' ' || line || ' ', ''), lambda c: unicode(c)::BIGINT) AS c FROM {})"""
    return f"""langs AS (SELECT lang AS language, count(*) AS docs FROM lines GROUP BY lang),
seen AS (SELECT lang AS language, bucket, count(*) AS n FROM ({grams.format("lines")}) GROUP BY ALL),
sizes AS (SELECT language, sum(n) + 16384 AS total FROM seen GROUP BY language),
line_grams AS (SELECT {key}, bucket, count(*) AS n FROM ({grams.format(table)}) GROUP BY ALL),
weights_ AS (SELECT language, bucket, ln((coalesce(s.n, 0) + 1.0) / z.total) AS w
  FROM sizes z CROSS JOIN (SELECT DISTINCT bucket FROM line_grams) b LEFT JOIN seen s USING (language, bucket)),
scores AS (SELECT {key}, language, any_value(ln(l.docs / (SELECT sum(docs) FROM langs))) + sum(g.n * w.w) AS score
  FROM line_grams g JOIN weights_ w USING (bucket) JOIN langs l USING (language) GROUP BY {key}, language),
odds AS (SELECT *, exp(score - max(score) OVER (PARTITION BY {key})) AS o FROM scores),
english AS (SELECT {key} FROM (SELECT *, o / sum(o) OVER (PARTITION BY {key}) AS p FROM odds) WHERE language = 'en' AND p >= 0.9)"""


@query("filter_language_id", q.with_(q.LINES, _trigram_sql("lines", "doc_id, line_no"), f"SELECT {_COLUMNS} FROM lines ANTI JOIN english USING (doc_id, line_no)"))
def filter_language_id(t: Tables):
    found = lines(t).select("doc_id", "lang", "line_no", "line")
    return language_id.filter_language_id(found, language_id.fit_language_id(found))


@query("clean_corpus_language", q.with_(
    q.LINES, _BENCH, _MERGED,
    f"""chain AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {_KEY} ORDER BY corpus, doc_id, line_no) AS r FROM merged)
  WHERE r = 1 AND {_LENGTH} AND {_AVERAGE} AND {_LONG} AND {_ALPHABET})""",
    _trigram_sql("chain", "corpus, doc_id, line_no"),
    "SELECT corpus, doc_id, line_no, line FROM chain ANTI JOIN english USING (corpus, doc_id, line_no)"))
def clean_corpus_language(t: Tables):
    """The whole cleaning chain over merged corpora: duplicates, line filters, then lines in the language to leave out."""
    model = language_id.fit_language_id(lines(t).select("lang", "line"))
    kept = clean.filter_quality(clean.dedup_normalized(merged(t), ["corpus", "doc_id", "line_no"]))
    return language_id.filter_language_id(kept, model)


@query("remove_blank_lines", f"""
SELECT doc_id, line_no, line FROM (
  SELECT doc_id, unnest(range(1, len(p) + 1)) AS line_no, {q.strip('unnest(p)')} AS line
  FROM (SELECT doc_id, string_split_regex(replace(text, '. ', '.' || chr(10) || chr(10)), '\\r\\n|\\r|\\n') AS p FROM documents))
WHERE line <> ''""")
def remove_blank_lines(t: Tables):
    spaced = t.documents.select("doc_id", F.replace("text", F.lit(". "), F.lit(".\n\n")).alias("text"))
    return corpus.drop_blank(corpus.explode_records(spaced))


@query("detokenize_punctuation", q.with_(q.LINES, """
SELECT doc_id, line_no, regexp_replace(regexp_replace(spaced, ' ([,.;:?!\\)\\]»“])', '\\1', 'g'), '([\\(\\[«„]) ', '\\1', 'g') AS line
FROM (SELECT doc_id, line_no, regexp_replace(line, '([,.(])', ' \\1 ', 'g') AS spaced FROM lines)"""))
def detokenize_punctuation(t: Tables):
    spaced = lines(t).select("doc_id", "line_no", F.regexp_replace("line", r"([,.(])", " $1 ").alias("line"))
    return clean.detokenize_punctuation(spaced)


# --- shuffles, splits, shards ---------------------------------------------------------------

def _ranked(source: str, seed, keys: str, by: str = "") -> str:
    """Rank in the hash order, with the group size."""
    part = f"PARTITION BY {by} " if by else ""
    columns = keys.split(", ")
    return (f"ranked AS (SELECT *, row_number() OVER ({part}ORDER BY {q.digest(seed, *columns)}, {keys}) AS r, "
            f"count(*) OVER ({part.strip()}) AS n FROM {source})")


_RANKED = _ranked("lines", 1, "doc_id, line_no")
_RANKED_LANG = _ranked("lines", 1, "doc_id, line_no", "lang")


@query("seeded_shuffle", q.with_(q.LINES, _RANKED, "SELECT doc_id, line_no, r AS position FROM ranked"))
def seeded_shuffle(t: Tables):
    return split.seeded_shuffle(lines(t).select(*LINE_KEY), LINE_KEY)


@query("split_ratio", q.with_(q.LINES, _RANKED, """
SELECT doc_id, line_no, line, CASE WHEN r <= ceil(n * 0.8) THEN 'train' WHEN r <= ceil(n * 0.8) + ceil(n * 0.1) THEN 'dev' ELSE 'test' END AS split
FROM ranked"""))
def split_ratio(t: Tables):
    return split.split_ratio(lines(t).select("doc_id", "line_no", "line"), LINE_KEY, 0.8, 0.1)


@query("split_absolute", q.with_(q.LINES, _RANKED, """
SELECT doc_id, line_no, line, CASE WHEN r <= n - 300 THEN 'train' WHEN r <= n - 200 THEN 'dev' ELSE 'test' END AS split FROM ranked"""))
def split_absolute(t: Tables):
    return split.split_absolute(lines(t).select("doc_id", "line_no", "line"), LINE_KEY, dev=100, test=200)


_THRESHOLD = """cut AS (SELECT *, greatest(0.1, 512.0 / n)::DOUBLE AS ts, greatest(0.05, 256.0 / n)::DOUBLE AS ds FROM ranked),
sized AS (SELECT *, ceil(ts * n) AS tests, CASE WHEN ts < 1 THEN ceil(ds / (1.0 - ts) * (n - ceil(ts * n))) ELSE 0 END AS devs FROM cut),
parted AS (SELECT *, CASE WHEN n < 1792 THEN 'test' WHEN r <= tests THEN 'test' WHEN r <= tests + devs THEN 'dev' ELSE 'train' END AS split
  FROM sized)"""


def _thresholded(t: Tables):
    return split.split_threshold(lines(t).select("doc_id", "lang", "line_no"), LINE_KEY, ["lang"])


@query("split_threshold", q.with_(q.LINES, _RANKED_LANG, _THRESHOLD, "SELECT doc_id, lang, line_no, split FROM parted"))
def split_threshold(t: Tables):
    return _thresholded(t)


@query("pool_train_dev", q.with_(q.LINES, _RANKED_LANG, _THRESHOLD,
                                 "SELECT doc_id, line_no, split FROM parted WHERE split IN ('train', 'dev')"))
def pool_train_dev(t: Tables):
    return split.pool_train_dev(_thresholded(t))


@query("split_size_report", q.with_(q.LINES, _RANKED_LANG, _THRESHOLD, """
SELECT lang, split, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY lang), 6) + 0.0 AS share FROM parted GROUP BY lang, split"""))
def split_size_report(t: Tables):
    return split.split_size_report(_thresholded(t)).withColumn("share", F.round("share", 6))


@query("combine_and_resplit", q.with_(
    q.LINES, "chosen AS (SELECT * FROM lines WHERE lang IN ('de', 'es', 'fr'))", _ranked("chosen", 1, "doc_id, line_no"), _THRESHOLD,
    "SELECT doc_id, lang, line_no, split, 'romance+de' AS dataset FROM parted"))
def combine_and_resplit(t: Tables):
    return split.combine_and_resplit(lines(t).select("doc_id", "lang", "line_no"), ["de", "es", "fr"], "romance+de", LINE_KEY)


def spaced_blocks(t: Tables):
    """Each document as a file whose lines come in blocks of three, closed by a blank line."""
    blocks = F.flatten(F.transform("ls", lambda l, i: F.when(i % 3 == 2, F.array(l, F.lit(""))).otherwise(F.array(l))))
    rows = doc_lines(t).select(F.col("doc_id").alias("file"), F.posexplode(blocks).alias("_pos", "line"))
    return rows.select("file", (F.col("_pos") + 1).cast("long").alias("line_no"), "line")


_BLOCKS = """numbered AS (
  SELECT doc_id AS file, len(ls) AS size, unnest(range(0, len(ls))) AS i, unnest(ls) AS line FROM doclines),
blocks AS (SELECT file, i // 3 AS block_no, i + i // 3 + 1 AS line_no, line FROM numbered WHERE i < size // 3 * 3),
block_keys AS (SELECT DISTINCT file, block_no FROM blocks)"""
_BLOCK_RANKS = _ranked("block_keys", 1, "file, block_no")


@query("group_sentences", q.with_(q.DOCLINES, _BLOCKS, "SELECT file, block_no, line_no, line FROM blocks"))
def group_sentences(t: Tables):
    return split.group_sentences(spaced_blocks(t)).select("file", "block_no", "line_no", "line")


@query("count_sentences", q.with_(q.DOCLINES, _BLOCKS, "SELECT count(*) AS sentences FROM block_keys"))
def count_sentences(t: Tables):
    return split.count_sentences(spaced_blocks(t))


@query("downsample_sentences", q.with_(q.DOCLINES, _BLOCKS, _BLOCK_RANKS, """
SELECT b.file, b.block_no, b.line_no, b.line FROM blocks b JOIN ranked k USING (file, block_no) WHERE k.r <= 200"""))
def downsample_sentences(t: Tables):
    grouped = split.group_sentences(spaced_blocks(t))
    return split.downsample_sentences(grouped, 200).select("file", "block_no", "line_no", "line")


@query("holdout_sentences", q.with_(q.DOCLINES, _BLOCKS, _BLOCK_RANKS, """
SELECT b.file, b.block_no, b.line_no, CASE WHEN k.r <= k.n - 100 THEN 'kept' ELSE 'eval' END AS part
FROM blocks b JOIN ranked k USING (file, block_no)"""))
def holdout_sentences(t: Tables):
    grouped = split.group_sentences(spaced_blocks(t))
    return split.holdout_sentences(grouped, 100).select("file", "block_no", "line_no", "part")


@query("cap_examples", q.with_(q.LINES, _RANKED, "SELECT doc_id, line_no, line FROM ranked WHERE r <= 500"))
def cap_examples(t: Tables):
    return split.cap_examples(lines(t).select("doc_id", "line_no", "line"), LINE_KEY, 500)


@query("head_per_language", q.with_(q.LINES, """
SELECT doc_id, lang, line_no, line, row_no FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id, line_no) AS row_no FROM lines) WHERE row_no <= 250"""))
def head_per_language(t: Tables):
    return split.head_per_language(lines(t).select("doc_id", "lang", "line_no", "line"), 250, LINE_KEY)


@query("make_shards", q.with_(q.LINES, """
numbered AS (SELECT *, row_number() OVER (ORDER BY doc_id, line_no) - 1 AS i, count(*) OVER () AS n FROM lines)""", """
SELECT doc_id, line_no, CASE WHEN i < (7 - n % 7) * (n // 7) THEN i // greatest(n // 7, 1)
  ELSE 7 - n % 7 + (i - (7 - n % 7) * (n // 7)) // (n // 7 + 1) END + 1 AS shard_id FROM numbered"""))
def make_shards(t: Tables):
    return split.make_shards(lines(t).select(*LINE_KEY), 7, LINE_KEY)


# --- language sampling ------------------------------------------------------------------------

_WEIGHTS = f"""composition AS (SELECT lang, count(*) AS lines, count(*) / (SELECT count(*) FROM lines) AS proportion FROM lines GROUP BY lang),
weights AS (SELECT *, pow(proportion, {ALPHA}) / sum(pow(proportion, {ALPHA})) OVER () AS weight FROM composition)"""


@query("language_composition", q.with_(q.LINES, _WEIGHTS, "SELECT lang, lines, round(proportion, 9) + 0.0 AS proportion FROM composition"))
def language_composition(t: Tables):
    return sampling.language_composition(lines(t)).withColumn("proportion", F.round("proportion", 9))


def _weights(t: Tables):
    return sampling.alpha_weights(sampling.language_composition(lines(t)), ALPHA)


@query("alpha_weights", q.with_(q.LINES, _WEIGHTS, "SELECT lang, lines, round(proportion, 9) + 0.0 AS proportion, round(weight, 9) + 0.0 AS weight FROM weights"))
def alpha_weights(t: Tables):
    return _weights(t).select("lang", "lines", F.round("proportion", 9).alias("proportion"), F.round("weight", 9).alias("weight"))


@query("sampling_rates", q.with_(q.LINES, _WEIGHTS, "SELECT lang, round(weight / proportion, 9) + 0.0 AS rate FROM weights"))
def sampling_rates(t: Tables):
    return sampling.sampling_rates(_weights(t)).select("lang", F.round("rate", 9).alias("rate"))


@query("sample_languages", q.with_(
    q.LINES, _WEIGHTS, _RANKED_LANG,
    "ladder AS (SELECT lang, lines, coalesce(lag(upto) OVER (ORDER BY lang), 0) AS low, "
    "CASE WHEN lead(lang) OVER (ORDER BY lang) IS NULL THEN 2.0 ELSE upto END AS high "
    "FROM (SELECT *, sum(weight) OVER (ORDER BY lang) AS upto FROM weights))",
    f"draws AS (SELECT draw, {q.uniform(1, chr(39) + 'language' + chr(39), 'draw')} AS u, {q.uniform(1, chr(39) + 'line' + chr(39), 'draw')} AS v "
    "FROM (SELECT unnest(range(0, (SELECT count(*) FROM lines))) AS draw))",
    "SELECT d.draw, s.lang, k.doc_id, k.line_no, k.line FROM draws d JOIN ladder s ON d.u >= s.low AND d.u < s.high "
    "JOIN ranked k ON k.lang = s.lang AND k.r = floor(d.v * s.lines)::BIGINT + 1"))
def sample_languages(t: Tables):
    return sampling.sample_languages(lines(t).select("doc_id", "lang", "line_no", "line"), ALPHA, LINE_KEY)


@query("sample_languages_rate", q.with_(
    q.LINES, _WEIGHTS,
    "means AS (SELECT lang, weight * (SELECT count(*) FROM lines) / lines AS mean FROM weights)",
    "terms AS (SELECT lang, mean, unnest(range(0, ceil(mean + 12 * sqrt(mean) + 30)::BIGINT + 1)) AS k FROM means)",
    "mass AS (SELECT lang, k, exp(k * ln(mean) - mean - sum(ln(greatest(k, 1))) OVER (PARTITION BY lang ORDER BY k)) AS p FROM terms)",
    "cdf AS (SELECT lang, k, sum(p) OVER (PARTITION BY lang ORDER BY k) AS upto FROM mass)",
    "ladders AS (SELECT lang, list(upto ORDER BY k) AS ladder FROM cdf GROUP BY lang)",
    f"drawn AS (SELECT *, {q.uniform(1, chr(39) + 'copies' + chr(39), 'doc_id', 'line_no')} AS u FROM lines)",
    "SELECT doc_id, d.lang, line_no, unnest(range(1, len(list_filter(ladder, lambda c: c <= u)) + 1)) AS copy "
    "FROM drawn d JOIN ladders USING (lang)"))
def sample_languages_rate(t: Tables):
    return sampling.sample_languages_rate(lines(t).select("doc_id", "lang", "line_no"), ALPHA, LINE_KEY)


def minimum_slice(t: Tables):
    """Records to lines, deduplicated, filtered, weighted by language: the flagship chain."""
    found = clean.filter_quality(clean.dedup_normalized(lines(t).select("doc_id", "lang", "line_no", "line"), LINE_KEY))
    weights = sampling.sampling_rates(sampling.alpha_weights(sampling.language_composition(found), ALPHA))
    return weights.select("lang", "lines", *[F.round(c, 9).alias(c) for c in ("proportion", "weight", "rate")])


@query("multilingual_corpus", q.with_(
    q.LINES, _DEDUP, f"kept AS (SELECT * FROM deduped WHERE {_LENGTH} AND {_AVERAGE} AND {_LONG} AND {_ALPHABET})",
    "composition AS (SELECT lang, count(*) AS lines, count(*) / (SELECT count(*) FROM kept) AS proportion FROM kept GROUP BY lang)",
    f"weights AS (SELECT *, pow(proportion, {ALPHA}) / sum(pow(proportion, {ALPHA})) OVER () AS weight FROM composition)",
    "SELECT lang, lines, round(proportion, 9) + 0.0 AS proportion, round(weight, 9) + 0.0 AS weight, round(weight / proportion, 9) + 0.0 AS rate FROM weights"))
def multilingual_corpus(t: Tables):
    return minimum_slice(t)
