"""Annotated-data readers, transforms, baselines and metrics over rule-tagged `documents` words."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexmesh.functions.text import words
from lexmesh.operators import examples, metrics, probe, tagged
from lexmesh.operators.tagged import POS_LABELS, label_array
from lexmesh.plans import sqltext as q
from lexmesh.plans.bindings import LINE_KEY, WORD_KEY, bio, bio_sentences, embeddings, labelled, lines, records
from lexmesh.plans.inputs import conllu_files
from lexmesh.plans.registry import Tables, query
from lexmesh.sources import tagged as readers


def conllu_lines(t: Tables):
    """Every document as a CoNLL-U file, with comments, a range row per 7-letter word and an empty
    node after each 11-letter word."""
    return conllu_files(records(t).select(F.col("doc_id").alias("file"), "text"))


_CONLLU = f"""sents AS (
  SELECT doc_id AS file, unnest(range(0, len(ls))) AS sent_no, {q.split_words('unnest(ls)')} AS w FROM doclines),
rows_ AS (
  SELECT file, sent_no, flatten(list_transform(w, lambda x: CASE WHEN length(x) = 11 THEN [x, x || '~'] ELSE [x] END)) AS words,
         flatten(list_transform(w, lambda x: CASE WHEN length(x) = 11 THEN [{q.POS}[length(x) % 17 + 1], 'X'] ELSE [{q.POS}[length(x) % 17 + 1]] END)) AS tags
  FROM sents)"""


@query("parse_conllu", q.with_(q.DOCLINES, _CONLLU, """
SELECT file, sent_no, unnest(range(1, len(words) + 1)) AS word_no, unnest(words) AS word, unnest(tags) AS upos FROM rows_"""))
def parse_conllu(t: Tables):
    return readers.parse_conllu(conllu_lines(t))


@query("conllu_text", q.with_(q.DOCLINES, "SELECT doc_id AS file, unnest(ls) AS sentence FROM doclines"))
def conllu_text(t: Tables):
    return readers.conllu_text(conllu_lines(t)).select("file", "sentence")


def bio_groups(t: Tables):
    """Each line as a BIO group of three columns; every fifth group is broken and must be dropped."""
    grouped = bio_sentences(t, lambda word, tag: [F.concat_ws(" ", word, F.lower(word), tag).alias("row")])
    text = F.array_join(F.transform("words", lambda x: x["row"]), "\n")
    broken = F.when((F.col("doc_id") + F.col("line_no")) % 5 == 0, F.concat(F.lit("\n"), text)).otherwise(F.concat(text, F.lit("\n")))
    return grouped.select("lang", "doc_id", F.col("line_no").alias("sent_no"), broken.alias("group"))


_KEPT = "(doc_id + line_no) % 5 <> 0"


@query("parse_bio", q.with_(q.LINES, q.TOKENS, q.BIO, f"""
SELECT lang, doc_id, line_no AS sent_no, word_no, word AS token, lower(word) AS span_text, tag FROM bio WHERE {_KEPT}"""))
def parse_bio(t: Tables):
    return readers.parse_bio(bio_groups(t))


def _bio_tokens(t: Tables):
    return bio(t).select(*LINE_KEY, "lang", "word_no", F.col("word").alias("token"), F.lower("word").alias("span_text"), "tag")


@query("encode_bio_tags", q.with_(q.LINES, q.TOKENS, q.BIO, f"""
SELECT doc_id, line_no, word_no, word AS token, list_position({q.NER}, tag) - 1 AS ner_tag FROM bio"""))
def encode_bio_tags(t: Tables):
    return tagged.encode_bio_tags(_bio_tokens(t)).select(*LINE_KEY, "word_no", "token", "ner_tag")


@query("bio_spans", q.with_(q.LINES, q.TOKENS, q.BIO, """
SELECT doc_id, line_no, word_no, kind || ': ' || lower(word) AS span FROM bio WHERE tag LIKE 'B-%'"""))
def bio_spans(t: Tables):
    return tagged.bio_spans(_bio_tokens(t)).select(*LINE_KEY, "word_no", "span")


_INSTANCES = f"""instances AS (
  SELECT doc_id, line_no, lang, string_agg(word, ' ' ORDER BY word_no) AS tokens,
         string_agg((list_position({q.NER}, tag) - 1)::VARCHAR, ' ' ORDER BY word_no) AS ner_tags,
         string_agg(lang, ' ' ORDER BY word_no) AS langs,
         coalesce(string_agg(kind || ': ' || lower(word), '|' ORDER BY word_no) FILTER (tag LIKE 'B-%'), '') AS spans
  FROM bio GROUP BY doc_id, line_no, lang)"""


def instances(t: Tables):
    sentences = bio_sentences(t, lambda word, tag: [word.alias("token"), tag.alias("tag"), F.lower(word).alias("span_text")])
    return tagged.bio_instances(sentences, LINE_KEY)


def _flat(df):
    return df.select(*LINE_KEY, F.array_join("tokens", " ").alias("tokens"),
                     F.array_join(F.transform("ner_tags", lambda x: x.cast("string")), " ").alias("ner_tags"),
                     F.array_join("langs", " ").alias("langs"), F.array_join("spans", "|").alias("spans"))


@query("bio_instances", q.with_(q.LINES, q.TOKENS, q.BIO, _INSTANCES, "SELECT doc_id, line_no, tokens, ner_tags, langs, spans FROM instances"))
def bio_instances(t: Tables):
    return _flat(instances(t))


@query("read_ner_json", q.with_(q.LINES, q.TOKENS, q.BIO, _INSTANCES,
                                "SELECT doc_id, line_no, tokens, ner_tags, langs, spans FROM instances WHERE doc_id % 10 <> 0"))
def read_ner_json(t: Tables):
    emptied = F.when(F.col("doc_id") % 10 == 0, F.array().cast("array<string>")).otherwise(F.col("tokens"))
    text = F.to_json(F.struct(emptied.alias("tokens"), "ner_tags", "langs", "spans"))
    return _flat(readers.parse_ner_json(instances(t).select(*LINE_KEY, text.alias("json")), "json"))


@query("label_index", q.with_(q.LINES, q.TOKENS, q.LABELLED, "SELECT doc_id, line_no, word_no, label, label_id FROM labelled"))
def label_index(t: Tables):
    return tagged.label_index(labelled(t).drop("label_id")).select(*WORD_KEY, "label", "label_id")


# --- baselines and metrics ----------------------------------------------------------------------

_TRAIN = f"""train_counts AS (SELECT word, label, count(*) AS n FROM labelled WHERE part = 'train' AND label <> '_' GROUP BY word, label),
guesses AS (SELECT word, label AS guess FROM (
  SELECT *, row_number() OVER (PARTITION BY word ORDER BY n DESC, list_position({q.POS}, label)) AS r FROM train_counts) WHERE r = 1)"""


@query("majority_label_baseline", q.with_(q.LINES, q.TOKENS, q.LABELLED, """
SELECT round(max(n) / sum(n) * 100, 6) + 0.0 AS majority_baseline FROM (
  SELECT label, count(*) AS n FROM labelled WHERE part = 'train' AND label <> '_' GROUP BY label)"""))
def majority_label_baseline(t: Tables):
    found = metrics.majority_label_baseline(labelled(t).filter(F.col("part") == "train"))
    return found.select(F.round("majority_baseline", 6).alias("majority_baseline"))


@query("word_label_counts", q.with_(q.LINES, q.TOKENS, q.LABELLED, _TRAIN, "SELECT word, label, n FROM train_counts"))
def word_label_counts(t: Tables):
    return metrics.word_label_counts(labelled(t).filter(F.col("part") == "train"))


# the label is a function of the word, so a second labelling by position makes the majority matter
def _noisy(t: Tables):
    shifted = F.get(label_array(POS_LABELS), (F.char_length("word") + F.col("word_no") % 3) % 17)
    return labelled(t).withColumn("label", F.when(F.col("label") == "_", F.col("label")).otherwise(shifted))


_NOISY = f"""noisy AS (
  SELECT * REPLACE (CASE WHEN label = '_' THEN '_' ELSE {q.POS}[(length(word) + word_no % 3) % 17 + 1] END AS label) FROM labelled),
noisy_counts AS (SELECT word, label, count(*) AS n FROM noisy WHERE part = 'train' AND label <> '_' GROUP BY word, label),
noisy_guesses AS (SELECT word, label AS guess FROM (
  SELECT *, row_number() OVER (PARTITION BY word ORDER BY n DESC, list_position({q.POS}, label)) AS r FROM noisy_counts) WHERE r = 1)"""


@query("per_word_majority_baseline", q.with_(q.LINES, q.TOKENS, q.LABELLED, _NOISY, """
SELECT round(sum(CASE WHEN g.guess = n.label THEN 1 ELSE 0 END) / count(*) * 100, 6) + 0.0 AS per_word_baseline
FROM noisy n LEFT JOIN noisy_guesses g USING (word) WHERE n.part = 'test'"""))
def per_word_majority_baseline(t: Tables):
    noisy = _noisy(t).select("word", "label", "part")
    found = metrics.per_word_majority_baseline(noisy.filter(F.col("part") == "train"), noisy.filter(F.col("part") == "test"), POS_LABELS)
    return found.select(F.round("per_word_baseline", 6).alias("per_word_baseline"))


@query("accuracy", q.with_(q.LINES, q.TOKENS, q.LABELLED, """
SELECT lang, count(*) AS words, count(*) FILTER (prediction = label_id) AS correct,
       round(count(*) FILTER (prediction = label_id) / count(*), 9) + 0.0 AS accuracy FROM labelled GROUP BY lang"""))
def accuracy(t: Tables):
    return metrics.accuracy(labelled(t), ["lang"]).withColumn("accuracy", F.round("accuracy", 9))


@query("predict_top1", """
SELECT vec_id AS id, list_position(embedding, list_max(embedding)) - 1 AS prediction FROM embeddings""")
def predict_top1(t: Tables):
    return metrics.predict_top1(embeddings(t), "vector").select("id", "prediction")


_SEQUENCES = """sequences AS (
  SELECT *, (dense_rank() OVER (ORDER BY doc_id, line_no) - 1) // 8 AS batch FROM bio)"""


def _chunks(tag: str, name: str, kind: str) -> str:
    return f"""{name}_rows AS (
  SELECT batch, {tag} AS tag, {kind} AS kind, row_number() OVER w AS place, lag({tag}) OVER w AS tag_before, lag({kind}) OVER w AS kind_before
  FROM sequences WINDOW w AS (PARTITION BY batch ORDER BY doc_id, line_no, word_no)),
{name}_numbered AS (
  SELECT *, sum(CASE WHEN tag LIKE 'B%' OR (tag LIKE 'I%' AND (tag_before IS NULL OR tag_before = 'O' OR kind_before <> kind)) THEN 1 ELSE 0 END)
    OVER (PARTITION BY batch ORDER BY place) AS entity FROM {name}_rows),
{name} AS (SELECT batch, min(place) AS first, max(place) AS last, kind AS type FROM {name}_numbered WHERE tag <> 'O' GROUP BY batch, entity, kind)"""


_PARTS = 8


def sequences(t: Tables):
    """BIO words with the batch of their sentence, eight sentences per batch in corpus order, and
    their position in it, which is counted on the lines before these become words."""
    batches = examples.assign_batches(lines(t).select(*LINE_KEY), LINE_KEY, 8).select(*LINE_KEY, "batch")
    before = Window.partitionBy("batch").orderBy(*LINE_KEY).rowsBetween(Window.unboundedPreceding, -1)
    # a task sorts the words of all its lines; eight times the partitions hold an eighth of them each
    parts = _PARTS * int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    found = lines(t).join(batches, LINE_KEY).repartition(parts, "batch")
    placed = found.withColumn("offset", F.coalesce(F.sum(F.size(words(F.col("line")))).over(before), F.lit(0)))
    return bio(t, placed).withColumn("place", F.col("offset") + F.col("word_no"))


@query("entity_chunks", q.with_(q.LINES, q.TOKENS, q.BIO, _SEQUENCES, _chunks("tag", "truth", "kind"), "SELECT batch, first, last, type FROM truth"))
def entity_chunks(t: Tables):
    return metrics.entity_chunks(sequences(t), ["batch"], "place")


@query("ner_f1", q.with_(q.LINES, q.TOKENS, q.BIO, _SEQUENCES, _chunks("tag", "truth", "kind"), _chunks("pred_tag", "guess", "pred_kind"), """
SELECT true_entities, predicted_entities, matched, round(2.0 * matched / (true_entities + predicted_entities), 9) + 0.0 AS f1 FROM (
  SELECT (SELECT count(*) FROM truth) AS true_entities, (SELECT count(*) FROM guess) AS predicted_entities,
         (SELECT count(*) FROM truth JOIN guess USING (batch, first, last, type)) AS matched)"""))
def ner_f1(t: Tables):
    found = metrics.ner_f1(sequences(t), ["batch"], "place")
    return found.withColumn("f1", F.round("f1", 9))


@query("trial_summary", """
SELECT event_type AS setting, count(*) AS trials, round(avg(s), 2) AS mean_score, round(stddev_pop(s), 2) AS std_score,
       round(avg(e), 2) AS mean_epochs, round(stddev_pop(e), 2) AS std_epochs
FROM (SELECT event_type, sqrt(abs(value)) AS s, event_id % 50 AS e FROM events) GROUP BY event_type""")
def trial_summary(t: Tables):
    trials = t.events.select(F.col("event_type").alias("setting"), F.sqrt(F.abs("value")).alias("score"), (F.col("event_id") % 50).alias("epochs"))
    return metrics.trial_summary(trials, ["setting"])


def _series(t: Tables):
    """One validation series per conversation: its turns are the epochs."""
    return t.conversations.select(F.col("conv_id").alias("trial"), (F.col("turn") + 1).alias("epoch"),
                                  (F.char_length("text") % 7 / 7).alias("score"))


_SERIES = "series AS (SELECT conv_id AS trial, turn + 1 AS epoch, length(text) % 7 / 7 AS score FROM conversations)"


def _replay(patience: int) -> str:
    return f"""evals AS (SELECT *, row_number() OVER (PARTITION BY trial ORDER BY epoch) AS step FROM series WHERE epoch % 1 = 0),
replay AS (
  SELECT trial, epoch, step, greatest(score, 0.0) AS best, CASE WHEN score >= 0 THEN 0 ELSE 1 END AS used,
         CASE WHEN score >= 0 THEN epoch END AS best_epoch, false AS stopped
  FROM evals WHERE step = 1
  UNION ALL
  SELECT e.trial, e.epoch, e.step, greatest(r.best, e.score), CASE WHEN e.score >= r.best THEN 0 WHEN r.used = {patience} THEN r.used ELSE r.used + 1 END,
         CASE WHEN e.score >= r.best THEN e.epoch ELSE r.best_epoch END, e.score < r.best AND r.used = {patience}
  FROM replay r JOIN evals e ON e.trial = r.trial AND e.step = r.step + 1 WHERE NOT r.stopped),
ended AS (SELECT * FROM replay QUALIFY row_number() OVER (PARTITION BY trial ORDER BY step DESC) = 1)"""


@query("early_stopping_replay", q.with_(_SERIES, _replay(1), """
SELECT trial, epoch AS stopped_at, stopped::INT::BIGINT AS early, epoch - used AS reported_epochs, best_epoch FROM ended"""))
def early_stopping_replay(t: Tables):
    found = metrics.early_stopping_replay(_series(t), patience=1, eval_every=1)
    return found.withColumn("early", F.col("early").cast("long"))


@query("select_best_trial_checkpoint", q.with_(_SERIES, """
SELECT trial, max(epoch) AS best_epoch, round(max(score), 9) + 0.0 AS best_score FROM (
  SELECT *, max(score) OVER (PARTITION BY trial) AS top FROM series) WHERE score = top GROUP BY trial"""))
def select_best_trial_checkpoint(t: Tables):
    return metrics.select_best_trial_checkpoint(_series(t)).withColumn("best_score", F.round("best_score", 9))


@query("train_probe")
def train_probe(t: Tables):
    rows = embeddings(t).withColumnRenamed("label", "label_id")
    return probe.train_probe(rows, "id").withColumn("accuracy", F.round("accuracy", 6))


@query("zero_shot_evaluation")
def zero_shot_evaluation(t: Tables):
    rows = embeddings(t).withColumnRenamed("label", "label_id").withColumn("lang", F.concat(F.lit("L"), F.col("id") % 4))
    return probe.zero_shot_evaluation(rows, "L0", "id")
