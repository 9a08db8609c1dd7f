"""Sinks as round trips: write the dataset to a fresh shared folder, read it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmesh.operators import embed, sampling, split
from lexmesh.plans import corpus_queries, embed_queries  # noqa: F401  (their SQL is reused)
from lexmesh.plans import sqltext as q
from lexmesh.plans import tagged_queries, vocab_queries
from lexmesh.plans.bindings import LINE_KEY, dims, lines, long_form, new_vocab
from lexmesh.plans.registry import ORACLES, Tables, query
from lexmesh.session import scratch_folder
from lexmesh.sinks import writers
from lexmesh.sources import corpus, tagged


def _numbered(t: Tables):
    return lines(t).select("doc_id", "line_no", "line")


@query("write_lines", q.with_(q.LINES, "SELECT line, count(*) AS n FROM lines GROUP BY line"))
def write_lines(t: Tables):
    path = scratch_folder(t.spark, "lines")
    writers.write_lines(_numbered(t), path, LINE_KEY)
    return corpus.scan_lines(t.spark, path).groupBy("line").agg(F.count(F.lit(1)).alias("n"))


@query("write_shards", "SELECT shard_id, line, count(*) AS n FROM (" + ORACLES["make_shards"].replace("SELECT doc_id, line_no, CASE", "SELECT line, CASE") + ") GROUP BY ALL")
def write_shards(t: Tables):
    path = scratch_folder(t.spark, "shards")
    writers.write_shards(split.make_shards(_numbered(t), 7, LINE_KEY), path, LINE_KEY)
    found = t.spark.read.schema("value string, shard_id long").text(path)
    return found.groupBy("shard_id", F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


@query("write_splits", f"SELECT split, line, count(*) AS n FROM ({ORACLES['split_ratio']}) GROUP BY ALL")
def write_splits(t: Tables):
    path = scratch_folder(t.spark, "splits")
    writers.write_splits(split.split_ratio(_numbered(t), LINE_KEY, 0.8, 0.1), path, LINE_KEY)
    found = t.spark.read.schema("value string, split string").text(path)
    return found.groupBy("split", F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


@query("write_conllu", q.with_(q.DOCLINES, tagged_queries._CONLLU, """
SELECT word, upos, count(*) AS n FROM (SELECT unnest(words) AS word, unnest(tags) AS upos FROM rows_) GROUP BY word, upos"""))
def write_conllu(t: Tables):
    path = scratch_folder(t.spark, "conllu")
    writers.write_conllu(split.group_sentences(tagged_queries.conllu_lines(t)), path, compression="gzip")
    return tagged.parse_conllu(tagged.read_conllu(t.spark, path)).groupBy("word", "upos").agg(F.count(F.lit(1)).alias("n"))


@query("write_ner_json", q.with_(q.LINES, q.TOKENS, q.BIO, tagged_queries._INSTANCES,
                                 "SELECT tokens, ner_tags, langs, spans, count(*) AS n FROM instances GROUP BY ALL"))
def write_ner_json(t: Tables):
    path = scratch_folder(t.spark, "ner")
    writers.write_ner_json(tagged_queries.instances(t), path)
    found = tagged.read_ner_json(t.spark, path)
    flat = found.select(F.array_join("tokens", " ").alias("tokens"), F.array_join(F.transform("ner_tags", lambda x: x.cast("string")), " ").alias("ner_tags"),
                        F.array_join("langs", " ").alias("langs"), F.array_join("spans", "|").alias("spans"))
    return flat.groupBy(*flat.columns).agg(F.count(F.lit(1)).alias("n"))


@query("write_token_counts", ORACLES["token_language_counts"])
def write_token_counts(t: Tables):
    """The wide table as rows again: a column for each language is not known when the SQL is written."""
    path = scratch_folder(t.spark, "counts")
    languages = sorted(r["lang"] for r in lines(t).select("lang").distinct().collect())  # one entry per language
    writers.write_token_counts(vocab_queries.token_language_counts(t), path, languages)
    wide = t.spark.read.option("header", True).schema(", ".join(["token string", *(f"`{x}` long" for x in languages)])).csv(path)
    return wide.unpivot(["token"], languages, "lang", "n")


@query("write_composition", ORACLES["language_composition"])
def write_composition(t: Tables):
    path = scratch_folder(t.spark, "composition")
    writers.write_composition(sampling.language_composition(lines(t)), path)
    found = t.spark.read.option("header", True).schema("lang string, lines long, proportion double").csv(path)
    return found.withColumn("proportion", F.round("proportion", 9))


@query("write_embeddings", "SELECT id, dim, value FROM (" + ORACLES["init_random"] + ")")
def write_embeddings(t: Tables):
    path = scratch_folder(t.spark, "matrix")
    writers.write_embeddings(embed.init_random(new_vocab(t), dims(t)), path)
    return long_form(t.spark.read.parquet(path))
