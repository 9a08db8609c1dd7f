"""The dealt operators as queries over whole tables. SQL is in ``sqltext``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lexmesh.llm import collocations, decontaminate, divergence, html_text, jaccard_join, language, line_dedup, nearest, packing, pieces, secrets, substring_dedup, warc
from lexmesh.llm.storage import small_batches
from lexmesh.session import scratch_folder

SENTENCEPIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Documents (by doc_id) and pages (by page_id) as one set of records: pages alone have addresses and markup."""
    records = language.document_records(_table(spark, folder, "documents")).unionByName(language.page_records(_table(spark, folder, "pages")))
    return language.identify(records, ["doc_id", "page_id"])


def op2_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _table(spark, folder, "embeddings")
    return nearest.nearest(vectors, vectors.filter("vec_id % 20 = 0"))


def op3_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.find_secrets(_table(spark, folder, "documents"))


def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, folder, "documents"), _table(spark, folder, "benchmark")).drop("row")


def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.drop_repeated_lines(_table(spark, folder, "documents"), keep_text=False)


def op6_sentencepiece(spark: SparkSession, folder: str, model: str = SENTENCEPIECE_MODEL) -> DataFrame:
    return pieces.encode(_table(spark, folder, "documents"), model, keep_ids=False)


def op7_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.remove_repeated_windows(_table(spark, folder, "documents"), keep_text=False)


def op8_warc(spark: SparkSession, folder: str) -> DataFrame:
    archive = scratch_folder(spark, "warc")
    warc.write_archives(_table(spark, folder, "pages"), archive)
    return warc.read_archives(spark, archive)


def op9_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.jaccard_components(_table(spark, folder, "documents")).drop("row")


def op10_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract_text(_table(spark, folder, "pages"))


def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(_table(spark, folder, "documents"))


def op12_packing(spark: SparkSession, folder: str, tokenizer: str | None = None) -> DataFrame:
    return packing.pack(_table(spark, folder, "documents"), tokenizer or public_tokenizers.path("word_bpe_49k.json"))


def op13_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.source_divergence(_table(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_nearest_neighbours, op3_secret_scan, op4_decontamination, op5_line_dedup, op6_sentencepiece, op7_substring_dedup, op8_warc, op9_jaccard_join, op10_html_text, op11_collocations, op12_packing, op13_source_divergence)}
