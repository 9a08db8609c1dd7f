"""What the physical plans must and must not contain."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import TESTDATA
from lexmesh.functions.numbering import rank_by_hash


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


NARROW = ["scan_lines", "filter_word_count", "filter_long_word", "filter_alphabet_ratio", "detokenize_punctuation", "truncate_encode",
          "align_words", "chunk_by_length", "mask_tokens", "encode_bio_tags", "label_index", "pretokenize", "conllu_text"]


@pytest.mark.parametrize("name", NARROW)
def test_row_wise_operators_do_not_shuffle_or_leave_the_jvm(spark, name):
    text = plan(entry.queries()[name](spark, TESTDATA))
    exchanges = re.findall(r"Exchange (\w+)", text)
    assert exchanges == []
    assert "Python" not in text and "Pandas" not in text


def test_scan_reads_only_the_needed_columns(spark):
    text = plan(entry.queries()["seeded_shuffle"](spark, TESTDATA))
    assert set(re.findall(r"ReadSchema: (\S+)", text)) == {"struct<doc_id:bigint,text:string>"}
    assert set(re.findall(r"ReadSchema: (\S+)", plan(entry.queries()["accuracy"](spark, TESTDATA)))) == {"struct<doc_id:bigint,text:string,lang:string>"}


def test_filters_reach_the_scan(spark):
    text = plan(entry.queries()["combine_and_resplit"](spark, TESTDATA))
    assert re.search(r"PushedFilters: \[.*lang", text) or re.search(r"DataFilters: \[.*lang", text)


def test_ranking_shuffles_the_rows_once(spark):
    df = spark.range(100).withColumn("lang", F.lit("x"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = plan(rank_by_hash(df, 1, ["id"], by=["lang"], total="n"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    side = text[text.index("SortMergeJoin"):]
    rows, offsets = side.split("row_number", 1)[1], side
    assert len(re.findall(r"Exchange hashpartitioning\(lang#\w+, _bucket", text)) <= 3
    assert "Exchange" not in text[text.index("SortMergeJoin"):text.index("row_number")]


def test_aggregations_combine_before_the_shuffle(spark):
    for name, partial in (("word_frequencies", "partial_count"), ("dedup_normalized", "partial_min"), ("category_moments", "partial_aggregate"), ("accuracy", "partial_count")):
        text = plan(entry.queries()[name](spark, TESTDATA))
        assert partial in text, (name, text)


@pytest.mark.parametrize("name", ["bio_instances", "parse_bio", "read_ner_json"])
def test_sentences_are_shuffled_as_text(spark, name):
    text = plan(entry.queries()[name](spark, TESTDATA))
    assert "collect_list(line" in text and "collect_list(struct" not in text
